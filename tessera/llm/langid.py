"""Language identification by a bidirectional gated recurrent network over bytes.

A text (UTF-8 bytes, A-Z lower-cased) is read in spans of SPAN bytes, each with CONTEXT bytes more on either
side where the text has them, so the states of a position have seen at least that much of the text before
and after it, across words. Both directions label every position, and a document's probabilities are the mean
over the positions of its letters (a-z and bytes of other scripts). One more label stands for nonsense: it is
learned from training pieces whose bytes are scrambled, is never predicted, and lowers the score. Spans of similar length run together, so
little is padded, and a long text is cut into batches. Training is plain numpy: backpropagation through time
with Adam on the driver, on a bounded sample: DOCS_PER_LANG labelled documents of each language, of each
PIECES pieces of PIECE bytes at even distances over the whole text, cut out in the tasks. More labels than
MAX_LANGS are an error, none is left out.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. No labelled row at all: every
text is ``und``. A null id is held out of training and reported as not held out. Repeated rows are judged
alike; an empty table gives an empty one; extra columns are not carried by ``predict`` but for the id and
those named in ``keep``, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import buffer_of, read_table, small_batches

HIDDEN = 16
SPAN = 480
CONTEXT = 32
#: Spans that run together: so few that their products stay in a core's cache and on its thread.
ROWS = 512
#: Bounds of the training sample.
DOCS_PER_LANG = 250
PIECES, PIECE = 12, 96
MAX_LANGS = 1024
STEPS = 400
SCRAMBLED = 0.2
BATCH = 128
#: Bytes of texts in one round of a worker, about.
BUFFER = 4 << 20
UND = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGru:
    """Two gated recurrent layers (one each way) and a softmax over languages at each position."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 5):
        rng, h = np.random.Generator(np.random.PCG64(seed)), hidden
        self.h, self.p = hidden, {}
        for d in "fb":
            self.p[f"E{d}"] = (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)  # input weights, one row per byte
            self.p[f"U{d}"] = (rng.standard_normal((h, 2 * h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"V{d}"] = (rng.standard_normal((h, h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"O{d}"] = (rng.standard_normal((h, n_out)) / np.sqrt(h)).astype(np.float32)
        self.p["c"] = np.zeros(n_out, np.float32)

    def _scan(self, x: np.ndarray, live: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction: x is (rows, steps) bytes; a dead position keeps the state."""
        e, u, v, h = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"V{d}"], self.h
        state, out, tape = np.zeros((len(x), h), np.float32), np.zeros((*x.shape, h), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a = e[x[:, t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ u)
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + (r * state) @ v)
            m = live[:, t, None] * z
            tape.append((t, state, z, r, n, m))
            state = state + m * (n - state)
            out[:, t] = state
        return out, tape

    def probs(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, tf = self._scan(x, live, "f")
        b, tb = self._scan(x, live, "b")
        y = f @ self.p["Of"] + b @ self.p["Ob"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y, (f, b, tf, tb)

    def label(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The probabilities alone, by steps (steps, rows, labels): no state is kept, only what it adds to the labels."""
        h, steps, rows = self.h, x.shape[1], len(x)
        cols, y = np.ascontiguousarray(x.T), np.empty((x.shape[1], rows, len(self.p["c"])), np.float32)
        y[:] = self.p["c"]
        whole, mask = live.all(0), np.ascontiguousarray(live.T, np.float32)[:, :, None]
        half = np.full(3 * h, 0.5, np.float32)
        half[2 * h :] = 1
        a, zr, n = np.empty((rows, 3 * h), np.float32), np.empty((rows, 2 * h), np.float32), np.empty((rows, h), np.float32)
        for d in "fb":
            e, u, v, o = self.p[f"E{d}"] * half, self.p[f"U{d}"] * np.float32(0.5), self.p[f"V{d}"], self.p[f"O{d}"]
            state = np.zeros((rows, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(e, cols[t], 0, out=a, mode="clip")
                np.matmul(state, u, out=zr)
                zr += a[:, : 2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                np.matmul(zr[:, h:] * state, v, out=n)
                n += a[:, 2 * h :]
                np.tanh(n, out=n)
                n -= state
                n *= zr[:, :h]
                if not whole[t]:
                    n *= mask[t]
                state += n
                y[t] += state @ o
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def grads(self, x: np.ndarray, live: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
        y, (f, b, tf, tb) = self.probs(x, live)
        y[np.arange(len(x)), :, lang] -= 1
        dy = y * (live[:, :, None] / live.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = dy.sum((0, 1))
        h = self.h
        for d, s, tape in (("f", f, tf), ("b", b, tb)):
            g[f"O{d}"] = np.einsum("nth,ntk->hk", s, dy, optimize=True)
            into, carry = dy @ self.p[f"O{d}"].T, np.zeros((len(x), h), np.float32)
            u, v = self.p[f"U{d}"], self.p[f"V{d}"]
            for t, prev, z, r, n, m in reversed(tape):
                carry = carry + into[:, t]
                dn = carry * m * (1 - n * n)
                back = dn @ v.T
                dz = carry * live[:, t, None] * (n - prev) * z * (1 - z)
                dr = back * prev * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"U{d}"] += prev.T @ dzr
                g[f"V{d}"] += (r * prev).T @ dn
                np.add.at(g[f"E{d}"], x[:, t], np.concatenate([dzr, dn], 1))
                carry = carry * (1 - m) + back * r + dzr @ u.T
        return g


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[97:123] = True
_LETTER_BYTE[128:] = True
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def spans_of(offs: np.ndarray, span: int = SPAN, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(text, first, last, from, to) of each span of the texts of a buffer: it labels first..last and reads from..to."""
    size = np.diff(offs)
    n = -(-size // span)
    who = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    first = offs[who] + k * span
    last = np.minimum(first + span, offs[who + 1])
    return who, first, last, np.maximum(first - context, offs[who]), np.minimum(last + context, offs[who + 1])


def text_sums(net: BiGru, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text of a buffer the sums of the label probabilities over its letters, then the letters."""
    who, first, last, low, high = spans_of(offs)
    out = np.zeros((len(offs) - 1, len(net.p["c"]) + 1))
    data = np.concatenate([_LOWER[data], np.zeros(1, np.uint8)])
    order = np.argsort(high - low, kind="stable")
    for i in range(0, len(order), ROWS):
        k = order[i : i + ROWS]
        width = int((high[k] - low[k]).max())
        at = low[k][:, None] + np.arange(width)
        live = at < high[k][:, None]
        x = data[np.where(live, at, len(data) - 1)]
        y = net.label(x, live)
        mine = ((at >= first[k][:, None]) & (at < last[k][:, None]) & _LETTER_BYTE[x]).astype(np.float32)
        sums = np.einsum("tnk,nt->nk", y, mine)
        np.add.at(out, who[k], np.concatenate([sums, mine.sum(1, keepdims=True)], 1))
    return out


def scrambled(piece: bytes, rng: np.random.Generator) -> bytes:
    """A piece in no language: its bytes in another order, its letters replaced one for one, or one or two of its bytes over and over."""
    kind = rng.integers(0, 5)
    x = _LOWER[np.frombuffer(piece, np.uint8)]
    if kind < 2:
        return rng.permutation(x).tobytes()
    if kind < 4:
        table = np.arange(256, dtype=np.uint8)
        table[97:123] = rng.permutation(table[97:123])
        table[128:] = rng.permutation(table[128:])
        return table[x].tobytes()
    return rng.choice(x, max(1, len(x) // 40)).repeat(len(x))[: len(x)].tobytes()


def train(rows: list[tuple[bytes, str]], seed: int = 5) -> tuple[list[str], BiGru]:
    """Fit on (piece of a text, lang) pairs; each step takes pieces of all languages in equal shares, SCRAMBLED of them made nonsense.

    Nonsense is one more label of the network, after the languages.
    """
    langs = sorted({x for _, x in rows})
    rng = np.random.Generator(np.random.PCG64(seed))
    net, m = BiGru(len(langs) + 1, seed=seed), {}
    own = [[t for t, x in rows if x == lang] for lang in langs]
    for step in range(1, STEPS + 1):
        lab = rng.permutation(np.arange(BATCH) % len(langs)) if len(langs) <= BATCH else rng.integers(0, len(langs), BATCH)
        pieces = [own[k][rng.integers(0, len(own[k]))] for k in lab]
        for i in np.flatnonzero(rng.random(BATCH) < SCRAMBLED):
            pieces[i], lab[i] = scrambled(pieces[i], rng), len(langs)
        width = max(map(len, pieces))
        live = np.arange(width) < np.array([len(t) for t in pieces])[:, None]
        x = np.zeros(live.shape, np.uint8)
        x[live] = _LOWER[np.frombuffer(b"".join(pieces), np.uint8)]
        rate = 0.02 * (1 - 0.9 * step / STEPS)
        for name, g in net.grads(x, live.astype(np.float32), lab).items():
            a, b = m.get(name, (0, 0))
            a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
            m[name] = a, b
            net.p[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return langs, net


def sample(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = DOCS_PER_LANG) -> list[tuple[bytes, str]]:
    """Pieces of at most ``per_lang`` labelled training documents of each language, which are the first by a hash of their id."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    order = W.partitionBy(lang).orderBy(F.xxhash64(id_col), id_col)
    ids = rows.select(id_col, lang).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang).drop("_n").distinct()
    small_batches(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, parts = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                step = max(1, (len(t) - PIECE) // (PIECES - 1))
                for s in range(0, max(1, len(t) - PIECE + 1), step):
                    if len(parts_ := t[s : s + PIECE]) and has_letter(parts_):
                        who.append(i)
                        parts.append(parts_)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(parts, pa.binary())], names=["id", "lang", "piece"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    picked = picked.join(F.broadcast(ids.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))), ["id", "lang"])  # at most per_lang ids a language
    got = picked.mapInArrow(cut, f"id {kind}, lang string, piece binary").orderBy("id", "lang", "piece").collect()
    if len({r["lang"] for r in got}) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    return [(bytes(r["piece"]), r["lang"]) for r in got]


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 5 == 0


def predict(df: DataFrame, langs: list[str], net: BiGru | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of each row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            judged = [bool(t) and has_letter(t) for t in texts.to_pylist()]
            pred, score = [UND] * b.num_rows, [0.0] * b.num_rows
            size = np.cumsum([0, *(len(t) if ok else 0 for t, ok in zip(texts.to_pylist(), judged, strict=True))])
            lo = 0
            while lo < b.num_rows and net is not None:  # about BUFFER bytes at once, or one text
                hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(size, size[lo] + BUFFER, side="right")) - 1))
                some = [i for i in range(lo, hi) if judged[i]]
                if some:
                    for i, total in zip(some, text_sums(net, *buffer_of(texts.take(pa.array(some)))), strict=True):
                        best = int(total[:-2].argmax())
                        pred[i], score[i] = langs[best], min(1.0, float(total[best] / total[-1]))
                lo = hi
            cols = [b.column(0), *(b.column(2 + i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *keep, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    return df.select(id_col, text, *keep).mapInArrow(run, f"{kinds}lang_pred string, score double")


def fit(df: DataFrame) -> tuple[list[str], BiGru | None]:
    rows = sample(df)
    return train(rows) if rows else ([], None)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = predict(docs, *fit(docs))
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
