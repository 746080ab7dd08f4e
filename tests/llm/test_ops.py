"""Operators against brute force, exact round trips and held-out accuracy; edge cases of every operator."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, media, minhash, packing, sharding, suffixes, urls, vectors, warc
from tessera.llm._common import components

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 3000
EDGE = [(1, None), (2, ""), (3, "word"), (4, "Word word"), (5, "word"), (5, "word"), (None, "one two three four five six"), (6, "one two three four five six"), (7, LONG), (8, "!!! 123 ..."), (9, "aé日本\u0301 x\t\n  y"), (10, LONG + "end")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for c in ("key", "id", "data", "n", "_h", "_p", "m", "h", "shard", "slot", "lang", "size", "length", "count"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


def brute_repeats(texts, width=200):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_near(rows, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                n = len(a & sets[j])
                if den * n >= num * (len(a) + len(sets[j]) - n):
                    x, y = find(rows[i][0]), find(rows[j][0])
                    root[max(x, y)] = min(x, y)
    return [(i, len(s), i if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for i in range(300)}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: r for i, r in root.items() if i != r} == got


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 2), (60, 1), (500, 3), (2000, 2), (2000, 256)):
        x, want = rng.integers(0, letters, n).astype(np.uint8), rng.random(n) < 0.6
        full = sorted(range(n), key=lambda i: bytes(x[i:]))
        assert [i for i in full if want[i]] == suffixes.suffix_order(x, want, 4000).tolist()


def test_spans(spark, docs, edge, empty):
    period = "abcdefgh" * 60
    rows = [*docs.items(), (9001, period), (9002, "x" * 900), (9003, LONG), (9004, LONG), (9005, None)]
    got = suffixes.spans(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows])
    same([tuple(r) for r in got], [(i, *w) for (i, _), w in zip(rows, want, strict=True)])
    want = brute_repeats([(t or "").encode() for _, t in EDGE])
    same([tuple(r) for r in suffixes.spans(edge).collect()], [(i, *w) for (i, _), w in zip(EDGE, want, strict=True)])
    assert suffixes.spans(empty).count() == 0


def test_spans_hot_minimizer(spark, monkeypatch):
    """A phrase shorter than the window in all texts: its group is dealt into sub-groups and loses nothing."""
    monkeypatch.setattr(suffixes, "GROUP", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    phrase = "this very common line stands in each of these texts, word for word as it is"
    rows = [(i, word() + phrase + word()) for i in range(60)] + [(100 + i, "p" * 50 + phrase + "q" * 200 + word()) for i in range(5)]
    want = brute_repeats([t.encode() for _, t in rows])
    same([tuple(r) for r in suffixes.spans(spark.createDataFrame(rows, SCHEMA)).collect()], [(i, *w) for (i, _), w in zip(rows, want, strict=True)])


def test_spans_hot_passage_in_other_surroundings(spark, monkeypatch):
    """A passage longer than the window in all texts, and one that only two texts hold, perhaps in different chunks."""
    monkeypatch.setattr(suffixes, "GROUP", 4)
    rng = random.Random(5)
    word = lambda n=150: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, phrase = word(330), "this very common line stands in each of these texts, word for word as it is"
    rows = [(i, word() + hot + word()) for i in range(60)]
    for i in range(100, 140, 2):
        twin = word(70) + phrase + word(70)
        rows += [(i, word() + twin + word()), (i + 1, word() + twin + word())]
    want = brute_repeats([t.encode() for _, t in rows])
    assert sum(w[1] > 0 for w in want) == 100
    same([tuple(r) for r in suffixes.spans(spark.createDataFrame(rows, SCHEMA)).collect()], [(i, *w) for (i, _), w in zip(rows, want, strict=True)])


@pytest.mark.parametrize("num", [80, 85])
def test_near_duplicates(spark, docs, edge, empty, num):
    rows = list(docs.items())
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), num=num).collect()
    same([tuple(r)[:3] for r in got], brute_near(rows, num, 100))
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    same([tuple(r)[:3] for r in minhash.near_duplicates(edge, num=num).collect()], brute_near(EDGE, num, 100))
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = base.copy()
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    same([tuple(r)[:3] for r in got], brute_near(rows, 85, 100))


def test_near_duplicates_across_chunks_of_a_star(spark, monkeypatch):
    """A family at about 0.8 of which pairs are closer: no link is lost across the chunks of its centre."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)

    def edit(words, k):
        at = set(rng.sample(range(len(words)), k))
        return [f"x{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]

    base, docs = [f"w{i}" for i in range(400)], {}
    for i in range(60):
        own = edit(base, 5)
        docs[2 * i], docs[2 * i + 1] = " ".join(own), " ".join(edit(own, 4))
    got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t in docs.items()}
    want = {i: i for i in docs}
    for i in docs:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_common_sizes():
    rng = np.random.Generator(np.random.PCG64(1))
    xs = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 200, 90)]
    ys = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (70, 1, 250)]
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert minhash.common_sizes(xs, ys, 16).tolist() == minhash.common_sizes(xs, ys).tolist() == want
    assert minhash.common_sizes([], ys).shape == (0, 3)


def test_sharding(spark, docs, edge, empty):
    rows = list(docs.items()) * 3
    for part in (20_000, 50):
        got = sharding.shuffle_into_shards(spark.createDataFrame(rows, SCHEMA), 16, part_rows=part).collect()
        same([(r.doc_id, r.text) for r in got], rows)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    got = sharding.shuffle_into_shards(edge, 3).collect()
    same([(r.doc_id, r.text, r._h, r.key) for r in got], [(*r, "x", "x") for r in EDGE])
    assert sharding.shuffle_into_shards(empty, 4).count() == 0
    same_row = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one").alias("text"))
    got = sharding.shuffle_into_shards(same_row, 4, part_rows=50).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(250)]
    draw = lambda seed: np.array([sharding.matrix_row(p, np.cumsum([5, 0, 7]), np.array([4, 3, 5]), seed) for p in range(3)])
    for m in map(draw, range(20)):
        assert m.sum(1).tolist() == [5, 0, 7] and m.sum(0).tolist() == [4, 3, 5]


def test_sharding_is_uniform(spark):
    """Chi-square of partition-to-shard counts and of pairs of rows that were neighbours, over many seeds, against the exact expectation."""
    cells, n = np.zeros((3, 3)), 3000
    ends, blocks = np.cumsum([6, 3, 9]), np.array([6, 6, 6])
    for seed in range(n):
        cells += [sharding.matrix_row(p, ends, blocks, seed) for p in range(3)]
    mean = n * np.array([[2.0] * 3, [1.0] * 3, [3.0] * 3])
    assert (np.abs(cells - mean) < 5 * np.sqrt(mean)).all()
    df, hits = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).cache(), np.zeros((4, 4))
    for seed in range(12):
        at = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(df, 4, seed, part_rows=40).collect()}
        for i in range(0, 400, 2):
            hits[at[i], at[i + 1]] += 1
    chi = ((hits - 150) ** 2 / 150).sum()
    assert chi < 40  # 15 degrees of freedom: about one in 2000 by chance


def test_draws_beyond_what_numpy_makes():
    rng = np.random.default_rng(3)
    colors = np.array([10**9, 3 * 10**9, 5, 0], np.int64)
    for n in (0, 7, 10**9, int(colors.sum())):
        got = sharding._drawn(rng, colors, n)
        assert got.sum() == n and (got <= colors).all() and (got >= 0).all()


def test_bpe(spark, docs, edge, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, rows in ((spark.createDataFrame(list(docs.items()), SCHEMA), list(docs.items())), (edge, EDGE)):
        want = []
        for i, t in rows:
            ids = enc.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        same([tuple(r) for r in bpe.encode(df, path, P.PATTERN, with_ids=False).collect()], want)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    c, rng = bpe.codec(path, P.PATTERN), random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice(["a", "é", "the", "ing", " ", "\n", "9", "日本", "x" * rng.randint(1, 400), "!?", "\u0301"]) for _ in range(rng.randint(0, 150)))
        ids = next(c.encode([s]))
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(s) and c.decode(ids) == s.encode()


def test_packing(spark, docs, edge, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for df, rows in ((spark.createDataFrame(list(docs.items()), SCHEMA), list(docs.items())), (edge, EDGE)):
        got = packing.pack(packing.pieces_of(df, path)).collect()
        want = []
        for i, t in rows:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
        same([tuple(r)[:5] for r in got], want)
        seqs = collections.defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
        for places in seqs.values():
            end = 0
            for o, n in sorted(places):
                assert o == end
                end += n
            assert end <= 2048
        assert sorted(seqs) == list(range(len(seqs)))
        assert len(seqs) <= 1.02 * sum(r.length for r in got) / 2048 + 1  # padding under 2 %
    other = packing.WordCache(path)
    other.by_word = False
    texts = [(t or "").encode() for _, t in EDGE]
    assert list(other.ids(texts)) == list(packing.WordCache(path).ids(texts))
    assert packing.pack(packing.pieces_of(empty, path)).count() == 0


def test_words_apart_are_words_together():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(4)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    cache = packing.WordCache(path)
    bits = ["a", "É", "ß", "İ", "Σ", "ſ", "'s", "don't", "H\u0331", "e\u0301", "...", "!?", "x,", "12", "<|endoftext|>", "日本", "\u00a0", " ", "\n", "\u2003", "ª", "µ", "A\u030a", "IT'S"]
    for _ in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(next(cache.ids([s.encode()])), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_files_of_another_make_take_whole_texts():
    import json

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = json.load(f)
    assert packing.cuts_words(own) and not packing.cuts_words({**own, "normalizer": None})
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not packing.cuts_words(json.load(f))


def test_patterns_hold_every_length():
    rng = random.Random(6)
    hist = collections.Counter(rng.randint(1, 64) for _ in range(500))
    packs = packing.patterns(hist, 64)
    used = collections.Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == hist


def test_langid(spark, edge, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(df, *langid.fit(df), keep=("lang",)).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    out = [r for r in got if r.out]
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    none = {(r.doc_id, r.lang_pred) for r in langid.predict(edge, *langid.fit(df)).collect()}
    assert {(1, "und"), (2, "und"), (8, "und")} <= none and (3, "und") not in none
    rng, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyz    "
    junk = [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((60, 200, 1000, 5000) * 5)] + [(90, "x" * 500), (91, "это русский текст о кошке и собаке " * 5)]
    low = langid.predict(spark.createDataFrame(junk, SCHEMA), *langid.fit(df)).collect()
    assert max(r.score for r in low) < 0.05 < min(r.score for r in got if r.lang_pred != "und")
    assert {r.lang_pred for r in low} <= {"de", "en", "es", "fr"}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "MAX_LANGS", 3)
        with pytest.raises(ValueError):
            langid.sample(df)
    assert langid.fit(empty) == ([], None) and langid.predict(empty, [], None).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, [], None).collect()} == {"und"}


def test_langid_sees_across_words_and_cuts_texts_without_loss():
    net = langid.BiGru(4, 4)
    text = b"Eins zwei, drei " * 40
    data, offs = np.frombuffer(text + b"abc" + text[:7], np.uint8), np.array([0, len(text), len(text), len(text) + 3, len(text) + 10])
    got = langid.text_sums(net, data, offs)
    assert got[:, -1].tolist() == [len(re.findall(rb"[A-Za-z]", t)) for t in (text, b"", b"abc", text[:7])]
    who, first, last, low, high = langid.spans_of(offs, 32, 16)
    covered = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
    assert sorted(covered.tolist()) == list(range(len(data))) and (first - low <= 16).all() and (low >= offs[who]).all() and (high <= offs[who + 1]).all()
    x, live = np.frombuffer(b"abc dea bc  bcd e cc", np.uint8).reshape(4, 5), np.arange(5) < np.array([[5], [3], [1], [4]])
    assert np.allclose(net.label(x, live).transpose(1, 0, 2)[live], net.probs(x, live.astype(np.float32))[0][live], atol=1e-5)
    a, b = (langid.text_sums(net, np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (b"aaa bbb ccc", b"zzz bbb ccc"))
    x, y = (net.probs(np.frombuffer(t, np.uint8)[None], np.ones((1, 11), np.float32))[0][0, 4:7] for t in (b"aaa bbb ccc", b"zzz bbb ccc"))
    assert not np.allclose(x, y) and not np.allclose(a, b)  # the labels of a word depend on the words before it


def test_gradients():
    net, rng = langid.BiGru(3, 4), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = rng.integers(97, 105, (5, 6)).astype(np.uint8), (np.arange(6) < np.array([[6], [3], [1], [4], [6]])).astype(np.float64)
    lab = np.array([0, 1, 2, 0, 1])
    loss = lambda: -(np.log(net.probs(x, live)[0][np.arange(5), :, lab]) * live).sum() / live.sum()
    grads = net.grads(x, live, lab)
    for name in ("Ef", "Uf", "Vb", "Ob", "c", "Eb"):
        flat = net.p[name].reshape(-1)
        at = int(np.abs(grads[name]).argmax())
        old, eps = flat[at], 1e-3
        flat[at] = old + eps
        up = loss()
        flat[at] = old - eps
        down = loss()
        flat[at] = old
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[at]) < 2e-3


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7x?q#f"), (4, "https://x.com/en/1"), (5, "http://com/en/"), (6, "http://example.net/de/8"), (7, "http://m.example.net/de/9#t"), (8, "ftp://q.org/es/"), (9, "http://welcom/en/1"), (10, "a://b://c/d"), (10, "a://b://c/d"), (11, "http://www.cheap-pills.example.org/fr/3"), (12, "http://museum.example.net/fr/3"), (13, "x://ÀB?y"), (14, "http://한국.kr/가나다라"), (15, "http://x.kr/😀😀😀😀😀"), (16, "http://blog.poker-stars.example.com/fr/1"), (17, "http://www.zumbalo.example.com/fr/1"), (18, "http://city-museums.example.net/fr/1")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(5)), urls.train(spark)).collect()}
    say = lambda i: tuple(got[i][c] for c in ("host", "path", "rule", "verdict"))
    assert say(1)[:3] == say(2)[:3] == ("", "", None)
    assert say(3) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert say(4)[2:] == say(5)[2:] == ("com/en/", "block")
    assert say(6)[2:] == ("example.net/de/8", "block") and say(7)[2:] == ("net/de/", "allow") and say(8)[2:] == ("org/es/", "block")
    assert say(9)[2] is None and say(10)[:2] == ("b:", "//c/d")
    assert say(11)[3] == "block" and say(12)[3] == "allow" and say(13)[0] == "Àb"
    assert say(14)[:2] == ("한국.kr", "/가나다라") and say(14)[3] == say(15)[3] == "allow"
    assert [say(i)[3] for i in (16, 17, 18)] == ["block", "allow", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.train(spark)).count() == 0


def test_urls_of_words_that_the_table_does_not_hold():
    """Fitted without a quarter of the words: hosts of unseen words to be allowed stay; known words to be blocked are found in forms that the table lacks."""
    score = lambda w, u: w[-1] + np.mean([w[k] for k in urls.plain_grams(u)])
    wrong, all_ = 0, 0
    for r in range(4):
        keep = lambda words, r=r: [x for i, x in enumerate(words) if i % 4 != r]
        w = urls.fit([(urls.plain_grams(u), y) for u, y in urls.labelled(keep(urls.BLOCK_WORDS), keep(urls.ALLOW_WORDS))])
        unseen = urls.labelled([], [x for i, x in enumerate(urls.ALLOW_WORDS) if i % 4 == r])
        wrong, all_ = wrong + sum(score(w, u) >= 0 for u, _ in unseen), all_ + len(unseen)
    assert wrong / all_ < 0.05
    w = urls.fit([(urls.plain_grams(u), y) for u, y in urls.LABELLED])
    assert np.mean([score(w, f"https://{form.format(x)}.example.net/fr/77") >= 0 for x in urls.BLOCK_WORDS for form in ("big-{}", "best{}", "{}zone")]) > 0.85
    assert not {x.split("//")[1].split("/")[0].split(".example")[0].split(".")[-1] for x, _ in urls.LABELLED} & {"cheap-pills", "free-bets", "spam-farm", "casino-win", "adult-x", "ads-track"}


def test_warc(spark, tmp_path):
    magic = "\x1f\x8b\x08 WARC/1.1\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", None), (4, None, ""), (5, "u", magic * 50), (6, "u", "big " * 400_000), (7, "é\r\nX: y", "ü"), (8, "u", "same"), (8, "u", "same"), (None, "n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("data", F.lit(1))
    want, last = [], {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        b = (h or "").encode()
        first = last[h or ""] == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]))
    files = warc.write(df, str(tmp_path / "a"))
    for size in (warc.RANGE, 777):  # ranges much smaller than records
        got = warc.read(files, size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        same([tuple(r) for r in got], want)
    assert {(r.payload or b"").decode() for r in warc.read(files).where("record_type = 'response'").collect()} == {r[2] or "" for r in rows}
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "b"))).count() == 0
    light = warc.read(warc.write(df, str(tmp_path / "c"), min_bytes=5)).select("page_id", "record_type", "refers_to").collect()
    same([tuple(r) for r in light], [(i, "response", None) for i, *_ in rows])
    import gzip
    from pathlib import Path

    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "a").glob("*.warc.gz"))
    named = set(re.findall(rb"WARC-Record-ID: (\S+)", text))
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", text)) <= named


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 16))
    near = np.concatenate([base[:60] + rng.normal(size=(60, 16)) * s for s in (0.05, 0.2, 0.35)])
    x = np.concatenate([base, near, base[:30] * 2, np.repeat(base[:1], 20, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [float("nan")] * 16), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (None, x[0].tolist())]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("w", F.lit(1))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T >= 0.9
    np.fill_diagonal(sim, False)
    lab = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(lab[i], lab[s].min(initial=len(x))) for i, s in enumerate(sim)])
        if (new == lab).all():
            break
        lab = new
    total, found = sim.sum(), sum(got[i].n_links for i in range(len(x)))
    assert found <= total and found / total >= 0.98
    assert np.mean([got[i].component_id == lab[i] for i in range(len(x))]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002, 9003, 9004, None))
    assert got[9005].n_links == got[9006].n_links == 1 and got[9006].component_id == 9005
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def links_of(x):
    """(links, component) of each row, by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T >= 0.9
    np.fill_diagonal(sim, False)
    lab = np.arange(len(x))
    while True:
        new = np.array([min(lab[i], lab[s].min(initial=len(x))) for i, s in enumerate(sim)])
        new = new[new]
        if (new == lab).all():
            return sim.sum(1), lab
        lab = new


def vector_rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("cap", [50, 4096])
def test_vectors_dense_groups(spark, monkeypatch, cap):
    """Groups that no pair is formed for, rows near enough to reach into them, and a group too wide for a ball: exact."""
    monkeypatch.setattr(vectors, "SHARD_CAP", cap)
    rng = np.random.default_rng(8)
    mid = rng.normal(size=(3, 24))
    mid[1] = mid[0] + rng.normal(size=24) * 0.42  # two balls whose members partly link
    x = np.concatenate([mid[0] + rng.normal(size=(150, 24)) * 0.05, mid[1] + rng.normal(size=(120, 24)) * 0.05, mid[0] + rng.normal(size=(60, 24)) * rng.uniform(0.2, 0.6, (60, 1)), mid[2] + rng.normal(size=(90, 24)) * 0.3, rng.normal(size=(200, 24))])
    x = x[rng.permutation(len(x))]
    got = {r.vec_id: r for r in vectors.near_vectors(vector_rows(spark, x)).collect()}
    links, lab = links_of(x)
    assert len(vectors.pivots(vectors.unit(x), 0.9)) >= 2
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == lab.tolist()


def test_vectors_group_beside_sparse_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 16)
    monkeypatch.setattr(vectors, "GROUP", 10**6)  # no balls: the graph has to find all
    rng = np.random.default_rng(11)
    a = rng.normal(size=(500, 32))
    away = rng.normal(size=a.shape)
    x = np.concatenate([a, a + 0.4 * away, rng.normal(size=(1, 32)) + rng.normal(size=(500, 32)) * 0.1])
    got = {r.vec_id: r for r in vectors.near_vectors(vector_rows(spark, x)).collect()}
    links, lab = links_of(x)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= links).all() and have.sum() >= 0.98 * links.sum()
    some = links[:1000] > 0
    assert some.sum() > 100 and (have[:1000][some] / links[:1000][some]).mean() >= 0.98


def test_vectors_ids_shared_by_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (2, [0.01, 1.0]), (-3, [-1.0, 0.0]), (-3, [-1.0, 0.01])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(-3, 1, -3), (-3, 1, -3), (1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_vectors_at_twenty_thousand(spark):
    """Planted pairs among random vectors, too few to tell the audit much: recall against brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(300, 64))
    away -= (away * x[:300]).sum(1, keepdims=True) * x[:300]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, (300, 1))
    x[10_000:10_300] = c * x[:300] + np.sqrt(1 - c * c) * away
    got = {r.vec_id: r for r in vectors.near_vectors(vector_rows(spark, x)).collect()}
    assert np.mean([got[i].n_links == 1 and got[10_000 + i].component_id == i for i in range(300)]) >= 0.97
    assert sum(r.n_links for r in got.values()) <= 600


def test_vectors_audit_sees_lost_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 64))
    x = np.concatenate([a, a + rng.normal(size=a.shape) * 0.1, a[:1] + rng.normal(size=(200, 64)) * 0.01])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "cid long, v array<double>, w long")
    found = spark.createDataFrame([(i, int(n)) for i, n in enumerate(links) if n > 1], "cid long, links long")  # the pairs are lost
    assert np.ravel(vectors.audit(classes, found, 0.9))[0] < 0.1


def test_vectors_probes_hold_planted_pairs():
    rng = np.random.default_rng(10)
    x = vectors.unit(rng.normal(size=(6000, 64)))
    cent = vectors.kmeans(x[:4000], 100)
    p = vectors.probes_needed(cent, x[4000:], 0.9)
    noise = rng.normal(size=(2000, 64))
    noise -= (noise * x[4000:]).sum(1, keepdims=True) * x[4000:]
    y = 0.905 * x[4000:] + np.sqrt(1 - 0.905**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    near = [np.argsort(-(z @ cent.T), axis=1)[:, :p] for z in (x[4000:], y)]
    assert 2 < p < 30 and np.mean([len({*i} & {*j}) > 0 for i, j in zip(*near, strict=True)]) >= 0.98


def pgm(x):
    x = np.clip(x, 0, 255).astype(np.uint8)
    return f"P5 {x.shape[1]} {x.shape[0]} 255\n".encode() + x.tobytes()


def png(x):
    import struct

    x = np.clip(x, 0, 255).astype(np.uint8)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\x00" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_media(spark):
    rng = np.random.default_rng(0)
    base = [np.kron(rng.integers(0, 256, (12, 12)), np.ones((10, 10))) for _ in range(20)]
    edits = [lambda x: x[11:111, 5:105], lambda x: x * 0.7 + 30, lambda x: x + rng.normal(0, 5, x.shape), np.rot90]
    rows = [(i, pgm(x)) for i, x in enumerate(base)] + [(100 + i, pgm(edits[i % 4](x))) for i, x in enumerate(base)]
    rows += [(200, None), (201, b"junk"), (202, b""), (203, png(base[0])), (203, png(base[0])), (None, pgm(base[0])), (204, pgm(np.zeros((40, 40))))]
    broken = bytearray(png(base[1]))
    broken[60] ^= 255
    rows += [(300 + i, x) for i, x in enumerate((png(base[0])[:40], png(base[0])[:9], bytes(broken), b"P5 0 0 255\n", b"P5 99999999 99999999 255\n", png(base[0])[:-60]))]
    got = media.near_copies(spark.createDataFrame(rows, "id long, media binary").withColumn("key", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("kps", F.lit(1))).collect()
    by = {r.id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[100 + i].component_id == i for i in range(20))
    assert all(by[i].component_id == i and by[i].kept for i in range(20))
    assert by[203].component_id == 0 and all(by[i].n_keypoints == 0 and by[i].kept for i in (200, 201, 202, 204, 300, 301, 303, 304))
    assert media.near_copies(spark.createDataFrame([], "id long, media binary")).count() == 0


@pytest.mark.parametrize("exact", [media.EXACT, 0])
def test_media_links_of_groups(spark, exact):
    """Every row's links and component against brute force: near copies beside each other, exact copies, an id of two images."""
    rng = np.random.default_rng(8)
    base = [media.decode(x) for x in media.render(rng.normal(size=(12, 64)))]
    rows = [(i, pgm(x)) for i, x in enumerate(base)]
    rows += [(100 + i, pgm(base[0] + rng.normal(0, 4, base[0].shape))) for i in range(15)] + [(200, rows[0][1]), (7, pgm(base[11] + 9)), (2, rows[3][1])]
    told = [media.describe(media.decode(x)[None])[0] for _, x in rows]
    n = len(rows)
    near = np.array([[rows[i][1] == rows[j][1] or media.agree(*told[i], *told[j]) for j in range(n)] for i in range(n)])
    own = np.array([[rows[i][0] == rows[j][0] for j in range(n)] for i in range(n)])
    root = np.arange(n)
    for _ in range(n):
        root = np.where(near | own, root, n).min(1)
    least = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in set(root)}
    got = media.near_copies(spark.createDataFrame(rows, "id long, media binary"), exact=exact).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == sorted((rows[i][0], int(near[i].sum()) - 1, least[root[i]]) for i in range(n))


def test_media_candidates_of_larger_tables(spark):
    """Keys tell what they do among all images, whatever block holds them; unrelated candidates are a smaller share of more images, edited copies stay."""
    rng, share = np.random.default_rng(3), {}
    images = [media.decode(x) for x in media.render(rng.normal(size=(6000, 64)))]
    edited = [np.clip(x + rng.normal(0, 10, x.shape), 0, 255).astype(np.uint8).astype(np.float32) for x in images[:100]]
    told = [d for lo in range(0, 6100, 50) for d in media.describe(np.stack((images + edited)[lo : lo + 50]))]
    copies = [i for i in range(100) if media.agree(*told[i], *told[6000 + i])]
    assert len(copies) > 90
    keys = [np.unique(media.table_keys(d, media.WIDTH).view(np.uint64) & np.uint64(0xFFFFFFFF)) for _, d in told]
    for n in (1500, 6000):
        ids = [*range(n), *range(6000, 6100)]
        rows = spark.createDataFrame([(i % 4, i, told[i][1].tobytes()) for i in ids], "block long, node long, descs binary")
        _, at, held = np.unique(np.concatenate([keys[i] for i in ids]), return_inverse=True, return_counts=True)
        owner = np.repeat(ids, [len(keys[i]) for i in ids])
        bits = np.rint(8 * np.maximum(media.LEAST, np.log2(len(ids) / held)))[at]
        some = held[at] > 1
        want = collections.Counter(zip((owner[some] % 4).tolist(), owner[some].tolist(), np.concatenate([keys[i] for i in ids])[some].tolist(), bits[some].tolist(), strict=True))
        got = collections.Counter()
        for r in media._rarity(rows, len(ids), 3).collect():
            for x in r.keyed:
                parts = (np.frombuffer(x[c], t).tolist() for c, t in (("nodes", np.int64), ("keys", np.uint32), ("told", np.uint8)))
                got.update((r.block, *row) for row in zip(*parts, strict=True))
        assert got == want
        # Two blocks: the images, and their edited copies with others.
        blocks, z = [], np.zeros(1000, np.int64)
        for held_by in (range(1000), [*range(500, 1400), *range(6000, 6100)]):
            place = {i: k for k, i in enumerate(held_by)}
            keyed = sorted((key << 32 | place[node], eighths) for _, node, key, eighths in want if node in place)
            blocks.append(media.Block(z, z, z, z, None, None, np.array([k for k, _ in keyed], np.uint64), np.array([t for _, t in keyed], np.uint8)))
        some = media.shared_bits(*blocks) >= media.least_bits(len(ids))
        assert np.mean([some[i, 900 + i] for i in copies]) >= 0.98
        share[n] = some[:500, :900].mean()
    assert share[6000] < 0.85 * share[1500]


def test_media_png_filters():
    """Each line filter against pixels made forwards."""
    import struct

    rng = np.random.default_rng(2)
    for planes, color in ((1, 0), (3, 2)):
        px, body, w = rng.integers(0, 256, (10, 12 * planes)), b"", 12 * planes
        for y, row in enumerate(px):
            up = px[y - 1] if y else np.zeros(w, int)
            left = np.concatenate([np.zeros(planes, int), row[:-planes]])
            corner = np.concatenate([np.zeros(planes, int), up[:-planes]])
            p = left + up - corner
            near = np.stack([np.abs(p - left), np.abs(p - up), np.abs(p - corner)]).argmin(0)
            kind = y % 5
            guess = [0 * row, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
            body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + b"0000"
        data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 12, 10, 8, color, 0, 0, 0)) + part(b"IDAT", zlib.compress(body))
        assert np.allclose(media.decode(data), px.reshape(10, 12, planes).mean(2))


def test_media_recall_among_twenty_thousand(spark):
    """Edited copies among 20,000 images against brute force: every edited pair that the confirmation links, so recall of the tables and stars."""
    rng = np.random.default_rng(1)
    edits = [lambda x: x * 0.7 + 30, lambda x: x + rng.normal(0, 5, x.shape), np.rot90, lambda x: x[5:63, 3:61], lambda x: x[4:60, 6:62] + rng.normal(0, 3, (56, 56))]
    images, pairs = media.render(rng.normal(size=(20_000, 64))), []
    rows = list(enumerate(images))
    for i in range(200):
        rows.append((10**6 + i, pgm(edits[i % 5](media.decode(images[i])))))
        a, b = (media.describe(media.decode(x)[None])[0] for x in (images[i], rows[-1][1]))
        if media.agree(*a, *b):
            pairs.append(i)
    assert len(pairs) > 190
    got = {r.id: r for r in media.near_copies(spark.createDataFrame(rows, "id long, media binary").repartition(16)).collect()}
    assert np.mean([got[10**6 + i].component_id == i for i in pairs]) >= 0.97
    assert sum(got[i].n_links > 0 for i in range(200, 20_000)) <= 10


@pytest.mark.parametrize("part", [0.5, 0.25])
def test_media_crops_of_natural_images(part):
    """Crops to a half and to a quarter of the area, beside unrelated images of the same statistics."""
    rng, n = np.random.default_rng(4), 200

    def image():
        f = np.fft.fft2(rng.normal(size=(n, n))) / (np.hypot(np.fft.fftfreq(n)[:, None], np.fft.fftfreq(n)[None]) + 2 / n)
        x = np.real(np.fft.ifft2(f))
        return np.clip(128 + 50 * (x - x.mean()) / x.std(), 0, 255).astype(np.uint8).astype(np.float32)

    images = [image() for _ in range(10)]
    told = [media.describe(x[None])[0] for x in images]
    side = int(n * part**0.5)
    crops = [media.describe(x[None, 21 : 21 + side, 33 : 33 + side])[0] for x in images]
    assert [[media.agree(*a, *b) for b in crops] for a in told] == [[i == j for j in range(10)] for i in range(10)]
    keys = [[np.intersect1d(media.table_keys(a[1], 40), media.table_keys(b[1], 40)).size for b in crops] for a in told]
    assert all((keys[i][j] >= media.VOTES) or i != j for i in range(10) for j in range(10))
