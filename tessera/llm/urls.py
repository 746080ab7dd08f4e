"""URL filters: host and path rules, then a logistic regression on hashed character n-grams.

Features and verdicts are DataFrame expressions. The model is fitted on the driver by full-batch gradient
steps over the features of a small labelled URL table, made by rule from common words; its weights (BUCKETS
doubles) enter the scoring expression as one literal.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the model's verdict
on the bias alone (allow). Any character may stand in a url: an n-gram's code is taken modulo BUCKETS at each
step. Repeated rows are judged alike; extra columns pass through ``judge`` untouched,
and an input column named like an output is replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import read_table

BUCKETS = 4096
NGRAM = 4
STEPS = 1000
RATE = 2.0
DECAY = 1e-4
SCALE = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): the rule's host and path prefix.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Words of hosts to block and to allow; the labelled table is made from them by the forms below, 1 is to be blocked.
BLOCK_WORDS = "betting casino dating escort gambling jackpot lottery malware nude payday phishing pills poker porn replica roulette slots spam torrent viagra warez xxx".split()
ALLOW_WORDS = "archive bakery biology bridge bulletin cinema city college council daily gallery garden gazette health hospital journal kitchen library market mountain museum music nature news ocean orchestra physics poetry radio review river school science shop sport station stories theatre travel university weather wiki".split()
FORMS = ["{}", "my-{}", "{}-world", "the{}", "{}online", "{}-24"]
PREFIXES, TOPS = ["", "www.", "m.", "blog."], ["example.com", "example.org", "example.net"]
PATHS = ["/en/1", "/de/20/", "/fr/305.html", "/es/7"]


def labelled(blocked: list[str] = BLOCK_WORDS, allowed: list[str] = ALLOW_WORDS) -> list[tuple[str, int]]:
    """(url, label): each word in each form, under a sub-domain, top-level name and path that its place gives. Allowed ones twice: most hosts are to be allowed, unknown ones too."""
    out = []
    for words, y, times in ((blocked, 1, 1), (allowed, 0, 2)):
        for i, word in enumerate(words):
            for j, form in enumerate(FORMS):
                for k in range(times):
                    n = i + j + 2 * k
                    out.append((f"http://{PREFIXES[n % 4]}{form.format(word)}.{TOPS[n % 3]}{PATHS[(i + 3 * j + k) % 4]}", y))
    return out


LABELLED = labelled()


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Null or no ://: empty."""
    raw = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end. Null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram of host + path, framed by blanks."""
    text = F.concat(F.lit(" "), host, path, F.lit(" "))

    def bucket(i: Column) -> Column:
        code = F.lit(0)
        for k in range(NGRAM):  # the remainder at each step: no product leaves 32 bits, whatever the character
            code = F.pmod(code * 37 + F.ascii(F.substring(text, i + k, F.lit(1))), F.lit(BUCKETS))
        return code

    n = F.length(text) - (NGRAM - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), bucket)).otherwise(F.array().cast("array<int>"))


def _score(feats: Column, weights: Column, bias: Column) -> Column:
    total = F.aggregate(feats, F.lit(0.0), lambda s, g: s + F.element_at(weights, (g + 1).cast("int")))
    return bias + F.coalesce(total / F.greatest(F.size(feats), F.lit(1)), F.lit(0.0))


def train(spark: SparkSession, table: list[tuple[str, int]] = LABELLED) -> list[float]:
    """BUCKETS weights and the bias. DataFrame expressions make the features of the small labelled table; the driver fits them."""
    url = F.col("x.url")
    urls = F.from_json(F.lit(json.dumps([{"url": u, "y": y} for u, y in table])), "array<struct<url:string,y:double>>")
    rows = spark.range(1).select(F.explode(urls).alias("x")).select(grams(host_of(url), path_of(url)).alias("g"), F.col("x.y").alias("y")).collect()
    return fit([(r["g"], r["y"]) for r in rows])


def plain_grams(url: str) -> list[int]:
    """What ``grams`` gives for a well-formed url, in plain Python."""
    rest = url.partition("://")[2]
    text = f" {rest.split('?')[0].split('#')[0].lower()} "
    out = []
    for i in range(len(text) - NGRAM + 1):
        code = 0
        for c in text[i : i + NGRAM]:
            code = code * 37 + ord(c)
        out.append(code % BUCKETS)
    return out


def fit(rows: list[tuple[list[int], float]]) -> list[float]:
    """Logistic regression on shares of buckets, by full-batch gradient steps; BUCKETS weights and the bias."""
    x = np.zeros((len(rows), BUCKETS))
    for i, (g, _) in enumerate(rows):
        np.add.at(x[i], g, 1.0)
    x *= SCALE / np.maximum(x.sum(1, keepdims=True), 1)
    y = np.array([float(v) for _, v in rows])
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        e = y - 1 / (1 + np.exp(-(x @ w + bias)))
        w += RATE * (x.T @ e / len(y) - DECAY * w)
        bias += RATE * e.mean()
    return [*map(float, w * SCALE), float(bias)]


def judge(df: DataFrame, weights: list[float], url: str = "url", rules: list[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule and verdict. ``rules`` is a short list; the longest that fits wins."""
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    w = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    p = 1 / (1 + F.exp(-_score(grams(F.col("host"), F.col("path")), w, F.lit(weights[-1]))))
    model = F.when(p >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).withColumn("verdict", verdict.otherwise(model) if verdict is not None else model)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(spark)).select("page_id", "host", "path", "rule", "verdict")
