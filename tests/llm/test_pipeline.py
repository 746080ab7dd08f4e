"""The corpus pipeline, stage by stage."""

import collections
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp

sys.path.insert(0, str(Path(__file__).parent))
from test_ops import EDGE, brute_near, brute_repeats

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").unionByName(spark.createDataFrame([(*r, None, None, None) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars"))
    before = docs.select("doc_id", "text").collect()
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, D).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert collections.Counter(r.doc_id for r in docs.where("start = 0").collect()) == collections.Counter(r.doc_id for r in before)
            continue
        assert docs.columns == cp.COLUMNS
        after = docs.select("doc_id", "text").collect()
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {100001, 100002, 100008} <= gone <= {100000 + r[0] for r in EDGE if r[0]}
            assert {100007, 100010} <= gone  # a language that no document teaches
        elif name == "near_duplicates":
            want = {i for i, _, c in brute_near([tuple(r) for r in before], *cp.NEAR) if i == c}
            assert {r.doc_id for r in after} == want
        else:
            cut = brute_repeats([(r.text or "").encode() for r in before])
            left = dict(after)
            assert all(len((left[r.doc_id] or "").encode()) <= c[0] - c[1] and (c[1] > 0 or left[r.doc_id] == r.text) for r, c in zip(before, cut, strict=True) if r.doc_id is not None)
        before = after


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, D).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
