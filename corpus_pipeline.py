"""Corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Edge cases: documents without a letter are rejected by the first stage; rows that share a doc_id are one
document and go or stay together; a null doc_id is never anyone's duplicate; empty inputs give empty
outputs; columns besides those of documents are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, packing, suffixes
from tessera.llm._common import stage, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of near-duplicates: 80 of 100 shingles.
NEAR = (80, 100)
#: Least pooled probability of the predicted language. Held-out documents of the test tables score 0.12 or more, letter junk and
#: languages that no document teaches mostly 0.01 or less.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; ``lang`` stays as it came."""
    docs = docs.select(*COLUMNS)
    got = langid.predict(docs, *langid.fit(docs), keep=("text", "lang", "source", "n_chars"))
    return got.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    got = minhash.near_duplicates(docs, num=NEAR[0], den=NEAR[1])
    gone = got.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 200-byte strings met twice cover; n_chars follows."""
    cut = suffixes.spans(docs.withColumn("_null", F.col("text").isNull()), with_text=True, carry=("lang", "source", "n_chars", "_null"))
    n = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.when(~F.col("_null"), F.col("kept_text")).alias("text"), "lang", "source", n.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return packing.pack(stage(packing.pieces_of(docs, P.path("word_bpe_49k.json"), with_ids=False), "pieces"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    for k, (name, f) in enumerate(STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs


#: SQL can't express the network of the first stage; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None
