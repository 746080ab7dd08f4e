"""Queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, langid, media, minhash, oracles, packing, sharding, suffixes, urls, vectors, warc

QUERIES = {
    "op5_minhash": minhash.op5_minhash,
    "op1_media": media.op1_media,
    "op2_vectors": vectors.op2_vectors,
    "op3_suffix_array": suffixes.op3_suffix_array,
    "op4_sharding": sharding.op4_sharding,
    "op6_bpe": bpe.op6_bpe,
    "op7_packing": packing.op7_packing,
    "op8_langid": langid.op8_langid,
    "op9_url_filter": urls.op9_url_filter,
    "op10_warc": warc.op10_warc,
}
ORACLE_SQL: dict[str, str] = oracles.all_sql()
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
