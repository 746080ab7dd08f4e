"""Registered queries against their SQL."""

import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[2])]
import oracle

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert oracle.differs(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None
