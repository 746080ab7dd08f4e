"""Every registered query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    f, sql = catalog.QUERIES[name]
    assert sql, "no SQL"
    assert oracle.differs(spark, con, f, sql, SF) is None
