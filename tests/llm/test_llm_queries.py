"""Every training-data query over the smallest tables, beside its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle
from serat.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert not oracle.compare(spark, DATA, name).startswith("FAIL")
