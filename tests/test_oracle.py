"""Every query that SQL can express equals DuckDB's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import differences

from sojourn.plans import queries_reference, queries_state, queries_training

SMALL = "/root/testdata/sf0.001"
PAIRS = [(m.QUERIES[k], v, k) for m in (queries_training, queries_reference, queries_state) for k, v in m.ORACLE.items()]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
@pytest.mark.parametrize(("query", "sql", "name"), PAIRS, ids=[p[2] for p in PAIRS])
def test_equal_rows(spark, query, sql, name):
    assert differences(query(spark, SMALL), sql, SMALL) == ""


def test_imports_without_llm(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "sojourn.llm", None)
    monkeypatch.delitem(sys.modules, "sojourn.llm.queries", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__

    assert "p1_found" in __spark_entry__.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
