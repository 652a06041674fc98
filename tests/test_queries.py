"""Every query that has an SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
            con.execute(f"create view {name[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    assert entry.entry(spark).columns == ["doc_id", "chunk_idx", "chunk", "n_chars", "seed"]
