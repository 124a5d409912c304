"""Every screening query against its SQL on the smallest tables."""

import duckdb
import pytest

from tapeworks import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run by test_horizons.py on a smaller table.
SLOW = {"save_walk_forward_detail", "sweep_horizons", "best_horizon"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v or str(v) == "NaT":
        return None
    if isinstance(v, (bool, str, list)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return float(v) + 0.0


@pytest.mark.parametrize("name", [q for q in registry.queries() if q not in SLOW])
def test_query(spark, sf, con, name):
    rows = registry.queries()[name](spark, sf)
    order = sorted(rows.columns)
    got = sorted((tuple(cell(r[c]) for c in order) for r in rows.collect()), key=str)
    if name not in registry.oracle_sql():
        assert got
        return
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == order
    want = sorted((tuple(cell(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    assert got == want

