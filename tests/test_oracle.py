"""Every registered query against its DuckDB oracle at sf0.01 (order-insensitive
value hash over columns sorted by name, as the driver compares)."""

import hashlib

import pytest

from conftest import SF01
from paxcast.plans import registry

registry.load_all()


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF01)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(registry.ORACLES[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _digest(df.columns, s_rows) == _digest(d_cols, d_rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = registry.QUERIES[name](spark, SF01)
    assert df.count() > 0
