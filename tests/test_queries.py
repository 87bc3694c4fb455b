"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loamwatch.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(one(x) for x in v)
        if v is None or v is pd.NA or v != v:
            return "~"
        if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 6)
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(one(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(abs(p - q) <= 2e-6 * max(1, abs(q)) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
