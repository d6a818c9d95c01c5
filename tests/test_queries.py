"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return str(value.tolist()) if hasattr(value, "tolist") and getattr(value, "ndim", 0) else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, sql, name, tmp_path):
    """The query's rows as they are written and read again, which asks for distinct names, against its SQL."""
    registry.QUERIES[name](spark, small).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got), "a query without rows shows nothing"
    if name in registry.ORACLES:
        want = sql.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry_names():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
