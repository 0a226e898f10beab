"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())


def plain(v):
    """A value as text; whole numbers alike whether or not nulls made their column floating."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return str(v)


def shown(df):
    return sorted(tuple(map(plain, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from lotwise.streaming.events import drained, job_states

    moves = [("a", 1, "dispatch", "w"), ("a", 2, "claim", "w"), ("a", 3, "complete", "v"), ("a", 4, "complete", "w"), ("b", 1, "claim", "w")]
    df = spark.createDataFrame(moves, "record_key string, event_id long, move string, worker string")
    df.write.parquet(str(tmp_path / "in"))
    stream = job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = {(r.record_key, r.status, r.attempt) for r in drained(stream, "states", "update").collect()}
    assert got == {("a", "completed", 1), ("b", "queued", 0)}
