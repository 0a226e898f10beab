"""Versions, guards, replays and concurrent batches of the keyed table."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import types as T

from lotwise.sources.keyed_table import KeyedTable, added, replaced

JOBS = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("status", T.StringType()), T.StructField("worker", T.StringType()), T.StructField("n", T.LongType())])


def shown(table, number=None):
    return {tuple(r) for r in table.rows(number).collect()}


def test_upserts_guards_and_versions(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/jobs", JOBS, ["record_key"], 4)
    make = lambda *rows: spark.createDataFrame(rows, JOBS)
    assert shown(table) == set() and table.version().number == 0
    assert table.upsert(make(("a", "processing", "w", 1), ("b", "processing", "v", 1), (None, "queued", None, 0)), "one", replaced)
    before = shown(table)
    guard = lambda old, new: (old["status"] == "processing") & (old["worker"] == new["worker"])
    assert table.upsert(make(("a", "completed", "w", 2), ("b", "completed", "w", 2), ("new", "completed", "w", 2)), "two", replaced, guard, insert=False)
    assert shown(table) == {("a", "completed", "w", 2), ("b", "processing", "v", 1), (None, "queued", None, 0)}
    assert shown(table, 1) == before and table.version().number == 2
    # the same batch again changes nothing
    assert not table.upsert(make(("a", "failed", "w", 9)), "two", replaced) and not table.upsert(make(("a", "failed", "w", 9)), "one", replaced)
    assert table.version().number == 2


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", JOBS, ["record_key"], 16)
    table.upsert(spark.createDataFrame([(f"k{i}", "s", None, i) for i in range(100)], JOBS), "all", replaced)
    first = table.version().folders
    table.upsert(spark.createDataFrame([("k7", "t", None, 0)], JOBS), "one", replaced)
    second = table.version()
    assert len(second.touched) == 1 and sum(first[b] != second.folders[b] for b in first) == 1 and table.rows().count() == 100


def test_concurrent_batches_and_torn_commits(spark, tmp_path):
    """Twelve batches at once add up, whichever buckets they share; a commit without content and a missing mark do no harm."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("top", T.LongType())])
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, ["k"], 3)
    run = lambda i: KeyedTable(spark, table.path, schema, ["k"], 3).upsert(spark.createDataFrame([("all", 1, i), (f"k{i % 4}", 10, i)], schema), f"batch {i}", added("n"))
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(run, range(8)))
    assert table.store.create(f"commits/{table.version().number + 1:012d}.json", "")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(run, range(8, 12)))
    assert shown(table) == {("all", 12, 11), *((f"k{i}", 30, 8 + i) for i in range(4))}
    last = table.version()
    table.store.fs.delete(table.store._path(table._mark(last.batch)), False)
    assert not run(int(last.batch.split()[1])) and table.version().number == last.number


def test_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", JOBS, ["record_key"])
    assert table.upsert(spark.createDataFrame([], JOBS), "none", replaced) and shown(table) == set()
    with pytest.raises(Exception, match="missing"):
        table.upsert(spark.createDataFrame([("a",)], "record_key string"), "bad", lambda c, old, new: new["missing"]).count()
