"""Prefix scans by ranges give what a window over the whole key gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.operators import scan


@pytest.mark.parametrize("broadcast", [True, False])
def test_ranges_equal_windows(spark, monkeypatch, broadcast):
    """One key has half of the rows; keys and values are null here and there; names clash."""
    if not broadcast:
        monkeypatch.setattr(scan, "small_side", lambda df: df)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None, "c"]), r.choice([None, 1, 2, 5]), 7) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k string, v long, _in0 int").withColumns({"_at": F.lit(1), "S": F.lit(2)})
    asked = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "l": ("last", F.col("v")), "b": ("before", F.col("v"))}
    w = Window.partitionBy("k").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.coalesce("v", F.lit(0))
    want = df.drop("S").withColumns({"s": F.sum(zero).over(w), "n": F.count("v").over(w), "l": F.last("v", True).over(w), "b": F.sum(zero).over(w) - zero})
    shown = lambda d: sorted(map(repr, d.select("id", "k", "v", "_in0", "_at", "s", "n", "l", "b").collect()))
    for most in (0, scan.MOST_ROWS):
        got = scan.prefix_scan(df, ["k"], [F.desc("id")], asked, most)
        assert got.columns == ["id", "k", "v", "_in0", "_at", "s", "n", "l", "b"] and shown(got) == shown(want)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_key_is_dealt_to_several_tasks(spark):
    tagged = scan.ranged(spark.range(4000).withColumn("k", F.lit(1)), ["k", "id"], "at").withColumn("part", F.shiftright("at", 33))
    held = tagged.groupBy("part").count().collect()
    assert len(held) == 4 and max(x["count"] for x in held) < 2000
    got = scan.prefix_scan(spark.range(4000), [], ["id"], {"n": ("count", F.col("id"))}, 0)
    assert got.where("n != id + 1").isEmpty() and got.count() == 4000


def test_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "k string, id long")
    for most in (0, 10):
        assert scan.prefix_scan(empty, ["k"], ["id"], {"n": ("count", F.col("id"))}, most).collect() == []
    with pytest.raises(ValueError, match="median"):
        scan.prefix_scan(empty, ["k"], ["id"], {"n": ("median", F.col("id"))})
