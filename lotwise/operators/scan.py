"""Running values over ordered keys, however many rows one key has.

A window over a key's rows brings them into one task. Where a key is larger than `most` rows, the rows
are dealt into ranges of (key, order) instead: each range runs its own values, one row for each
range and key says what it adds, and a key's rows take what the ranges before theirs add up to. The rows
are shuffled twice, whatever the keys; the table of ranges has a row for each range and each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import fresh, small_side, written

#: Rows of one key up to which a plain window is used.
MOST_ROWS = 1_000_000
#: Kinds of running values: of the rows up to and with a row, or (before) up to the one before it.
KINDS = ("sum", "count", "last", "before")


def ranged(df: DataFrame, by: list[Column | str], name: str) -> DataFrame:
    """Written table of df, dealt into ranges of `by`, with `name`: the range's number times 2^33 and the row's number in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "ranges")


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]], most: int = MOST_ROWS) -> DataFrame:
    """df with a running value for each name: (kind, column).

    sum and count: of the rows up to this one; before: the sum of the rows before this one; last: the last
    value that is not null. A sum without values is 0. Rows that tie in `order` run in any order. Null keys
    are a key of their own; columns that clash with the new names are replaced.
    """
    bad = {kind for kind, _ in values.values()} - {*KINDS}
    if bad:
        raise ValueError(f"unknown kinds of running values: {sorted(bad)}")
    had = [c for c in df.columns if c.lower() not in {n.lower() for n in values}]
    inputs = fresh(df, *[f"_in{i}" for i in range(len(values))])
    zero = lambda c: F.coalesce(c, F.lit(0))
    given = {"sum": zero, "before": zero, "last": lambda c: c, "count": lambda c: c.isNotNull().cast("long")}
    rows = df.withColumns({i: given[kind](c) for i, (kind, c) in zip(inputs, values.values(), strict=True)})
    kinds = dict(zip(inputs, (k for k, _ in values.values()), strict=True))
    back = [F.col(f"`{c}`") for c in had]

    def running(i: str, w: Window) -> Column:
        if kinds[i] == "last":
            return F.last(i, ignorenulls=True).over(w)
        return F.sum(i).over(w) - F.col(i) if kinds[i] == "before" else F.sum(i).over(w)

    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    if most and (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= most:
        w = upto(*keys).orderBy(*order)
        return rows.select(*back, *[running(i, w).alias(n) for i, n in zip(inputs, values, strict=True)])
    at, part = fresh(rows, "_at", "_range")
    tagged = ranged(rows, [*keys, *order], at).withColumn(part, F.shiftright(at, 33))
    total = lambda i: F.max(F.when(F.col(i).isNotNull(), F.struct(F.col(at), F.col(i).alias("v"))))["v"] if kinds[i] == "last" else F.sum(i)
    added = tagged.groupBy(part, *keys).agg(*[total(i).alias(i) for i in inputs])
    former = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda i: F.last(i, ignorenulls=True).over(former) if kinds[i] == "last" else F.sum(i).over(former)
    n, k = len(inputs), len(keys) + 1
    new = fresh(tagged, *[f"_of{j}" for j in range(k)], *[f"_carried{j}" for j in range(n)], *[f"_run{j}" for j in range(n)])
    sides, carried, runs = new[:k], new[k : k + n], new[k + n :]
    held = added.select(*[F.col(c).alias(s) for c, s in zip((part, *keys), sides, strict=True)], *[carry(i).alias(c) for i, c in zip(inputs, carried, strict=True)])
    same = F.col(part) == F.col(sides[0])
    for key, side in zip(keys, sides[1:], strict=True):
        same &= F.col(key).eqNullSafe(F.col(side))
    w = upto(part, *keys).orderBy(at)
    local = tagged.withColumns({run: running(i, w) for i, run in zip(inputs, runs, strict=True)})
    out = local.join(small_side(written(held, "range-totals")), same, "left")
    full = lambda i, run, c: F.coalesce(run, c) if kinds[i] == "last" else F.col(run) + zero(F.col(c))
    return out.select(*back, *[full(*x).alias(name) for *x, name in zip(inputs, runs, carried, values, strict=True)])
