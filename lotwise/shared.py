"""What operators share: the folder between driver and executors, written tables, bounded broadcasts, free names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side, and bytes of their values, that may be broadcast after they have been counted; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 12 * 2**20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lotwise-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lotwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values: fixed ones by their type, text and lists by what they hold."""
    total = F.lit(16 * len(df.columns))
    for field in df.schema:
        kind, name = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            total = total + 8 * F.greatest(F.size(name), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return total


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its counted rows and bytes stay within the bounds."""
    held = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df).cast("long")).alias("size")).first()
    return F.broadcast(df) if held["n"] <= rows and (held["size"] or 0) <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them (column names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
