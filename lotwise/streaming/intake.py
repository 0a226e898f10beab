"""Job intake as a stream: requests as JSON lines, each key told as accepted or refused, in two tables that a replay does not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.jobs import classified, validated

#: Fixed value: jobs that one request may name.
MOST = 25
ACCEPTED, REFUSED = "accepted", "refused"


def request_stream(spark: SparkSession, path: str, fields: str = "request_id string, record_key string, payload string", files: int = 1000) -> DataFrame:
    """JSON lines as they land; a line that is no object has null fields and keeps its text in `line`.

    A request's lines lie in one file, so a batch has them all.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.from_json("value", fields).alias("j"), F.col("value").alias("line")).select("j.*", "line")


def told(requests: DataFrame, jobs: DataFrame, key: str = "record_key", request: str = "request_id") -> DataFrame:
    """requests with outcome: accepted, a reason why not (blank_key, duplicate_key, too_many_jobs), not_found or status_<s>.

    Keys are unique within a request, and a request names at most MOST jobs.
    """
    from pyspark.sql.window import Window

    checked = validated(requests, key, (request,))
    n = F.count(F.lit(1)).over(Window.partitionBy(request))
    checked = checked.withColumn("error", F.coalesce(F.col("error"), F.when(n > MOST, "too_many_jobs")))
    known = classified(checked, jobs, key)
    return known.withColumn("outcome", F.coalesce("error", "outcome")).drop("error")


def land(requests: DataFrame, batch: int, jobs: DataFrame, path: str) -> None:
    """Writes one batch's rows to both tables; written again, it replaces itself."""
    rows = told(requests, jobs)
    for name, taken in ((ACCEPTED, F.col("outcome") == ACCEPTED), (REFUSED, F.col("outcome") != ACCEPTED)):
        rows.where(taken).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def intake(requests: DataFrame, jobs: Callable[[], DataFrame], path: str) -> None:
    """Takes in all requests that have landed. jobs: the jobs as they are when a batch is told."""
    query = requests.writeStream.foreachBatch(lambda rows, batch: land(rows, batch, jobs(), path)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def taken_in(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of what was accepted or refused, with the batch that brought it."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("outcome", T.StringType()), T.StructField("batch", T.LongType())])).parquet(f"{path}/{name}")
