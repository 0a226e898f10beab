"""Analytics over runs, events and counters: grouped, conditional and pivoted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Counters that a run carries.
RUN_COUNTERS = (
    "llm_requests", "llm_successes", "llm_failures", "llm_prompt_tokens", "llm_completion_tokens", "llm_total_tokens", "llm_fallbacks", "embedding_queries",
    "embedding_http_requests", "qdrant_queries", "qdrant_http_requests", "qdrant_results", "documents_requested", "documents_parsed", "download_bytes", "warnings_count",
)


def conditional_counts(df: DataFrame, column: str, values: list[str], keys: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """total, a count for each value of the column, and sums (0 where there is none), for each key or for all."""
    parts = [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(f"{v}_count") for v in values]]
    parts += [F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sums]
    return df.groupBy(*keys).agg(*parts) if keys else df.agg(*parts)


def metric_increments(events: DataFrame) -> DataFrame:
    """metric, model, status, increment of each counter that an event moves; zero moves are left out.

    events: event_type, service, status, model, prompt_tokens, completion_tokens, result_count, fallback_used.
    """
    status, model = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
    n = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    one, blank = F.lit(1).cast("long"), F.lit("")
    move = lambda metric, label, by: F.struct(F.lit(metric).alias("metric"), label.alias("model"), status.alias("status"), by.alias("increment"))
    none = F.array().cast("array<struct<metric:string,model:string,status:string,increment:bigint>>")
    moves = (
        F.when(F.col("service") == "llm", F.array(
            move("llm_requests", model, one), move("llm_prompt_tokens", model, n(F.col("prompt_tokens"))), move("llm_completion_tokens", model, n(F.col("completion_tokens"))),
            move("llm_fallbacks", model, F.coalesce(F.col("fallback_used"), F.lit(False)).cast("long")),
        ))
        .when(F.col("service") == "qdrant", F.array(move("qdrant_queries", blank, one), move("qdrant_results", blank, n(F.col("result_count")))))
        .when(F.col("service") == "qdrant_http", F.array(move("qdrant_http_requests", blank, one)))
        .when(F.col("service") == "embedding", F.array(move("embedding_queries", model, one)))
        .when(F.col("service") == "ollama_http", F.array(move("embedding_http_requests", model, one)))
        .otherwise(none)
    )
    return events.where(F.col("event_type") == "external_call").select(F.explode(moves).alias("x")).select("x.*").where(F.col("increment") != 0)


def metric_counters(increments: DataFrame) -> DataFrame:
    """The counters' values: increments added up per metric, model and status."""
    return increments.groupBy("metric", "model", "status").agg(F.sum("increment").alias("value"))


def metric_pivot(counters: DataFrame, metrics: list[str]) -> DataFrame:
    """A column per metric (0 where it never moved) for each model and status."""
    return counters.groupBy("model", "status").pivot("metric", metrics).max("value").fillna(0, metrics)


def run_counters(moves: DataFrame) -> DataFrame:
    """run_id, counter, value: non-negative moves of known counters added up."""
    known = moves.where(F.col("counter").isin(*RUN_COUNTERS))
    return known.groupBy("run_id", "counter").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("value").cast("long"))).alias("value")).where(F.col("value") != 0)


def high_water(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The largest value seen for each key."""
    return df.groupBy(*keys).agg(*[F.max(v).alias(f"peak_{v}") for v in values])


def hourly(df: DataFrame, time: str, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows and sums by hour and key."""
    return df.groupBy(F.date_trunc("hour", time).alias("hour"), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def stale(df: DataFrame, beat: str, ref: Column, seconds: int, running: Column) -> DataFrame:
    """Running rows without a beat for longer than the given seconds before ref."""
    return df.where(running & (F.col(beat) < ref - F.expr(f"interval {int(seconds)} seconds")))


def staleness(interval: int) -> int:
    """Seconds without a beat after which a run is stale."""
    return max(120, 4 * interval)


def retained(df: DataFrame, time: str, ref: Column, days: int) -> DataFrame:
    return df.where(F.col(time) >= ref - F.expr(f"interval {int(days)} days"))


def recent(df: DataFrame, order: list[Column], limit: int, most: int = 500) -> DataFrame:
    """The newest rows, at least one and at most `most`."""
    return df.orderBy(*order).limit(min(max(limit, 1), most))


def latest_groups(df: DataFrame, key: str, time: str, limit: int = 1000) -> DataFrame:
    """Keys by their newest row, newest first."""
    return df.groupBy(key).agg(F.max(time).alias("last")).orderBy(F.desc("last"), key).limit(limit)


def stage_timeline(events: DataFrame, keys: list[str], time: str = "event_time", kind: str = "event_type") -> DataFrame:
    """started, finished, seconds and status of each stage."""
    at = lambda name: F.min(F.when(F.col(kind) == name, F.col(time)))
    end = F.max(F.when(F.col(kind) == "stage_finished", F.col(time)))
    out = events.groupBy(*keys).agg(at("stage_started").alias("started"), end.alias("finished"), F.max_by("status", F.when(F.col(kind) == "stage_finished", F.col(time))).alias("status"))
    return out.withColumn("seconds", F.unix_micros(F.col("finished").cast("timestamp")).cast("double") / 1e6 - F.unix_micros(F.col("started").cast("timestamp")).cast("double") / 1e6)


def runs_with_events(runs: DataFrame, events: DataFrame, run_id: str = "run_id", order: tuple[str, ...] = ("event_time", "event_id")) -> DataFrame:
    """Runs with their events as one ordered array."""
    rest = [c for c in events.columns if c not in (*order, run_id)]
    nested = events.groupBy(run_id).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("events"))
    return runs.join(nested, run_id, "left")


def usage_total(total: Column, prompt: Column, completion: Column) -> Column:
    """The reported total, or prompt plus completion."""
    return F.coalesce(F.nullif(total, F.lit(0)), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def superseded(runs: DataFrame, key: str = "record_key", time: str = "started_at") -> DataFrame:
    """Adds next_start, final_status and seconds: a running attempt ends where a newer one starts."""
    w = Window.partitionBy(key).orderBy(time)
    out = runs.withColumn("next_start", F.lead(time).over(w))
    cut = (F.col("status") == "running") & F.col("next_start").isNotNull()
    gap = F.unix_micros(F.col("next_start").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return out.withColumns({"final_status": F.when(cut, "interrupted").otherwise(F.col("status")), "seconds": F.when(cut, gap / 1e6)})


def ranked_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
