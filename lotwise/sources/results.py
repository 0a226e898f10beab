"""Sinks: the result document, delimited reports, metric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_unique

#: Keys of a result document, in order.
RESULT_KEYS = (
    "fields", "meta", "productCheck", "decision", "warnings", "logs", "debug", "reportId", "seldonId", "etpId", "purchaseType", "purchaseNumber", "tenderUrl", "batchId",
    "batchDate", "rowNumber", "jobRecordKey", "remainingDays", "toCode", "lawCode", "sectionName", "filterName", "reportFields", "sourceTender", "processedAt",
)


def result_json(df: DataFrame, columns: dict[str, str | Column], processed_at: Column) -> DataFrame:
    """Adds result_json: all RESULT_KEYS (null where nothing is given), warnings once each, UTC time."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    if "warnings" in given:
        given["warnings"] = ordered_unique(given["warnings"])
    given["processedAt"] = F.date_format(processed_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [given.get(k, F.lit(None).cast("string")).alias(k) for k in RESULT_KEYS]
    return df.withColumn("result_json", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def write_reports(df: DataFrame, path: str, partition: str = "report_id") -> None:
    """Delimited reports by type: semicolons, header, a byte-order mark before the first header cell."""
    first, *rest = [c for c in df.columns if c != partition]
    marked = df.select(F.col(first).alias("﻿" + first), *rest, partition)
    marked.write.mode("overwrite").partitionBy(partition).options(sep=";", header=True, encoding="UTF-8").csv(path)


def prometheus_lines(metrics: DataFrame, name: str, labels: list[str], value: str = "value") -> DataFrame:
    """`line` in the text exposition format of each row."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit('"')) for x in labels])
    return metrics.select(F.concat(F.col(name), F.lit("{"), shown, F.lit("} "), F.col(value).cast("string")).alias("line"))
