"""From line items and texts to one explained decision per tender: operators composed, no actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import coverage, coverage_summary, matched_items
from ..operators.customer import looked_up
from ..operators.rules import decided, hard_reasons

MODEL = "struct<decision:string,primaryReason:string,detectedReasons:array<struct<reason:string,evidence:string,confidence:string>>,note:string,confidence:string>"


def decide_tenders(tenders: DataFrame, items: DataFrame, registry: DataFrame, ref_date: Column, key: str = "tender", model: DataFrame | None = None, link_prefix: str = "") -> DataFrame:
    """status, reason, note and coverage of each tender.

    tenders: key, lot_divisible, inn, kpp, report_id, all_text and what else the rules read;
    items: key and what matched_items() reads; registry: see looked_up(); model: key and model.
    """
    lots = coverage_summary(coverage(matched_items(items, link_prefix), tenders.select(key, "lot_divisible"), [key]))
    checks = lots.drop("lot_divisible", "status").withColumn("supply_total", F.col("quantity_total"))
    party = looked_up(tenders.select(key, "inn", "kpp"), registry, key).select(key, F.col("status").alias("counterparty_status"), F.col("reason").alias("counterparty_reason"))
    rows = tenders.join(checks, key).join(party, key)
    rows = rows.join(model, key, "left") if model is not None else rows.withColumn("model", F.lit(None).cast(MODEL))
    return decided(hard_reasons(rows, ref_date))
