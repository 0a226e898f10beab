"""Coverage and price of lots: one grouped aggregation between two projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import format_money, percent, round_money
from ..functions.text import real_value

#: Fixed values.
FULL, ANALOG = "Полное соответствие", "Аналог"
VALUE_THRESHOLD, SHARE_THRESHOLD = 1_000_000, 80


def matched_items(items: DataFrame, link_prefix: str = "") -> DataFrame:
    """Adds link, full_match, analog_match, analog_accepted, supplied and the price columns to line items.

    items: correspondence, article, link, analogs_allowed, median_price, quantity and
    optionally document_unit_price, document_line_total, document_currency. An analog
    counts unless it is expressly forbidden: null allows it.
    """
    article = real_value(F.col("article"))
    link = F.coalesce(real_value(F.col("link")), F.when(article.isNotNull(), F.concat(F.lit(link_prefix), article)))
    proof = F.coalesce(article, link).isNotNull()
    full = F.coalesce((F.col("correspondence") == FULL) & proof, F.lit(False))
    analog = F.coalesce((F.col("correspondence") == ANALOG) & proof, F.lit(False))
    accepted = analog & ~F.col("analogs_allowed").eqNullSafe(F.lit(False))
    out = items.withColumns({"link": link, "full_match": full, "analog_match": analog, "analog_accepted": accepted, "supplied": full | accepted})
    out = out.withColumns({
        "unit_price": F.when(F.col("supplied") & (F.col("median_price") >= 0), F.col("median_price")),
        "quantity": F.when(F.col("quantity") > 0, F.col("quantity")),
    })
    return out.withColumn("position_total", round_money(F.col("unit_price") * F.col("quantity")))


def document_prices(items: DataFrame) -> DataFrame:
    """Adds what the documents' own prices say: comparable unit price, consistency, difference and status."""
    unit, line = F.when(F.col("document_unit_price") > 0, F.col("document_unit_price")), F.when(F.col("document_line_total") > 0, F.col("document_line_total"))
    out = items.withColumns({"document_unit_price": unit, "document_line_total": line})
    currency = F.nullif(F.upper(F.trim("document_currency")), F.lit(""))
    comparable = F.coalesce(currency.isin("RUB", "RUR"), F.lit(True))
    derived = F.when(F.col("document_unit_price").isNull(), round_money(F.col("document_line_total") / F.col("quantity")))
    calculated = round_money(F.col("document_unit_price") * F.col("quantity"))
    out = out.withColumns({
        "document_comparable_unit_price": F.coalesce("document_unit_price", derived),
        "document_calculated_total": calculated,
        "document_currency_comparable": comparable,
        "document_line_consistent": F.abs(calculated - F.col("document_line_total")) <= F.greatest(F.lit(1.0), F.col("document_line_total") * 0.01),
        "document_line_difference_percent": F.bround((calculated - F.col("document_line_total")) / F.col("document_line_total") * 100, 2),
    })
    gap = F.when(F.col("document_currency_comparable"), round_money(F.col("unit_price") - F.col("document_comparable_unit_price")))
    status = (
        F.when(F.col("document_unit_price").isNull() & F.col("document_line_total").isNull(), "not_available")
        .when(~F.col("document_currency_comparable"), "currency_not_comparable")
        .when(F.col("document_line_consistent"), "unit_times_quantity_matches_line_total")
        .when(~F.col("document_line_consistent"), "unit_times_quantity_mismatch")
        .otherwise("diagnostic_only")
    )
    return out.withColumns({
        "document_difference": gap,
        "document_difference_percent": F.bround(gap / F.col("document_comparable_unit_price") * 100, 2),
        "document_status": status,
    })


def _money_sum(x: Column) -> Column:
    """Cents add up exactly whatever the order of rows."""
    return F.coalesce(F.sum(x.cast("decimal(28,2)")), F.lit(0).cast("decimal(28,2)")).cast("double")


def coverage(items: DataFrame, lots: DataFrame, keys: list[str], divisible: str = "lot_divisible") -> DataFrame:
    """One row for each lot: counts, coverage, sums, the rule's verdicts. Lots without items are rows, too.

    items: what matched_items() returned, with the lots' keys; lots: keys and `divisible` (true, false or null).
    """
    yes = lambda name: F.count_if(F.col(name))
    own = lambda name: F.when(F.col("supplied"), F.col(name))
    sums = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), yes("supplied").alias("supplied_count"), yes("full_match").alias("full_match_count"),
        yes("analog_accepted").alias("analog_count"), F.count_if(F.col("analog_match") & ~F.col("analog_accepted")).alias("rejected_analog_count"),
        F.count(own("unit_price")).alias("priced_count"), F.count(own("quantity")).alias("quantity_known_count"), F.count(own("position_total")).alias("fully_calculated_count"),
        _money_sum(round_money(own("unit_price"))).alias("median_price_sum"), _money_sum(own("position_total")).alias("quantity_total"),
    )
    counts = ["total", "supplied_count", "full_match_count", "analog_count", "rejected_analog_count", "priced_count", "quantity_known_count", "fully_calculated_count"]
    out = lots.join(sums, keys, "left").fillna(0, counts).fillna(0.0, ["median_price_sum", "quantity_total"])
    share, some = percent(F.col("supplied_count"), F.col("total")), F.col("total") > 0
    free = F.coalesce(F.col(divisible), F.lit(False))
    approved = some & F.when(free, F.col("supplied_count") >= 1).otherwise(F.coalesce(share >= SHARE_THRESHOLD, F.lit(False)))
    complete = (F.col("supplied_count") > 0) & (F.col("fully_calculated_count") == F.col("supplied_count"))
    out = out.withColumns({
        "not_found_count": F.col("total") - F.col("supplied_count"),
        "coverage_percent": share,
        "coverage_rule": F.when(free, "divisible_at_least_one_position").otherwise("indivisible_at_least_80_percent"),
        "approval_threshold": F.when(~free, SHARE_THRESHOLD),
        "coverage_approved": approved,
        "hard_reject": some & ~approved,
        "median_complete": (F.col("supplied_count") > 0) & (F.col("priced_count") == F.col("supplied_count")),
        "price_complete": complete,
        "status": F.when(some, "evaluated").otherwise("not_evaluated"),
    })
    applicable = F.col("coverage_approved") & F.col("price_complete")
    return out.withColumns({"threshold_applicable": applicable, "value_reject": applicable & (F.col("quantity_total") < VALUE_THRESHOLD)})


def coverage_summary(lots: DataFrame, divisible: str = "lot_divisible") -> DataFrame:
    """Adds `summary`, the verdict in words (fixed texts)."""
    n = lambda name: F.col(name).cast("string")
    share = F.concat(F.format_string("%s", F.col("coverage_percent")), F.lit("%"))
    free = F.coalesce(F.col(divisible), F.lit(False))
    label = F.when(F.col(divisible).isNull(), "Делимость лота не подтверждена; применяется правило неделимого лота").otherwise("Лот неделимый")
    rule = F.when(free, "Лот делимый: найдена хотя бы одна поставляемая позиция, проверка пройдена.").otherwise(F.concat(label, F.when(F.col("coverage_approved"), ": порог не менее 80% пройден.").otherwise(": порог не менее 80% не пройден.")))
    head = F.concat(F.lit("Покрытие ассортимента "), share, F.lit(" ("))
    text = (
        F.when(F.col("total") == 0, "Товарные позиции для проверки ассортимента не извлечены.")
        .when((F.col("supplied_count") == 0) & free, F.concat(head, F.lit("0 из "), n("total"), F.lit("). Лот делимый, но не найдена ни одна поставляемая позиция; проверка не пройдена.")))
        .when(F.col("supplied_count") == 0, F.concat(head, F.lit("0 из "), n("total"), F.lit("); порог не менее 80% для неделимого лота не пройден.")))
        .otherwise(F.concat(head, n("supplied_count"), F.lit(" из "), n("total"), F.lit("); точных совпадений "), n("full_match_count"), F.lit(", допустимых аналогов "), n("analog_count"), F.lit(", не закрыто "), n("not_found_count"), F.lit(". "), rule))
    )
    price = (
        F.when(F.col("total") == 0, "Сумма медианных цен не определена: товарные позиции для проверки не извлечены.")
        .when(F.col("supplied_count") == 0, "Сумма медианных цен поставляемого ассортимента: 0,00 руб.; точные совпадения и допустимые аналоги не найдены.")
        .otherwise(F.concat(
            F.lit("Сумма медианных цен поставляемых позиций: "), format_money(F.col("median_price_sum")), F.lit(" (цена найдена для "), n("priced_count"), F.lit(" из "), n("supplied_count"), F.lit("). "),
            F.when(F.col("price_complete"), F.concat(F.lit("Расчётная сумма с учётом количества (медианная цена единицы × количество): "), format_money(F.col("quantity_total")), F.lit(".")))
            .otherwise(F.concat(F.lit("Для "), (F.col("supplied_count") - F.col("fully_calculated_count")).cast("string"), F.lit(" из "), n("supplied_count"), F.lit(" поставляемых позиций нет цены и/или количества, поэтому автоматический порог 1 млн руб. не применяется."))),
        ))
    )
    return lots.withColumns({"coverage_text": text, "price_summary": price}).withColumn("summary", F.concat_ws(" ", "coverage_text", "price_summary"))
