"""Operators applied to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dates, numbers
from .functions import text as tx
from .operators import answers, audit, coverage, documents, jobs, matching, normalize, positions, rules, vector_index
from .operators.documents import within_budget
from .operators.scan import prefix_scan

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
Frame = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with its SQL."""

    def register(f: Callable[[Frame], DataFrame]) -> Callable[[Frame], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- coverage -------------------------------------------------------------------------------------

ITEMS_SQL = """
items AS (
  SELECT l_orderkey, p_brand,
    CASE l_returnflag WHEN 'N' THEN 'full' WHEN 'A' THEN 'analog' ELSE 'none' END AS kind,
    l_linestatus = 'F' AND p_size % 3 = 0 AS forbidden,
    CASE WHEN p_size >= 5 THEN p_retailprice END AS price, l_quantity AS quantity,
    CASE WHEN p_size % 4 <> 0 THEN l_extendedprice END AS line_total, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS doc_price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
matched AS (SELECT *, kind = 'full' OR (kind = 'analog' AND NOT forbidden) AS supplied FROM items),
priced AS (SELECT *, CASE WHEN supplied THEN price END AS unit_price, CASE WHEN supplied THEN round(price * quantity + 1e-12, 2) END AS total_price FROM matched)"""
COVERAGE_SQL = f"""WITH {ITEMS_SQL},
sums AS (
  SELECT l_orderkey, count(*) AS total, count(*) FILTER (supplied) AS supplied_count, count(*) FILTER (kind = 'full') AS full_match_count,
    count(*) FILTER (kind = 'analog' AND NOT forbidden) AS analog_count, count(*) FILTER (kind = 'analog' AND forbidden) AS rejected_analog_count,
    count(unit_price) AS priced_count, count(total_price) AS fully_calculated_count,
    sum(round(unit_price + 1e-12, 2)::DECIMAL(28,2))::DOUBLE AS median_price_sum, sum(total_price::DECIMAL(28,2))::DOUBLE AS quantity_total
  FROM priced GROUP BY l_orderkey),
lots AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority = '1-URGENT' AS free, coalesce(total, 0)::BIGINT AS total, coalesce(supplied_count, 0)::BIGINT AS supplied_count,
    coalesce(full_match_count, 0)::BIGINT AS full_match_count, coalesce(analog_count, 0)::BIGINT AS analog_count, coalesce(rejected_analog_count, 0)::BIGINT AS rejected_analog_count,
    coalesce(priced_count, 0)::BIGINT AS priced_count, coalesce(fully_calculated_count, 0)::BIGINT AS fully_calculated_count,
    coalesce(median_price_sum, 0::DOUBLE) AS median_price_sum, coalesce(quantity_total, 0::DOUBLE) AS quantity_total
  FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey),
shares AS (SELECT *, CASE WHEN total > 0 THEN round_even(supplied_count::DOUBLE / total::DOUBLE * 100::DOUBLE, 2) END AS coverage_percent FROM lots),
verdicts AS (SELECT *, total > 0 AND (CASE WHEN free THEN supplied_count >= 1 ELSE coalesce(coverage_percent >= 80, false) END) AS coverage_approved,
  supplied_count > 0 AND fully_calculated_count = supplied_count AS price_complete, supplied_count > 0 AND priced_count = supplied_count AS median_complete FROM shares)"""


def order_items(read: Frame) -> DataFrame:
    """Order lines as matched line items of lots."""
    size = F.col("p_size")
    items = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "p_brand", F.when(F.col("l_returnflag") == "N", coverage.FULL).when(F.col("l_returnflag") == "A", coverage.ANALOG).otherwise("Товар не найден").alias("correspondence"),
        F.col("l_partkey").cast("string").alias("article"), F.lit(None).cast("string").alias("link"), (~((F.col("l_linestatus") == "F") & (size % 3 == 0))).alias("analogs_allowed"),
        F.when(size >= 5, F.col("p_retailprice")).alias("median_price"), F.col("l_quantity").alias("quantity"),
        F.when(size % 4 != 0, F.col("l_extendedprice")).alias("document_line_total"), F.when(size % 2 == 0, F.col("p_retailprice")).alias("document_unit_price"), F.lit("RUB").alias("document_currency"),
    )
    return coverage.matched_items(items)


def order_lots(read: Frame) -> DataFrame:
    orders = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("lot_divisible"))
    return coverage.coverage(order_items(read), orders, ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")


@query(COVERAGE_SQL + """
SELECT o_orderkey, total, supplied_count, full_match_count, analog_count, rejected_analog_count, coverage_percent, coverage_approved, total > 0 AND NOT coverage_approved AS hard_reject,
  CASE WHEN free THEN 'divisible_at_least_one_position' ELSE 'indivisible_at_least_80_percent' END AS coverage_rule, median_price_sum, quantity_total, price_complete FROM verdicts""")  # fmt: skip
def coverage_by_order(read: Frame) -> DataFrame:
    return order_lots(read).select("o_orderkey", "total", "supplied_count", "full_match_count", "analog_count", "rejected_analog_count", "coverage_percent", "coverage_approved", "hard_reject", "coverage_rule", "median_price_sum", "quantity_total", "price_complete")


@query(COVERAGE_SQL + """
SELECT o_orderkey, price_complete, median_complete, coverage_approved AND price_complete AS threshold_applicable, coverage_approved AND price_complete AND quantity_total < 1000000 AS value_reject,
  CASE WHEN NOT free THEN 80 END::DOUBLE AS approval_threshold FROM verdicts""")  # fmt: skip
def coverage_price_flags(read: Frame) -> DataFrame:
    return order_lots(read).select("o_orderkey", "price_complete", "median_complete", "threshold_applicable", "value_reject", F.col("approval_threshold").cast("double").alias("approval_threshold"))


@query(COVERAGE_SQL + """
SELECT o_orderstatus, count(*) AS lots, count(*) FILTER (coverage_approved) AS approved, count(*) FILTER (total = 0) AS empty, sum(total)::BIGINT AS items, sum(quantity_total::DECIMAL(28,2))::DOUBLE AS value
FROM verdicts GROUP BY o_orderstatus""")  # fmt: skip
def coverage_totals_by_status(read: Frame) -> DataFrame:
    return order_lots(read).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("lots"), F.count_if("coverage_approved").alias("approved"), F.count_if(F.col("total") == 0).alias("empty"), F.sum("total").alias("items"), F.sum(F.col("quantity_total").cast("decimal(28,2)")).cast("double").alias("value")
    )


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT *, round(doc_price * quantity + 1e-12, 2) AS calc FROM priced)
SELECT CASE WHEN doc_price IS NULL AND line_total IS NULL THEN 'not_available' WHEN abs(calc - line_total) <= greatest(1.0::DOUBLE, line_total * 0.01::DOUBLE) THEN 'unit_times_quantity_matches_line_total'
  WHEN abs(calc - line_total) > greatest(1.0::DOUBLE, line_total * 0.01::DOUBLE) THEN 'unit_times_quantity_mismatch' ELSE 'diagnostic_only' END AS document_status, count(*) AS n FROM d GROUP BY 1""")  # fmt: skip
def document_price_status(read: Frame) -> DataFrame:
    return coverage.document_prices(order_items(read)).groupBy("document_status").agg(F.count(F.lit(1)).alias("n"))


# --- rules ----------------------------------------------------------------------------------------

REASONS_SQL = COVERAGE_SQL + """,
dates AS (SELECT l_orderkey, max(l_shipdate)::DATE AS delivery FROM lineitem GROUP BY 1),
facts AS (SELECT v.*, o.o_totalprice, o.o_orderdate::DATE AS created, o.o_custkey, date_diff('day', DATE '1998-08-01', o.o_orderdate::DATE)::DOUBLE AS remaining, d.delivery
  FROM verdicts v JOIN orders o USING (o_orderkey) LEFT JOIN dates d ON d.l_orderkey = o_orderkey),
reasons AS (
  SELECT o_orderkey, 5 AS p, 'Номенклатура. Лот неделимый. Не можем скомплектовать более 20% номенклатуры' AS r FROM facts WHERE total > 0 AND NOT coverage_approved
  UNION ALL SELECT o_orderkey, 25, 'Оргвопросы. Отсутствует ТЗ / Нет документации / Некорректная ссылка' FROM facts WHERE total = 0
  UNION ALL SELECT o_orderkey, 15, 'Оргвопросы. На момент согласования менее 3 рабочих дней до подачи заявки' FROM facts WHERE remaining < 3
  UNION ALL SELECT o_orderkey, 20, 'Коммерческие условия. НМЦК менее 1 млн руб.' FROM facts WHERE (o_totalprice > 0 AND o_totalprice < 1000000) OR (coverage_approved AND price_complete AND quantity_total < 1000000)
  UNION ALL SELECT o_orderkey, 32, 'Коммерческие условия. Не проходим по сроку поставки' FROM facts WHERE delivery > (created + INTERVAL 18 MONTH)::DATE)"""


def order_reasons(read: Frame) -> DataFrame:
    """Orders as tenders with their hard reasons."""
    late = read("lineitem").groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("delivery_date"))
    facts = read("orders").select(
        "o_orderkey", "o_custkey", F.format_string("%.2f", "o_totalprice").alias("initial_price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_created"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1998-08-01").cast("date")).cast("double").alias("remaining_days"),
    )
    lots = order_lots(read).drop("o_orderstatus", "status").withColumnsRenamed({"quantity_total": "supply_total"})
    rows = lots.join(facts, "o_orderkey").join(late.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return rules.hard_reasons(rows, F.lit("1998-08-01").cast("date"))


@query(REASONS_SQL + """
SELECT o_orderkey, coalesce(string_agg(r, ' | ' ORDER BY p) FILTER (r IS NOT NULL), '') AS reasons, arg_min(r, p) AS first_reason, count(r) AS n FROM verdicts LEFT JOIN reasons USING (o_orderkey) GROUP BY o_orderkey""")
def hard_reasons_by_order(read: Frame) -> DataFrame:
    named = F.transform("hard", lambda x: x["reason"])
    return order_reasons(read).select("o_orderkey", F.array_join(named, " | ").alias("reasons"), F.get(named, F.lit(0)).alias("first_reason"), F.size("hard").cast("long").alias("n"))


@query(REASONS_SQL + """,
agg AS (SELECT o_orderkey, count(r) AS n, arg_min(r, p) AS any_r, arg_min(r, p) FILTER (r NOT LIKE 'Номенклатура. Лот%') AS other_r FROM verdicts LEFT JOIN reasons USING (o_orderkey) GROUP BY 1)
SELECT o_orderkey, CASE WHEN n > 0 THEN 'Отказано КУ ЦП' WHEN c_nationkey % 5 = 0 THEN 'Проработка контрагента' WHEN o_orderkey % 2 = 0 THEN 'Согласовано КУ ЦП' ELSE 'Загружен Seldon' END AS status,
  CASE WHEN n > 0 THEN coalesce(other_r, any_r) WHEN c_nationkey % 5 = 0 THEN 'Прочее' WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Прочее' END AS reason,
  CASE WHEN n > 0 THEN 'deterministic' WHEN c_nationkey % 5 = 0 THEN 'counterparty' WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'fallback' END AS reason_origin
FROM agg JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def final_decision_by_order(read: Frame) -> DataFrame:
    none = F.expr("cast(array() as array<struct<reason:string,evidence:string,confidence:string>>)")
    model = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit("approve").alias("decision"), F.lit(None).cast("string").alias("primaryReason"), none.alias("detectedReasons"), F.lit("").alias("note"), F.lit("high").alias("confidence")))
    known = read("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") % 5 == 0, "not_found").otherwise("matched").alias("counterparty_status"))
    rows = order_reasons(read).join(known, "o_custkey").withColumns({"model": model, "counterparty_reason": F.lit(None).cast("string")})
    return rules.decided(rows).select("o_orderkey", "status", "reason", "reason_origin")


CHECKS_SQL = """SELECT o_orderkey, date_diff('day', DATE '1998-08-01', o_orderdate::DATE) < 3 AS too_late, strftime(o_orderdate::DATE + INTERVAL 18 MONTH, '%Y-%m-%d') AS limit_date FROM orders"""


@query(CHECKS_SQL)
def deadline_rule(read: Frame) -> DataFrame:
    day = F.to_date("o_orderdate")
    tenders = read("orders").select("o_orderkey", F.datediff(day, F.lit("1998-08-01").cast("date")).cast("double").alias("remaining_days"), F.date_format(day, "yyyy-MM-dd").alias("date_created"))
    return rules.with_checks(tenders, F.lit("1998-08-01").cast("date")).select("o_orderkey", F.col("checks.submissionDeadlineCheck.triggered").alias("too_late"), F.col("checks.deliveryDeadlineCheck.limitDate").alias("limit_date"))


@query(COVERAGE_SQL + """
SELECT o_orderkey, round(o.o_totalprice, 2) AS price, v.coverage_percent AS percent, v.coverage_approved AS approved, total > 0 AND NOT v.coverage_approved AS rejected, v.price_complete AS complete, total > 0 AS extracted,
  to_json(['rulesVersion', 'reasonOptions', 'productCheck', 'hardReasons', 'initialPriceNumeric', 'submissionDeadlineCheck', 'productCoverageCheck', 'documentationCheck', 'marketResearchCheck', 'deliveryDeadlineCheck']) AS members,
  CASE WHEN o_orderkey % 3 = 0 THEN 21 ELSE 20 END::BIGINT AS options, CASE WHEN total > 0 AND coverage_approved THEN 0 WHEN total = 0 THEN 1 ELSE 1 END::BIGINT AS least_reasons
FROM verdicts v JOIN orders o USING (o_orderkey)""")  # fmt: skip
def decision_context(read: Frame) -> DataFrame:
    lots = order_lots(read).drop("o_orderstatus", "status")
    facts = read("orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("initial_price"), F.when(F.col("o_orderkey") % 3 == 0, 3).otherwise(1).alias("report_id"))
    day = F.lit("1998-08-01").cast("date")
    out = rules.decision_context(rules.with_checks(rules.hard_reasons(lots.join(facts, "o_orderkey"), day), day))
    get = lambda path: F.get_json_object("context", f"$.{path}")
    check = lambda name: F.col(f"checks.{name}")
    least = F.size(F.filter("hard", lambda x: x["reason"].isin(rules.INDIVISIBLE, rules.DOCUMENTATION))).cast("long")
    return out.select(
        "o_orderkey", check("initialPriceNumeric").alias("price"), check("productCoverageCheck.coveragePercent").alias("percent"), check("productCoverageCheck.approved").alias("approved"), check("productCoverageCheck.triggered").alias("rejected"),
        check("productCoverageCheck.quantityAdjustedTotalComplete").alias("complete"), check("documentationCheck.productsExtracted").alias("extracted"),
        F.to_json(F.json_object_keys("context")).alias("members"), F.json_array_length(get("reasonOptions")).cast("long").alias("options"), least.alias("least_reasons"),
    )


#: A phrase for each text rule, by the number that a document's id leaves, and texts that come close; what comes of each.
PHRASES = (
    ("это дубль карточки", rules.DUPLICATE), ("оплата производится после оплаты генподрядчиком", rules.PAY_AFTER), ("поставка в Республику Саха (Якутия)", rules.REMOTE), ("консигнац, за счет поставщика", rules.CONSIGNMENT),
    ("частотный привод на 6 кВ", rules.DRIVE), ("требуется ЗИП", rules.SPARES), ("военная приёмка", rules.MILITARY), ("класс безопасности 3", rules.NUCLEAR), ("МОПП подаёт самостоятельно", rules.SELF_SUBMIT),
    ("закрытый тендер", rules.CLOSED), ("закупка отменена", rules.CANCELLED), ("опрос рынка", rules.MARKET), ("кабель 10 кВ и выключатель 110 кВ", rules.VOLTAGE), ("отсрочка платежа 120 календарных дней", rules.PAY_DELAY),
    ("монтаж силами поставщика", rules.WORKS), ("дублёр", None), ("калининградец", None), ("кабель 34,9 кВ", None), ("отсрочка платежа 89 дней", None), ("монтаж не требуется, монтаж подрядчиком", None),
)
PLANTED_SQL = "".join(f" WHEN {i} THEN '{reason}'" for i, (_, reason) in enumerate(PHRASES) if reason)


@query(f"""SELECT doc_id, CASE doc_id % {len(PHRASES)}{PLANTED_SQL} ELSE '' END AS reasons,
  doc_id % {len(PHRASES)} < {sum(r is not None for _, r in PHRASES)} AS shown FROM documents""")
def text_reasons_planted(read: Frame) -> DataFrame:
    """All text rules over every document's whole text with a phrase after it: what fires, and whether the evidence shows the phrase."""
    phrase = F.element_at(F.array(*[F.lit(p) for p, _ in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    core = F.element_at(F.array(*[F.lit(p.split(" и ")[-1].removesuffix(" дней")) for p, _ in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    tenders = read("documents").select("doc_id", core.alias("core"), F.concat_ws("\n", "text", phrase).alias("all_text"), F.lit(100.0).alias("coverage_percent"), F.lit(1).cast("long").alias("total"), F.lit(3).alias("report_id"))
    found = rules.hard_reasons(tenders, F.lit("2024-01-01").cast("date"))
    return found.select("doc_id", F.array_join(F.transform("hard", lambda x: x["reason"]), " | ").alias("reasons"), F.coalesce(F.get("hard", F.lit(0))["evidence"].contains(F.col("core")), F.lit(False)).alias("shown"))


GAP = r"(?:the|der|los)[\s\S]{0,40}(?:and|und|con)[\s\S]{0,40}(?:of|von|del)"


@query(rf"""SELECT doc_id, regexp_matches(text, '(?i){GAP}(?:[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]|$)') AS gap_hit,
  regexp_extract(text, '(?i)({GAP})(?:[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]|$)', 1) AS gap_text FROM documents""")
def text_rules_docs(read: Frame) -> DataFrame:
    """A text rule on every document and its whole text; a null text has null answers."""
    rule = rules.text_rule(1, "gap", F.col("text"), GAP + r"(?![\p{L}\p{M}\p{Nd}\p{Pc}])")
    return read("documents").select("doc_id", rule.condition.alias("gap_hit"), F.regexp_extract("text", rules.FLAGS + GAP + r"(?![\p{L}\p{M}\p{Nd}\p{Pc}])", 0).alias("gap_text"))


@query(rf"""SELECT doc_id, regexp_matches(text, '(?i){GAP}(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)') AS gap_hit,
  regexp_extract(text, '(?i)({GAP})(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)', 1) AS gap_text FROM documents""")
def text_rules_all_docs(read: Frame) -> DataFrame:
    """The same rule, but no letter number or other digit of any script may follow either."""
    pattern = rf"(?i){GAP}(?![\p{{L}}\p{{M}}\p{{N}}_])"
    return read("documents").select("doc_id", F.col("text").rlike(pattern).alias("gap_hit"), F.regexp_extract("text", pattern, 0).alias("gap_text"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '([0-9]{1,4})', 1), lambda x: x::DOUBLE >= 35))::BIGINT AS large_numbers, coalesce(list_max(list_transform(regexp_extract_all(text, '([0-9]{1,4})', 1), lambda x: x::BIGINT)), -1) AS largest FROM documents""")
def numeric_threshold_text(read: Frame) -> DataFrame:
    found = lambda least: numbers.numbers_in(F.col("text"), "([0-9]{1,4})", least)
    return read("documents").select("doc_id", F.size(found(35)).cast("long").alias("large_numbers"), F.coalesce(F.array_max(found(0)).cast("long"), F.lit(-1).cast("long")).alias("largest"))


@query(r"""WITH hits AS (SELECT doc_id, text, strpos(text, 'token') AS p FROM documents WHERE contains(text, 'token'))
SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, p - 60), p + 65 - greatest(1, p - 60)), '\s+', ' ', 'g')) AS evidence FROM hits""")
def evidence_snippet(read: Frame) -> DataFrame:
    return read("documents").where(F.col("text").contains("token")).select("doc_id", tx.snippet(F.col("text"), "token", 60).alias("evidence"))


# --- functions ------------------------------------------------------------------------------------

MONEY_SQL = "format('{:.2f}', l_extendedprice)"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linenumber % 3 AS k, {MONEY_SQL} AS plain FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS money,
  CASE k WHEN 0 THEN plain::DOUBLE WHEN 1 THEN regexp_extract(regexp_replace(plain, '([0-9])([0-9]{{3}})\\.', '\\1 \\2.'), '([0-9]+(?:[.][0-9]+)?)', 1)::DOUBLE ELSE plain::DOUBLE END AS first_number FROM s""")
def parse_money_cases(read: Frame) -> DataFrame:
    plain = F.format_string("%.2f", "l_extendedprice")
    spaced = F.regexp_replace(plain, r"([0-9])([0-9]{3})\.", "$1 $2.")
    shown = F.when(F.col("l_linenumber") % 3 == 0, plain).when(F.col("l_linenumber") % 3 == 1, F.translate(spaced, ".", ",")).otherwise(F.concat(F.translate(plain, ".", ","), F.lit(" руб.")))
    rows = read("lineitem").withColumn("s", shown)
    return rows.select("l_orderkey", "l_linenumber", numbers.parse_money(F.col("s")).alias("money"), numbers.parse_number(F.col("s")).alias("first_number"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS normal FROM orders")
def parse_dates_mixed(read: Frame) -> DataFrame:
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return read("orders").withColumn("s", shown).select("o_orderkey", dates.parse_date(F.col("s")).cast("string").alias("parsed"), dates.normal_date(F.col("s")).alias("normal"))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ','), '_', ' ') || ' руб.' AS shown FROM orders")
def format_money(read: Frame) -> DataFrame:
    return read("orders").select("o_orderkey", numbers.format_money(F.col("o_totalprice")).alias("shown"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS value, CASE WHEN json_extract_string(props, '$.missing') IS NOT NULL THEN 'missing' ELSE 'k' END AS path FROM events""")
def alias_coalesce_props(read: Frame) -> DataFrame:
    found = tx.first_defined_with_path([(n, F.get_json_object("props", f"$.{n}")) for n in ("missing", "k")])
    return read("events").withColumn("x", found).select("event_id", "x.value", "x.path")


@query("""SELECT event_id, CASE WHEN k % 5 IN (0, 1) THEN 'true' WHEN k % 5 IN (2, 3) THEN 'false' END AS flag, CASE k % 3 WHEN 0 THEN 'RUB' WHEN 1 THEN 'USD' END AS currency
FROM (SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events)""")
def tri_state_flags(read: Frame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    word = F.element_at(F.array(*[F.lit(x) for x in ("да", "Yes", "нет", "false", "может быть")]), (k % 5 + 1).cast("int"))
    money = F.element_at(F.array(*[F.lit(x) for x in ("rur", " usd", "")]), (k % 3 + 1).cast("int"))
    return read("events").select("event_id", tx.available(word).cast("string").alias("flag"), tx.currency(money).alias("currency"))


#: Field values as they are written, #N# standing for a number, and as they are read (null: nothing to read), for each function.
PLANTED_VALUES = {
    "quantity": (numbers.parse_quantity, [("#N#,5 шт", "#N#.5"), ("около #N#", "#N#"), ("-#N#", "#N#"), ("нет", None), ("", None), ("2 x #N#", "2")]),
    "clock": (dates.normal_time, [("в 9.05 #N#", "09:05"), ("23:59", "23:59"), ("#N#", None), ("7:5", None), ("c 10:30 до 12:00", "10:30")]),
    "inn": (tx.tax_number, [("12345-67890", "1234567890"), ("ИНН 123456789012", "123456789012"), ("123", None), ("12345678901", None)]),
    "kpp": (tx.registration_code, [("12345 6789", "123456789"), ("1234567890", None), ("КПП:000000001", "000000001")]),
    "file_name": (tx.safe_filename, [("a/b/%D0%94oc#N#.pdf", "Дoc#N#.pdf"), ("x<y>|#N#?.txt", "x_y__#N#_.txt"), ("C:\\dir\\f#N#.doc", "f#N#.doc"), ("dir/", "")]),
    "article": (tx.catalog_id, [("https://h/cat/nn/A#N#?x", "A#N#"), ("https://h/CAT/NN/b#N#/c", "b#N#"), ("https://h/x", None)]),
    "name_key": (tx.name_key, [("Насос  Ёлка-#N# (шт.)", "насос елка #N# шт"), ("undefined X#N#", "x#N#"), ("«»", "")]),
    "currency": (tx.currency_in, [("#N# руб.", "RUB"), ("#N# ₽", "RUB"), ("USD #N#", None), ("рубероид", None)]),
    "header": (tx.header_role, [("Цена за единицу", "unit_price"), ("Кол-во", "quantity"), ("Ед. изм.", "unit"), ("Наименование товара", "product"), ("Сумма, руб", "line_total"), ("Прочее #N#", None)]),
    "value": (tx.real_value, [("  NULL ", None), (" v#N# ", "v#N#"), ("Товар не найден", None), ("0", "0")]),
}


def listed_sql(values: list, index: str) -> str:
    """SQL for the value of a list of texts at an index, with the order's customer in place of #N#."""
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"replace(list_extract([{shown}]::VARCHAR[], ({index} % {len(values)} + 1)::INTEGER), '#N#', o_custkey::VARCHAR)"


@query("SELECT o_orderkey, " + ", ".join(listed_sql([want for _, want in cases], "o_orderkey") + ("::DOUBLE" if name == "quantity" else "") + f" AS {name}" for name, (_, cases) in PLANTED_VALUES.items()) + " FROM orders")
def field_values(read: Frame) -> DataFrame:
    """Each reader of field values on many shapes."""
    written_as = lambda cases: F.replace(F.element_at(F.array(*[F.lit(raw) for raw, _ in cases]), (F.col("o_orderkey") % len(cases) + 1).cast("int")), F.lit("#N#"), F.col("o_custkey").cast("string"))
    return read("orders").select("o_orderkey", *[f(written_as(cases)).alias(name) for name, (f, cases) in PLANTED_VALUES.items()])


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_replace(url, '[?#].*$', '') AS shown, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages""")
def url_parts(read: Frame) -> DataFrame:
    url = F.col("url")
    return read("pages").select("page_id", tx.host(url).alias("host"), tx.loggable_url(url).alias("shown"), F.nullif(F.regexp_extract(url, "/([0-9]+)", 1), F.lit("")).alias("number"))


# texts between tags, each trimmed; references as they occur in the given pages, some without a semicolon
BARE_SQL = r"""bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '<br>', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '<br>', 'g'), '(?s)<!--.*?-->', '<br>', 'g') AS t FROM pages),
plain AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '</?[A-Za-z][^>]*>|<[!?][^>]*>'),
  lambda x: regexp_replace(replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS joined FROM bare),
page AS (SELECT page_id, regexp_replace(regexp_replace(joined, '\n{3,}', chr(10) || chr(10), 'g'), '&amp;?', '&', 'g') AS text FROM plain)"""


@query(f"WITH {BARE_SQL} SELECT page_id, text FROM page")
def html_to_text(read: Frame) -> DataFrame:
    return read("pages").select("page_id", tx.page_text(F.col("html")).alias("text"))


#: What is planted behind a page, and how it reads.
PLANTED_MARKUP = (
    ("<p>&laquo;Кабель&raquo; &mdash; &#1056;&#x420;&#X44F;", "«Кабель» — РРя"),
    ("<p>  a\n&nbsp;<b> b</b>&emsp;</p>&#8194;<i></i>c", "a\nb\nc"),
    ("<p>x<noscript>gone</noscript>y<STYLE>p{}</STYLE >z<script>not closed <p>", "x\ny\nz"),
    ("<p>&amp;lt;b&amp;gt; &ltd &notit; &unknown; &#xD800;&#150;&#0;", "<b> <d ¬it; &unknown; �–�"),
    ("<p>1 < 2 and 3 > 2 <!-- not closed <p> at all", "1 < 2 and 3 > 2"),
    ("<p>&hearts;&hellip;&CounterClockwiseContourIntegral;&para&sect;", "♥…∳¶§"),
    ("<p>A<br>\n\n\n\n<br/>B\n\n\n\n\nC</p> ", "A\nB\n\nC"),
)


@query(f"""WITH {BARE_SQL} SELECT page_id, CASE WHEN text = '' THEN '' ELSE text || chr(10) END || list_extract([{", ".join("'" + shown.replace(chr(10), "' || chr(10) || '") + "'" for _, shown in PLANTED_MARKUP)}], (page_id % {len(PLANTED_MARKUP)} + 1)::INTEGER) AS text FROM page""")
def html_references_planted(read: Frame) -> DataFrame:
    """Pages that end in references of all kinds, odd white space and markup that is never closed."""
    planted = F.element_at(F.array(*[F.lit(raw) for raw, _ in PLANTED_MARKUP]), (F.col("page_id") % len(PLANTED_MARKUP) + 1).cast("int"))
    return read("pages").select("page_id", tx.page_text(F.concat("html", F.lit("<hr>"), planted)).alias("text"))


# --- documents ------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, (generate_subscripts(x, 1) - 1)::INTEGER AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)""")
def doc_lines(read: Frame) -> DataFrame:
    return positions.lines(read("documents"), ["doc_id"]).select("doc_id", "line_no", "line")


@query(r"""SELECT doc_id, CASE WHEN length(text) >= 500 AND regexp_matches(text, '[A-Za-z0-9]') THEN 'ok' WHEN length(text) >= 100 THEN 'short' ELSE 'unusable' END AS status FROM documents""")
def doc_quality_status(read: Frame) -> DataFrame:
    return read("documents").select("doc_id", documents.text_status(F.col("text")).alias("status"))


@query(r"""SELECT doc_id, CASE WHEN length(text) >= 500 AND regexp_matches(regexp_replace(text, '[0-9]', '', 'g'), '[\p{L}\p{N}]') THEN 'ok' WHEN length(text) >= 100 THEN 'short' ELSE 'unusable' END AS russian,
  CASE WHEN length(text) >= 100 THEN 'short' ELSE 'unusable' END AS dashes FROM documents""")
def doc_quality_cyrillic(read: Frame) -> DataFrame:
    """The texts in Cyrillic letters without digits, and as dashes: only the latter have nothing to read."""
    latin = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    russian = F.regexp_replace(F.translate("text", latin, "абвгдежзийклмнопрстуфхцчшщАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩ"), "[0-9]", "-")
    return read("documents").select("doc_id", documents.text_status(russian).alias("russian"), documents.text_status(F.regexp_replace("text", "(?s).", "-")).alias("dashes"))


@query("""SELECT source, count(*) AS requested, count(*) FILTER (length(text) >= 500) AS parsed, string_agg(CASE WHEN length(text) < 100 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS unusable,
  CASE WHEN count(*) FILTER (length(text) >= 500) = 0 THEN 'unavailable' WHEN count(*) FILTER (length(text) < 100) > 0 THEN 'partial' ELSE 'available' END AS status FROM documents GROUP BY source""")
def doc_status_by_source(read: Frame) -> DataFrame:
    docs = read("documents").withColumn("n", F.length("text"))
    requested = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_requested"))
    # texts that are too short for one but not unusable are parsed in part: neither read nor failed
    parsed = docs.where((F.col("n") >= documents.TEXT_LENGTH) | (F.col("n") < documents.SHORT_LENGTH)).select(
        "source", F.col("doc_id").alias("document_index"), F.col("doc_id").cast("string").alias("file_name"), (F.col("n") >= documents.TEXT_LENGTH).alias("text_ok"), F.lit("ok").alias("status"), F.lit("").alias("warning"), F.lit("").alias("error")
    )
    out = documents.availability(requested, parsed, ["source"])
    return out.select("source", F.col("n_requested").alias("requested"), F.col("documents_parsed").alias("parsed"), F.nullif(F.array_join("files_without_text", ","), F.lit("")).alias("unusable"), F.col("processing_status").alias("status"))


@query("""WITH b AS (SELECT doc_id, source, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, text FROM documents)
SELECT doc_id, used::BIGINT AS used, md5(substr(text, 1, greatest(0, 50000 - used)::BIGINT)) AS clipped_md5 FROM b""")
def char_budget_clip(read: Frame) -> DataFrame:
    return within_budget(read("documents").select("doc_id", "source", "text"), ["source"], ["doc_id"], "text", 50_000).select("doc_id", F.col("used").cast("long").alias("used"), F.md5("clipped").alias("clipped_md5"))


@query("""SELECT DISTINCT l_orderkey, 'Item ' || l_partkey % 5 AS product, l_quantity % 3 AS quantity, CASE l_suppkey % 3 WHEN 0 THEN 'шт' WHEN 1 THEN 'компл' ELSE '' END AS unit FROM lineitem""")
def structured_purchases(read: Frame) -> DataFrame:
    """Line items of purchases as JSON: own products and those of lots, numbers and units in several shapes, equal ones once."""
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey") % 3
    name, quantity = F.concat(F.lit("Item "), (F.col("l_partkey") % 5).cast("string")), (F.col("l_quantity") % 3).cast("int").cast("string")
    unit = F.when(supplier == 0, '"unit": "шт"').when(supplier == 1, '"okei": {"code": "1", "shortName": " компл "}').otherwise('"unit": ""')
    item = F.when(line % 3 == 0, F.concat(F.lit('{"product": {"name": "'), name, F.lit('"}, "qty": "'), quantity, F.lit(',0", '), unit, F.lit("}"))).when(
        line % 3 == 1, F.concat(F.lit('{"title": "'), name, F.lit('", "count": '), quantity, F.lit(", "), unit, F.lit("}"))
    ).otherwise(F.concat(F.lit('{"productName": "  '), name, F.lit(' ", "quantity": "'), quantity, F.lit(' ед", '), unit, F.lit("}")))
    rows = read("lineitem").select("l_orderkey", item.alias("item"), (line % 2 == 0).alias("own"))
    listed = lambda own: F.array_join(F.collect_list(F.when(F.col("own") == own, F.col("item"))), ", ")
    purchases = rows.groupBy("l_orderkey").agg(F.concat(F.lit('{"items": ['), listed(True), F.lit('], "lots": [{"products": ['), listed(False), F.lit("]}]}")).alias("purchase"))
    return positions.structured_positions(purchases, ["l_orderkey"]).select("l_orderkey", "product", "quantity", "unit")


FOLDER_SQL = """docs AS (SELECT doc_id, doc_id % 7 + 1 AS q, 'Item' || chr((65 + doc_id % 20)::INTEGER) || ' ' || source AS name FROM documents)"""


@query(f"""WITH {FOLDER_SQL} SELECT doc_id, 1 AS kind, name AS product, 'шт' AS unit, q::DOUBLE AS quantity FROM docs UNION ALL SELECT doc_id, 2, 'Насос ' || q, 'компл', q + 0.5 FROM docs""")
def unit_row_positions(read: Frame) -> DataFrame:
    """Line items of a row without headers and of a labelled free text, planted for each document."""
    q = (F.col("doc_id") % 7 + 1).cast("string")
    name = F.concat(F.lit("Item"), F.char(F.lit(65) + F.col("doc_id") % 20), F.lit(" "), F.col("source"))
    row = F.concat(F.lit("Строка 2: A: 1 | B: "), name, F.lit(" | D: шт | E: "), q)
    label = F.concat(F.lit("Наименование товара: Насос "), q, F.lit(" | Ед. изм.: компл | Кол-во: "), q, F.lit(",5"))
    texts = read("documents").select("doc_id", F.concat_ws("\n", row, F.lit("Строка 3: A: 2 | B: Итого | E: 9"), label).alias("text"))
    out = positions.deterministic_positions(texts, ["doc_id"])
    return out.select("doc_id", F.col("ord.kind").cast("int").alias("kind"), "product", "unit", "quantity")


@query("""SELECT doc_id, md5('--- ДАННЫЕ ЗАКУПКИ ИЗ SELDON API ---' || chr(10) || 'Seldon ID: ' || doc_id || chr(10) || 'Report ID: 3' || chr(10) || 'Номер закупки на площадке: ' || CASE WHEN doc_id % 2 = 0 THEN 'N' || doc_id ELSE 'E' END || chr(10) ||
  'Предмет закупки: ' || source || chr(10) || 'Начальная цена / НМЦ: ' || n_chars || chr(10) || 'Дата публикации: ' || chr(10) || 'Дата начала подачи: ' || chr(10) || 'Дата окончания подачи: ' || chr(10) || 'Ссылка на источник: ' || chr(10) || chr(10) ||
  '--- ПОЛНЫЕ СТРУКТУРИРОВАННЫЕ ДАННЫЕ SELDON ---' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '{"number":"N' || doc_id || '","name":"' || source || '","nmck":' || n_chars || '}' ELSE '{"name":"' || source || '","nmck":' || n_chars || '}' END || chr(10) || chr(10) ||
  '--- АКТУАЛЬНЫЕ ДОКУМЕНТЫ SELDON ---' || chr(10) || '[{"fileName":"' || lang || '.txt","version":null}]') AS page_md5 FROM documents""")  # fmt: skip
def page_text_assembly(read: Frame) -> DataFrame:
    docs = read("documents")
    purchase = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("N"), F.col("doc_id").cast("string"))).alias("number"), F.col("source").alias("name"), F.col("n_chars").alias("nmck")))
    tenders = docs.select("doc_id", F.col("doc_id").alias("seldon_id"), F.lit(3).alias("report_id"), F.lit("E").alias("etp_id"), F.lit(None).cast("string").alias("tender_url"), purchase.alias("purchase"))
    files = docs.select("doc_id", F.lit(1).alias("index"), F.concat("lang", F.lit(".txt")).alias("fileName"), F.lit(None).cast("string").alias("version"))
    return documents.full_page_text(tenders, files, ["doc_id"]).select("doc_id", F.md5("page_text").alias("page_md5"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_clerk END AS source, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(repeat(o_orderpriority, 200), 1, 900) END AS evidence
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, 'c' || (o_custkey % 5) AS o_clerk FROM orders)""")  # fmt: skip
def field_writes(read: Frame) -> DataFrame:
    """A field written with its meta over an older value; a blank one leaves both as they were."""
    none = F.expr("cast(map() as map<string,struct<source:string,confidence:string,evidence:string>>)")
    value = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderstatus"))
    source = F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string"))
    fields, meta = normalize.written_field(F.create_map(F.lit("status"), F.lit("old")), none, "status", value, source, F.lit("high"), F.repeat("o_orderpriority", 200))
    about = F.try_element_at(meta, F.lit("status"))
    return read("orders").select("o_orderkey", F.element_at(fields, F.lit("status")).alias("value"), about["source"].alias("source"), about["evidence"].alias("evidence"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' ELSE 'rar' END AS file_type, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'unsupported' END AS status,
  CASE WHEN doc_id % 4 = 0 THEN 'Лист: CSV' || chr(10) || 'Строка 1: A: Наименование | B: Кол-во' || chr(10) || 'Строка 2: A: ' || source || ' | B: ' || doc_id
    WHEN doc_id % 4 = 2 THEN substr('Лист: CSV' || chr(10) || 'Строка 1: A: ' || repeat('x', 300), 1, 200) END AS text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS warnings FROM documents""")  # fmt: skip
def parsed_file_texts(read: Frame) -> DataFrame:
    """A file for each document, told by type, read by its reader and clipped."""
    from .sources.files import parsed_files

    k = F.col("doc_id") % 4
    table = F.encode(F.concat(F.lit("Наименование;Кол-во\n"), F.col("source"), F.lit(";"), F.col("doc_id").cast("string"), F.lit("\n")), "UTF-8")
    wide = F.encode(F.repeat(F.lit("x"), 300), "UTF-8")
    content = F.when(k == 0, table).when(k == 1, F.unhex(F.lit("255044462D"))).when(k == 2, wide).otherwise(F.unhex(F.lit("526172211A0700")))
    name = F.concat(F.col("doc_id").cast("string"), F.when(k % 2 == 0, ".csv").otherwise(".bin"))
    out = parsed_files(read("documents").select("doc_id", name.alias("name"), content.alias("content")), ["doc_id"], most=200)
    return out.select("doc_id", "file_type", "status", "text", F.size("warnings").cast("long").alias("warnings"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_fold(read: Frame) -> DataFrame:
    rows = read("conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("said"))
    threads = audit.runs_with_events(rows.select("conv_id").distinct(), rows, "conv_id", ("turn",))
    return threads.select("conv_id", F.array_join(F.transform("events", lambda x: x["said"]), "\n").alias("said"), F.size("events").cast("long").alias("turns"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(read: Frame) -> DataFrame:
    return documents.equal_contents(read("documents"), "doc_id", "text").select(F.col("md5").alias("digest"), "n", F.col("first_doc_id").alias("first_doc"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id""")
def ordered_unique_list(read: Frame) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return read("conversations").groupBy("conv_id").agg(F.array_join(tx.ordered_unique(roles), ",").alias("roles"))


# --- windows and merges ---------------------------------------------------------------------------


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS last_signup FROM events""")
def header_forward_fill(read: Frame) -> DataFrame:
    signup = F.when(F.col("event_type") == "signup", F.col("event_id").cast("double"))
    return positions.filled(read("events"), ["user_id"], ["ts", "event_id"], {"last_signup": signup}).select("event_id", "last_signup")


@query("""SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM events""")
def segment_ids(read: Frame) -> DataFrame:
    return positions.numbered_segments(read("events"), ["user_id"], ["event_id"], F.col("event_type") == "signup").select("event_id", "segment")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS quantity_before, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
  last_value(CASE WHEN l_linestatus = 'F' THEN l_orderkey END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS last_filled FROM (SELECT * FROM lineitem) WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)""")
def hot_prefix_scan(read: Frame) -> DataFrame:
    """Running values over three keys that hold all rows, each dealt over many ranges."""
    rows = read("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    values = {"quantity_before": ("before", F.col("l_quantity")), "n": ("count", F.lit(1)), "last_filled": ("last", F.when(F.col("l_linestatus") == "F", F.col("l_orderkey").cast("double")))}
    return prefix_scan(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], values, most=0).drop("l_quantity", "l_linestatus")


@query("""SELECT source, event_type, event_id FROM (SELECT user_id AS source, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedup_first_wins(read: Frame) -> DataFrame:
    return matching.first_by(read("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select(F.col("user_id").alias("source"), "event_type", "event_id")


MERGE_SQL = """WITH s AS (SELECT l_orderkey AS k, l_partkey AS part, l_suppkey % 3 AS rank, l_linenumber * 100000000 + l_suppkey * 100 + l_quantity::BIGINT AS ord, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS q, l_extendedprice AS price FROM lineitem),
t AS (SELECT k, part, arg_max(struct_pack(q := q), ord) FILTER (rank = 1) AS s1, arg_max(struct_pack(q := q), ord) FILTER (rank = 2) AS s2, arg_max(price, ord) FILTER (rank = 2) AS p2 FROM s GROUP BY 1, 2),
m AS (SELECT s.k, s.part, s.rank, s.ord, coalesce(s1.q, s2.q, s.q) AS quantity, coalesce(p2, s.price) AS price FROM s JOIN t USING (k, part)),
d AS (SELECT *, row_number() OVER (PARTITION BY k, part, quantity ORDER BY rank, ord) AS rn FROM m)
SELECT k AS l_orderkey, part AS l_partkey, rank, ord, quantity, price FROM d WHERE rn = 1"""


@query(MERGE_SQL)
def priority_merge(read: Frame) -> DataFrame:
    rows = read("lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_suppkey") % 3).alias("rank"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ord"), F.col("l_partkey").cast("string").alias("product"), F.lit(None).cast("string").alias("product_query"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("quantity"), F.lit("шт").alias("unit"), F.col("l_extendedprice").alias("document_unit_price"),
        F.lit(None).cast("double").alias("document_line_total"), F.lit("RUB").alias("document_currency"), F.lit("").alias("document_price_evidence"),
    )
    return positions.merged(rows, ["l_orderkey"]).select("l_orderkey", "l_partkey", "rank", "ord", "quantity", F.col("document_unit_price").alias("price"))


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id")
def backfill_first_non_null(read: Frame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = read("events").select("user_id", "event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("first_purchase"))
    return matching.first_by(rows, ["user_id"], [F.col("event_id")]).select("user_id", "first_purchase")


# --- matching -------------------------------------------------------------------------------------

KNN_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS score FROM v q JOIN v ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


#: Cells that a probe reads. The given vectors have no clusters to speak of, so many are needed for nine tenths of the nearest ones.
PROBES = 280


def nearest(read: Frame, k: int) -> DataFrame:
    """The stated queries (every vector whose id is divisible by 50) against all vectors."""
    vectors = read("embeddings")
    return matching.top_k(vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), vectors, k)


@query(KNN_SQL + " SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn_topk(read: Frame) -> DataFrame:
    return nearest(read, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(KNN_SQL + " SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_index_topk(read: Frame) -> DataFrame:
    """The same by the cluster index, whose bounds leave the result exact."""
    vectors = read("embeddings")
    found, _ = vector_index.search(vector_index.build(vectors), vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_index_report(read: Frame) -> DataFrame:
    """For each stated query: vectors in all, cells and vectors that the exact search and a probe of PROBES cells read, and how many of the ten nearest the probe finds."""
    vectors = read("embeddings")
    index = vector_index.build(vectors)
    asked = vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    (exact, all_read), (near, few_read) = vector_index.search(index, asked, 10), vector_index.search(index, asked, 10, PROBES)
    hits = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("nearest"))
    few = vector_index.reads(index, few_read).withColumnsRenamed({"cells": "probe_cells", "vectors": "probe_vectors"})
    return hits.join(vector_index.reads(index, all_read), "query_id").join(few, "query_id").withColumn("indexed", F.lit(index.vectors.count()))


@query(KNN_SQL + " SELECT query_id, count(*) FILTER (label = query_label) AS same_label, count(*) AS n FROM r WHERE rank <= 11 GROUP BY query_id")
def knn_label_vote(read: Frame) -> DataFrame:
    labels = read("embeddings").select("vec_id", "label")
    met = nearest(read, 11).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return met.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("query_label")).alias("same_label"), F.count(F.lit(1)).alias("n"))


#: Replies with the number {n} in them, and how they are told: origin and whether they were repaired (null: nothing to read).
PLANTED_REPLIES = (
    ('{{"n": {n}, "fields": {{"a": "x"}}}}', "raw", False), ('So:\n```json\n{{"n": {n}, "fields": {{"a": "x"}}}}\n```', "markdown_fence", False), ('It is {{"n": {n}, "fields": {{"a": "x"}}}} indeed', "object_bounds", False),
    ('{{"n": {n} "fields": {{"a": "x" }},}}', "raw", True), ("{{'n': {n}, fields: {{'a': 'x',, }} }}", "raw", True), ('{{"n": {n}, "fields": {{"a": "x"', "raw", True), ('{{"n": {n}, "fields": {{"a": "x', "raw", True),
    ('Here:\n```json\n{{"n": {n}, "fields": {{"a": "x", "b": [1, 2}}}}\n```', "markdown_fence", True), ('Sure {{"n" {n} "fields": {{"a" : x, "b": }} , "c": True}} bye', "object_bounds", True), ("plain {n}", None, None), ("", None, None),
)


@query(f"""SELECT o_orderkey, CASE WHEN origin IS NOT NULL THEN o_custkey::VARCHAR END AS n, CASE WHEN origin IS NOT NULL THEN 'x' END AS a, origin, repaired FROM (SELECT *,
  list_extract([{", ".join("NULL" if o is None else f"'{o}'" for _, o, _ in PLANTED_REPLIES)}], (o_orderkey % {len(PLANTED_REPLIES)} + 1)::INTEGER) AS origin, list_extract([{", ".join("NULL" if r is None else str(r) for _, _, r in PLANTED_REPLIES)}]::BOOLEAN[], (o_orderkey % {len(PLANTED_REPLIES)} + 1)::INTEGER) AS repaired FROM orders)""")
def repaired_replies(read: Frame) -> DataFrame:
    """Replies of a model in all states of repair."""
    number = F.col("o_custkey").cast("string")
    shapes = [F.replace(F.lit(raw.format(n="#N#")), F.lit("#N#"), number) for raw, _, _ in PLANTED_REPLIES]
    said = read("orders").select("o_orderkey", F.element_at(F.array(*shapes), (F.col("o_orderkey") % len(shapes) + 1).cast("int")).alias("reply"))
    told = said.select("o_orderkey", answers.json_result(F.col("reply")).alias("r"))
    return told.select("o_orderkey", F.get_json_object("r.json", "$.n").alias("n"), F.get_json_object("r.json", "$.fields.a").alias("a"), "r.origin", "r.repaired")


@query("""SELECT p_brand, round(median(p_retailprice), 2) AS median_price, count(p_retailprice) AS priced, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS fields FROM part GROUP BY p_brand""")
def same_product_median(read: Frame) -> DataFrame:
    rows = read("part").select(F.lit(1).alias("q"), F.col("p_brand").alias("product_id"), F.col("p_partkey").cast("string").alias("point_id"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("unit_price"), F.col("p_type").alias("price_field"), F.lit("RUB").alias("currency"))
    return matching.same_product_prices(rows, ["q"]).select(F.col("product_id").alias("p_brand"), F.round("median_price", 2).alias("median_price"), "priced", "fields")


@query("""WITH s AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) SELECT p_brand, p_size, CASE WHEN n > 1 THEN 'median_same_product_id' ELSE 'selected_candidate' END AS price_method, n FROM s""")
def price_source_label(read: Frame) -> DataFrame:
    rows = read("part").select(
        "p_brand", F.col("p_size").cast("string").alias("product_id"), F.col("p_partkey").cast("string").alias("point_id"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("unit_price"), F.col("p_type").alias("price_field"),
        F.lit("RUB").alias("currency"), F.col("p_name").alias("name"), F.lit("").alias("manufacturer"), F.lit("").alias("url"),
    )
    chosen = rows.groupBy("p_brand", "product_id").agg(F.min_by("point_id", "pos").alias("point_id")).select("p_brand", "point_id", F.lit("Аналог").alias("correspondence"), F.lit("").alias("rationale"))
    return matching.hydrated(chosen, rows, ["p_brand"]).select("p_brand", F.col("product_id").cast("int").alias("p_size"), "price_method", F.col("priced").alias("n"))


@query("""SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_customers_scored(read: Frame) -> DataFrame:
    from .operators.customer import best_scored

    return best_scored(read("orders"), ["o_custkey"], F.col("o_totalprice"), F.col("o_orderkey"), 3).select("o_custkey", "o_orderkey", "rank")


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_suppkey % 4 AS code, s_name FROM supplier), m AS (SELECT c_custkey, s_name, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(code = c_custkey % 4, false) DESC, s_suppkey) AS rn, count(s_suppkey) OVER (PARTITION BY c_custkey) AS n FROM customer LEFT JOIN r ON c_nationkey = s_nationkey)
SELECT c_custkey, CASE WHEN s_name IS NULL THEN 'not_found' ELSE 'matched' END AS status, s_name AS matched_name, n AS by_inn_count FROM m WHERE rn = 1""")
def registry_lookup(read: Frame) -> DataFrame:
    from .operators.customer import looked_up

    wanted = read("customer").select("c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("inn"), F.lpad((F.col("c_custkey") % 4).cast("string"), 9, "0").alias("kpp"))
    registry = read("supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("inn"), F.lpad((F.col("s_suppkey") % 4).cast("string"), 9, "0").alias("kpp"), F.col("s_name").alias("full_name"), F.lit("").alias("short_name"), F.col("s_suppkey").alias("pos"))
    return looked_up(wanted, registry, "c_custkey").select("c_custkey", "status", "matched_name", "by_inn_count")


#: Numbers as they are written: digits apart, too few or too many of them, none.
NUMBERS_SQL = """CASE {c} % 6 WHEN 0 THEN lpad({n}::VARCHAR, 10, '0') WHEN 1 THEN '12-' || {n} WHEN 2 THEN substr(lpad({n}::VARCHAR, 12, '0'), 1, 6) || ' ' || substr(lpad({n}::VARCHAR, 12, '0'), 7) WHEN 3 THEN NULL WHEN 4 THEN 'ИНН ' || lpad({n}::VARCHAR, 10, '0') ELSE {n}::VARCHAR END"""
MALFORMED_SQL = f"""WITH w AS (SELECT c_custkey, regexp_replace(coalesce({NUMBERS_SQL.format(c="c_custkey", n="c_nationkey")}, ''), '[^0-9]', '', 'g') AS inn, CASE WHEN c_custkey % 5 < 3 THEN lpad((c_custkey % 4)::VARCHAR, 9, '0') ELSE (c_custkey % 4)::VARCHAR END AS kpp FROM customer),
r AS (SELECT s_suppkey AS pos, s_name, regexp_replace(coalesce({NUMBERS_SQL.format(c="s_suppkey", n="s_nationkey")}, ''), '[^0-9]', '', 'g') AS inn, CASE WHEN s_suppkey % 2 = 0 THEN lpad((s_suppkey % 4)::VARCHAR, 9, '0') END AS kpp FROM supplier),
m AS (SELECT c_custkey, w.inn, s_name, count(pos) OVER (PARTITION BY c_custkey) AS n, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(length(w.kpp) = 9 AND w.kpp = r.kpp, false) DESC, pos) AS rn
  FROM w LEFT JOIN r ON w.inn = r.inn AND length(w.inn) IN (10, 12))
SELECT c_custkey, CASE WHEN n > 0 THEN 'matched' ELSE 'not_found' END AS status, CASE WHEN n = 0 THEN CASE WHEN length(inn) IN (10, 12) THEN 'listed' ELSE 'number' END END AS missing, s_name AS matched_name, n AS by_inn_count FROM m WHERE rn = 1"""


@query(MALFORMED_SQL)
def registry_lookup_malformed(read: Frame) -> DataFrame:
    """Numbers of all shapes on both sides; only those of a tax number's length can match."""
    from .operators.customer import NO_NUMBER, looked_up

    def number(c: str, n: str):
        n, k = F.col(n).cast("string"), F.col(c) % 6
        spaced = F.concat(F.substring(F.lpad(n, 12, "0"), 1, 6), F.lit(" "), F.substring(F.lpad(n, 12, "0"), 7, 6))
        return F.when(k == 0, F.lpad(n, 10, "0")).when(k == 1, F.concat(F.lit("12-"), n)).when(k == 2, spaced).when(k == 3, None).when(k == 4, F.concat(F.lit("ИНН "), F.lpad(n, 10, "0"))).otherwise(n)

    code = lambda c: F.lpad((F.col(c) % 4).cast("string"), 9, "0")
    wanted = read("customer").select("c_custkey", number("c_custkey", "c_nationkey").alias("inn"), F.when(F.col("c_custkey") % 5 < 3, code("c_custkey")).otherwise((F.col("c_custkey") % 4).cast("string")).alias("kpp"))
    registry = read("supplier").select(number("s_suppkey", "s_nationkey").alias("inn"), F.when(F.col("s_suppkey") % 2 == 0, code("s_suppkey")).alias("kpp"), F.col("s_name").alias("full_name"), F.lit("").alias("short_name"), F.col("s_suppkey").alias("pos"))
    missing = F.when(F.col("reason") == NO_NUMBER, "number").when(F.col("reason").isNotNull(), "listed")
    return looked_up(wanted, registry, "c_custkey").select("c_custkey", "status", missing.alias("missing"), "matched_name", "by_inn_count")


# --- jobs and audit -------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(event_id) FILTER (event_type = 'purchase')::DOUBLE AS last_purchase, count(*) AS n FROM events GROUP BY user_id")
def job_latest_state(read: Frame) -> DataFrame:
    events = read("events")
    latest = audit.ranked_latest(events, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("latest"))
    bought = audit.high_water(events.withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("event_id"))), ["user_id"], ["bought"])
    counted = audit.conditional_counts(events, "event_type", [], ("user_id",))
    return latest.join(bought, "user_id").join(counted, "user_id").select("user_id", "latest", F.col("peak_bought").cast("double").alias("last_purchase"), F.col("total").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'dispatch' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'requeue' END AS move,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, 'queued' AS status, 0 AS attempt, NULL::VARCHAR AS worker FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, m.rn,
    CASE WHEN m.move = 'dispatch' AND f.status = 'queued' THEN 'dispatching' WHEN m.move = 'claim' AND f.status = 'dispatching' THEN 'processing' WHEN m.move = 'complete' AND f.status = 'processing' AND f.worker = 'w' THEN 'completed'
      WHEN m.move = 'fail' AND f.status = 'processing' AND f.worker = 'w' THEN 'failed' WHEN m.move = 'requeue' AND f.status = 'failed' THEN 'queued' ELSE f.status END,
    f.attempt + CASE WHEN m.move = 'claim' AND f.status = 'dispatching' THEN 1 ELSE 0 END, CASE WHEN m.move = 'claim' AND f.status = 'dispatching' THEN 'w' ELSE f.worker END
  FROM f JOIN m ON m.user_id = f.user_id AND m.rn = f.rn + 1)
SELECT user_id AS record_key, arg_max(status, rn) AS status, arg_max(attempt, rn) AS attempt, arg_max(worker, rn) FILTER (worker IS NOT NULL) AS worker FROM f GROUP BY user_id""")
def job_state_fold(read: Frame) -> DataFrame:
    moves = F.create_map(*[F.lit(x) for p in (("signup", "dispatch"), ("view", "claim"), ("purchase", "complete"), ("error", "fail"), ("click", "requeue")) for x in p])
    rows = read("events").select(F.col("user_id").alias("record_key"), F.col("ts").alias("event_time"), "event_id", F.try_element_at(moves, F.col("event_type")).alias("move"), F.lit("w").alias("worker"))
    return jobs.folded(rows)


#: What is taken for a job's moves, the minutes that a state may last here, and when all is looked at.
JOB_MOVES = {"signup": "dispatch", "view": "claim", "purchase": "complete", "error": "fail", "click": "claim"}
JOB_MINUTES, JOB_UNTIL = (900, 1500), "2024-02-20"
LIFECYCLE_SQL = f"""WITH RECURSIVE m AS (SELECT user_id, ts, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOB_MOVES.items())} END AS move, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, 'queued' AS status, 0 AS attempt, NULL::TIMESTAMP AS since FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, nrn,
    CASE WHEN move = 'dispatch' AND st = 'queued' THEN 'dispatching' WHEN move = 'claim' AND st = 'dispatching' THEN 'processing' WHEN move = 'complete' AND st = 'processing' THEN 'completed' WHEN move = 'fail' AND st = 'processing' THEN 'failed' ELSE st END,
    attempt + CASE WHEN move = 'claim' AND st = 'dispatching' THEN 1 ELSE 0 END,
    CASE WHEN (move = 'dispatch' AND st = 'queued') OR (move = 'claim' AND st = 'dispatching') OR (move IN ('complete', 'fail') AND st = 'processing') THEN ts WHEN st <> status THEN due ELSE since END
  FROM (SELECT *, CASE WHEN ts > due THEN 'queued' ELSE status END AS st FROM (SELECT f.*, m.ts, m.move, m.rn AS nrn,
    CASE status WHEN 'dispatching' THEN since + INTERVAL {JOB_MINUTES[0]} MINUTE WHEN 'processing' THEN since + INTERVAL {JOB_MINUTES[1]} MINUTE WHEN 'failed' THEN CASE WHEN attempt < 3 THEN since END END AS due FROM f JOIN m ON m.user_id = f.user_id AND m.rn = f.rn + 1))),
l AS (SELECT user_id, arg_max(status, rn) AS status, arg_max(attempt, rn) AS attempt FROM f GROUP BY user_id)
SELECT user_id AS record_key, CASE WHEN status IN ('dispatching', 'processing') OR (status = 'failed' AND attempt < 3) THEN 'queued' ELSE status END AS status, attempt FROM l"""


def job_moves(read: Frame) -> DataFrame:
    moves = F.create_map(*[F.lit(x) for pair in JOB_MOVES.items() for x in pair])
    return read("events").select(F.col("user_id").cast("string").alias("record_key"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", F.try_element_at(moves, F.col("event_type")).alias("move"), F.lit("w").alias("worker"))


@query(LIFECYCLE_SQL)
def job_lifecycle(read: Frame) -> DataFrame:
    """Job states with what happens without events: stuck jobs and failed ones go back to the queue."""
    out = jobs.lifecycle(job_moves(read), F.lit(JOB_UNTIL), dispatch_minutes=JOB_MINUTES[0], process_minutes=JOB_MINUTES[1])
    return out.select(F.col("record_key").cast("long").alias("record_key"), "status", "attempt")


@query(LIFECYCLE_SQL)
def streaming_job_lifecycle(read: Frame) -> DataFrame:
    """The same as a stream of all moves in parts of the time range, shuffled within a part, with timers; a last row lets the time pass."""
    from .shared import shared_dir
    from .streaming.events import drained
    from .streaming.lifecycle import Limits, job_changes, keyed_state

    moves = job_moves(read)
    spark = moves.sparkSession
    folder = f"{shared_dir(spark)}/lotwise-moves-{uuid.uuid4().hex}"
    parts = moves.repartitionByRange("event_time").sortWithinPartitions(F.xxhash64("event_id"))
    parts.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(folder)
    end = F.lit(JOB_UNTIL).cast("timestamp") + F.expr("interval 2 days")
    clock = spark.range(1).select(F.lit("clock").alias("record_key"), end.alias("event_time"), F.lit(0).cast("long").alias("event_id"), F.lit("none").alias("move"), F.lit("w").alias("worker"), F.lit(9).alias("part"))
    clock.write.mode("append").partitionBy("part").parquet(folder)
    # one batch reads all files, whatever their order; the last row then lets the watermark pass every timer
    stream = spark.readStream.schema(parts.schema).parquet(folder).withWatermark("event_time", "1 hour")
    with keyed_state(spark):
        changes = drained(job_changes(stream, Limits(*JOB_MINUTES)), "lotwise-lifecycle", "update")
    last = changes.groupBy("record_key").agg(F.max(F.struct("change", "status", "attempt")).alias("last"))
    every = moves.select("record_key").distinct().join(last, "record_key", "left")
    return every.select(F.col("record_key").cast("long").alias("record_key"), F.coalesce("last.status", F.lit("queued")).alias("status"), F.coalesce("last.attempt", F.lit(0)).alias("attempt"))


@query("""WITH r AS (SELECT o_custkey::VARCHAR AS request_id, CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN (o_orderkey - o_orderkey % 3)::VARCHAR WHEN 2 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS record_key FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY request_id, record_key) AS same, count(*) OVER (PARTITION BY request_id) AS all_of FROM r)
SELECT request_id, record_key, count(*) AS n, CASE WHEN record_key = '' THEN 'blank_key' WHEN same > 1 THEN 'duplicate_key' WHEN all_of > 25 THEN 'too_many_jobs' WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'O' THEN 'accepted' ELSE 'status_' || o_orderstatus END AS outcome
FROM c LEFT JOIN orders ON record_key = o_orderkey::VARCHAR GROUP BY 1, 2, 4""")
def streaming_intake(read: Frame) -> DataFrame:
    """Requests of many jobs each, with blank, repeated and unknown keys, as a stream of JSON lines into two tables."""
    from .shared import shared_dir
    from .streaming.intake import ACCEPTED, REFUSED, intake, request_stream, taken_in

    key, n = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(11))
    named = F.when(n == 0, "  ").when(n == 1, F.concat((key - key % 3).cast("string"), F.lit(" "))).when(n == 2, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    orders = read("orders")
    spark = orders.sparkSession
    folder = f"{shared_dir(spark)}/lotwise-intake-{uuid.uuid4().hex}"
    requests = orders.select(F.col("o_custkey").cast("string").alias("request_id"), named.alias("record_key"), F.col("o_orderpriority").alias("payload"))
    # a request's lines stay in one file
    requests.repartition("request_id").select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/in")
    stream = request_stream(spark, f"{folder}/in", files=3)
    jobs_now = orders.select(key.cast("string").alias("record_key"), F.when(F.col("o_orderstatus") == "O", "dispatching").otherwise(F.col("o_orderstatus")).alias("status"))
    intake(stream, lambda: jobs_now, folder)
    every = taken_in(spark, folder, ACCEPTED, stream.schema).unionByName(taken_in(spark, folder, REFUSED, stream.schema))
    return every.groupBy("request_id", "record_key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event, max(value) AS peak FROM events GROUP BY 1, 2")
def keyed_counters(read: Frame) -> DataFrame:
    """Counters in a keyed table, upserted in three batches, one of which comes twice."""
    from .shared import shared_dir
    from .sources.keyed_table import KeyedTable, added

    counted = read("events").groupBy("user_id", "event_type", F.pmod("event_id", F.lit(3)).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"), F.max("value").alias("peak"))
    spark, rows = counted.sparkSession, counted.drop("batch")
    table = KeyedTable(spark, f"{shared_dir(spark)}/lotwise-counters-{uuid.uuid4().hex}", rows.schema, ["user_id", "event_type"], 8)
    for batch in (0, 1, 1, 2):
        table.upsert(counted.where(F.col("batch") == batch).drop("batch"), f"events {batch}", added("n"))
    return table.rows()


@query("""SELECT event_id, ts AS started, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL (event_id % 90) MINUTE END AS finished FROM events""")
def streaming_stages(read: Frame) -> DataFrame:
    """Planted stages, a fifth of them without an end, as a join of two streams within two hours."""
    from .shared import shared_dir
    from .streaming.events import drained, stage_intervals

    events = read("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    spark = events.sparkSession
    ends = events.where("event_id % 5 <> 0").select("event_id", F.timestamp_add("MINUTE", F.pmod("event_id", F.lit(90)), F.col("ts")).alias("ts"), F.lit("stage_finished").alias("kind"))
    rows = events.withColumn("kind", F.lit("stage_started")).unionByName(ends)
    folder = f"{shared_dir(spark)}/lotwise-stages-{uuid.uuid4().hex}"
    rows.repartition(F.xxhash64("event_id", "kind")).write.parquet(folder)
    # one more stage, long after all others, lets the time pass
    later = events.agg(F.timestamp_add("DAY", F.lit(3), F.max("ts")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.explode(F.array(F.lit("stage_started"), F.lit("stage_finished"))).alias("kind"))
    later.write.mode("append").parquet(folder)
    found = drained(stage_intervals(spark.readStream.schema(rows.schema).parquet(folder), ["event_id"]), "lotwise-stages", "append")
    return found.where("event_id >= 0").select("event_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("finished").cast("timestamp_ntz").alias("finished"))


@query("""SELECT event_id, next_start, CASE WHEN event_type = 'view' AND next_start IS NOT NULL THEN 'interrupted' ELSE event_type END AS final_status FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_start FROM events)""")
def job_superseded(read: Frame) -> DataFrame:
    runs = read("events").select("event_id", F.col("user_id").alias("record_key"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"))
    return audit.superseded(runs).select("event_id", "next_start", F.when(F.col("final_status") == "running", "view").otherwise(F.col("final_status")).alias("final_status"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, bool_and(o_orderstatus IN ('F', 'P')) AS terminal FROM orders GROUP BY 1""")
def batch_progress(read: Frame) -> DataFrame:
    rows = read("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("batch"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"))
    return jobs.progress(rows, ["batch"])


@query("""WITH a AS (SELECT *, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_orderpriority) AS busy FROM orders), q AS (SELECT o_orderkey, busy, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM a WHERE o_orderstatus = 'O') SELECT o_orderkey FROM q WHERE rn <= 1200 - busy""")
def claim_slots(read: Frame) -> DataFrame:
    rows = read("orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "queued").otherwise(F.col("o_orderstatus")))
    return jobs.claimable(rows, 1200, [F.col("o_orderdate"), F.col("o_orderkey")], ("o_orderpriority",), F.col("status") == "P").select("o_orderkey")


@query("""SELECT event_id, CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'O' THEN 'accepted' ELSE 'status_' || o_orderstatus END AS outcome FROM events LEFT JOIN orders ON event_id = o_orderkey""")
def dispatch_classify(read: Frame) -> DataFrame:
    known = read("orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "O", "dispatching").otherwise(F.col("o_orderstatus")).alias("status"))
    return jobs.classified(read("events").select("event_id"), known, "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def never_dispatched(read: Frame) -> DataFrame:
    busy = read("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.never(read("customer"), busy, "c_custkey").select("c_custkey", "c_name")


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'error') AS error_count, count(*) FILTER (event_type = 'purchase') AS purchase_count, coalesce(sum((json_extract_string(props, '$.k'))::BIGINT), 0)::BIGINT AS sum_k FROM events""")
def run_totals(read: Frame) -> DataFrame:
    rows = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return audit.conditional_counts(rows, "event_type", ["click", "error", "purchase"], sums=("k",))


CALLS_SQL = """WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'qdrant' WHEN 'purchase' THEN 'embedding' WHEN 'signup' THEN 'qdrant_http' ELSE 'ollama_http' END AS service,
  'm' || (user_id % 3)::VARCHAR AS model, CASE WHEN value > 50 THEN 'ok' ELSE 'error' END AS status, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events),
i AS (SELECT 'llm_requests' AS metric, model, status, 1 AS x FROM c WHERE service = 'llm' UNION ALL SELECT 'llm_prompt_tokens', model, status, k FROM c WHERE service = 'llm'
  UNION ALL SELECT 'llm_completion_tokens', model, status, k // 2 FROM c WHERE service = 'llm' UNION ALL SELECT 'llm_fallbacks', model, status, 1 FROM c WHERE service = 'llm' AND k % 2 = 0
  UNION ALL SELECT 'qdrant_queries', '', status, 1 FROM c WHERE service = 'qdrant' UNION ALL SELECT 'qdrant_results', '', status, k FROM c WHERE service = 'qdrant'
  UNION ALL SELECT 'qdrant_http_requests', '', status, 1 FROM c WHERE service = 'qdrant_http' UNION ALL SELECT 'embedding_queries', model, status, 1 FROM c WHERE service = 'embedding'
  UNION ALL SELECT 'embedding_http_requests', model, status, 1 FROM c WHERE service = 'ollama_http'),
n AS (SELECT metric, model, status, sum(x)::BIGINT AS value FROM i WHERE x <> 0 GROUP BY 1, 2, 3)"""


def calls(read: Frame) -> DataFrame:
    """Events as external calls."""
    k = F.get_json_object("props", "$.k").cast("long")
    services = F.create_map(*[F.lit(x) for p in (("click", "llm"), ("view", "qdrant"), ("purchase", "embedding"), ("signup", "qdrant_http"), ("error", "ollama_http")) for x in p])
    return read("events").select(
        "event_id", "ts", F.lit("external_call").alias("event_type"), F.try_element_at(services, F.col("event_type")).alias("service"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("value") > 50, "ok").otherwise("error").alias("status"), k.alias("prompt_tokens"), F.floor(k / 2).cast("long").alias("completion_tokens"), k.alias("result_count"), (k % 2 == 0).alias("fallback_used"),
    )


@query(CALLS_SQL + " SELECT * FROM n")
def metric_counters(read: Frame) -> DataFrame:
    return audit.metric_counters(audit.metric_increments(calls(read)))


@query(CALLS_SQL + """ SELECT model, status, coalesce(max(value) FILTER (metric = 'llm_requests'), 0)::BIGINT AS llm_requests, coalesce(max(value) FILTER (metric = 'llm_prompt_tokens'), 0)::BIGINT AS llm_prompt_tokens, coalesce(max(value) FILTER (metric = 'llm_completion_tokens'), 0)::BIGINT AS llm_completion_tokens FROM n GROUP BY 1, 2""")
def metric_pivot(read: Frame) -> DataFrame:
    return audit.metric_pivot(audit.metric_counters(audit.metric_increments(calls(read))), ["llm_requests", "llm_prompt_tokens", "llm_completion_tokens"])


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_calls(read: Frame) -> DataFrame:
    return audit.hourly(read("events"), "ts", ["event_type"])


@query("SELECT event_type, sum((json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS tokens, count(*) AS calls FROM events GROUP BY 1")
def tokens_by_type(read: Frame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read("events").groupBy("event_type").agg(F.sum(audit.usage_total(k, F.lit(0), F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("""WITH b AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1), m AS (SELECT max(ts) AS ref FROM events) SELECT user_id, beat FROM b, m WHERE beat < ref - INTERVAL 7200 SECOND""")
def stale_runs(read: Frame) -> DataFrame:
    beats = read("events").groupBy("user_id").agg(F.max("ts").alias("beat"))
    ref = beats.agg(F.max("beat").alias("ref"))
    return audit.stale(beats.join(F.broadcast(ref)), "beat", F.col("ref"), 7200, F.lit(True)).select("user_id", "beat")  # ref is one row


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_runs(read: Frame) -> DataFrame:
    return audit.recent(read("events").select("event_id", "ts", "user_id"), [F.desc("ts"), F.desc("event_id")], 200)


@query("""SELECT user_id, min(ts) FILTER (event_type = 'signup') AS started, max(ts) FILTER (event_type = 'purchase') AS finished FROM events GROUP BY 1""")
def run_timeline(read: Frame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "stage_started").when(F.col("event_type") == "purchase", "stage_finished")
    rows = read("events").select("user_id", "ts", kind.alias("kind"), F.col("event_type").alias("status"))
    return audit.stage_timeline(rows, ["user_id"], "ts", "kind").select("user_id", "started", "finished")


@query("WITH m AS (SELECT max(ts) AS ref FROM events) SELECT event_id FROM events, m WHERE ts >= ref - INTERVAL 10 DAY")
def retention_keep(read: Frame) -> DataFrame:
    events = read("events").select("event_id", "ts")
    return audit.retained(events.join(F.broadcast(events.agg(F.max("ts").alias("ref")))), "ts", F.col("ref"), 10).select("event_id")  # ref is one row


@query("SELECT user_id, max(value) AS peak_value, max(event_id) AS peak_event_id FROM events GROUP BY 1")
def peak_high_water(read: Frame) -> DataFrame:
    return audit.high_water(read("events"), ["user_id"], ["value", "event_id"])


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 1000")
def latest_groups(read: Frame) -> DataFrame:
    return audit.latest_groups(read("events"), "user_id", "ts")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_counters(read: Frame) -> DataFrame:
    """The hourly counts as a stream over all of the table's files, drained into a Parquet folder."""
    from .streaming.events import drained, event_stream, hourly_counts

    batch = read("events")
    files = batch.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    rows = event_stream(batch.sparkSession, folder, batch.schema, glob=files[0].rsplit("/", 1)[1] if len(files) == 1 else "*.parquet")
    return drained(hourly_counts(rows, "event_type"), "lotwise-hourly").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
