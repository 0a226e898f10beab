"""The prioritised rule engine: conditions as an array of reasons, deduplicated and sorted, then one decision.

No Python runs on rows. A rule is a condition, a reason, an evidence and a priority; the
row's reasons are an array of struct<priority, ord, reason, evidence>.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import delivery_date, parse_date
from ..functions.numbers import numbers_in, parse_money
from ..functions.text import FLAGS, clip, collapse, snippet, snippet_of

#: The reasons that a decision may name, and the patterns that detect them in a tender's text.
DUPLICATE = "Дубль"
PRICE = "Коммерческие условия. НМЦК менее 1 млн руб."
ACTUAL_COST = "Коммерческие условия. НМЦК менее фактической стоимости"
DELIVERY = "Коммерческие условия. Не проходим по сроку поставки"
PAY_AFTER = "Коммерческие условия. Оплата Покупателем после оплаты Генподрядчиком / Госзаказчиком"
PAY_DELAY = "Коммерческие условия. Отсрочка платежа 90 дней и более"
REMOTE = "Коммерческие условия. Поставка в удаленные территории"
CONSIGNMENT = "Коммерческие условия. Консигнация / Хранение у Покупателя за счет Поставщика"
INDIVISIBLE = "Номенклатура. Лот неделимый. Не можем скомплектовать более 20% номенклатуры"
VOLTAGE = "Номенклатура. Оборудование 35 кВ и выше"
DRIVE = "Номенклатура. Частотный привод 6–10 кВ"
SPARES = "Номенклатура. Ремкомплект / ЗИП / Продукция по чертежу"
MILITARY = "Номенклатура. Военная приемка"
NUCLEAR = "Номенклатура. Атомная приемка"
WORKS = "Номенклатура. Поставка с работами"
DEADLINE = "Оргвопросы. На момент согласования менее 3 рабочих дней до подачи заявки"
SELF_SUBMIT = "Оргвопросы. МОПП подается самостоятельно (подача без ЭЦП)"
HOLDING = "Оргвопросы. Тендер ХК. Нет УРКК. Договоры с филиалами. Отгрузка по всей стране."
DOCUMENTATION = "Оргвопросы. Отсутствует ТЗ / Нет документации / Некорректная ссылка"
CLOSED = "Оргвопросы. Закрытый тендер / Не прошли квалификацию"
CANCELLED = "Оргвопросы. Отказ организатора от проведения тендера"
ABSENCE = "Оргвопросы. Отпуск или Болезнь МОПП"
MARKET = "Оргвопросы. Опрос рынка / Мониторинг / Анализ рынка / Анонс / КИМ"
ASSORTMENT = "Непоставляемый ассортимент"
OTHER = "Прочее"
REASONS = (
    DUPLICATE, PRICE, ACTUAL_COST, DELIVERY, PAY_AFTER, PAY_DELAY, REMOTE, CONSIGNMENT, INDIVISIBLE, VOLTAGE, DRIVE, SPARES, MILITARY,
    NUCLEAR, WORKS, DEADLINE, SELF_SUBMIT, HOLDING, DOCUMENTATION, CLOSED, CANCELLED, ABSENCE, MARKET, ASSORTMENT, OTHER,
)
CONTROLLED = (DEADLINE, ASSORTMENT, INDIVISIBLE)
DUPLICATE_PATTERN = r"\b(дубль|дубликат|повторная\s+карточка|уже\s+загружен[ао]?)\b"
MARKET_PATTERN = r"\b(опрос\s+рынка|мониторинг\s+рынка|анализ\s+рынка|маркетингов(?:ое|ого)\s+исследовани[ея]|исследование\s+рынка|анонс\s+закупки|ким)\b"
VOLTAGE_PATTERN = r"\b(\d{1,4}(?:[.,]\d+)?)\s*к\s*в\b"
PAY_DELAY_PATTERN = r"(?:отсрочк[а-я]*|оплат[а-яё\s]{0,120}?в\s+течение)[^\d]{0,80}(\d+)\s*(?:(рабоч|календарн)[а-я]*)?\s*д"
WORKS_PATTERN = r"(?:монтаж|установк[а-я]*|пусконаладк[а-я]*|ввод\s+в\s+эксплуатацию)[\s\S]{0,100}(?:поставщиком|подрядчиком|силами\s+поставщика|входит\s+в\s+(?:предмет|стоимость|объ[её]м))"
NO_WORKS_PATTERN = r"не\s+требуется|не\s+входит|заказчик|без\s+монтажа"
TEXT_PATTERNS = (
    (30, PAY_AFTER, r"(?:оплат[а-я]*|расч[её]т[а-я]*)[\s\S]{0,100}(?:после|по\s+мере)[\s\S]{0,100}(?:генподрядчик|госзаказчик)"),
    (40, REMOTE, r"\b(республик[а-я]*\s+саха(?:\s*\(якутия\))?|якут(?:ия|ск[а-я]*)|дагестан(?:ск[а-я]*)?|калининград(?:ск[а-я]*)?)\b"),
    (45, CONSIGNMENT, r"\b(консигнац|ответственн(?:ое|ого)\s+хранени|хранени[ея]\s+у\s+покупателя)[\s\S]{0,140}(?:за\s+сч[её]т\s+поставщика|поставщик)"),
    (60, DRIVE, r"(?:частотн[а-я]*\s+(?:привод|преобразователь)|пч)[\s\S]{0,120}\b(?:6|10|6\s*[-–]\s*10)\s*к\s*в\b"),
    (65, SPARES, r"\b(ремкомплект|ремонтн[а-я]*\s+комплект|зип|запасн[а-я]*\s+част|изготовлени[ея]\s+по\s+чертеж|продукци[яи]\s+по\s+чертеж)\b"),
    (70, MILITARY, r"\b(военн[а-я]*\s+при[её]мк[а-я]*|при[её]мк[а-я]*\s+военн[а-я]*\s+представитель|контрол[ья]\s+военн[а-я]*\s+представитель)\b"),
    (75, NUCLEAR, r"\b(атомн[а-я]*\s+при[её]мк[а-я]*|при[её]мк[а-я]*\s+для\s+о(?:бъект|иаэ)|класс\s+безопасности\s+[1-4])\b"),
    (16, SELF_SUBMIT, r"(?:мопп|менеджер)[\s\S]{0,120}(?:пода[её]т|подача)[\s\S]{0,100}(?:самостоятельно|без\s+эцп)"),
    (90, CLOSED, r"\b(закрыт(?:ый|ая)\s+(?:тендер|закупка)|не\s+прошли\s+квалификац)\b"),
    (91, CANCELLED, r"\b(отказ\s+организатора|закупка\s+отменена|отказался\s+от\s+проведения)\b"),
)
#: For each text rule the stems of which an upper-case text holds one wherever the pattern matches: a text without them is not searched.
STEMS = {
    DUPLICATE: ("ДУБЛ", "КАРТОЧКА", "ЗАГРУЖЕН"), MARKET: ("РЫНКА", "МАРКЕТИНГОВ", "АНОНС", "КИМ"), PAY_AFTER: ("ГЕНПОДРЯДЧИК", "ГОСЗАКАЗЧИК"), REMOTE: ("САХА", "ЯКУТ", "ДАГЕСТАН", "КАЛИНИНГРАД"),
    CONSIGNMENT: ("ПОСТАВЩИК",), DRIVE: ("ПРИВОД", "ПРЕОБРАЗОВАТЕЛЬ", "ПЧ"), SPARES: ("КОМПЛЕКТ", "ЗИП", "ЗАПАСН", "ЧЕРТЕЖ"), MILITARY: ("ВОЕНН",), NUCLEAR: ("АТОМН", "ДЛЯ", "БЕЗОПАСНОСТИ"), SELF_SUBMIT: ("МОПП", "МЕНЕДЖЕР"),
    CLOSED: ("ЗАКРЫТ", "КВАЛИФИКАЦ"), CANCELLED: ("ОТКАЗ", "ОТМЕНЕНА"), PAY_DELAY: ("ОТСРОЧК", "ОПЛАТ"), WORKS: ("МОНТАЖ", "УСТАНОВК", "ПУСКОНАЛАДК", "ВВОД"), VOLTAGE: ("К",),
}
REJECTED, APPROVED, NEEDS_WORK, LOADED = "Отказано КУ ЦП", "Согласовано КУ ЦП", "Проработка контрагента", "Загружен Seldon"


@dataclass(frozen=True)
class Rule:
    """A reason for rejection: fires where the condition is true; evidence is its explanation."""

    priority: int
    reason: str
    condition: Column
    evidence: Column


REASON_TYPE = "array<struct<priority:int,ord:int,reason:string,evidence:string>>"


def evaluated(rules: list[Rule]) -> Column:
    """The reasons of the rules that fire: first evidence per reason, by priority, then by the rules' order."""
    each = [
        F.when(r.condition, F.struct(F.lit(r.priority).alias("priority"), F.lit(i).alias("ord"), F.lit(r.reason).alias("reason"), F.substring(F.coalesce(r.evidence.cast("string"), F.lit("")), 1, 1000).alias("evidence")))
        for i, r in enumerate(rules)
    ]
    fired = F.filter(F.array(*each), lambda x: x.isNotNull())
    first = lambda xs: F.aggregate(xs, F.expr(f"cast(array() as {REASON_TYPE})"), lambda acc, x: F.when(F.exists(acc, lambda y: y["reason"] == x["reason"]), acc).otherwise(F.concat(acc, F.array(x))))
    # an array's element is computed once, however often the lambda names it
    return F.transform(F.array(fired), lambda xs: F.when(F.size(xs) < 2, xs).otherwise(F.array_sort(first(xs))))[0]


def text_rule(priority: int, reason: str, text: Column, pattern: str, probe: Column | None = None) -> Rule:
    """probe: a cheaper condition that holds wherever the pattern matches."""
    full = FLAGS + pattern
    return Rule(priority, reason, text.rlike(full) if probe is None else probe & text.rlike(full), snippet(text, full))


def held(upper: Column, reason: str) -> Column:
    """Whether an upper-case text holds a stem of the reason's pattern."""
    return reduce(Column.__or__, [upper.contains(stem) for stem in STEMS[reason]])


#: Sentences of evidence; what stands between two parts is a value of the row.
SAID_LOT, SAID_PAPERS = "Проверка комплектования лота не пройдена.", "документация отсутствует"
SAID_NOTHING = "Товарные позиции для проверки ассортимента не извлечены; coverage не рассчитан. Автоматическое согласование запрещено."
SAID_DAYS, SAID_PRICE = ("Колонка «Осталось дней»: ", ". Условие: remainingDays < 3."), "НМЦК: "
SAID_DELIVERY = ("Дата заведения: ", "; предел 18 месяцев: ", "; поставка: ")
#: Sentences of a decision's note.
NOTE_PARTY, NOTE_MAIN, NOTE_MODEL = "Контрагент с указанным ИНН не найден в IPro.", "Основная причина отказа: ", "Подтверждён критерий отказа: "
NOTE_WEAK, NOTE_NONE = "LLM reject содержал только запрещённую/неподтверждённую controlled-причину.", "Критерии отказа не подтверждены."
NOTE_FALLBACK = "LLM решения по статусу не вернул валидный JSON; обязательные критерии не сработали."
NOTE_ADVISORY = ("Дополнительная информация по контрагенту: ", " Статус «Проработка контрагента» не применяется, поскольку тендер уже имеет подтверждённую причину отказа.")
NOTE_MORE = "Дополнительные подтверждённые причины: "


def hard_rules(ref_date: Column) -> list[Rule]:
    """All rules, in their order, over the columns of hard_reasons(), `_upper`, the text in upper case, and `_price`, the initial price as an amount."""
    text, c = F.coalesce("all_text", F.lit("")), F.col
    probe = lambda reason: held(c("_upper"), reason)
    price = c("_price")
    volts = FLAGS + VOLTAGE_PATTERN
    high = F.when(probe(VOLTAGE) & c("_upper").rlike(r"(?U)К\s*В") & text.rlike(volts), F.get(numbers_in(text, volts, 35), F.lit(0)))
    named = F.regexp_extract_all(text, F.lit(volts), F.lit(1))
    firing = F.array_position(F.transform(named, lambda v: F.translate(v, ",", ".").try_cast("double") >= 35), F.lit(True))
    delays = F.when(probe(PAY_DELAY), F.filter(F.regexp_extract_all(text, F.lit(FLAGS + PAY_DELAY_PATTERN), F.lit(0)), lambda m: F.regexp_extract(m, r"(\d+)\s*(?:(?iuU)(?:рабоч|календарн)[а-я]*)?\s*[дД]$", 1).try_cast("long") >= 90))
    created = F.coalesce(parse_date(c("date_created")), ref_date)
    delivery = delivery_date(created, parse_date(c("delivery_date")), parse_money(c("delivery_days")))
    limit = F.add_months(created, 18)
    works = F.when(probe(WORKS), snippet(text, FLAGS + WORKS_PATTERN, 120))
    rules = [
        Rule(5, INDIVISIBLE, c("hard_reject"), F.coalesce("summary", F.lit(SAID_LOT))),
        Rule(25, DOCUMENTATION, c("documentation_missing"), F.coalesce("documentation_note", F.lit(SAID_PAPERS))),
        Rule(25, DOCUMENTATION, F.coalesce(c("total") <= 0, F.lit(False)) | c("coverage_percent").isNull(), F.lit(SAID_NOTHING)),
        text_rule(10, DUPLICATE, text, DUPLICATE_PATTERN, probe(DUPLICATE)),
        Rule(15, DEADLINE, c("remaining_days") < 3, F.concat(F.lit(SAID_DAYS[0]), c("remaining_days").cast("string"), F.lit(SAID_DAYS[1]))),
        Rule(20, PRICE, (price > 0) & (price < 1_000_000), F.concat(F.lit(SAID_PRICE), c("initial_price").cast("string"))),
        Rule(21, PRICE, c("value_reject") & c("threshold_applicable") & c("price_complete") & c("coverage_approved") & (c("supply_total") < 1_000_000), F.coalesce("price_summary", c("supply_total").cast("string"))),
    ]
    rules += [text_rule(priority, reason, text, pattern, probe(reason)) for priority, reason, pattern in TEXT_PATTERNS]
    market = text_rule(18, MARKET, text, MARKET_PATTERN, probe(MARKET))
    rules += [
        Rule(18, MARKET, (c("report_id") == 3) & market.condition, market.evidence),
        Rule(55, VOLTAGE, high.isNotNull(), snippet_of(text, volts, firing)),
        Rule(35, PAY_DELAY, F.size(delays) > 0, F.get(delays, F.lit(0))),
        Rule(32, DELIVERY, delivery > limit, F.concat(F.lit(SAID_DELIVERY[0]), created.cast("string"), F.lit(SAID_DELIVERY[1]), limit.cast("string"), F.lit(SAID_DELIVERY[2]), delivery.cast("string"))),
        Rule(80, WORKS, works.isNotNull() & ~works.rlike(FLAGS + NO_WORKS_PATTERN), works),
    ]
    return rules


#: Thresholds and labels that the checks report.
DAYS_SOURCE, DAYS_COMPARISON, LEAST_DAYS, LONGEST_MONTHS, RULES_VERSION = "Seldon / колонка «Осталось дней»", "remainingDays < 3", 3, 18, "2026-06 / пользовательский справочник причин"
#: Reasons that a model is never offered.
NOT_OFFERED = (*CONTROLLED, ACTUAL_COST)


def checks(ref_date: Column) -> Column:
    """What the rules looked at, as a struct with a member for each check, over the columns of hard_reasons()."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    created = F.coalesce(parse_date(c("date_created")), ref_date)
    delivery = delivery_date(created, parse_date(c("delivery_date")), parse_money(c("delivery_days")))
    limit = F.add_months(created, LONGEST_MONTHS)
    extracted = ~(yes(c("total") <= 0) | c("coverage_percent").isNull())
    market = yes(c("all_text").rlike(FLAGS + MARKET_PATTERN))
    return F.struct(
        parse_money(c("initial_price")).alias("initialPriceNumeric"),
        F.struct(F.lit(DAYS_SOURCE).alias("source"), c("remaining_days").alias("remainingDays"), F.lit(LEAST_DAYS).alias("thresholdExclusive"), F.lit(DAYS_COMPARISON).alias("comparison"), yes(c("remaining_days") < LEAST_DAYS).alias("triggered")).alias("submissionDeadlineCheck"),
        F.struct(
            c("coverage_percent").alias("coveragePercent"), c("coverage_rule").alias("coverageRule"), c("lot_divisible").alias("lotDivisible"), c("approval_threshold").alias("approvalThresholdInclusive"),
            c("minimum_supplied").alias("minimumSuppliedPositions"), yes(c("coverage_approved")).alias("approved"), yes(c("hard_reject")).alias("triggered"), yes(c("price_complete")).alias("quantityAdjustedTotalComplete"),
        ).alias("productCoverageCheck"),
        F.struct(yes(c("documentation_missing")).alias("documentationMissing"), c("documentation_note").alias("documentationNote"), extracted.alias("productsExtracted"), (extracted & ~yes(c("documentation_missing"))).alias("automaticApprovalAllowed")).alias("documentationCheck"),
        F.struct(c("report_id").alias("reportId"), F.lit(True).alias("commercialOnly"), market.alias("detectedInText"), yes(c("report_id") == 3).alias("rejectionApplicable"), (yes(c("report_id") == 3) & market).alias("triggered")).alias("marketResearchCheck"),
        F.struct(created.cast("string").alias("createdDate"), delivery.cast("string").alias("deliveryDate"), F.lit(LONGEST_MONTHS).alias("maximumPeriodMonths"), limit.cast("string").alias("limitDate"), yes(delivery > limit).alias("exceedsMaximum")).alias("deliveryDeadlineCheck"),
    )


def with_checks(tenders: DataFrame, ref_date: Column) -> DataFrame:
    """Adds `checks`. Missing INPUTS count as null."""
    return _with_inputs(tenders).withColumn("checks", checks(ref_date))


def reason_options(report: Column, form: Callable[[Column], Column] = lambda options: options) -> Column:
    """The reasons that a model may choose from, in the given form: research of the market only where it applies."""
    offered = F.array(*[F.lit(r) for r in REASONS if r not in NOT_OFFERED])
    return F.when(F.coalesce(report.isin(1, 2), F.lit(False)), form(F.array_remove(offered, MARKET))).otherwise(form(offered))


def decision_context(tenders: DataFrame, most_text: int = 220_000) -> DataFrame:
    """Adds `context` (JSON: version, options, product check, hard reasons, checks) and `context_text`, the clipped text.

    tenders: what hard_reasons() and with_checks() returned; product_check (a struct) if there is one.
    """
    product = F.col("product_check") if "product_check" in tenders.columns else F.lit(None).cast("struct<total:bigint>")
    hard = F.transform("hard", lambda x: F.struct(x["reason"].alias("reason"), x["evidence"].alias("evidence"), x["priority"].alias("priority")))
    # the members that do not depend on the row are made into text once, not for each row
    fixed = reason_options(F.col("report_id"), lambda options: F.rtrim(F.to_json(F.struct(F.lit(RULES_VERSION).alias("rulesVersion"), options.alias("reasonOptions"))), F.lit("}")))
    own = F.struct(product.alias("productCheck"), hard.alias("hardReasons"), *[F.col(f"checks.{n}") for n in tenders.schema["checks"].dataType.names])
    context = F.concat(fixed, F.lit(","), F.substr(F.to_json(own, {"ignoreNullFields": "false"}), F.lit(2)))
    return tenders.withColumns({"context": context, "context_text": clip(F.coalesce("all_text", F.lit("")), most_text)})


#: Columns that the rules read, with the type of those that a caller leaves out.
INPUTS = {
    "hard_reject": "boolean", "summary": "string", "documentation_missing": "boolean", "documentation_note": "string", "total": "bigint", "coverage_percent": "double",
    "all_text": "string", "remaining_days": "double", "initial_price": "string", "value_reject": "boolean", "threshold_applicable": "boolean", "price_complete": "boolean",
    "coverage_approved": "boolean", "supply_total": "double", "price_summary": "string", "coverage_rule": "string", "lot_divisible": "boolean", "approval_threshold": "double", "minimum_supplied": "int", "report_id": "int", "date_created": "string", "delivery_date": "string", "delivery_days": "string",
}


def hard_reasons(tenders: DataFrame, ref_date: Column) -> DataFrame:
    """Adds `hard`, the fired rules' reasons. Missing INPUTS count as null."""
    upper = F.upper(F.coalesce("all_text", F.lit("")))
    known = _with_inputs(tenders).withColumns({"_upper": upper, "_price": parse_money(F.col("initial_price"))})
    return known.withColumn("hard", evaluated(hard_rules(ref_date))).drop("_upper", "_price")


def _with_inputs(tenders: DataFrame) -> DataFrame:
    missing = {name: F.lit(None).cast(kind) for name, kind in INPUTS.items() if name not in tenders.columns}
    return tenders.withColumns(missing) if missing else tenders


def decided(tenders: DataFrame) -> DataFrame:
    """Adds status, reason, reason_origin, confidence, additional_reasons and note.

    tenders: hard (array of reasons), counterparty_status, counterparty_reason,
    model (null or struct<decision, primaryReason, detectedReasons: array<struct<reason,
    evidence, confidence>>, note, confidence>), report_id, coverage_percent, total,
    coverage_approved, summary. Hard reasons come first, then the model's rejection, then
    the counterparty, then the model's approval.
    """
    c = F.col
    suppressed = F.coalesce(c("report_id").isin(1, 2), F.lit(False))
    unevaluated = c("coverage_percent").isNull() | F.coalesce(c("total") <= 0, F.lit(False))
    kept = F.filter("hard", lambda x: ~(suppressed & (x["reason"] == MARKET)))
    added = F.array(F.struct(F.lit(25).alias("priority"), F.lit(1000).alias("ord"), F.lit(DOCUMENTATION).alias("reason"), F.lit("Товарные позиции не извлечены либо coverage не рассчитан. Автоматическое согласование запрещено.").alias("evidence")))
    hard = F.array_sort(F.when(unevaluated & ~F.exists(kept, lambda x: x["reason"] == DOCUMENTATION), F.concat(kept, added)).otherwise(kept))
    out = tenders.withColumn("_hard", hard)
    other_hard = F.filter("_hard", lambda x: ~x["reason"].isin(ASSORTMENT, INDIVISIBLE))
    usable = lambda reason: reason.isin(*REASONS) & ~reason.isin(*CONTROLLED) & ~(suppressed & (reason == MARKET))
    found = F.coalesce(c("model.detectedReasons"), F.expr("cast(array() as array<struct<reason:string,evidence:string,confidence:string>>)"))
    on_topic = lambda x: F.coalesce(c("coverage_approved"), F.lit(False)) & x["evidence"].rlike(FLAGS + "ассортимент|номенклатур")
    allowed = F.filter(found, lambda x: usable(x["reason"]) & ~F.coalesce(on_topic(x), F.lit(False)))
    out = out.withColumns({"_other": other_hard, "_allowed": allowed})
    named = c("model.primaryReason")
    primary = F.when(usable(named), named).otherwise(F.get("_allowed", F.lit(0))["reason"])
    same = F.get(F.filter("_allowed", lambda x: x["reason"] == primary), F.lit(0))
    sure = lambda x: F.when(x.isin("low", "medium", "high"), x).otherwise("medium")
    first = F.struct(primary.alias("reason"), F.coalesce(collapse(same["evidence"]), F.lit("")).alias("evidence"), sure(F.coalesce(same["confidence"], c("model.confidence"))).alias("confidence"))
    rest = F.transform("_allowed", lambda x: F.struct(x["reason"].alias("reason"), F.coalesce(collapse(x["evidence"]), F.lit("")).alias("evidence"), sure(x["confidence"]).alias("confidence")))
    none = F.expr("cast(array() as array<struct<reason:string,evidence:string,confidence:string>>)")
    once = lambda xs: F.aggregate(xs, none, lambda acc, x: F.when(F.exists(acc, lambda y: y["reason"] == x["reason"]), acc).otherwise(F.concat(acc, F.array(x))))
    out = out.withColumns({"_primary": primary, "_model": once(F.when(primary.isNotNull(), F.concat(F.array(first), rest)).otherwise(rest))})
    rejected, other, alternative = F.size("_hard") > 0, F.get("_other", F.lit(0)), F.get("_model", F.lit(0))
    by_model = (c("model.decision") == "reject") & c("_primary").isNotNull()
    unknown = ~c("counterparty_status").eqNullSafe(F.lit("matched"))
    pick = lambda hard_other, hard_model, hard_only, model, party, weak, approve, nothing: (
        F.when(rejected & (F.size("_other") > 0), hard_other).when(rejected & (F.size("_model") > 0), hard_model).when(rejected, hard_only)
        .when(by_model, model).when(unknown, party).when(c("model.decision") == "reject", weak).when(c("model.decision") == "approve", approve).otherwise(nothing)
    )
    text = F.lit
    none_text = F.lit(None).cast("string")
    out = out.withColumns({
        "status": pick(*map(text, (REJECTED, REJECTED, REJECTED, REJECTED, NEEDS_WORK, APPROVED, APPROVED, LOADED))),
        "reason": pick(other["reason"], alternative["reason"], F.get("_hard", F.lit(0))["reason"], c("_primary"), text(OTHER), none_text, none_text, text(OTHER)),
        "confidence": pick(text("high"), alternative["confidence"], text("high"), c("model.confidence"), text("medium"), c("model.confidence"), c("model.confidence"), text("low")),
        "reason_origin": pick(*map(text, ("deterministic", "llm_alternative_over_coverage", "deterministic", "llm", "counterparty", "none", "none", "fallback"))),
    })
    advisory = (c("status") == REJECTED) & unknown
    party = F.coalesce(F.nullif("counterparty_reason", F.lit("")), text(NOTE_PARTY))
    hard_as = F.transform("_hard", lambda x: F.struct(x["reason"].alias("reason"), collapse(x["evidence"]).alias("evidence"), F.lit("high").alias("confidence")))
    more = F.when(c("status") == REJECTED, F.filter(once(F.concat(hard_as, c("_model"))), lambda x: x["reason"] != c("reason"))).otherwise(none)
    out = out.withColumn("additional_reasons", more)
    listed = F.array_join(F.transform("additional_reasons", lambda x: F.when(x["evidence"] != "", F.concat(x["reason"], text(" — "), x["evidence"])).otherwise(x["reason"])), " | ")
    papers = F.get(F.filter("_hard", lambda x: x["reason"] == DOCUMENTATION), F.lit(0))["evidence"]
    main = pick(
        *[F.concat(text(NOTE_MAIN), c("reason"), text("."))] * 3,
        F.coalesce(F.nullif(c("model.note"), text("")), F.concat(text(NOTE_MODEL), c("_primary"), text("."))), party,
        text(NOTE_WEAK), F.coalesce(F.nullif(c("model.note"), text("")), text(NOTE_NONE)),
        text(NOTE_FALLBACK),
    )
    about = F.when(advisory, F.concat(text(NOTE_ADVISORY[0]), party, text(NOTE_ADVISORY[1])))
    parts = F.array(c("summary"), main, F.when(rejected, papers), about, F.when(F.size("additional_reasons") > 0, F.concat(text(NOTE_MORE), listed)))
    tidy = F.array_distinct(F.filter(F.transform(parts, lambda x: collapse(F.coalesce(x, text("")))), lambda x: x != ""))
    return out.withColumns({"note": F.substring(F.array_join(tidy, " "), 1, 4000), "counterparty_advisory_only": advisory}).drop("_hard", "_other", "_allowed", "_primary", "_model")
