"""Normalisation and validation of jobs and extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normal_date, normal_time
from ..functions.numbers import parse_number
from ..functions.text import FLAGS, digits, first_defined, lot_divisible, string_or_none, without_yo

#: Fixed values.
REPORT_ALIASES = {
    1: ("1", "223", "223-фз", "223 фз"),
    2: ("2", "44", "94", "44-фз", "94-фз", "44/94-фз"),
    3: ("3", "коммерческие закупки", "коммерческие", "commercial", "kom"),
    4: ("4", "контракты", "контракт", "contracts"),
    5: ("5", "международные закупки", "международные", "international"),
}
ALLOWED_FIELDS = (
    "dateCreated", "submissionDeadlineDate", "submissionDeadlineTime", "tenderUrlSource", "federalLaw", "stateDefenseOrder", "tenderStatus", "tenderStatusNote", "tenderStatusReason", "tenderGroup",
    "initialPrice", "finalPrice", "resultDate", "contractDate", "deliveryType", "deliveryBatchDays", "deliveryDays", "deliveryDate", "paymentDelayDays", "lotDivisible", "deliveryNote",
    "counterpartyCode", "counterpartyName", "counterpartyInn", "counterpartyKpp", "counterpartyCkg", "counterpartyPotential", "deal", "contract", "counterpartyNote", "customerContactPerson", "op",
    "tenderSubmittedDate", "tenderWonDate", "applicationSecurity", "contractSecurity", "warrantySecurity", "warrantyMonths", "nationalRegime", "specialAccount", "counterparty", "inn", "kpp",
)
DATE_FIELDS = ("dateCreated", "submissionDeadlineDate", "resultDate", "contractDate", "deliveryDate", "tenderSubmittedDate", "tenderWonDate")
DEFENSE_ORDER = "гособоронзаказ|275-фз|отдельный банковский счет|казначейское сопровождение"
DIRECT_LOT = FLAGS + r"лот\s+неделим|делени[ея]\s+лота\s+не\s+допуска|лот\s+делим|подач[а-я]+\s+на\s+част[ьи]\s+лота"
PAYMENT = FLAGS + r"оплат[а-я\s]{0,80}в\s+течение\s+(\d+)\s*(?:рабоч|календарн)?\s*д"
BATCHES = FLAGS + r"по\s+заявк|партиями|график(?:у|а)?\s+поставки"


def report_id(explicit: Column, kind: Column, law: Column) -> Column:
    """1 to 5: as given, by the purchase type's aliases, by the law; null where none tells."""
    given = explicit.cast("string").try_cast("int")
    word = F.trim(F.regexp_replace(F.translate(without_yo(F.lower(kind)), "—", "-"), r"(?U)\s+", " "))
    named = None
    for number, words in REPORT_ALIASES.items():
        named = F.when(word.isin(*words), number) if named is None else named.when(word.isin(*words), number)
    text = F.lower(law)
    by_law = F.when(text.contains("223"), 1).when(text.contains("44") | text.contains("94"), 2).when(text.contains("commercial") | text.contains("ком"), 3)
    return F.coalesce(F.when(given.between(1, 5), given), named, by_law)


def normalized_jobs(claims: DataFrame) -> DataFrame:
    """Jobs from claims (record_key, batch_id, attempt, report_id, seldon_id, etp_id, report_fields map, input_json text).

    A row that cannot be normalised has an error: no report type, contracts, or no id.
    """
    get = lambda *names: first_defined(*[F.get_json_object("input_json", f"$['{n}']") for n in names])
    field = lambda n: F.try_element_at("report_fields", F.lit(n))
    report = report_id(first_defined(get("reportId", "report_id", "ReportId"), F.col("report_id").cast("string")), get("purchaseType", "tenderType"), get("lawCode", "Код ФЗ"))
    seldon = string_or_none(first_defined(get("seldonId", "SeldonID"), F.col("seldon_id")))
    etp = F.when(seldon.isNull(), string_or_none(first_defined(get("etpId", "№ извещения"), F.col("etp_id"))))
    out = claims.withColumns({"_report": report, "_seldon": seldon, "_etp": etp})
    purchase = first_defined(get("seldonPurchase"), get("purchase"), get("rawPurchase"))
    inner = lambda *names: first_defined(*[F.get_json_object(purchase, f"$.{n}") for n in names])
    default_law = F.when(F.col("_report") == 1, "223").when(F.col("_report") == 2, "44").when(F.col("_report") == 3, "Commercial")
    out = out.withColumns({
        "to_code": string_or_none(first_defined(get("toCode"), field("Код ТО"))),
        "law_code": string_or_none(first_defined(get("lawCode"), field("Код ФЗ"), default_law)),
        "remaining_days": parse_number(first_defined(get("remainingDays"), field("Осталось дней")), allow_negative=True),
        "purchase_type": string_or_none(get("purchaseType")), "section_name": string_or_none(get("sectionName")), "filter_name": string_or_none(get("filterName")),
        "source_file": string_or_none(get("sourceFile")), "batch_date": string_or_none(get("batchDate")), "purchase": purchase,
        "tender_url": string_or_none(first_defined(get("tenderUrl", "tender_url"), inner("urlSource", "purchaseUrl", "tenderUrl", "purchaseLink", "url", "link", "sourceUrl", "href"))),
        "error": F.when(F.col("_report").isNull(), "no_report_type").when(F.col("_report") == 4, "contracts_not_supported").when(F.col("_seldon").isNull() & F.col("_etp").isNull(), "no_id"),
    })
    return out.drop("report_id", "seldon_id", "etp_id").withColumnsRenamed({"_report": "report_id", "_seldon": "seldon_id", "_etp": "etp_id"})


def with_headers(fields: Column, headers: list[str]) -> Column:
    """A map of fields that has every header; missing ones are blank."""
    missing = F.array_except(F.array(*[F.lit(h) for h in headers]), F.map_keys(fields))
    return F.map_concat(fields, F.map_from_arrays(missing, F.transform(missing, lambda h: F.lit(""))))


def flat_purchase(fields: Column, report: Column) -> Column:
    """A purchase with one lot from a flat row (a map)."""
    f = lambda *names: first_defined(*[F.try_element_at(fields, F.lit(n)) for n in names])
    organizer = F.struct(f("Организатор", "Название заказчика").alias("name"), f("ИНН заказчика/организатора", "ИНН заказчика").alias("inn"), f("КПП заказчика/организатора", "КПП заказчика").alias("kpp"), f("Регион заказчика/организатора").alias("region"))
    lot = F.struct(F.lit(1).alias("lotNumber"), f("Наименование").alias("subject"), f("Начальная цена", "initialPrice").alias("price"), f("Валюта").alias("currency"))
    return F.struct(f("seldonId", "SeldonID", "ID").alias("seldonId"), report.alias("reportId"), f("etpId", "№ извещения").alias("notificationNumber"), f("tenderUrl", "Ссылка на тендер").alias("purchaseLink"), f("Наименование").alias("subject"), f("purchasePrice", "Начальная цена").alias("purchasePrice"), f("Электронная площадка", "Торговая площадка").alias("epName"), organizer.alias("organizer"), F.array(lot).alias("lotsList"))


def allowed_fields(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Extracted fields (keys, field, value, confidence, source, evidence, ord): known names, non-blank, the first of each."""
    from .matching import first_by

    kept = extracted.where(F.col("field").isin(*ALLOWED_FIELDS) & (F.trim("value") != ""))
    return first_by(kept, [*keys, "field"], [F.col("ord")])


def written_field(fields: Column, meta: Column, name: str, value: Column, source: Column, confidence: Column, evidence: Column) -> tuple[Column, Column]:
    """The maps of values and of their meta (struct<source, confidence, evidence>) with one more entry; a blank value changes neither."""
    own = value.cast("string")
    given = F.trim(F.coalesce(own, F.lit(""))) != ""
    about = F.struct(source.alias("source"), confidence.alias("confidence"), F.substring(F.coalesce(evidence, F.lit("")), 1, 900).alias("evidence"))
    put = lambda held, x: F.when(given, F.map_concat(F.map_filter(held, lambda k, v: k != name), F.create_map(F.lit(name), x))).otherwise(held)
    return put(fields, own), put(meta, about)


def validated_fields(tenders: DataFrame) -> DataFrame:
    """Fills and normalises fields (a map) from the job and the text, with warnings.

    tenders: fields map<string,string>, evidence map<string,string>, combined_text, report_id, tender_url, purchase (JSON text), report_fields map, ref_date.
    """
    get = lambda n: F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit(""))
    report = lambda *names: first_defined(*[F.try_element_at("report_fields", F.lit(n)) for n in names])
    inner = lambda *paths: first_defined(*[F.get_json_object("purchase", f"$.{p}") for p in paths])
    text = without_yo(F.lower(F.coalesce("combined_text", F.lit(""))))
    defense = text.rlike(DEFENSE_ORDER)
    law = F.when(text.contains("223-фз") | (F.col("report_id") == 1), "223").when(text.contains("44-фз") | (F.col("report_id") == 2), "44").when(F.col("report_id") == 3, "commercial")
    regime = F.when(~text.rlike("1875|национальный режим"), "none").when(text.contains("преимущество"), "preference").when(text.contains("запрет"), "ban").otherwise("restriction")
    column = lot_divisible(report("Лот делимый", "lotDivisible"))
    direct = F.concat_ws(" ", get("lotDivisible"), F.try_element_at("evidence", F.lit("lotDivisible"))).rlike(DIRECT_LOT)
    lot = F.when(column, "yes").when(~column, "no").when(direct, get("lotDivisible"))
    batches = F.coalesce(F.col("combined_text").rlike(BATCHES), F.lit(False))
    yes_no = lambda cond: F.when(cond, "yes").otherwise("no")
    values = {
        "tenderUrlSource": F.coalesce(get("tenderUrlSource"), F.col("tender_url")),
        "dateCreated": normal_date(F.coalesce(get("dateCreated"), F.col("ref_date").cast("string"))),
        "tenderStatus": F.coalesce(get("tenderStatus"), F.lit("Загружен Seldon")),
        "finalPrice": F.coalesce(get("finalPrice"), F.lit("0")),
        "initialPrice": F.coalesce(get("initialPrice"), inner("purchasePrice", "initialPrice", "price")),
        "counterpartyName": F.coalesce(get("counterpartyName"), get("counterparty"), inner("organizer.name"), report("Название заказчика", "Организатор")),
        "counterpartyInn": F.nullif(digits(F.coalesce(get("counterpartyInn"), get("inn"), inner("organizer.inn"), report("ИНН заказчика", "ИНН заказчика/организатора"))), F.lit("")),
        "counterpartyKpp": F.nullif(digits(F.coalesce(get("counterpartyKpp"), get("kpp"), inner("organizer.kpp"), report("КПП заказчика", "КПП заказчика/организатора"))), F.lit("")),
        "lotDivisible": lot,
        "federalLaw": F.coalesce(get("federalLaw"), law),
        "stateDefenseOrder": F.coalesce(get("stateDefenseOrder"), yes_no(defense)),
        "specialAccount": F.coalesce(get("specialAccount"), yes_no(defense | text.contains("спецсчет"))),
        "nationalRegime": F.coalesce(get("nationalRegime"), regime),
        "paymentDelayDays": F.coalesce(get("paymentDelayDays"), F.nullif(F.regexp_extract("combined_text", PAYMENT, 1), F.lit(""))),
        "deliveryType": F.when(batches, "by_requests").otherwise(get("deliveryType")),
        "deliveryNote": F.coalesce(get("deliveryNote"), F.when(batches, "Поставка партиями/по заявкам")),
        "submissionDeadlineTime": F.coalesce(normal_time(get("submissionDeadlineTime")), get("submissionDeadlineTime")),
    }
    values |= {n: normal_date(get(n)) for n in DATE_FIELDS if n != "dateCreated"}
    set_ = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()])), lambda k, v: v.isNotNull())
    rest = F.map_filter("fields", lambda k, v: ~k.isin(*values))
    size = lambda n: F.length(values[n])
    wrong = lambda n: F.concat(F.lit(f"{n} выглядит некорректно: "), values[n])
    warnings = F.array_compact(F.array(
        F.when(get("lotDivisible").isNotNull() & lot.isNull(), "Лот делимый не заполнен: нет прямого evidence."),
        F.when(~size("counterpartyInn").isin(10, 12), wrong("counterpartyInn")), F.when(size("counterpartyKpp") != 9, wrong("counterpartyKpp")),
    ))
    return tenders.withColumns({"validated": F.map_concat(rest, set_), "field_warnings": warnings})
