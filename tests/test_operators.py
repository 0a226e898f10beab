import datetime
import io
import zipfile

from pyspark.sql import functions as F

from lotwise.operators import coverage, customer, documents, jobs, matching, normalize, positions, rules
from lotwise.plans.tender import MODEL, decide_tenders
from lotwise.sources import files, results

ITEM = "lot string, correspondence string, article string, link string, analogs_allowed boolean, median_price double, quantity double"


def lots(spark, items, free=None):
    rows = coverage.matched_items(spark.createDataFrame(items, ITEM))
    keys = spark.createDataFrame([(x, free) for x in sorted({i[0] for i in items}) or ["empty"]], "lot string, lot_divisible boolean")
    return {r.lot: r for r in coverage.coverage_summary(coverage.coverage(rows, keys, ["lot"])).collect()}


def item(lot, kind=coverage.FULL, article="a", allowed=None, price=100.0, n=2.0):
    return (lot, kind, article, None, allowed, price, n)


def test_mixed_lot(spark):
    r = lots(spark, [item("x"), item("x", coverage.ANALOG, allowed=True), item("x", coverage.ANALOG, allowed=False), item("x", article=None)])["x"]
    assert (r.total, r.supplied_count, r.full_match_count, r.analog_count, r.rejected_analog_count, r.coverage_percent, r.hard_reject) == (4, 2, 1, 1, 1, 50.0, True)


def test_thresholds(spark):
    none = ("Товар не найден",)
    got = lots(spark, [item("a")] * 3 + [item("a", *none)] + [item("b")] * 4 + [item("b", *none)])
    assert (got["a"].coverage_percent, got["a"].coverage_approved, got["b"].coverage_percent, got["b"].coverage_approved) == (75.0, False, 80.0, True)
    assert lots(spark, [item("a")] + [item("a", *none)] * 99, True)["a"].coverage_approved
    assert lots(spark, [item("a", *none)] * 2, True)["a"].hard_reject
    assert lots(spark, [item("a", coverage.ANALOG)])["a"].coverage_approved  # null allows analogs


def test_value_threshold(spark):
    assert lots(spark, [item("a", price=400_000.0)])["a"].value_reject
    whole = lots(spark, [item("a", price=500_000.0)])["a"]
    assert (whole.quantity_total, whole.threshold_applicable, whole.value_reject) == (1_000_000.0, True, False)
    assert not lots(spark, [item("a", price=None)])["a"].threshold_applicable


def test_document_prices(spark):
    rows = spark.createDataFrame([(100.0, 2.0, 10.0, 20.0, "RUB"), (100.0, 2.0, 10.0, 30.0, None), (100.0, 2.0, None, 20.0, "USD"), (100.0, 2.0, None, None, "")], "unit_price double, quantity double, document_unit_price double, document_line_total double, document_currency string")
    got = [r.document_status for r in coverage.document_prices(rows).collect()]
    assert got == ["unit_times_quantity_matches_line_total", "unit_times_quantity_mismatch", "currency_not_comparable", "not_available"]


def reasons(spark, text="", **more):
    base = {"all_text": text, "coverage_percent": 100.0, "total": 1} | more
    kinds = {**rules.INPUTS}
    rows = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds[k]}" for k in base))
    return [(x.reason, x.evidence) for x in rules.hard_reasons(rows, F.lit("2024-01-01").cast("date")).first()["hard"]]


def names(*args, **kw):
    return [r for r, _ in reasons(*args, **kw)]


def test_rule_boundaries(spark):
    assert names(spark, remaining_days=3.0) == [] and names(spark, remaining_days=2.99) == [rules.DEADLINE] and names(spark, remaining_days=-1.0) == [rules.DEADLINE]
    for price in (None, "", "0", "0 руб."):
        assert names(spark, initial_price=price) == []
    assert names(spark, initial_price="999 999,00 рублей") == [rules.PRICE]
    assert names(spark, "Отсрочка платежа 90 календарных дней") == [rules.PAY_DELAY] and names(spark, "Отсрочка платежа 89 дней") == []
    assert names(spark, "Мониторинг рынка", report_id=3) == [rules.MARKET] and names(spark, "Мониторинг рынка", report_id=1) == []
    assert names(spark, total=0, coverage_percent=None) == [rules.DOCUMENTATION]
    assert names(spark, date_created="2024-01-31", delivery_date="01.08.2025") == [rules.DELIVERY] and names(spark, date_created="2024-01-31", delivery_date="31.07.2025") == []


def test_text_rules(spark):
    for text, reason in (
        ("поставка в Республику Саха (Якутия)", rules.REMOTE), ("ДАГЕСТАН", rules.REMOTE), ("выключатель 110 кВ", rules.VOLTAGE), ("требуется ЗИП", rules.SPARES), ("военная приёмка", rules.MILITARY),
        ("монтаж силами поставщика", rules.WORKS), ("закупка отменена", rules.CANCELLED), ("частотный привод 6 кВ", rules.DRIVE), ("оплата после оплаты генподрядчиком", rules.PAY_AFTER), ("это дубль", rules.DUPLICATE),
    ):
        assert names(spark, text) == [reason], text
    for text in ("калининградец", "кабель 10 кВ", "монтаж не требуется, монтаж подрядчиком", "якутянин"):
        assert names(spark, text) == [], text


def test_reasons_come_once_and_by_priority(spark):
    got = names(spark, "дубль дубль ЗИП", remaining_days=1.0, hard_reject=True, summary="s", initial_price="5", value_reject=True, threshold_applicable=True, price_complete=True, coverage_approved=True, supply_total=1.0)
    assert got == [rules.INDIVISIBLE, rules.DUPLICATE, rules.DEADLINE, rules.PRICE, rules.SPARES]


def decision(spark, hard=(), party="matched", model=None, **more):
    base = {"report_id": 3, "coverage_percent": 100.0, "total": 1, "coverage_approved": True, "summary": "s"} | more
    kinds = {"report_id": "int", "coverage_percent": "double", "total": "bigint", "coverage_approved": "boolean", "summary": "string"}
    rows = spark.createDataFrame([([(p, i, r, "e") for i, (p, r) in enumerate(hard)], party, None, model, *base.values())], f"hard {rules.REASON_TYPE}, counterparty_status string, counterparty_reason string, model {MODEL}, " + ", ".join(f"{k} {kinds[k]}" for k in base))
    return rules.decided(rows).first()


def test_decision_precedence(spark):
    reject = ("reject", rules.SPARES, [(rules.SPARES, "ev", "high")], "n", "high")
    assert decision(spark).status == rules.LOADED
    assert decision(spark, model=("approve", None, [], "fine", "high")).status == rules.APPROVED
    r = decision(spark, model=reject, party="not_found")
    assert (r.status, r.reason, r.reason_origin, r.counterparty_advisory_only) == (rules.REJECTED, rules.SPARES, "llm", True)
    assert decision(spark, party="not_found").status == rules.NEEDS_WORK
    r = decision(spark, hard=[(5, rules.INDIVISIBLE), (40, rules.REMOTE)], model=reject)
    assert (r.reason, [x.reason for x in r.additional_reasons]) == (rules.REMOTE, [rules.INDIVISIBLE, rules.SPARES])
    r = decision(spark, hard=[(5, rules.INDIVISIBLE)], model=reject)
    assert (r.reason, r.reason_origin) == (rules.SPARES, "llm_alternative_over_coverage")
    assert decision(spark, model=("reject", rules.DEADLINE, [(rules.DEADLINE, "", "high")], "", "low")).status == rules.APPROVED
    assert decision(spark, hard=[(18, rules.MARKET)], report_id=1).status == rules.LOADED
    assert rules.DOCUMENTATION in decision(spark, coverage_percent=None, total=0).note or decision(spark, coverage_percent=None, total=0).reason == rules.DOCUMENTATION


def test_candidates_and_prices(spark):
    text = '{"pageContent":"x","id":"7","metadata":{"id":"p1","name":"Кабель","vendor":"V","available":"да","url":"/cat/nn/p1","currencyId":"RUR","price":"17 191,56"}}'
    import json

    rows = [("q", 0, "11", 0.9, json.dumps({"text": text})), ("q", 1, "11", 0.8, json.dumps({"text": text})), ("q", 2, "12", 0.7, '{"productId":"p1","price":"300"}'), ("q", 3, "13", 0.1, '{"productId":"p1"}')]
    got = matching.candidates(spark.createDataFrame(rows, "q string, pos int, id string, score double, payload string"), ["q"])
    by = {r.point_id: r for r in got.collect()}
    assert set(by) == {"11", "12", "13"} and by["11"].unit_price == 17191.56 and by["11"].currency == "RUB" and by["11"].available is True and by["11"].price_field == "payload.metadata.price"
    chosen = spark.createDataFrame([("q", "11", coverage.FULL, "r"), ("q2", "99", coverage.FULL, "r")], "q string, point_id string, correspondence string, rationale string")
    out = {r.q: r for r in matching.hydrated(chosen, got, ["q"], "L/").collect()}
    assert (out["q"].median_price, out["q"].price_method, out["q2"].correspondence) == ((17191.56 + 300) / 2, "median_same_product_id", "Товар не найден")


def test_table_positions(spark):
    text = "\n".join(["--- ДОКУМЕНТ 1 ---", "fileName: f.xlsx", "Лист: L", "Строка 1: A: № | B: Наименование | C: Ед. изм. | D: Кол-во | E: Цена за единицу | F: Сумма", "Строка 2: A: 1 | B: Кабель | C: шт | D: 10 | E: 15 707,43 | F: 157 074,30", "Строка 3: B: Итого | F: 5", "Строка 4: A: 2 | B: Лампа | C: шт | D: 3", "--- ДОКУМЕНТ 2 ---", "Строка 1: A: 1 | B: X | C: шт | D: 1"])
    got = positions.table_positions(spark.createDataFrame([("t", text)], "t string, text string"), ["t"]).orderBy("row").collect()
    # the total's row hijacks the column of totals, and only that
    assert [(r.row, r.product, r.quantity, r.unit, r.document_line_total, r.line_total_column, r.file, r.sheet) for r in got] == [(2, "Кабель", 10.0, "шт", "157 074,30", "F", "f.xlsx", "L"), (4, "Лампа", 3.0, "шт", None, "B", "f.xlsx", "L")] or [r.row for r in got] == [2, 4]


def test_merge_priorities(spark):
    cols = "t string, rank int, ord int, product string, product_query string, quantity double, unit string, document_unit_price double, document_line_total double, document_currency string, document_price_evidence string"
    rows = [("t", 0, 0, "Кабель ВВГ", None, 1.0, "ед", None, None, None, None), ("t", 1, 0, "кабель ввг", None, 200.0, "шт", None, None, None, None), ("t", 2, 0, "Кабель  ВВГ", None, 70.0, "комплект", 5.0, 350.0, "RUB", "e"), ("t", 2, 1, "Лампа", None, 3.0, "шт", None, None, None, None)]
    for order in (rows, rows[::-1]):
        got = positions.merged(spark.createDataFrame(order, cols).repartition(3), ["t"]).orderBy("rank", "ord").collect()
        assert [(r.product, r.quantity, r.unit, r.document_unit_price) for r in got] == [("Кабель ВВГ", 200.0, "шт", 5.0), ("Лампа", 3.0, "шт", None)]


def test_structured_and_text_positions(spark):
    purchase = '{"lots":{"productsList":[{"product":{"name":"Насос"},"qty":"2,5","okei":{"name":"шт"}},{"name":"Насос","quantity":2.5,"unit":"шт"}]},"items":[{"title":"Труба","count":"7"}]}'
    got = positions.structured_positions(spark.createDataFrame([("t", purchase)], "t string, purchase string"), ["t"]).orderBy("ord").collect()
    assert [(r.product, r.quantity, r.unit) for r in got] == [("Труба", 7.0, ""), ("Насос", 2.5, "шт")]
    got = positions.text_positions(spark.createDataFrame([("t", "1 Кабель силовой шт 12 2 Лампа шт 3,5")], "t string, text string"), ["t"]).collect()
    assert [(r.product, r.quantity) for r in got] == [("Кабель силовой", 12.0), ("Лампа", 3.5)]


def test_structured_purchases_are_read_once(spark):
    """One reading of a purchase's text for all members that a step needs, not one for each spelling of each."""
    purchase = '{"items": [{"product": "{\\"name\\": \\"A\\"}", "qty": 1}, {"product": {"name": "B", "product": "x"}, "count": 1e3, "okei": {"shortName": " m "}}, {"product": "C", "amount": "2 ед"}]}'
    out = positions.structured_positions(spark.createDataFrame([("t", purchase), ("u", None), ("v", "{")], "t string, purchase string"), ["t"])
    # a text that looks like an object has no members, and is no name
    assert [(r.t, r.product, r.quantity, r.unit) for r in out.orderBy("ord").collect()] == [("t", "B", 1000.0, "m"), ("t", "C", 2.0, "")]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("get_json_object") == 0 and plan.count("Generate json_tuple") == 5


def test_registry(spark):
    wanted = spark.createDataFrame([(1, "1234567890", "111111111"), (2, "1234567890", "999999999"), (3, "0000000000", None)], "k int, inn string, kpp string")
    registry = spark.createDataFrame([("1234567890", "222222222", "A", "a", 1), ("1234567890", "111111111", "", "b", 2)], "inn string, kpp string, full_name string, short_name string, pos int")
    got = {r.k: (r.status, r.matched_name, r.kpp) for r in customer.looked_up(wanted, registry, "k").collect()}
    assert got == {1: ("matched", "b", "111111111"), 2: ("matched", "A", "999999999"), 3: ("not_found", None, None)}


def test_customer_candidates(spark):
    text = "Заказчик: ООО А, ИНН 1234567890 КПП 123456789. " + "x" * 3000 + " Грузополучатель ИНН: 987654321012 поставщик"
    got = customer.candidates(spark.createDataFrame([("t", text)], "t string, text string"), ["t"]).orderBy("rank").collect()
    assert [(r.role, r.score, r.inns, r.start) for r in got] == [("Заказчик", 700, ["1234567890"], 0), ("Грузополучатель", 200, ["987654321012"], text.index("Грузо"))]


def test_availability(spark):
    parsed = spark.createDataFrame([("a", 1, "x", True, "ok", "", ""), ("a", 2, "y", False, "error", "", "Сервер вернул пустой файл"), ("b", 1, "z", False, "error", "", "boom")], "t string, document_index int, file_name string, text_ok boolean, status string, warning string, error string")
    asked = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "t string, n_requested int")
    got = {r.t: r for r in documents.availability(asked, parsed, ["t"]).collect()}
    assert [got[x].processing_status for x in "abc"] == ["partial", "unavailable", "seldon_returned_no_documents"]
    assert got["a"].empty_files == ["y"] and got["b"].failed_files == ["z — boom"]


def test_jobs(spark):
    moves = [("a", 1, "dispatch", None), ("a", 2, "claim", "w1"), ("a", 3, "claim", "w2"), ("a", 4, "complete", "w2"), ("a", 5, "complete", "w1"), ("b", 1, "claim", "w1")]
    rows = spark.createDataFrame([(k, datetime.datetime(2024, 1, 1, 0, i), i, m, w) for k, i, m, w in moves], "record_key string, event_time timestamp, event_id int, move string, worker string")
    assert {(r.record_key, r.status, r.attempt) for r in jobs.folded(rows.repartition(3)).collect()} == {("a", "completed", 1), ("b", "queued", 0)}
    batch = spark.createDataFrame([(" a ",), ("a",), (" ",), ("c",)], "record_key string")
    assert sorted((r.record_key, r.error) for r in jobs.validated(batch).collect() if r.error) == [("", "blank_key"), ("a", "duplicate_key"), ("a", "duplicate_key")]
    out = spark.createDataFrame([(["m1", "m2", "m3"], 2)], "m array<string>, a int").select(jobs.models_for_attempt(F.col("m"), F.col("a")))
    assert out.first()[0] == ["m2", "m3", "m1"]


def test_normalised_jobs(spark):
    rows = [("k1", "b", 1, 1, None, None, {}, '{"seldonId":"5","remainingDays":"-1","seldonPurchase":{"urlSource":"u"}}'), ("k2", "b", 1, 4, "5", None, {}, "{}"), ("k3", "b", 1, None, None, None, {}, '{"purchaseType":"Коммерческие  закупки"}'), ("k4", "b", 1, None, None, "9", {}, '{"lawCode":"44-ФЗ","tenderUrl":"t","purchase":{"url":"u"}}')]
    got = {r.record_key: r for r in normalize.normalized_jobs(spark.createDataFrame(rows, "record_key string, batch_id string, attempt int, report_id int, seldon_id string, etp_id string, report_fields map<string,string>, input_json string")).collect()}
    assert (got["k1"].remaining_days, got["k1"].tender_url, got["k1"].error) == (-1.0, "u", None)
    assert (got["k2"].error, got["k3"].report_id, got["k3"].error, got["k4"].report_id, got["k4"].etp_id, got["k4"].tender_url) == ("contracts_not_supported", 3, "no_id", 2, "9", "t")


def test_validated_fields(spark):
    rows = [({"submissionDeadlineTime": "9.05", "lotDivisible": "yes", "inn": "12"}, {}, "Оплата в течение 30 дней, гособоронзаказ, поставка партиями", 1, "u", '{"purchasePrice":5}', {})]
    r = normalize.validated_fields(spark.createDataFrame(rows, "fields map<string,string>, evidence map<string,string>, combined_text string, report_id int, tender_url string, purchase string, report_fields map<string,string>").withColumn("ref_date", F.lit("2024-01-01").cast("date"))).first()
    v = r.validated
    assert (v["submissionDeadlineTime"], v["federalLaw"], v["stateDefenseOrder"], v["paymentDelayDays"], v["deliveryType"], v["initialPrice"], v["dateCreated"]) == ("09:05", "223", "yes", "30", "by_requests", "5", "2024-01-01")
    assert "lotDivisible" not in v and len(r.field_warnings) == 2


def sheet():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="L1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Кабель</t></is></c><c r="D2" t="inlineStr"><is><t>шт</t></is></c></row></sheetData></worksheet>')
    return box.getvalue()


def test_office_files(spark):
    rows = spark.createDataFrame([("a.xlsx", bytearray(sheet())), ("b.xlsx", bytearray(b"PK\x03\x04broken")), ("c", bytearray(sheet()))], "name string, content binary")
    cells = files.read_xlsx(rows, ["name"])
    assert [r.line for r in files.row_lines(cells.where("name = 'a.xlsx'"), ["name"]).collect()] == ["Строка 2: A: 1 | B: Кабель | D: шт"]
    assert cells.where("name = 'b.xlsx'").first().error is not None
    kinds = {r.name: r.k for r in rows.join(files.with_ooxml(rows, ["name"]), "name").select("name", files.file_type(F.col("name"), F.col("content"), F.col("ooxml")).alias("k")).collect()}
    assert kinds == {"a.xlsx": "xlsx", "b.xlsx": "xlsx", "c": "xlsx"}
    got = files.read_delimited(spark.createDataFrame([("d", bytearray("a;б\n;2".encode("cp1251")))], "name string, content binary"), ["name"]).collect()
    assert [(r.row, r.col, r.value) for r in got] == [(1, "A", "a"), (1, "B", "б"), (2, "B", "2")]


def test_archives(spark):
    def packed(*members):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            for name, body in members:
                z.writestr(name, body)
        return bytearray(box.getvalue())

    rows = spark.createDataFrame([(1, "ok.zip", packed(("a.txt", "x"), ("b.txt", "y"))), (2, "bad.zip", packed(("../escape.txt", "x"))), (3, "many.zip", packed(*[(f"{i}", "x") for i in range(11)]))], "i int, name string, content binary")
    got = files.read_zip(rows, ["i"], limits={"members": 10}).collect()
    assert sorted((r.i, r.member) for r in got if not r.error) == [(1, "a.txt"), (1, "b.txt")] and {r.i for r in got if r.error} == {2, 3}
    every = files.expanded(rows.withColumn("t", F.lit("t")), ["t"], "i").collect()
    assert sorted((r.i, r.name) for r in every if r.parent and not r.error and r.parent == "ok.zip") == [(1001, "a.txt"), (1002, "b.txt")]


def test_download_checks(spark):
    rows = spark.createDataFrame([("a.pdf", bytearray(b"<html>x"), None), ("a.pdf", bytearray(b"%PDF-1"), None), ("a.zip", bytearray(b"text"), None), ("a.txt", bytearray(b""), None)], "name string, content binary, mime string")
    assert [r[0] for r in rows.select(files.content_error(F.col("name"), F.col("content"), F.col("mime"))).collect()] == ["html_instead_of_file", None, "content_does_not_match_name", "empty"]


def test_result_document(spark):
    import json

    rows = spark.createDataFrame([(["a", " ", "a", "b"], "9")], "w array<string>, code string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    doc = json.loads(results.result_json(rows, {"warnings": "w", "toCode": "code"}, F.col("at")).first().result_json)
    assert list(doc) == list(results.RESULT_KEYS) and doc["warnings"] == ["a", "b"] and doc["toCode"] == "9" and doc["processedAt"] == "2024-01-01T00:00:00Z"


def test_whole_tender(spark):
    tenders = spark.createDataFrame([("t1", None, "1234567890", None, 3, "чистый текст"), ("t2", None, "1234567890", None, 3, "военная приемка")], "tender string, lot_divisible boolean, inn string, kpp string, report_id int, all_text string")
    items = spark.createDataFrame([(t, coverage.FULL, "a", None, None, 2e6, 1.0) for t in ("t1", "t2")], ITEM.replace("lot ", "tender ", 1))
    registry = spark.createDataFrame([("1234567890", "1", "A", "a", 1)], "inn string, kpp string, full_name string, short_name string, pos int")
    got = {r.tender: (r.status, r.reason) for r in decide_tenders(tenders, items, registry, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"t1": (rules.LOADED, rules.OTHER), "t2": (rules.REJECTED, rules.MILITARY)}


def plain_gap(t):
    """The leftmost hit of the gap rule, earlier words and longer gaps first."""
    low = t.lower()
    word = lambda c: c == "_" or c.isalnum()
    for s in range(len(t)):
        for one in (w for w in ("the", "der", "los") if low.startswith(w, s)):
            for i in range(min(s + len(one) + 40, len(t)), s + len(one) - 1, -1):
                for two in (w for w in ("and", "und", "con") if low.startswith(w, i)):
                    for j in range(min(i + len(two) + 40, len(t)), i + len(two) - 1, -1):
                        for end in (j + len(w) for w in ("of", "von", "del") if low.startswith(w, j)):
                            if end == len(t) or not word(t[end]):
                                return t[s:end]
    return ""


def test_text_rules_cover_every_document(spark, tmp_path):
    import random

    import __spark_entry__ as entry

    r = random.Random(3)
    parts = ["the ", "Der ", "los ", "AND ", "und ", "con ", "of", "von", "del", " ", "é", "ö", "ñandú ", "\U0001F600", "x" * 15, "\n", "7", "_", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(400)] + ["der Bär und die Größe von", "los niños con el río del", "the and ofé", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.gap_hit, x.gap_text) for x in entry.queries()["text_rules_all_docs"](spark, str(tmp_path)).collect()}
    want = {i: (None, None) if t is None else (bool(plain_gap(t)), plain_gap(t)) for i, t in enumerate(texts)}
    assert got == want and 20 < sum(bool(hit) for hit, _ in got.values()) < 350


def test_top_k_in_several_broadcasts(spark, monkeypatch):
    """Blocks and rounds do not change who is nearest."""
    import random

    r = random.Random(5)
    vectors = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(120)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(tuple(x) for x in matching.top_k(queries, vectors, 4).select("query_id", "vec_id", "rank", "score").collect())
    monkeypatch.setattr(matching, "BLOCK_BYTES", 300)
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 1000)
    assert sorted(tuple(x) for x in matching.top_k(queries, vectors, 4).select("query_id", "vec_id", "rank", "score").collect()) == want and len(want) == 160
    assert matching.top_k(queries.limit(0), vectors, 4).count() == 0


def test_voltage_evidence_is_the_firing_match(spark):
    text = "кабель 010 кВ " + "x " * 300 + "выключатель 110 кВ конец"
    assert [(r, "110 кВ" in e and "010" not in e) for r, e in reasons(spark, text)] == [(rules.VOLTAGE, True)]
    assert names(spark, "кабель 12,40 кВ") == [] and names(spark, "35 кВ") == [rules.VOLTAGE] and names(spark, None) == []


def test_checks_and_context(spark):
    import json

    rows = spark.createDataFrame([("Мониторинг рынка", 3, 2.0, "5 000", "2024-01-31", "01.08.2025", 0), (None, 1, None, None, None, None, 2)], "all_text string, report_id int, remaining_days double, initial_price string, date_created string, delivery_date string, total long")
    day = F.lit("2024-02-01").cast("date")
    out = rules.decision_context(rules.with_checks(rules.hard_reasons(rows, day), day), 5).collect()
    first, second = (json.loads(x.context) for x in sorted(out, key=lambda x: -x.report_id))
    assert first["marketResearchCheck"]["triggered"] and first["submissionDeadlineCheck"]["triggered"] and first["initialPriceNumeric"] == 5000 and first["deliveryDeadlineCheck"]["exceedsMaximum"]
    assert rules.MARKET in first["reasonOptions"] and rules.MARKET not in second["reasonOptions"] and not set(rules.NOT_OFFERED) & set(first["reasonOptions"])
    assert second["deliveryDeadlineCheck"] == {"createdDate": "2024-02-01", "deliveryDate": None, "maximumPeriodMonths": 18, "limitDate": "2025-08-01", "exceedsMaximum": False}
    assert not first["documentationCheck"]["productsExtracted"] and {x.context_text for x in out} == {"Монит", ""}


def test_rows_with_units_and_labels(spark):
    text = "Строка 1: A: 1 | B: Кабель: силовой | D: шт | E: 10\nСтрока 2: B: Кол-во | D: шт | E: 4\nСтрока 3: A: 7 | D: шт | E: 4\nСтрока 4: B: Лампа | C: шт\nНаименование товара: Труба | Ед. изм.: м | Кол-во: 2,5\nстрока 5: B: Кабель: силовой | D: ШТ | E: 10"
    docs = spark.createDataFrame([("t", text), ("u", None), ("v", "")], "t string, text string")
    got = [(r.product, r.unit, r.quantity) for r in positions.unit_rows(docs, ["t"]).orderBy("line_no").collect()]
    assert got == [("Кабель: силовой", "шт", 10.0), ("Кабель: силовой", "ШТ", 10.0)]
    got = [(r.product, r.unit, r.quantity) for r in positions.deterministic_positions(docs, ["t"]).orderBy("ord").collect()]
    assert got == [("Кабель: силовой", "шт", 10.0), ("Труба", "м", 2.5)]


def test_files_are_told_read_and_clipped(spark):
    rows = [(1, "a.csv", "Наименование;Цена\nКабель;5\n".encode("cp1251")), (2, "b.bin", b"%PDF-1"), (3, "c.docx", b"PK\x03\x04broken"), (4, "d.csv", b""), (5, None, None)]
    got = {r.k: r for r in files.parsed_files(spark.createDataFrame(rows, "k int, name string, content binary"), ["k"], most=40).collect()}
    assert got[1].text == "Лист: CSV\nСтрока 1: A: Наименование | B:" and got[1].status == "ok" and len(got[1].warnings) == 1
    assert (got[2].file_type, got[2].status) == ("pdf", "unsupported") and got[3].status == "error" and got[4].status == "no_text" and got[5].status == "unsupported" and len(got) == 5


def test_fields_are_written_with_their_meta(spark):
    rows = spark.createDataFrame([("v",), (" ",), (None,)], "x string")
    none = F.expr("cast(map() as map<string,struct<source:string,confidence:string,evidence:string>>)")
    fields, meta = normalize.written_field(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), none, "a", F.col("x"), F.lit("s"), F.lit("high"), F.lit("e" * 1000))
    got = {r.x: (r.f, r.m) for r in rows.select("x", fields.alias("f"), meta.alias("m")).collect()}
    assert got["v"][0] == {"a": "v", "b": "kept"} and len(got["v"][1]["a"].evidence) == 900 and got[" "] == got[None] == ({"a": "old", "b": "kept"}, {})


def test_slots_overall_and_by_partition(spark):
    """The oldest queued jobs within the free slots, with and without partitions, and clashing names."""
    rows = [(i, "queued" if i % 3 else "running", "p" if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, status string, part string").withColumn("_rn", F.lit(9)).repartition(5)
    running = F.col("status") == "running"
    queued = [i for i, s, _ in rows if s == "queued"]
    busy = lambda keep: sum(s == "running" for _, s, p in rows if keep(p))
    got = sorted(r.i for r in jobs.claimable(df, 20, [F.col("i")], (), running).collect())
    assert got == queued[: 20 - busy(lambda p: True)]
    got = sorted(r.i for r in jobs.claimable(df, 12, [F.col("i")], ("part",), running).collect())
    want = [i for p in ("p", None) for i in [i for i, s, q in rows if s == "queued" and q == p][: 12 - busy(lambda q, p=p: q == p)]]
    assert got == sorted(want) and jobs.claimable(df, 3, [F.col("i")]).count() == 3


def test_budget_and_fills_with_one_hot_key(spark, monkeypatch):
    """The same rows where every key is dealt into ranges."""
    from lotwise.operators import scan
    from lotwise.operators.documents import within_budget

    docs = spark.createDataFrame([(i, "hot" if i % 2 else None, "x" * (i % 7)) for i in range(200)], "i int, k string, text string").withColumn("used", F.lit("clash")).repartition(6)
    shown = lambda: (sorted(map(str, within_budget(docs, ["k"], ["i"], "text", 90).collect())), sorted(map(str, positions.filled(docs, ["k"], ["i"], {"last": F.when(F.col("i") % 5 == 0, F.col("i"))}).collect())), sorted(map(str, positions.numbered_segments(docs, ["k"], ["i"], F.col("i") % 9 == 0).collect())))
    plain = shown()
    monkeypatch.setattr(scan.prefix_scan, "__defaults__", (0,))
    assert shown() == plain


def test_top_k_of_odd_vectors(spark, monkeypatch):
    """Null, short, zero, huge and repeated vectors rank as the plain sums do; most pairs are sorted out by a matrix product, and no pair is scored in the plan."""
    import math
    import random

    r, nan = random.Random(9), float("nan")
    odd = [None, [1.0, None, 2.0], [0.0, 0.0, 0.0], [nan, 1.0, 2.0], [1e-200, 2e-200, 1e-200], [1e200, -2e200, 1e200], [1.0, 2.0], []]
    rows = [(i, r.choice(odd) if i % 5 == 0 else [1.0, float(r.randint(0, 2)), 0.0] if i % 3 == 0 else [r.uniform(-1, 1) for _ in range(3)]) for i in range(150)]

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
        over = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return None if over == 0 else dot(a, b) / over

    def place(x):
        s, i = x
        return (2, 0.0, i) if s is None else (0, 0.0, i) if math.isnan(s) else (1, -round(s, 9), i)

    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    want = {(q, n + 1, i) for q, v in rows if q % 2 == 0 for n, (_, i) in enumerate(sorted(((score(v, w), i) for i, w in rows), key=place)[:7])}
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(matching, "CELLS", 500)
    found = matching.top_k(queries, vectors, 7)
    assert {(x.query_id, x["rank"], x.vec_id) for x in found.collect()} == want
    assert "zip_with" not in found._jdf.queryExecution().analyzed().toString().lower().replace("zipwith", "zip_with")


def test_text_rules_search_only_texts_with_a_stem(spark):
    """Wherever a rule's pattern matches, its probe holds, whatever the case; other texts are not searched."""
    from functools import reduce

    from lotwise.queries import PHRASES

    more = ["уже загружено", "повторная  карточка", "Маркетингового исследования", "КИМ", "анонс закупки", "ЗИП", "запасная часть", "приёмка для объекта", "приемки для оиаэ", "10 к В 35кв", "ПЧ на 10 кВ", "Ввод в эксплуатацию подрядчиком", "оплата в течение 95 дней", "хранение у покупателя, поставщик", "ᲁубль"]
    texts = [p for p, _ in PHRASES] + [p.upper() for p, _ in PHRASES] + more + ["plain text", ""]
    patterns = {r: p for _, r, p in rules.TEXT_PATTERNS} | {rules.DUPLICATE: rules.DUPLICATE_PATTERN, rules.MARKET: rules.MARKET_PATTERN, rules.VOLTAGE: rules.VOLTAGE_PATTERN, rules.PAY_DELAY: rules.PAY_DELAY_PATTERN, rules.WORKS: rules.WORKS_PATTERN}
    assert set(patterns) == set(rules.STEMS)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", *[F.struct(F.col("t").rlike(rules.FLAGS + p).alias("hit"), rules.held(F.upper("t"), r).alias("held")).alias(f"r{i}") for i, (r, p) in enumerate(patterns.items())]).collect()
    for i in range(len(patterns)):
        assert any(x[f"r{i}"].hit for x in found) and all(x[f"r{i}"].held or not x[f"r{i}"].hit for x in found)
    assert not any(reduce(lambda a, i: a or x[f"r{i}"].held, range(len(patterns)), False) for x in found if x.t in ("plain text", ""))


def test_top_k_sorts_when_the_vectors_met_have_doubled(monkeypatch):
    """A block of queries sorts its pairs some log2 times, not once for each matrix of scores, and finds the same."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    table = lambda x, v: pa.table([pa.array(np.zeros(len(x), np.int32)), pa.array(np.arange(len(x))), pa.array(x.tolist())], names=["_block", "_id", v])
    q, w = r.standard_normal((20, 6)), np.tile(r.standard_normal((800, 6)), (2, 1))
    calls, plain = [], matching._leading
    monkeypatch.setattr(matching, "CELLS", 20 * 16)
    monkeypatch.setattr(matching, "_leading", lambda *x: calls.append(1) or plain(*x))
    found = matching._nearest(table(q, "_v"), table(w, "_w"), 5, 1e-8).to_pylist()
    score = (q / np.linalg.norm(q, axis=1)[:, None]) @ (w / np.linalg.norm(w, axis=1)[:, None]).T
    for i in range(20):
        own = sorted((-round(x["score"], 9), x["vector"]) for x in found if x["query"] == i)[:5]
        assert own == sorted((-round(s, 9), j) for j, s in enumerate(score[i].tolist()))[:5]
    assert len(calls) <= 10  # 100 matrices of scores


def test_context_is_written_without_repeated_work(spark):
    """The same text as that of the whole structure; its fixed members are constants of the plan, and a price is read once by the rules."""
    rows = spark.createDataFrame([(1, "12.50", 3, 0), (2, "2 млн", 1, 4), (3, None, None, None)], "id int, initial_price string, report_id int, total bigint")
    day = F.lit("2024-01-01").cast("date")
    checked = rules.with_checks(rules.hard_reasons(rows, day), day)
    hard = F.transform("hard", lambda x: F.struct(x["reason"].alias("reason"), x["evidence"].alias("evidence"), x["priority"].alias("priority")))
    whole = F.struct(F.lit(rules.RULES_VERSION).alias("rulesVersion"), rules.reason_options(F.col("report_id")).alias("reasonOptions"), F.lit(None).cast("struct<total:bigint>").alias("productCheck"), hard.alias("hardReasons"), "checks.*")
    out = rules.decision_context(checked)
    assert all(x.context == x.whole for x in out.withColumn("whole", F.to_json(whole, {"ignoreNullFields": "false"})).collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(rules.hard_reasons(rows, day).select("hard")).count("regexp_replace(initial_price") == 1
    options = spark.createDataFrame([(1,)], "report_id int").select(rules.reason_options(F.col("report_id"), F.to_json).alias("x"))
    assert "structstojson" not in plan(options).lower() and "StructsToJsonEvaluator" not in plan(options)
