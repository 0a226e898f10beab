import json

from pyspark.sql import functions as F

from lotwise.operators import answers


def col(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_json_reply(spark):
    got = col(spark, ['{"a": 1}', 'So:\n```json\n[1, 2]\n```', 'it is {"a": {"b": 2}} indeed', "plain", "", None, '"text"', '{"a": '], answers.json_reply)
    assert [(x.json, x.origin) if x else None for x in got] == [('{"a": 1}', "raw"), ("[1, 2]", "markdown_fence"), ('{"a": {"b": 2}}', "object_bounds"), None, None, None, None, None]


def test_small_shapes(spark):
    assert col(spark, ['{"value": "x"}', "y", "[1]", None], answers.unwrapped) == ["x", "y", "[1]", None]
    assert col(spark, ['{"url": "u", "urlSource": " s ", "downloadUrl": "u"}', "{}"], answers.document_urls) == [["s", "u"], []]
    assert col(spark, ['{"fileName": "", "row": null}', '{"row": 3}', None], answers.price_source) == [None, '{"row": 3}', None]


def test_direct_match(spark):
    said = {"match": {"Артикул": "A1", "Цена": "1 234,50 руб.", "currencyId": "RUR", "Соответствие": "Аналог"}}
    got = col(spark, [json.dumps(said, ensure_ascii=False), '{"match": {"median_price": "", "price": 7}}', '{"candidates": []}', None], answers.direct_match)
    assert (got[0].article, got[0].median_price, got[0].currency, got[0].correspondence) == ("A1", 1234.5, "RUB", "Аналог")
    assert (got[1].median_price, got[1].correspondence) == (7.0, answers.NOT_FOUND) and got[2] is None and got[3] is None


def test_selection(spark):
    got = col(spark, ['{"selectedPointId": " 7 ", "Соответствие": "Аналог"}', '{"selectedPointId": ""}', None], answers.selection)
    assert [(x.point_id, x.correspondence, x.rationale) for x in got] == [("7", "Аналог", ""), (None, answers.NOT_FOUND, ""), (None, answers.NOT_FOUND, "")]


def test_candidate_list(spark):
    rows = spark.createDataFrame([([("p", {f"k{i}": "v" * 900 for i in range(40)})],)], "c array<struct<id:string,params:map<string,string>>>")
    at = lambda n: json.loads(rows.select(answers.candidate_list(F.col("c"), n)).first()[0])[0]
    assert len(at(100_000)["params"]) == 40
    assert len(at(30_000)["params"]) == 30 and {len(v) for v in at(30_000)["params"].values()} == {500}
    assert at(100) == {"id": "p", "params": {}}


def test_registry_rows(spark):
    row = {"innOrg": "7700000001", "kppOrg": "770001001", "fullNameOrg": "Org"}
    bodies = [{"data": {"rows": [row, {"inn": "1"}, "junk"]}}, {"body": {"result": {"row": row}}}, {"status": {"code": 500, "descr": "down"}}, {"rows": []}]
    docs = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, None)], "i int, body string")
    got = [(r.i, r.pos, r.inn, r.kpp, r.full_name, r.error) for r in answers.registry_rows(docs, ["i"]).orderBy("i", "pos").collect()]
    assert got == [
        (0, 0, "7700000001", "770001001", "Org", None), (0, 1, None, None, None, None), (1, 0, "7700000001", "770001001", "Org", None), (2, 0, None, None, None, "code 500: down"),
    ]


def test_broken_json_is_repaired(spark):
    import json

    cases = {
        '{"fields":{"dateCreated":{"value":"2026-08-17" "confidence":"high","source":"document"}},"warnings":[]}': {"fields": {"dateCreated": {"value": "2026-08-17", "confidence": "high", "source": "document"}}, "warnings": []},
        '{"decision":"reject"': {"decision": "reject"}, '{"a": [1, 2, {"b": "open': {"a": [1, 2, {"b": "open"}]}, "{'a': 'it\\'s \"x\"', b: None,}": {"a": 'it\'s "x"', "b": None},
        '[1 2,, 3,]': [1, 2, 3], '{"a":, "b": 1, "c"}': {"a": None, "b": 1, "c": None}, '{"a": "line\nbreak"}': {"a": "line\nbreak"}, '{"a": [1}, "b": 2}': {"a": [1]}, '{"a": tru, "b": 01}': {"a": "tru", "b": "01"},
        'x {"a": {"b": []}} {"second": 1}': {"a": {"b": []}}, '{"a": "\\u00e9\\"q"': {"a": 'é"q'}, "[]": [], "{": {}, '{"a": 1]': {"a": 1}, '{{"a": 1}}': {"": {"a": 1}},
        "no json": None, "": None, None: None, "]}": None, '{"a": "tail\\': {"a": "tail"},
    }
    got = col(spark, list(cases), answers.repaired_json)
    assert [json.loads(x) if x is not None else None for x in got] == list(cases.values())
    long = '{"a": [' + " ".join(f'{{"k": {i}}}' for i in range(20_000))
    (made,) = col(spark, [long], answers.repaired_json)
    assert [x["k"] for x in json.loads(made)["a"]] == list(range(20_000))


def test_cut_replies_are_not_repaired(spark):
    rows = spark.createDataFrame([('{"decision":"reject"', True), ('{"decision":"reject"', False), ('{"decision":"reject"}', True), ('{"decision":"reject"', None)], "t string, cut boolean")
    got = [(r.x.json, r.x.repaired) if r.x else None for r in rows.select(answers.json_result(F.col("t"), F.col("cut")).alias("x")).collect()]
    assert got == [None, ('{"decision":"reject"}', True), ('{"decision":"reject"}', False), ('{"decision":"reject"}', True)]
