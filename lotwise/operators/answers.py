"""What outside services answer: model replies, catalogue matches and selections, registry responses.

The engine calls no service. Landed answers arrive as a column of text; these functions turn
it into the columns that the operators read, so a model or a registry can be plugged in anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_money
from ..functions.text import currency, first_defined, ordered_unique, registration_code, string_or_none, tax_number

NOT_FOUND = "Товар не найден"
#: Spellings of a direct match's fields, in the order in which they count.
MATCH = {
    "article": ("Артикул", "article"),
    "link": ("Ссылка", "link"),
    "name": ("Наименование", "name"),
    "manufacturer": ("Производитель", "manufacturer"),
    "median_price": ("Медианная цена", "median_price", "Медианная цена, руб.", "Цена", "medianPrice", "price"),
    "currency": ("Валюта", "currency", "currencyId", "currency_id"),
    "price_source": ("Источник цены", "priceSource", "price_source"),
    "rationale": ("Обоснование", "rationale"),
    "correspondence": ("Соответствие", "correspondence"),
    "point_id": ("Qdrant point ID", "qdrant_point_id"),
    "product_id": ("ID товара", "product_id"),
}
#: Members that make a price source worth keeping; limits of a candidate list.
PRICE_SOURCE = ("fileName", "sheet", "row", "unitPriceColumn", "lineTotalColumn", "unitPriceHeader", "lineTotalHeader")
MOST_CHARS, MOST_PARAMS, NAME_CHARS, VALUE_CHARS = 150_000, 30, 200, 500
#: Where a registry's answer keeps its rows, and a single row.
ROWS = ("data.rows", "result.data.rows", "result.rows", "rows")
ROW = ("data.row", "result.row", "row")


def member(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$['{name}']")


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def _is_container(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def json_object(value: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(is_object(value), value)


def unwrapped(value: Column) -> Column:
    """{"value": x} as x; anything else as it is."""
    return F.coalesce(F.when(is_object(value), F.get_json_object(value, "$.value")), value)


def json_reply(reply: Column) -> Column:
    """struct(json, origin) of a model's reply: the whole text, else what a code fence or the outermost braces hold.

    Null if nothing in it is a JSON object or list; json_result() also repairs broken JSON.
    """
    text = F.regexp_replace(reply, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    bounded = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tried = (("raw", text), ("markdown_fence", fenced), ("object_bounds", bounded))
    return F.coalesce(*[F.when(_is_container(x), F.struct(x.alias("json"), F.lit(origin).alias("origin"))) for origin, x in tried])


#: A piece of JSON text: a string in either quotes, closed or not, a bracket, a sign, a bare word. Pieces that one step of the fold takes.
PIECE = r"""(?s)"(?:[^"\\]|\\.|\\\z)*+(?:"|\z)|'(?:[^'\\]|\\.|\\\z)*+(?:'|\z)|[{}\[\],:]|[^\s{}\[\],:"']++"""
PIECES = 256


def _scalar(x: Column, key: Column) -> Column:
    """A string or word as JSON: closed, in double quotes, without raw line breaks; known words and numbers stay unless they are keys."""
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    closed = x.rlike(r'(?s)^"(?:[^"\\]|\\.)*+"$')
    double = plain(F.when(closed, x).otherwise(F.concat(F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\$", "$1"), F.lit('"'))))
    inner = F.replace(F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"(?<!\\)'$", ""), F.lit("\\'"), F.lit("'"))
    single = quoted(plain(F.regexp_replace(inner, r'(?<!\\)"', r'\\"')))
    word = F.when(x.isin("True", "False"), F.lower(x)).when(x == "None", "null").when(x.rlike(r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"), x)
    bare = quoted(F.replace(x, F.lit("\\"), F.lit("\\\\")))
    return F.when(x.startswith('"'), double).when(x.startswith("'"), single).when(key, bare).otherwise(F.coalesce(word, bare))


def repaired_json(text: Column) -> Column:
    """Broken JSON as JSON, null if no object or list begins in it.

    A fold over the pieces with a stack of open brackets. Commas are set anew, so missing, doubled and trailing ones do not
    matter; open strings and brackets are closed, single quotes and bare words become strings, a missing value is null; what follows
    the first whole object or list is left away. Long texts are folded PIECES pieces at a time.
    """
    closers = lambda stack: F.reverse(F.translate(stack, "{[", "}]"))
    start = F.struct(F.lit("").alias("stack"), F.lit("K").alias("phase"), F.lit(False).alias("some"), F.lit(False).alias("over"))
    state = lambda z: [z[n].alias(n) for n in ("stack", "phase", "some", "over")]

    def step(acc: Column, x: Column) -> Column:
        top, phase = F.substring(acc["stack"], F.length(acc["stack"]), F.lit(1)), acc["phase"]
        in_object, is_open, is_close = top == "{", x.isin("{", "["), x.isin("}", "]")
        value = ~is_open & ~is_close & ~x.isin(",", ":")
        # what a container lacks before a comma or its end
        lack = F.when(in_object & (phase == "C"), ":null").when(in_object & (phase == "V"), "null").otherwise("")
        comma = F.when(acc["some"], ",").otherwise("")
        before = F.when(~in_object, F.when(top == "", "").otherwise(comma)).when(phase == "K", F.concat(comma, F.when(is_open, '"":').otherwise(""))).when(phase == "C", ":").otherwise("")
        opener = F.translate(x, "}]", "{[")
        at = F.length(acc["stack"]) - F.position(opener, F.reverse(acc["stack"])) + 1
        found = F.position(opener, acc["stack"]) > 0
        said = (
            F.when(acc["over"] | ((top == "") & ~is_open), "").when(is_open, F.concat(before, x)).when(is_close, F.when(found, F.concat(lack, closers(F.substring(acc["stack"], at, F.length(acc["stack"]))))).otherwise(""))
            .when(value, F.concat(before, _scalar(x, in_object & (phase == "K")))).when(x == ",", lack).otherwise(F.when(in_object & (phase == "C"), ":").otherwise(""))
        )
        quiet = acc["over"] | ((top == "") & ~is_open) | (is_close & ~found)
        stack = F.when(quiet, acc["stack"]).when(is_open, F.concat(acc["stack"], x)).when(is_close, F.substring(acc["stack"], F.lit(1), at - 1)).otherwise(acc["stack"])
        key = value & in_object & (phase == "K")
        turned = (
            F.when(quiet, phase).when(is_open | is_close, "K").when(key, "C").when(value, "K").when((x == ",") & phase.isin("C", "V"), "K").when((x == ":") & (phase == "C"), "V").otherwise(phase)
        )
        some = F.when(quiet, acc["some"]).when(is_open, F.lit(False)).when(is_close | (value & ~key) | ((x == ",") & phase.isin("C", "V") & in_object), F.lit(True)).otherwise(acc["some"])
        return F.struct(
            stack.alias("stack"), turned.alias("phase"), some.alias("some"), (acc["over"] | (~quiet & is_close & (at == 1))).alias("over"),
            F.concat(acc["out"], F.array(said)).alias("out"),
        )

    none = F.expr("cast(array() as array<string>)")

    def chunk(acc: Column, c: Column, pieces: Column) -> Column:
        own = F.aggregate(F.slice(pieces, c * PIECES + 1, F.lit(PIECES)), F.struct(*state(acc), none.alias("out")), step)
        return F.transform(F.array(own), lambda z: F.struct(*state(z), F.concat(acc["out"], F.array(F.array_join(z["out"], ""))).alias("out")))[0]

    def whole(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pieces) - 1) / PIECES).cast("int")))
        begun = F.transform(F.array(start), lambda s: F.struct(*state(s), none.alias("out")))[0]
        done = F.aggregate(numbers, begun, lambda acc, c: chunk(acc, c, pieces))
        in_object = lambda z: F.substring(z["stack"], F.length(z["stack"]), F.lit(1)) == "{"
        end = lambda z: F.concat(F.array_join(z["out"], ""), F.when(in_object(z) & (z["phase"] == "C"), ":null").when(in_object(z) & (z["phase"] == "V"), "null").otherwise(""), closers(z["stack"]))
        return F.transform(F.array(done), end)[0]

    made = F.transform(F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), whole)
    return F.get(F.filter(made, lambda x: F.coalesce(_is_container(x), F.lit(False))), F.lit(0))


def json_result(reply: Column, truncated: Column | None = None) -> Column:
    """struct(json, origin, repaired) of a model's reply: as json_reply(), else repaired, unless the reply was cut off at its limit."""
    text = F.regexp_replace(reply, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    bounded = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    told = lambda json, origin, mended: F.struct(json.alias("json"), F.lit(origin).alias("origin"), F.lit(mended).alias("repaired"))
    tried = ((fenced, "markdown_fence", F.lit(True)), (text, "raw", text.startswith("{")), (bounded, "object_bounds", F.lit(True)), (text, "raw", F.lit(True)))
    one = lambda x, origin, when: F.get(F.filter(F.transform(F.array(F.when((x != "") & when, repaired_json(x))), lambda j: told(j, origin, True)), lambda z: z["json"].isNotNull()), F.lit(0))
    mended = F.coalesce(*[one(*x) for x in tried])
    found = F.transform(F.array(json_reply(reply)), lambda z: F.when(z.isNotNull(), F.struct(z["json"].alias("json"), z["origin"].alias("origin"), F.lit(False).alias("repaired"))))[0]
    return F.coalesce(found, mended if truncated is None else F.when(~F.coalesce(truncated, F.lit(False)), mended))


def document_urls(document: Column, names: tuple[str, ...] = ("urlSeldon", "urlSource", "url", "downloadUrl")) -> Column:
    """A document's addresses in the order in which they are tried, each once."""
    return ordered_unique(F.array_compact(F.array(*[F.get_json_object(document, f"$.{n}") for n in names])))


def price_source(value: Column) -> Column:
    """A price source (JSON text); null if it says nothing."""
    said = F.coalesce(*[F.nullif(F.get_json_object(value, f"$.{n}"), F.lit("")) for n in PRICE_SOURCE])
    return F.when(~is_object(value) | said.isNotNull(), value)


def direct_match(response: Column) -> Column:
    """The match that a catalogue's answer names itself, under any spelling; null if it lists candidates instead."""
    own = json_object(F.get_json_object(response, "$.match"))
    found = {k: first_defined(*[member(own, n) for n in names]) for k, names in MATCH.items()}
    fields = found | {
        "median_price": parse_money(found["median_price"]),
        "currency": currency(found["currency"]),
        "price_source": F.coalesce(found["price_source"], F.lit("")),
        "rationale": F.coalesce(found["rationale"], F.lit("")),
        "correspondence": F.coalesce(found["correspondence"], F.lit(NOT_FOUND)),
    }
    return F.when(own.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def selection(reply: Column) -> Column:
    """struct(point_id, correspondence, rationale) of a selection; the English names count first."""
    of = lambda *names: F.coalesce(*[member(reply, n) for n in names])
    return F.struct(
        string_or_none(of("selectedPointId", "selected_point_id")).alias("point_id"),
        F.coalesce(of("correspondence", "Соответствие"), F.lit(NOT_FOUND)).alias("correspondence"),
        F.coalesce(of("rationale", "Обоснование"), F.lit("")).alias("rationale"),
    )


def candidate_list(candidates: Column, most: int = MOST_CHARS) -> Column:
    """A list of candidates (array of structs with a map `params`) as JSON within a length.

    Too long a list keeps 30 clipped parameters of each candidate; one that still is, none.
    """
    clipped = lambda m: F.map_from_entries(F.transform(F.slice(F.map_entries(m), 1, MOST_PARAMS), lambda e: F.struct(F.substring(e["key"], 1, NAME_CHARS), F.substring(e["value"], 1, VALUE_CHARS))))
    as_text = lambda f: F.to_json(F.transform(candidates, lambda c: c.withField("params", f(c["params"]))), {"ignoreNullFields": "false"})
    whole, short = as_text(lambda m: m), as_text(clipped)
    bare = as_text(lambda m: F.map_filter(m, lambda k, v: F.lit(False)))
    return F.when(F.length(whole) <= most, whole).when(F.length(short) <= most, short).otherwise(bare)


def registry_rows(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, pos, inn, kpp, full_name, short_name, error of a registry's landed answers.

    An answer with a code other than 200 is one row with an error; one without rows gives none.
    """
    inner = json_object(F.get_json_object(body, "$.body"))
    own = responses.select(*keys, F.coalesce(inner, F.col(body)).alias("_data"))
    at = lambda *paths: first_defined(*[F.get_json_object("_data", f"$.{p}") for p in paths])
    code = at("status.code", "code", "statusCode").try_cast("int")
    said = F.coalesce(at("status.message", "status.descr", "message"), F.lit("нет описания"))
    listed = at(*ROWS)
    many = F.when(listed.startswith("["), F.from_json(listed, "array<string>"))
    one = json_object(at(*ROW))
    rows = F.when(F.coalesce(F.size(many) > 0, F.lit(False)), many).when(one.isNotNull(), F.array(one))
    error = F.when(code != 200, F.concat(F.lit("code "), code.cast("string"), F.lit(": "), said))
    none = F.array(F.lit(None).cast("string"))
    out = own.select(*keys, error.alias("error"), F.posexplode(F.when(error.isNotNull(), none).otherwise(rows)).alias("pos", "_row"))
    of = lambda *names: first_defined(*[F.get_json_object("_row", f"$.{n}") for n in names])
    out = out.where(F.col("error").isNotNull() | is_object(F.col("_row")))
    return out.select(
        *keys, "pos", tax_number(of("innOrg", "inn")).alias("inn"), registration_code(of("kppOrg", "kpp")).alias("kpp"),
        of("fullNameOrg", "fullName", "name").alias("full_name"), of("shortNameOrg", "shortName").alias("short_name"), "error",
    )
