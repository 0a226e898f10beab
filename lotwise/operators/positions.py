"""Line items: header-aware table rows, free text, structured purchases, and their merge by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import parse_quantity
from ..functions.text import clean, currency_in, header_role, name_key, string_or_none, structured_cells, without_yo
from .scan import prefix_scan

ROLES = ("product", "unit", "quantity", "unit_price", "line_total")
#: Units, and where a row begins.
UNITS = r"шт\.?|штук[аи]?|компл\.?|комплект(?:а|ов)?|м2|м²|м3|м³|пог\.?\s*м|м|кг|т|тн|тонн[аы]?|л|уп\.?|упак\.?|рул\.?|набор|пар[аы]?|ед\.?"
ROW = r"(?iuU)^Строка\s+(\d+)\s*:\s*(.+)$"
LABELLED_ROW = r"(?iuU)наименование\s+товара[^:]*:\s*([^|\n]{2,140})[|\s]+ед\.?\s*изм\.?[^:]*:\s*([^|\n]{1,40})[|\s]+(?:кол-?во|количество)[^:]*:\s*(\d+(?:[,.]\d+)?)"
NOT_A_NAME = r"(?iuU)наименование\s+товара|кол-?во"
HEADER_WORDS = r"(?iuU)наименование|ед\.?\s*изм|кол-?во|количество"
TEXT_ROW = r"(?iuU)(?:^|\s)(\d{1,4})\s+([А-ЯA-ZЁ][А-ЯA-Zа-яa-zёЁ0-9\s\-–—\"«»().,/ ]{2,120}?)\s+(" + UNITS + r")\s+(\d+(?:[,.]\d+)?)(?=\s|$)"
CAP = 100


def lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no and line of each text."""
    return docs.select(*keys, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "line"))


def filled(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds the last value at or before each row, however many rows a key has."""
    return prefix_scan(df, keys, list(order), {name: ("last", value) for name, value in values.items()})


def forward_filled(df: DataFrame, keys: list[str], order: str, value: Column, boundary: Column | None = None) -> Column:
    """The last value at or before a row; a boundary row (by its running count) forgets what came before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if boundary is None:
        return F.last(value, ignorenulls=True).over(w)
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def segments(df: DataFrame, keys: list[str], order: str, boundary: Column, name: str = "_segment") -> DataFrame:
    """Adds the running number of boundaries within a document's lines."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(boundary.cast("int")).over(w))


def numbered_segments(df: DataFrame, keys: list[str], order: list[str], boundary: Column, name: str = "segment") -> DataFrame:
    """Adds the running number of boundaries, however many rows a key has."""
    return prefix_scan(df, keys, list(order), {name: ("sum", boundary.cast("long"))})


def table_positions(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Line items from `Строка n: A: v | B: v` rows under header rows, with file, sheet and row.

    Any row with a cell that reads as a header re-points that header's column for what follows;
    a new document or sheet forgets all headers.
    """
    rows = lines(docs, keys, text)
    new_doc, new_sheet = F.col("line").startswith("--- ДОКУМЕНТ "), F.col("line").startswith("Лист:")
    rows = segments(rows, keys, "line_no", new_doc, "_document")
    rows = segments(rows, keys, "line_no", new_doc | new_sheet)
    rows = rows.withColumn("cells", F.when(F.col("line").rlike(ROW), structured_cells(F.regexp_extract("line", ROW, 2))))
    heads = F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].alias("column"), e["value"].alias("label"), header_role(e["value"]).alias("role")))
    rows = rows.withColumn("_heads", F.filter(heads, lambda h: h["role"].isNotNull()))
    in_document, in_segment = Window.partitionBy(*keys, "_document").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "_segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.lower("line").startswith("filename:"), F.trim(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1)))
    rows = rows.withColumns({"file": F.last(file, ignorenulls=True).over(in_document), "sheet": F.last(F.when(new_sheet, F.trim(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))), ignorenulls=True).over(in_segment)})
    heads_of = lambda role: F.filter("_heads", lambda h: h["role"] == role)
    for role in ROLES:
        own = F.try_element_at(heads_of(role), F.lit(-1))
        rows = rows.withColumn(f"_{role}", F.last(own, ignorenulls=True).over(in_segment))
    data = rows.where(F.col("cells").isNotNull() & (F.size("cells") > 0) & (F.size("_heads") == 0) & F.col("_product").isNotNull() & F.col("_unit").isNotNull() & F.col("_quantity").isNotNull())
    cell = lambda role: F.try_element_at("cells", F.col(f"_{role}.column"))
    out = data.select(
        *keys, "line_no", "file", "sheet", F.regexp_extract("line", ROW, 1).cast("int").alias("row"), clean(cell("product")).alias("product"), clean(cell("unit")).alias("unit"), parse_quantity(cell("quantity")).alias("quantity"),
        cell("unit_price").alias("document_unit_price"), cell("line_total").alias("document_line_total"), F.col("_unit_price.column").alias("unit_price_column"), F.col("_line_total.column").alias("line_total_column"),
        F.col("_unit_price.label").alias("unit_price_header"), F.col("_line_total.label").alias("line_total_header"), F.substring(clean(F.col("line")), 1, 500).alias("evidence"),
    )
    out = out.withColumn("document_currency", currency_in("document_unit_price", "document_line_total", "unit_price_header", "line_total_header"))
    return out.where((F.col("product") != "") & (F.col("unit") != "") & F.col("quantity").isNotNull())


def text_positions(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Line items that free text lists: first those as number, name, unit, quantity, then those with a label before each part."""
    parts = lambda value, pattern, *at: F.transform(
        F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), *[F.regexp_extract(m, pattern, i).alias(n) for n, i in zip(("product", "unit", "quantity"), at, strict=True)])
    )
    found = docs.select(*keys, F.posexplode(F.concat(parts(clean(F.col(text)), TEXT_ROW, 2, 3, 4), parts(F.coalesce(text, F.lit("")), LABELLED_ROW, 1, 2, 3))).alias("pos", "x"))
    return found.select(*keys, "pos", clean(F.col("x.product")).alias("product"), clean(F.col("x.unit")).alias("unit"), parse_quantity(F.col("x.quantity")).alias("quantity"), F.substring(clean(F.col("x.m")), 1, 500).alias("evidence"))


def unit_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Line items of table rows without a header: a cell that is a unit, a quantity after it, and the nearest name before it."""
    rows = lines(docs, keys, text).where(F.col("line").rlike(ROW))
    cells = F.filter(F.transform(F.split(F.regexp_extract("line", ROW, 2), r"\|"), lambda c: F.regexp_replace(F.trim(c), r"^[A-Z]{1,3}:\s*", "")), lambda c: c != "")
    rows = rows.withColumn("cells", cells)
    rows = rows.select(*keys, "line_no", "line", "cells", F.posexplode("cells").alias("at", "unit")).where(F.col("unit").rlike(f"(?iuU)^(?:{UNITS})$"))
    named = F.filter(F.slice("cells", F.lit(1), F.col("at")), lambda c: ~c.rlike(r"^\d{1,4}$") & ~c.rlike(HEADER_WORDS))
    rows = rows.withColumns({"product": clean(F.try_element_at(named, F.lit(-1))), "quantity": parse_quantity(F.get("cells", F.col("at") + 1))})
    return rows.where((F.col("product") != "") & F.col("quantity").isNotNull()).select(*keys, "line_no", "at", "product", "unit", "quantity", F.substring(clean(F.col("line")), 1, 500).alias("evidence"))


def deterministic_positions(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Line items of a text: rows under headers, then rows with a unit, then free text; first of equal ones, at most CAP."""
    own = lambda df, kind, *order: df.select(*keys, F.struct(F.lit(kind).alias("kind"), *[o.cast("long").alias(f"o{i}") for i, o in enumerate(order)]).alias("ord"), "product", "unit", "quantity", "evidence")
    nothing = F.lit(0)
    every = own(table_positions(docs, keys, text), 0, F.col("line_no"), nothing).unionByName(own(unit_rows(docs, keys, text), 1, F.col("line_no"), F.col("at"))).unionByName(own(text_positions(docs, keys, text), 2, F.col("pos"), nothing))
    every = every.where(~F.col("product").rlike(NOT_A_NAME)).withColumn("_key", without_yo(F.lower("product")))
    same = Window.partitionBy(*keys, "_key", "quantity", F.lower("unit")).orderBy("ord")
    return capped(every.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn", "_key"), keys, [F.col("ord")])


#: Spellings in structured purchases.
LOTS = ("lotsList", "lots", "lotList")
PRODUCTS = ("productsList", "products", "productList", "positions", "items")
PRODUCT_NAME = ("name", "productName", "positionName", "subject", "title", "fullName")
QUANTITY = ("quantity", "amount", "count", "qty", "volume", "productQuantity")
UNIT = ("unit", "okei", "measureUnit", "unitName", "measure")


def _members(df: DataFrame, json: str, names: tuple[str, ...], prefix: str) -> DataFrame:
    """df with the named members of a column's JSON object, each as `prefix` and its name; one reading of the text gives all."""
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*own, F.json_tuple(json, *names).alias(*[f"{prefix}{n}" for n in names]))


def _list(value: Column) -> Column:
    """A member as a list of JSON texts; a single object is a list of one."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.startswith("{"), F.array(value)).otherwise(F.expr("cast(array() as array<string>)"))


def _first(names: tuple[str, ...], *prefixes: str) -> Column:
    """The first of the named members that is neither null nor blank."""
    return F.coalesce(*[string_or_none(F.col(f"{p}{n}")) for n in names for p in prefixes])


def structured_positions(purchases: DataFrame, keys: list[str], json: str = "purchase") -> DataFrame:
    """Line items of structured purchases: their own products, then those of their lots; first of equal ones."""
    lots = _members(purchases.select(*keys, F.col(json).alias("_json")), "_json", LOTS, "_lot_").withColumn("_lots", _first(LOTS, "_lot_"))
    boxes = lots.select(*keys, F.posexplode(F.concat(F.array("_json"), _list(F.col("_lots")))).alias("box_no", "box"))
    listed = _members(boxes, "box", PRODUCTS, "_list_").withColumn("_items", _first(PRODUCTS, "_list_"))
    items = listed.select(*keys, "box_no", F.posexplode(_list(F.col("_items"))).alias("item_no", "item")).where(F.col("item").startswith("{"))
    parts = (*PRODUCT_NAME, *QUANTITY, *UNIT)
    items = _members(items, "item", (*parts, "product"), "_own_")
    nested = F.col("_own_product")
    # an object under `product`, but not a text that looks like one
    quoted = F.col("item").rlike(r'"product"\s*:\s*"') & F.from_json("item", "product struct<name: string>")["product"].isNull()
    items = _members(items.withColumn("_product", F.when(nested.startswith("{") & ~quoted, nested)), "_product", parts, "_in_")
    items = items.withColumn("_unit", _first(UNIT, "_own_", "_in_"))
    shown = ("name", "shortName", "symbol", "code")
    items = _members(items.withColumn("_unit_json", F.when(F.col("_unit").startswith("{"), F.col("_unit"))), "_unit_json", shown, "_as_")
    out = items.select(
        *keys, (F.col("box_no") * 100_000 + F.col("item_no")).alias("ord"), clean(F.coalesce(_first(PRODUCT_NAME, "_own_", "_in_"), F.when(~nested.startswith("{"), nested))).alias("product"),
        parse_quantity(_first(QUANTITY, "_own_", "_in_")).alias("quantity"), clean(F.when(F.col("_unit").startswith("{"), _first(shown, "_as_")).otherwise(F.col("_unit"))).alias("unit"), F.substring("item", 1, 500).alias("evidence"),
    )
    out = out.withColumn("_key", name_key(F.col("product"))).where(F.col("_key") != "")
    w = Window.partitionBy(*keys, "_key", "quantity", F.lower("unit")).orderBy("ord")
    out = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")
    return capped(out, keys, [F.col("ord")])


def capped(df: DataFrame, keys: list[str], order: list[Column], n: int = CAP) -> DataFrame:
    """The first n rows of each key: the limit is part of the contract."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


PRICE_FIELDS = ("document_unit_price", "document_line_total", "document_currency", "document_price_evidence")


def merged(positions: DataFrame, keys: list[str]) -> DataFrame:
    """One list of line items from three sources: model (rank 0), structured (1), table (2), in this order.

    positions: keys, rank, ord, product, product_query, quantity, unit and PRICE_FIELDS.
    Quantity and unit come from the structured source's last item of that name, else the table's, else the
    item itself. Of equal items (name, quantity, unit) the first stays; the table's prices
    override it and later ones fill what is missing.
    """
    own = positions.withColumns({"_query": clean(F.coalesce(string_or_none(F.col("product_query")), F.col("product"))), "product": clean(F.col("product"))})
    own = own.withColumn("_name", name_key(F.col("_query")))
    by_name = Window.partitionBy(*keys, "_name")
    last = lambda rank, value: F.max_by(value, F.when(F.col("rank") == rank, F.col("ord"))).over(by_name)
    packed = F.struct("quantity", "unit", *PRICE_FIELDS)
    own = own.withColumns({"_structured": last(1, packed), "_table": last(2, packed)})
    has = lambda rank: F.max((F.col("rank") == rank).cast("int")).over(by_name) == 1
    own = own.withColumns({"_structured": F.when(has(1), F.col("_structured")), "_table": F.when(has(2), F.col("_table"))})
    blank = lambda x: F.nullif(x, F.lit(""))
    own = own.withColumns({
        "quantity": F.coalesce("_structured.quantity", "_table.quantity", "quantity"),
        "unit": F.coalesce(blank(F.col("_structured.unit")), blank(F.col("_table.unit")), F.col("unit"), F.lit("")),
    }).where(F.col("product") != "")
    same = Window.partitionBy(*keys, "_name", "quantity", F.lower("unit")).orderBy("rank", "ord")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fills = {f: F.coalesce(blank(F.col(f"_table.{f}").cast("string")), F.first(blank(F.col(f).cast("string")), ignorenulls=True).over(whole)).cast(dict(own.dtypes)[f]) for f in PRICE_FIELDS}
    own = own.withColumns(fills | {"_rn": F.row_number().over(same)}).where("_rn = 1")
    out = capped(own.withColumn("product_query", F.coalesce(blank(F.col("_query")), F.col("product"))), keys, [F.col("rank"), F.col("ord")])
    return out.drop("_query", "_name", "_structured", "_table", "_rn")
