"""Office files and archives from a table of names and bytes (spark.read.format("binaryFile")).

Types are told by DataFrame functions. Only opening a container needs Python: small
helpers over the standard library inside mapInArrow, one file at a time; a file that cannot be read is a row
with an error, never a failed task.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First bytes of file types; words that mark a usable table.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("526172211A07", "rar"), ("377ABCAF271C", "7z"), ("D0CF11E0A1B11AE1", "ole"))
KEYWORDS = (
    "наименование", "товар", "работ", "услуг", "характеристик", "кол-во", "количество", "ед. изм", "цена", "стоимость", "нмц", "спецификац",
    "поставка", "предмет закупки", "окпд", "производител", "страна происхождения",
)
LIMITS = {"members": 500, "bytes": 500 * 2**20, "ratio": 100.0}


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"\?.*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def magic_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for start, kind in MAGIC:
        out = F.when(head.startswith(start), kind) if out is None else out.when(head.startswith(start), kind)
    return out


def file_type(name: Column, content: Column, ooxml: Column | None = None) -> Column:
    """By first bytes, then by name; a zip is what its name or its members (ooxml) make it."""
    magic, suffix = magic_of(content), suffix_of(name)
    zipped = F.when(suffix.isin("docx", "xlsx"), suffix).otherwise(F.coalesce(ooxml, F.lit("zip")) if ooxml is not None else F.lit("zip"))
    return F.when(magic == "zip", zipped).when(magic == "ole", F.when(suffix.isin("doc", "xls"), suffix).otherwise("doc")).otherwise(F.coalesce(magic, F.nullif(suffix, F.lit("")), F.lit("unknown")))


def content_error(name: Column, content: Column, mime: Column) -> Column:
    """Why a downloaded file is not what it claims to be; null if it may be."""
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 4096), "ISO-8859-1")))
    page = F.lower(F.regexp_replace(F.coalesce(mime, F.lit("")), r";.*$", "")).isin("text/html", "application/xhtml+xml") | head.startswith("<!doctype html") | head.startswith("<html")
    magic, suffix = magic_of(content), suffix_of(name)
    wrong = suffix.isin("zip", "7z", "rar", "pdf", "docx", "xlsx") & magic.isNull()
    return F.when(F.length(content) == 0, "empty").when(page, "html_instead_of_file").when(wrong, "content_does_not_match_name")


def sheet_quality(text: Column) -> Column:
    """Long enough and with a word that tables of goods have."""
    return (F.length(text) >= 80) & F.lower(text).rlike("|".join(re.escape(k) for k in KEYWORDS))


_CELL = re.compile(r"([A-Z]+)(\d+)")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CELLS = [("sheet", T.StringType()), ("row", T.IntegerType()), ("col", T.StringType()), ("value", T.StringType())]
_MEMBERS = [("member", T.StringType()), ("size", T.LongType()), ("compressed", T.LongType()), ("is_dir", T.BooleanType()), ("is_link", T.BooleanType()), ("content", T.BinaryType())]
_TEXT = [("text", T.StringType())]


def xlsx_cells(raw: bytes) -> Iterator[tuple]:
    """sheet, row, column letters and text of each non-empty cell."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        shared = []
        if "xl/sharedStrings.xml" in box.namelist():
            for item in ElementTree.parse(box.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        book = ElementTree.parse(box.open("xl/workbook.xml")).getroot()
        names = [s.get("name") for s in book.iter(f"{_SHEET}sheet")]
        parts = sorted((n for n in box.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n[14:]).group()))
        for name, part in zip(names, parts, strict=False):
            for _, cell in ElementTree.iterparse(box.open(part)):
                if cell.tag != f"{_SHEET}c":
                    continue
                value = cell.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                if text is not None and cell.get("t") == "s":
                    text = shared[int(text)]
                if text is not None and text.strip() and (m := _CELL.fullmatch(cell.get("r", ""))):
                    yield name, int(m[2]), m[1], " ".join(text.split())
                cell.clear()


def letters(i: int) -> str:
    """The column letters of an index from 0."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def csv_cells(raw: bytes) -> Iterator[tuple]:
    """Cells of a delimited file: UTF-8 (with or without a mark) or Windows-1251; the delimiter is sniffed."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("cp1251", "replace")
    try:
        mark = csv.Sniffer().sniff(text[:10_000], ";\t,").delimiter
    except csv.Error:
        mark = ";"
    for number, row in enumerate(csv.reader(io.StringIO(text), delimiter=mark), 1):
        for i, value in enumerate(row):
            if value.strip():
                yield "CSV", number, letters(i), " ".join(value.split())


def docx_text(raw: bytes) -> Iterator[tuple]:
    """Paragraphs, then table rows with ` | ` between cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        body = ElementTree.parse(box.open("word/document.xml")).getroot()[0]
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    out = [said(p) for p in body if p.tag == f"{_WORD}p"]
    out += [" | ".join(said(c) for c in row.iter(f"{_WORD}tc")) for table in body.iter(f"{_WORD}tbl") for row in table.iter(f"{_WORD}tr")]
    yield ("\n".join(x for x in out if x),)


def zip_members(raw: bytes, limits: dict) -> Iterator[tuple]:
    """Members of an archive that keeps to the limits; links and paths that lead outside are errors."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        members = [m for m in box.infolist() if not m.is_dir()]
        size, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
        if len(members) > limits["members"]:
            raise ValueError(f"too many members: {len(members)}")
        if size > limits["bytes"]:
            raise ValueError("too large when unpacked")
        if packed and size / packed > limits["ratio"]:
            raise ValueError("too high a compression ratio")
        for m in members:
            path = m.filename.replace("\\", "/")
            if m.external_attr >> 16 & 0o170000 == 0o120000:
                raise ValueError(f"a symbolic link: {m.filename}")
            if path.startswith("/") or ".." in path.split("/") or "\0" in path:
                raise ValueError(f"a path out of the archive: {m.filename}")
        for m in members:
            yield m.filename, m.file_size, m.compress_size, False, False, box.read(m)


def ooxml_kind(raw: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        names = {n.replace("\\", "/").lstrip("/") for n in box.namelist()}
    yield ("xlsx" if "xl/workbook.xml" in names else "docx" if "word/document.xml" in names else None,)


def _opened(batches: Iterator[pa.RecordBatch], read, fields: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, error = [], None
            try:
                rows = list(read(batch.column(batch.num_columns - 1)[i].as_py() or b""))
            except (OSError, ValueError, KeyError, IndexError, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError) as e:
                error = f"{type(e).__name__}: {e}"
            rows = rows or [(None,) * len(fields)]
            keys = [pa.array([batch.column(j)[i].as_py()] * len(rows), batch.column(j).type) for j in range(batch.num_columns - 1)]
            own = [pa.array([r[j] for r in rows], T_ARROW[type(kind)]) for j, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*keys, *own, pa.array([error] * len(rows), pa.string())], names=[*batch.schema.names[:-1], *[n for n, _ in fields], "error"])


T_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}


def _read(files: DataFrame, keys: list[str], content: str, read, fields: list) -> DataFrame:
    schema = T.StructType([*[files.schema[k] for k in keys], *[T.StructField(n, k) for n, k in fields], T.StructField("error", T.StringType())])
    return files.select(*keys, content).mapInArrow(partial(_opened, read=read, fields=fields), schema)


def read_xlsx(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, sheet, row, col, value, error: one row for each cell (or for a file without any)."""
    return _read(files, keys, content, xlsx_cells, _CELLS)


def read_delimited(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _read(files, keys, content, csv_cells, _CELLS)


def read_docx(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, text, error; text that is too short to be a document is dropped, as is one without letters or digits."""
    out = _read(files, keys, content, docx_text, _TEXT)
    good = (F.length("text") >= 500) & F.col("text").rlike(r"(?U)\w")
    return out.withColumn("text", F.when(good, F.col("text")))


def read_zip(files: DataFrame, keys: list[str], content: str = "content", limits: dict | None = None) -> DataFrame:
    """keys, member, size, compressed, is_dir, is_link, content, error."""
    return _read(files, keys, content, partial(zip_members, limits=LIMITS | (limits or {})), _MEMBERS)


def with_ooxml(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys and ooxml: xlsx, docx or null by the members of a zip."""
    return _read(files, keys, content, ooxml_kind, [("ooxml", T.StringType())]).drop("error")


#: Type of file and the reader that takes it; others are told as unsupported.
READERS = ("xlsx", "csv", "docx")


def parsed_files(files: DataFrame, keys: list[str], name: str = "name", content: str = "content", most: int = 250_000) -> DataFrame:
    """keys, file_name, file_type, text, status, text_ok and warnings of each file: told by type, read by its reader, clipped.

    keys name a file. status: ok, no_text, error or unsupported; a table's text is its rows as lines, sheet by sheet.
    """
    typed = files.select(*keys, F.col(name).alias("file_name"), content)
    zipped = with_ooxml(typed.where(magic_of(F.col(content)) == "zip"), keys, content)
    typed = typed.join(zipped, keys, "left")
    typed = typed.withColumn("file_type", file_type(F.col("file_name"), F.col(content), F.col("ooxml"))).drop("ooxml")
    cells = read_xlsx(typed.where("file_type = 'xlsx'"), keys, content).unionByName(read_delimited(typed.where("file_type = 'csv'"), keys, content))
    lines = row_lines(cells, keys).groupBy(*keys, "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("x"))
    sheets = lines.select(*keys, F.struct("sheet", F.concat(F.lit("Лист: "), F.col("sheet"), F.lit("\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("t")).alias("s"))
    tables = sheets.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("text"))
    failed = cells.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.min("error").alias("error"))
    tables = tables.join(failed, keys, "full")
    words = read_docx(typed.where("file_type = 'docx'"), keys, content)
    read = tables.select(*keys, "text", "error").unionByName(words.select(*keys, "text", "error"))
    out = typed.drop(content).join(read, keys, "left")
    table = F.col("file_type").isin("xlsx", "csv")
    status = F.when(~F.col("file_type").isin(*READERS), "unsupported").when(F.col("error").isNotNull(), "error").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_text").otherwise("ok")
    cut = F.coalesce(F.length("text") > most, F.lit(False))
    said = F.array_compact(F.array(
        F.when(status == "unsupported", F.concat(F.lit("Неподдерживаемый тип файла: "), F.col("file_type"))),
        F.when(cut, F.concat(F.lit("Текст "), F.col("file_name"), F.lit(f" обрезан до {most} символов."))),
    ))
    out = out.withColumns({"status": status, "warnings": said, "text_ok": F.coalesce(F.when(table, sheet_quality(F.col("text"))).otherwise(F.length("text") > 0), F.lit(False))})
    return out.withColumn("text", F.substring("text", 1, most)).select(*keys, "file_name", "file_type", "text", "status", "text_ok", "warnings", "error")


def expanded(files: DataFrame, keys: list[str], index: str, name: str = "name", content: str = "content", depth: int = 1, limits: dict | None = None) -> DataFrame:
    """Files with the members of their archives, unrolled to a fixed depth; a member's index is parent * 1000 + its number."""
    cols = [*keys, index, name, content, "parent", "error"]
    level = files.withColumns({"parent": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).select(*cols)
    out = level
    for _ in range(depth):
        boxes = level.where(file_type(F.col(name), F.col(content)) == "zip")
        inner = read_zip(boxes.select(*keys, index, name, content), [*keys, index, name], content, limits)
        from pyspark.sql.window import Window

        n = F.row_number().over(Window.partitionBy(*keys, index).orderBy("member"))
        level = inner.select(*keys, (F.col(index) * 1000 + n).alias(index), F.coalesce("member", name).alias(name), content, F.col(name).alias("parent"), "error").select(*cols)
        out = out.unionByName(level)
    return out


def row_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sheet, row, line: `Строка n: A: v | B: v` of each row; empty cells are skipped, addresses kept."""
    placed = F.struct(F.length("col").alias("n"), F.col("col").alias("c"), F.col("value").alias("v"))
    own = cells.where(F.col("row").isNotNull()).groupBy(*keys, "sheet", "row").agg(F.array_sort(F.collect_list(placed)).alias("x"))
    body = F.array_join(F.transform("x", lambda p: F.concat(p["c"], F.lit(": "), p["v"])), " | ")
    return own.select(*keys, "sheet", "row", F.concat(F.lit("Строка "), F.col("row").cast("string"), F.lit(": "), body).alias("line"))
