"""Text functions. Patterns that meet Cyrillic text carry (?iuU): full case folding and classes."""

from __future__ import annotations

from collections.abc import Iterable

from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"


def string_or_none(x: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def first_defined(*xs: Column) -> Column:
    """The first value that is neither null nor blank; zero and false are values."""
    return F.coalesce(*[F.when(string_or_none(x).isNotNull(), x) for x in xs])


def first_defined_with_path(named: Iterable[tuple[str, Column]]) -> Column:
    """struct(value, path) of the first defined of the named values."""
    return F.coalesce(*[F.when(string_or_none(x).isNotNull(), F.struct(x.cast("string").alias("value"), F.lit(path).alias("path"))) for path, x in named])


def collapse(x: Column) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """collapse() without the word that a browser leaves for a missing value."""
    return collapse(F.replace(F.coalesce(x, F.lit("")), F.lit("undefined"), F.lit(" ")))


def real_value(x: Column, nothing: Iterable[str] = ("", "null", "undefined", "товар не найден")) -> Column:
    """Trimmed text; the words for nothing are null."""
    return F.when(~F.lower(F.trim(x)).isin(*nothing), F.trim(x))


def without_yo(x: Column) -> Column:
    return F.translate(x, "ёЁ", "еЕ")


def name_key(x: Column) -> Column:
    """Lower-case letters and digits, single blanks between: the key under which names are equal."""
    return F.trim(F.regexp_replace(without_yo(F.lower(clean(x))), "[^a-zа-я0-9]+", " "))


def header_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(without_yo(F.lower(clean(x))), "[^a-zа-я0-9№]+", " "))


def clip(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def snippet(text: Column, pattern: str, radius: int = 180) -> Column:
    """The first match with `radius` code points about it, white space collapsed; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_extract(text, pattern, 0))
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, collapse(F.substring(text, start, at + size + radius - start)))


def snippet_of(text: Column, pattern: str, which: Column, radius: int = 180) -> Column:
    """snippet() of the match with this number (from 1); null for 0 or null."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = which.cast("int")
    start = F.length(F.array_join(F.slice(gaps, F.lit(1), n), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), n - 1), "")) + 1
    low = F.greatest(F.lit(1), start - radius)
    return F.when(n > 0, collapse(F.substring(text, low, start + F.length(F.get(hits, n - 1)) + radius - low)))


def ordered_unique(xs: Column) -> Column:
    """Trimmed, non-blank items, each at its first place."""
    return F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != ""))


def as_flag(x: Column, yes: Iterable[str], no: Iterable[str]) -> Column:
    """True, false or null by word lists; case and yo do not count."""
    word = without_yo(F.lower(F.trim(x.cast("string"))))
    return F.when(word.isin(*yes), True).when(word.isin(*no), False)


def lot_divisible(x: Column) -> Column:
    return as_flag(x, ("да", "yes", "true", "1", "делимый", "делим"), ("нет", "no", "false", "0", "неделимый", "неделим"))


def available(x: Column) -> Column:
    return as_flag(x, ("true", "1", "yes", "да"), ("false", "0", "no", "нет"))


def currency(x: Column) -> Column:
    """Upper case; the spellings of the rouble are RUB; blank is null."""
    up = F.upper(F.trim(x))
    return F.when(up.isin("RUR", "RUB", "РУБ", "РУБ.", "₽"), "RUB").otherwise(F.nullif(up, F.lit("")))


def currency_in(*cells: Column) -> Column:
    """RUB if any price cell shows the rouble."""
    # fixed pattern
    return F.when(F.concat_ws(" ", *cells).rlike(FLAGS + r"₽|\bруб(?:\.|лей|ля)?\b"), "RUB")


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[^0-9]", "")


def tax_number(x: Column) -> Column:
    """Digits of a tax number (10 or 12 of them), else null."""
    return F.when(F.length(digits(x)).isin(10, 12), digits(x))


def registration_code(x: Column) -> Column:
    """Digits of a registration code (9 of them), else null."""
    return F.when(F.length(digits(x)) == 9, digits(x))


def structured_cells(row: Column) -> Column:
    """map of column letters to values from `A: v | B: v`; blanks are dropped, the last wins."""
    cells = F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c.rlike(r"^[A-Z]{1,3}:\s*\S"))
    pairs = F.transform(cells, lambda c: F.struct(F.regexp_extract(c, "^([A-Z]{1,3}):", 1).alias("key"), F.trim(F.regexp_extract(c, r"(?s)^[A-Z]{1,3}:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p: p["value"] != "")
    return F.map_from_entries(F.aggregate(last, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))))


def header_role(cell: Column) -> Column:
    """What a table header says its column holds; the order of the tests decides."""
    key = header_key(cell)
    # fixed patterns, in the order in which they are tried
    return F.when(key == "", None).when(key.rlike(FLAGS + r"(?:общая\s+)?стоимость(?:\s+позиции)?|сумма|итого|всего"), "line_total").when(
        key.rlike(FLAGS + r"цена(?:\s+(?:за|одной|1))?\s*(?:единиц[уы]?|ед\b)|стоимость\s+(?:за\s+)?(?:единиц[уы]?|ед\b)|^цена(?:\s+руб(?:лей)?)?$"), "unit_price"
    ).when(key.rlike(FLAGS + r"количество|кол во|кол\b"), "quantity").when(key.rlike(FLAGS + r"единица\s+измерения|ед\s+изм"), "unit").when(
        key.rlike(FLAGS + r"наименование|название\s+(?:товара|продукции)|^товар$|предмет\s+закупки"), "product"
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))


def loggable_url(url: Column) -> Column:
    """Scheme, host and path: no credentials, query or fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def catalog_id(url: Column) -> Column:
    """The article in a catalogue address."""
    # fixed pattern
    return F.nullif(F.regexp_extract(url, r"(?i)/cat/nn/([^/?#]+)", 1), F.lit(""))


def safe_filename(x: Column, limit: int = 220) -> Column:
    """Last path part, decoded, with characters that file systems refuse replaced."""
    base = F.regexp_extract(F.coalesce(F.try_url_decode(x), x), r"([^/\\]*)$", 1)
    return F.substring(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1F]', "_"), 1, limit)


def disposition_filename(header: Column) -> Column:
    """The file name of a content disposition: the extended form, else the plain one."""
    # fixed patterns
    wide = F.try_url_decode(F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1))
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)', 1)
    return F.coalesce(string_or_none(wide), string_or_none(plain))


#: What counts as white space around a text, and the white space and control characters that references never give.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{0,31});?"
#: Names that are references even without a semicolon, longest first, so that the longest one wins.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _literal(pairs: dict[str, str]) -> Column:
    """A map that is a constant of the plan."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(code: Column) -> Column:
    """The character of a numeric reference; 0x80 to 0x9F mean what they mean in windows-1252."""
    western = _literal({str(n): unescape(f"&#{n};") for n in range(0x80, 0xA0)})
    never = code.between(1, 8) | code.isin(11, 0x7F) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(code.between(0x80, 0x9F), F.try_element_at(western, code.cast("string"))).when(never, "").otherwise(plain)


def unescaped(text: Column) -> Column:
    """Text with its character references, numbered and named, as characters; what is none stays."""
    names = _literal({n: html5[n] for n in sorted(html5, key=lambda n: n.removesuffix(";") not in html5)})
    longest = "^&(" + "|".join(OPEN_NAMES) + ")"

    def one(ref: Column) -> Column:
        hexed = F.regexp_extract(ref, "(?i)^&#x0*([0-9a-f]*)", 1)
        code = F.when(ref.rlike("(?i)^&#x"), F.when(F.length(hexed) <= 8, F.conv(hexed, 16, 10).cast("long"))).otherwise(F.regexp_extract(ref, "^&#([0-9]*)", 1).try_cast("long"))
        named = F.when(ref.endswith(";"), F.try_element_at(names, F.substring(ref, 2, 40)))
        prefix = F.regexp_extract(ref, longest, 1)
        partly = F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substring(ref, F.length(prefix) + 2, F.lit(40))))
        return F.when(ref.startswith("&#"), _numbered(code)).otherwise(F.coalesce(named, partly, ref))

    def decoded(x: Column) -> Column:
        parts = F.zip_with(F.split(x, REFERENCE, -1), F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0)), one), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.contains(x, F.lit("&")) & x.rlike(REFERENCE), F.array_join(parts, "")).otherwise(x)

    return _let(text, decoded)


def page_text(html: Column, limit: int | None = None) -> Column:
    """A page's texts, each trimmed and on a line of its own, without scripts, styles and comments; references decoded.

    What is not closed reaches to the page's end, so no page is read twice; an unfinished tag at the end is text.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)|<!--.*?(?:-->|\z)", "<br>")
    last = lambda b: F.length(b) - F.locate(">", F.reverse(b)) + 1
    ends = _let(bare, lambda b: F.when(F.contains(b, F.lit(">")), F.array(F.substring(b, F.lit(1), last(b)), F.substring(b, last(b) + 1, F.length(b)))).otherwise(F.array(F.lit(""), b)))
    texts = _let(ends, lambda e: F.concat(F.split(e[0], "</?[A-Za-z][^>]*+>|<[!?][^>]*+>", -1), F.slice(e, 2, 1)))
    lines = F.filter(F.transform(texts, lambda x: F.btrim(unescaped(x), F.lit(SPACES))), lambda x: x != "")
    # decoded once more as one text, for references that were themselves written with references
    text = unescaped(F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(SPACES)))
    text = F.when(html.isNotNull(), text)
    return text if limit is None else clip(text, limit)
