import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.functions import dates, numbers, text


def values(spark, xs, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize("shown, amount", [
    ("15 707,43", 15707.43), ("157 074,30", 157074.30), ("1.234.567", 1234567.0), ("1,234.56", 1234.56), ("1.234,56", 1234.56), ("999 999,00 рублей", 999999.0),
    ("2 млн", 2e6), ("1,5 млрд", 1.5e9), ("0 руб.", 0.0), ("", None), (None, None), ("нет", None), ("-5", None), ("лот 2: 100", 2100.0),
])
def test_money(spark, shown, amount):
    assert values(spark, [shown], numbers.parse_money) == [amount]


def test_the_three_parsers_differ(spark):
    assert values(spark, ["15 707,43"], numbers.parse_number) == [15.0]
    assert values(spark, ["15 707,43"], numbers.parse_money) == [15707.43]
    assert values(spark, ["15 707,43"], numbers.parse_quantity) == [15.0]
    assert values(spark, ["-3", "x -2,5"], lambda x: numbers.parse_number(x, allow_negative=True)) == [-3.0, -2.5]
    assert values(spark, ["-3", "0"], lambda x: numbers.parse_number(x, positive=True)) == [None, None]


def test_percent_and_format(spark):
    rows = spark.createDataFrame([(3, 4), (1, 32), (1, 0)], "a int, b int").select(numbers.percent(F.col("a"), F.col("b")))
    assert [r[0] for r in rows.collect()] == [75.0, 3.12, None]
    assert values(spark, [1234567.891], numbers.format_money, "double") == ["1 234 567,89 руб."]


def test_dates(spark):
    day = datetime.date(2024, 1, 31)
    assert values(spark, ["2024-01-31", "31.1.2024", "31/01/2024", "31.02.2024", "", None, "2024-01-31T10:00"], dates.parse_date) == [day, day, day, None, None, None, day]
    assert values(spark, ["до 5.3.2024 г.", "2024-03-05", "скоро"], dates.normal_date) == ["2024-03-05", "2024-03-05", "скоро"]
    assert values(spark, ["в 9.05", "23:59", "x"], dates.normal_time) == ["09:05", "23:59", None]


def test_flags_and_words(spark):
    assert values(spark, ["Да", "неделим", "Неделимый ", "x", None], text.lot_divisible) == [True, False, False, None, None]
    assert values(spark, ["rur", "₽", " usd", ""], text.currency) == ["RUB", "RUB", "USD", None]
    assert values(spark, [" ", "Товар не найден", "x", None], text.real_value) == [None, None, "x", None]
    assert values(spark, ["Ёлка  №1", "undefined"], text.name_key) == ["елка 1", ""]
    assert values(spark, ["12 345 678 90", "123"], text.tax_number) == ["1234567890", None]
    assert values(spark, ["/cat/nn/77?x=1", "/cat/1"], text.catalog_id) == ["77", None]


def test_headers_and_cells(spark):
    heads = ["Общая стоимость", "Цена за единицу", "Кол-во", "Ед. изм.", "Наименование товара", "Стоимость за единицу", "прочее"]
    assert values(spark, heads, text.header_role) == ["line_total", "unit_price", "quantity", "unit", "product", "line_total", None]
    assert values(spark, ["A: 1 | B: Кабель | C:  | A: 2"], text.structured_cells) == [{"A": "2", "B": "Кабель"}]


def test_snippet_and_lists(spark):
    assert values(spark, ["a" * 10 + " X\n y " + "b" * 10], lambda x: text.snippet(x, "X", 3)) == ["aa X y"]
    assert values(spark, [[" a", "b", "", "a"]], text.ordered_unique, "array<string>") == [["a", "b"]]


def test_files_and_addresses(spark):
    assert values(spark, ["dir/a%20b:c.pdf"], text.safe_filename) == ["a b_c.pdf"]
    assert values(spark, ["attachment; filename*=UTF-8''%D0%B0.txt", 'inline; filename="x.doc"'], text.disposition_filename) == ["а.txt", "x.doc"]
    assert values(spark, ["https://u:p@host.example/a?b#c"], text.loggable_url) == ["https://host.example/a"]
    assert values(spark, ["<p>a&amp;b</p><script>x<y</script>\n\n\n\nc"], text.page_text) == ["a&b\nc"]


def test_references_as_the_standard_library_reads_them(spark):
    import html
    import random

    r = random.Random(4)
    parts = ["&", "amp", ";", "#", "x", "41", "1056", "lt", "notit", "hearts", "é", " ", "&#x", "&#", "&amp;", "&copy", "d800", "110000", "150", "0", "99999999999", "&Aacute", "&zwnj;", "\n", "FDD0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(1500)] + ["", "plain"]
    assert values(spark, texts, text.unescaped) == [html.unescape(t) for t in texts]


def test_unclosed_markup_takes_linear_time(spark):
    import time

    for piece in ("<script>", "<script ", "<style>x", "<!-- ", "<a ", "&", "<", "<p> ", "&#"):
        pages = [piece * n for n in (20_000, 80_000)]
        values(spark, pages[:1], text.page_text)
        start = time.perf_counter()
        values(spark, pages, text.page_text)
        assert time.perf_counter() - start < 10, piece
    assert values(spark, ["<p>a</p><script>x</p>", "<b>c <a href=", "d<!--", "<noscript>e", None], text.page_text) == ["a", "c <a href=", "d", "", None]
