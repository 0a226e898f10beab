"""Operators give the same results when a table has every name that their module uses as a further column."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lotwise.llm import common, jaccard_join, language, mixing, personal_data, pieces, quality_rules, queries, secret_scan, site_quality, url_filter, webp

ROWS = [
    (1, "one two three four five six seven eight nine ten eleven. " * 3, "en", "s"), (1, "one two three four five six seven eight nine ten eleven. " * 3, "en", "s"),
    (2, None, "en", None), (3, "", None, "s"), (4, "\n\t\n", "en", "t"), (4, "\n\t\n", "en", "t"), (5, "user=alice token: Abcdef0123456789xyz at https://host.example/", "en", "t"),
    (None, "mail me at a.b@mail.org or b.c@mail.org", "fr", "t"), (None, "mail me at a.b@mail.org or b.c@mail.org", "fr", "t"), (6, "un deux trois quatre cinq six sept huit neuf dix onze", "fr", "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
PAGES = [(1, "https://a.com/x/1", "<html lang=en>one two"), (1, "https://a.com/x/1", "<html lang=en>one two"), (2, None, None), (3, "https://a.com/y", ""), (None, "no address", "un deux")]
LABELS = [(1, 1, 0), (6, 0, 0), (5, None, 1)]
OPERATORS = {
    "quality_rules": (quality_rules, lambda d, x: quality_rules.quality_rules(d)),
    "without_copies": (jaccard_join, lambda d, x: jaccard_join.without_copies(d)),
    "components": (jaccard_join, lambda d, x: jaccard_join.jaccard_components(d)),
    "redacted": (secret_scan, lambda d, x: secret_scan.redacted(d)),
    "secret_scan": (secret_scan, lambda d, x: secret_scan.secret_scan(d)),
    "masked": (personal_data, lambda d, x: personal_data.masked(d)),
    "personal_data": (personal_data, lambda d, x: personal_data.personal_data(d)),
    "arranged": (mixing, lambda d, x: mixing.arranged(d, repeats=1.5)),
    "mixed": (mixing, lambda d, x: mixing.mixed(d, repeats=1.5)),
    "sampled": (pieces, lambda d, x: pieces.sampled(d, queries.PIECE_MODEL, k=1)),
    "media_column": (webp, lambda d, x: webp.media_column(d, F.col("text"))),
    "site_quality": (site_quality, lambda d, x: site_quality.site_quality(d, x)),
    "url_filter": (url_filter, lambda d, x: url_filter.url_filter(d, queries.URL_RULES)),
    "languages": (language, lambda d, x: language.languages(d, x)),
}
#: Operators that return all columns of their table.
THROUGH = ("quality_rules", "without_copies", "redacted", "masked", "arranged", "sampled", "media_column", "url_filter")


def names_of(module, taken):
    found = []
    for m in (module, common):
        found += re.findall(r"[\"'{](_?[A-Za-z][A-Za-z0-9_]*|_)[\"'}]", Path(m.__file__).read_text())
    lower = {c.lower() for c in taken}
    return [c for c in dict.fromkeys(x.lower() for x in found) if c not in lower] + ["_key_", "_", "_own_"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_all_helper_names_as_columns(spark, name):
    module, operator = OPERATORS[name]
    if name in ("url_filter", "languages"):
        docs = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        other = spark.createDataFrame([(t, g) for _, t, g, _ in ROWS], "text string, lang string")
    else:
        docs, other = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    extra = dict.fromkeys(names_of(module, docs.columns))
    wide = docs.select("*", *[F.lit(7).alias(c) for c in extra])
    plain, clashing = operator(docs, other), operator(wide, other)
    assert len({c.lower() for c in clashing.columns}) == len(clashing.columns)
    assert name not in THROUGH or {*wide.columns} <= {*clashing.columns}
    shared = [c for c in plain.columns]
    shown = lambda df: Counter(map(repr, df.select(*[F.col(f"`{c}`") for c in shared]).collect()))
    assert shown(plain) == shown(clashing)
    kept = [c for c in clashing.columns if c in extra and c not in shared]
    assert all(v == 7 for row in clashing.select(*[F.col(f"`{c}`") for c in kept]).collect() for v in row)


def test_texts_without_words_all_stay(spark):
    rows = [(1, "\n"), (1, "\n"), (2, "\t\t"), (2, "\t\t"), (3, "a b c d e f"), (3, "a b c d e f")]
    kept = jaccard_join.without_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 1, 2, 2, 3]
