"""URL filters: explicit rules first, then a path-template tree judged by labelled purity.

Per host, paths form a tree of segments, counted over distinct paths. Down to the deepest, a segment of at least
`least` pages stays literal if its labelled rate differs from its siblings'
by a two-proportion test, or if it has no siblings; other segments become wildcards (<n> for
numbers, <id> for identifiers, * for the rest), whatever the size of the host. Runs of segments without siblings are taken in one
step. A template's purity is its share of good labels, smoothed towards the same template on all hosts and towards the
global share; templates below the threshold are blocked. Everything is grouped
aggregation with DataFrame functions; the tree itself stays distributed.

Defined results: a null url, or one without ://, has an empty host and path; repeated rows
are judged alike; without labels all templates pass; an empty table stays empty; columns
that clash with the new ones are replaced, others pass through.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

#: Pages that a literal segment needs, by default.
MIN_COUNT = 5
Z = 2.58
STRENGTH = 20.0
THRESHOLD = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, host, path) rule that fits, as text, and its verdict; null without one."""
    text = verdict = None
    for kind, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text = F.when(fits, own + start) if text is None else text.when(fits, own + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))


def _typed(segment: Column) -> Column:
    """Numbers and identifiers are variable whatever their counts; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ending))
    kind = F.when(stem.rlike("^[0-9]+$"), "<n>").when(stem.rlike("^[0-9a-fA-F-]{8,}$") | stem.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{12,}$"), "<id>")
    return F.when(kind.isNotNull(), F.concat(kind, ending)).otherwise(segment)


def _tail(segments: Column, at: Column) -> Column:
    """What follows `at` segments, as a template without literal segments; a slash before each."""
    rest = F.slice(segments, at + 1, F.greatest(F.size(segments) - at, F.lit(0)))
    return F.array_join(F.transform(rest, lambda x: F.concat(F.lit("/"), F.when(x.startswith("<"), x).otherwise("*"))), "")


def templates(urls: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Written table host, path, template, n, labelled, bads of the distinct paths of rows with host, path and bad (1, 0, or null without a label).

    Each round takes every group of paths that share a template as far as they have all segments in common, and past one branching;
    so the rounds grow with the branchings and page-bearing levels of the deepest section, not with its depth.
    """
    counted = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), _typed)
    rows = counted.select("*", segments.alias("segments"), F.lit(0).alias("at"), F.lit("").alias("template"))
    done = []
    while True:
        rows = written(rows, "url-paths")
        done.append(rows.where(F.size("segments") <= F.col("at")))
        rows = rows.where(F.size("segments") > F.col("at"))
        if rows.isEmpty():
            break
        groups = rows.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
            F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bads").alias("all_bads"), F.min("segments").alias("lo"), F.max("segments").alias("hi")
        )
        apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
        groups = small_side(written(groups.select("_h", "_t", "all", "all_labelled", "all_bads", F.when(apart > 0, apart - 1).otherwise(F.size("lo")).cast("int").alias("common")), "url-groups"))
        rows = rows.join(groups, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).drop("_h", "_t")
        # where a group has fewer pages than a literal segment needs, its paths end; what all have in common stays literal
        chain = F.array_join(F.transform(F.slice("segments", F.col("at") + 1, F.col("common") - F.col("at")), lambda x: F.concat(F.lit("/"), x)), "")
        branching = (F.col("all") >= least) & (F.col("common") <= F.col("at"))
        own = F.get("segments", F.col("at"))
        branches = rows.where(branching & ~own.startswith("<")).groupBy(F.col("host").alias("_h"), F.col("template").alias("_t"), own.alias("_s")).agg(
            F.sum("n").alias("bn"), F.sum("labelled").alias("bl"), F.sum("bads").alias("bb"), F.max("all_labelled").alias("al"), F.max("all_bads").alias("ab")
        )
        # merged unless the branch's labels differ from those of its siblings taken together
        rest_n, pooled = F.col("al") - F.col("bl"), F.col("ab") / F.col("al")
        gap = F.abs(F.col("bb") / F.col("bl") - (F.col("ab") - F.col("bb")) / rest_n)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("bl") + 1 / rest_n))
        differs = F.when((F.col("bl") > 0) & (rest_n > 0), gap > Z * error).otherwise(F.lit(False))
        literal = small_side(written(branches.where((F.col("bn") >= least) & differs).select("_h", "_t", "_s"), "url-branches"))
        rows = rows.join(literal, branching & (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (own == F.col("_s")), "left")
        step = F.concat(F.lit("/"), F.when(own.startswith("<") | F.col("_s").isNotNull(), own).otherwise("*"))
        few = F.col("all") < least
        rows = rows.select(
            "host", "path", "n", "labelled", "bads", "segments", F.when(few, F.size("segments")).when(branching, F.col("at") + 1).otherwise(F.col("common")).alias("at"),
            F.concat("template", F.when(few, _tail(F.col("segments"), F.col("at"))).when(branching, step).otherwise(chain)).alias("template"),
        )
    return written(reduce(DataFrame.unionByName, done).select("host", "path", "template", "n", "labelled", "bads"), "url-templates")


def purities(paths: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """host, template, purity of templates(): good labels' share, smoothed over all hosts' equal templates and globally."""
    own = written(paths.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bads").alias("b")), "url-sums")
    alike = own.groupBy(F.col("template").alias("_of")).agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    whole = own.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    rate = (whole["b"] or 0) / whole["n"] if whole["n"] else 0.0
    over = (F.col("tb") + strength * rate) / (F.col("tn") + strength)
    met = own.join(small_side(written(alike, "url-alike")), F.col("template") == F.col("_of"))
    return met.select(F.col("host").alias("_h"), F.col("template").alias("_t"), (1 - (F.col("b") + strength * over) / (F.col("n") + strength)).alias("purity"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD, least: int = MIN_COUNT) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity.

    labelled: id and bad (0 or 1) of some pages; a page with several labels is bad if one of them says so. least: pages that a
    literal segment needs.
    """
    had = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "template", "purity")]
    # the page's own columns travel in a struct, so that none of their names can clash
    own = F.struct(*[F.col(f"`{c}`") for c in had]).alias("_page")
    rows = pages.select(own, F.col(id_col).alias("_key"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if labelled is None:
        rows = rows.withColumn("bad", F.lit(None).cast("int"))
    else:
        marks = small_side(written(labelled.select(F.col(id_col).alias("_id"), "bad").groupBy("_id").agg(F.max("bad").alias("bad")), "url-labels"))
        rows = rows.join(marks, F.col("_key") == F.col("_id"), "left").drop("_id")
    paths = templates(rows, least)
    judged_paths = paths.join(small_side(written(purities(paths), "url-purities")), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select(F.col("host").alias("_ho"), F.col("path").alias("_pa"), "template", "purity")
    judged = rows.drop("bad").join(small_side(written(judged_paths, "url-judged")), (F.col("host") == F.col("_ho")) & (F.col("path") == F.col("_pa")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    back = [F.col(f"_page.`{c}`").alias(c) for c in had]
    return judged.select(*back, "host", "path", "template", "purity", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
