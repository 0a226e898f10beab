"""Helpers that the operators share: row keys and native text spans, and what the library shares with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import fresh, small_side, written

__all__ = ["CHUNK", "WS", "fresh", "joined", "let", "small_side", "spans", "text_key", "written"]

#: Fixed value: ASCII white space, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
#: Matches that one step of a span fold holds, so that a text's fold is not quadratic in its matches.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def text_key(id_col: str, text_col: str) -> Column:
    """Key of a row's id and text: repeated rows share it, other texts under the same id do not."""
    return F.xxhash64(F.col(id_col), F.length(F.col(text_col)), F.col(text_col))


def spans(text: Column, pattern: str, probe: str | None = None, whole: bool = False) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,e,v,before,after>>, in code points, end exclusive.

    before and after are the stretches up to the neighbouring matches, at most 64
    code points of each; whole: all of the stretch and the neighbouring match. Texts without the cheaper `probe` pattern are not searched.
    """
    pat = F.lit(pattern)

    def folded(z: Column) -> Column:
        empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,v:string,before:string,after:string>>)")

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["0"])
            end = start + F.length(x["1"])
            one = F.struct(
                start.cast("long").alias("s"), end.cast("long").alias("e"), x["1"].alias("v"),
                *([x["3"].alias("before"), x["4"].alias("after")] if whole else [F.right(x["0"], F.lit(64)).alias("before"), F.left(x["2"], F.lit(64)).alias("after")]),
            )
            return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def local(c: Column) -> Column:
            return F.aggregate(F.slice(z, c * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)

        def moved(acc: Column, x: Column) -> Column:
            here = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["v"].alias("v"), y["before"].alias("before"), y["after"].alias("after")))
            return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], here).alias("out"))

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), local)
        return F.aggregate(chunks, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), moved)["out"]

    hits = F.regexp_extract_all(text, pat, F.lit(0))
    if whole:
        own = let(F.struct(F.split(text, pattern, -1).alias("g"), hits.alias("h")), lambda z: F.struct(
            F.slice(z["g"], 1, F.size(z["g"]) - 1).alias("gap"), z["h"].alias("hit"), F.slice(z["g"], 2, F.size(z["g"]) - 1).alias("next"),
            F.concat(F.array(F.lit("")), z["h"]).alias("shifted"),
        ))
        sides = lambda z: F.arrays_zip(
            z["gap"].alias("0"), z["hit"].alias("1"), z["next"].alias("2"),
            F.transform(z["gap"], lambda x, i: F.concat(F.get(z["shifted"], i), x)).alias("3"), F.transform(z["next"], lambda x, i: F.concat(x, F.coalesce(F.get(z["hit"], i + 1), F.lit("")))).alias("4"),
        )
        zipped = let(own, sides)
    else:
        zipped = let(F.split(text, pattern, -1), lambda g: F.arrays_zip(F.slice(g, 1, F.size(g) - 1).alias("0"), hits.alias("1"), F.slice(g, 2, F.size(g) - 1).alias("2")))
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint,v:string,before:string,after:string>>)")
    return F.when(text.rlike(probe or pattern), let(zipped, lambda z: F.when(F.size(z) > 0, folded(z)).otherwise(none))).otherwise(none)


def joined(items: Column, kind: str) -> Column:
    """kind:start:end of each span, as an array of strings."""
    return F.transform(items, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))
