"""Who the customer is: candidates in texts, a supplied resolution, the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FLAGS, collapse, registration_code, tax_number
from ..shared import small_side, written

#: Fixed patterns and scores.
ROLE = FLAGS + r"грузополучател|получател|филиал|обособлен|заказчик|покупател|сторона\s*1"
TAX = FLAGS + r"(?:ИНН|И\s*Н\s*Н)\s*[:№#\-–—]?\s*((?:\d[\s-]*){10,12})"
CODE = FLAGS + r"(?:КПП|К\s*П\s*П)\s*[:№#\-–—]?\s*((?:\d[\s-]*){9})"
SUPPLIER = FLAGS + r"поставщик|исполнитель|подрядчик|банк|уфк|казначейств|грузоотправител"
SCORES = (("груз", "Грузополучатель", 1000), ("получ", "Получатель", 850), ("филиал|обособ", "Филиал", 800))
BEFORE, AFTER, MOST = 900, 1900, 35


def candidates(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Places where a role is named, with the numbers about them; the best 35 of each key.

    A place's offset is the running length of what lies between the matches.
    """
    gaps, hits = F.split(text, ROLE, -1), F.regexp_extract_all(text, F.lit(ROLE), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,word:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        return F.struct((start + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lower(x["h"]).alias("word")))).alias("out"))

    placed = F.aggregate(F.filter(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: x["h"].isNotNull()), begin, step)["out"]
    low = lambda x: F.greatest(F.lit(0), x["start"] - BEFORE)
    # fragments are cut before the rows are dealt out, so no row carries its whole text along
    cut = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["word"].alias("word"), F.substring(F.col(text), low(x) + 1, x["start"] + F.length(x["word"]) + AFTER - low(x)).alias("fragment")))
    rows = texts.select(*keys, F.posexplode(cut).alias("pos", "x")).select(*keys, "pos", "x.*")
    role, score = F.lit("Заказчик"), F.lit(700)
    for mark, name, value in reversed(SCORES):
        role, score = F.when(F.col("word").rlike(mark), name).otherwise(role), F.when(F.col("word").rlike(mark), value).otherwise(score)
    valid = lambda pattern, check: F.array_distinct(F.filter(F.transform(F.regexp_extract_all("fragment", F.lit(pattern), F.lit(1)), check), lambda x: x.isNotNull()))
    out = rows.select(*keys, "pos", "start", role.alias("role"), (score - F.when(F.col("fragment").rlike(SUPPLIER), 800).otherwise(0)).alias("score"), valid(TAX, tax_number).alias("inns"), valid(CODE, registration_code).alias("kpps"), F.substring(collapse(F.col("fragment")), 1, 1800).alias("evidence"))
    return best_scored(out, keys, F.col("score"), F.col("pos"), MOST)


def best_scored(df: DataFrame, keys: list[str], score: Column, order: Column, most: int) -> DataFrame:
    """The rows of the highest scores of each key, with their rank; the order decides between equal ones."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), order))).where(F.col("rank") <= most)


def resolved(df: DataFrame) -> DataFrame:
    """Replaces name, inn and kpp by a supplied resolution (actual_name, actual_inn, actual_kpp, replace_inn, replace_kpp)."""
    inn, kpp = tax_number(F.col("actual_inn")), registration_code(F.col("actual_kpp"))
    own_inn, own_kpp = tax_number(F.col("inn")), registration_code(F.col("kpp"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return df.withColumns({
        "name": F.coalesce(F.nullif(F.trim("actual_name"), F.lit("")), F.col("name")),
        "inn": F.when(inn.isNotNull() & (yes("replace_inn") | ~inn.eqNullSafe(own_inn)), inn).otherwise(F.col("inn")),
        "kpp": F.when(kpp.isNotNull() & (yes("replace_kpp") | ~kpp.eqNullSafe(own_kpp)), kpp).otherwise(F.col("kpp")),
    })


#: Why a counterparty is not found.
NO_NUMBER = "Для проверки IPro отсутствует корректный ИНН контрагента."
NOT_LISTED = ("Организация с ИНН ", " в IPro не найдена.")
LOOKUP_FAILED = ("IPro API не выполнил проверку по ИНН ", ": ")


def looked_up(wanted: DataFrame, registry: DataFrame, key: str, order: str = "pos", failed: DataFrame | None = None) -> DataFrame:
    """status, reason, match and filled numbers of each wanted row (key, inn, kpp): by tax number; an equal code is preferred, never required.

    registry: inn, kpp, full_name, short_name and an order column; failed: inn and error of lookups without an answer.
    Numbers of another length than a tax number's or a code's count as none, on both sides. status: matched, not_found or
    lookup_error. The registry is reduced to its first row of each number before it is joined, so no row meets more than two.
    """
    name = F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), F.nullif(F.trim("short_name"), F.lit("")))
    first = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("pos"), name.isNull().alias("unnamed"), name.alias("name"), registration_code(F.col("kpp")).alias("kpp"))
    own = registry.select(tax_number(F.col("inn")).alias("_inn"), registration_code(F.col("kpp")).alias("_kpp"), first.alias("_first")).where("_inn IS NOT NULL")
    by_inn = small_side(written(own.groupBy("_inn").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_any")), "registry-numbers"))
    by_both = small_side(written(own.where("_kpp IS NOT NULL").groupBy(F.col("_inn").alias("_inn2"), F.col("_kpp")).agg(F.min("_first").alias("_same")), "registry-codes"))
    inn, kpp = tax_number(F.col("inn")), registration_code(F.col("kpp"))
    out = wanted.join(by_inn, inn == F.col("_inn"), "left").join(by_both, (inn == F.col("_inn2")) & (kpp == F.col("_kpp")), "left")
    error = F.lit(None).cast("string")
    if failed is not None:
        errors = failed.groupBy(tax_number(F.col("inn")).alias("_inn3")).agg(F.min("error").alias("_error"))
        out, error = out.join(small_side(written(errors, "registry-errors")), inn == F.col("_inn3"), "left"), F.col("_error")
    found, best = F.col("_n").isNotNull() & error.isNull(), F.coalesce("_same", "_any")
    status = F.when(inn.isNull(), "not_found").when(error.isNotNull(), "lookup_error").when(found, "matched").otherwise("not_found")
    reason = F.when(inn.isNull(), NO_NUMBER).when(error.isNotNull(), F.concat(F.lit(LOOKUP_FAILED[0]), inn, F.lit(LOOKUP_FAILED[1]), error)).when(~found, F.concat(F.lit(NOT_LISTED[0]), inn, F.lit(NOT_LISTED[1])))
    shown = {
        "status": status, "reason": reason, "by_inn_count": F.when(found, F.col("_n")).otherwise(F.lit(0)).cast("long"),
        "matched_name": F.when(found, best["name"]), "matched_kpp": F.when(found, best["kpp"]), "kpp": F.coalesce(kpp, F.when(found, best["kpp"])),
    }
    return out.withColumns(shown).drop("_inn", "_n", "_any", "_inn2", "_kpp", "_same", "_inn3", "_error")
