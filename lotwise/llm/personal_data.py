"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Well-formed identifiers (the base kinds) are seeds. The word before and the word
after a seed are its lexical patterns. A pattern's confidence for a kind is the
score of all occurrences of instances it surrounds over all places where its word occurs
in the corpus, so that ordinary words earn next to nothing and copies change nothing. Words that look like
identifiers, with the groups of digits that follow them, and stand in the same patterns get 1 - prod(1 - confidence) as score;
they feed back into the patterns for a few rounds over the pattern-instance graph.
What ends above the threshold is reported besides the base spans.

Defined results: null and empty texts have no spans; repeated rows get equal spans;
rows that share an id but not a text are kept apart; an empty table stays empty;
columns that clash with the new ones are replaced, others pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, joined, let, small_side, spans, text_key, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Fixed patterns: kind, expression (possessive and anchored at runs, so linear in the text), cheap probe.
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Whole words with a digit or an at sign.
WORD = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
#: Candidates for new identifiers: such words, and with them the groups of digits that single blanks join to their last digit or bracket.
GROUP = rf"(?<=[0-9)])\x20[(]?+[0-9][0-9().-]*+(?![^{WS},;:!?])[,;:!?]*+(?![^{WS}])"
CANDIDATE = rf"(?<![^{WS}])(?:[^{WS}0-9@]*+[0-9][^{WS}@]*+(?![^{WS}])(?:{GROUP})*+|[^{WS}0-9@]*+[0-9@][^{WS}]*+)"
ROUNDS = 3
MIN_SEEDS = 3
SMOOTHING = 2.0
THRESHOLD = 0.7


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = n * 2 - F.when(n > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(weighed(c, i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.when(F.length(part(x)) <= 3, part(x).cast("int")) <= 255))
    count = F.length(_digits(v))
    if kind == "phone":
        return count.between(9, 15)
    return F.when(count.between(13, 19), let(_digits(v), _luhn)).otherwise(F.lit(False))


def base_spans(text: Column, kind: str, whole: bool = False) -> Column:
    pattern, probe = PATTERNS[kind]
    return F.filter(spans(text, pattern, probe, whole), lambda x: valid(kind, x["v"]))


def _context(items: Column, kind: Column) -> Column:
    """The spans with their kind and the whole words that stand next to them."""
    before = lambda x: F.lower(F.regexp_extract(x["before"], rf"(?<![^{WS}])([^{WS}]++)[{WS}]*+\z", 1))
    after = lambda x: F.lower(F.regexp_extract(x["after"], rf"^[^{WS}]*+[{WS}]++([^{WS}]++)", 1))
    return F.transform(items, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), before(x).alias("l"), after(x).alias("r"), kind.alias("kind")))


def _patterns(items: DataFrame) -> DataFrame:
    """One row for each occurrence and side with a word; a pattern is a side and a word."""
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("l").alias("word")), F.struct(F.lit("R").alias("side"), F.col("r").alias("word")))
    return items.withColumn("_p", F.explode(sides)).select("*", "_p.side", "_p.word").drop("_p", "l", "r").where(F.col("word") != "")


def discovered(items: DataFrame, words: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(v, kind, score) of the identifiers that seeds' patterns find.

    items: kind (null: a candidate), v, l, r. words: word, n over the whole corpus.
    """
    occurs = _patterns(items)
    edges = occurs.groupBy("side", "word", "v", "kind").agg(F.count(F.lit(1)).alias("times"))
    seeded = edges.where(F.col("kind").isNotNull())
    common = seeded.groupBy("side", "word", "kind").agg(F.sum("times").alias("seeds"), F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") >= MIN_SEEDS).drop("distinct")
    vocabulary = written(common.join(words, "word"), "pii-patterns")
    links = edges.where(F.col("kind").isNull()).drop("kind").join(vocabulary, ["side", "word"])
    links = written(links.select("side", "word", "kind", "v", "times", "seeds", "n"), "pii-links")
    known = vocabulary.select("side", "word", "kind", (F.col("seeds") / (F.col("n") + SMOOTHING)).alias("confidence"))
    score = None
    for _ in range(rounds):
        odds = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        score = links.join(known, ["side", "word", "kind"]).groupBy("v", "kind").agg((1 - F.exp(odds)).alias("score"))
        score = score.where(F.col("score") >= threshold)
        found = links.join(score, ["v", "kind"]).groupBy("side", "word", "kind").agg(F.sum(F.col("score") * F.col("times")).alias("more"))
        known = vocabulary.join(found, ["side", "word", "kind"], "left").select(
            "side", "word", "kind", ((F.col("seeds") + F.coalesce(F.col("more"), F.lit(0.0))) / (F.col("n") + SMOOTHING)).alias("confidence")
        )
    return score


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, `pii`) for each row of docs: pii holds the kinds' base spans and `found`, the new ones.

    found: array<struct<kind,s,e,score>>, none of which overlaps a base span.
    """
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("k"), text.alias("t"))
    raw = own.select("id", "k", "t", *[base_spans(F.col("t"), kind, True).alias(kind) for kind in KINDS], spans(F.col("t"), CANDIDATE, "[0-9@]", True).alias("runs"))
    lean = lambda kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    taken = lambda x: reduce(lambda a, b: a | b, [F.exists(F.col(kind), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])) for kind in KINDS])
    # where a base span takes a part of a run, the run's other words stand alone
    raw = raw.withColumn("cut", F.filter("runs", taken)).withColumn("words", F.when(F.size("cut") > 0, spans(F.col("t"), WORD, "[0-9@]", True)))
    alone = F.filter("words", lambda x: F.exists("cut", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    raw = raw.withColumn("other", F.when(F.size("cut") > 0, F.concat(F.filter("runs", lambda x: ~taken(x)), alone)).otherwise(F.col("runs")))
    held = written(
        raw.select(
            "id", "k", *[lean(kind).alias(kind) for kind in KINDS],
            F.concat(*[_context(F.col(kind), F.lit(kind)) for kind in KINDS], _context(F.filter("other", lambda x: ~taken(x)), F.lit(None).cast("string"))).alias("items"),
        ),
        "pii-base",
    )
    items = held.select("id", "k", F.explode("items").alias("x")).select("id", "k", "x.*")
    # only words that seeds make patterns of are counted
    patterns = _patterns(items.where(F.col("kind").isNotNull())).groupBy("side", "word", "kind").agg(F.count_distinct("v").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    wanted = small_side(written(patterns.select("word").distinct(), "pii-words"))
    words = own.select(F.explode(F.split(F.lower("t"), f"[{WS}]+")).alias("word")).join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    score = written(discovered(items, words, rounds, threshold), "pii-found")
    candidates = items.where(F.col("kind").isNull()).drop("kind", "l", "r").distinct()
    best = score.groupBy("v").agg(F.max_by("kind", "score").alias("kind"), F.max("score").alias("score"))
    found = candidates.join(small_side(best), "v").groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e", "score"))).alias("found"))
    found = small_side(written(found, "pii-new")).withColumnsRenamed({"id": "id_", "k": "k_"})
    out = held.join(found, (F.col("k") == F.col("k_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    nothing = F.expr("cast(array() as array<struct<kind:string,s:bigint,e:bigint,score:double>>)")
    return out.select(F.col("id").alias(id_col), F.struct(*KINDS, F.coalesce("found", nothing).alias("found")).alias("pii"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose base spans read <kind>; a convenience that needs no second pass."""
    out = docs
    (tmp,) = fresh(docs, "_text")
    for kind in KINDS:
        items = base_spans(F.col(text_col), kind)
        out = out.withColumn(tmp, items).withColumn(text_col, replaced(F.col(text_col), F.col(tmp), F.lit(f"<{kind}>"))).drop(tmp)
    return out


def replaced(text: Column, items: Column, by: Column) -> Column:
    """text with each span (sorted, not overlapping) replaced."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.struct(x["e"].alias("at"), F.concat(acc["out"], kept, by).alias("out"))

    done = F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(items) > 0, done).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of what personal_data() returned."""
    base = F.concat(*[joined(F.col(f"pii.{kind}"), kind) for kind in KINDS])
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    own = lambda kind: F.transform(F.col(f"pii.{kind}"), lambda x: F.struct(F.lit(KINDS.index(kind) + 1).cast("long").alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    more = F.transform(F.col("pii.found"), lambda x: F.struct(rank(x["kind"]).cast("long").alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    everything = F.transform(F.array_sort(F.concat(*map(own, KINDS), more)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    return found.select(
        id_col,
        *[F.size(f"pii.{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", everything).alias("spans"),
        F.size("pii.found").cast("long").alias("n_found"),
    )
