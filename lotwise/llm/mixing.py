"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power `exponent`, normalised. The exponent
is found by repeated section of [0, 1]: each round one grouped aggregation evaluates a
grid of exponents over the table of sources, and only the grid's results (a bounded
number of rows) reach the driver. It meets either a target entropy (a share of the
highest one), a limit on how often the scarcest source repeats, or both: then the limit holds whatever the entropy.

Budget: as many tokens as give the least repeated source `least_epochs` passes. A source
gets budget * weight tokens: whole passes and a part of one. A pass is a permutation of
the source's documents by a seeded hash, dealt into blocks; the part takes whole
blocks, then documents of the block at the border, as long as the budget holds. Running totals go over
blocks, then inside one block, so no window holds a whole source. One more pass ends the
permutation; its order key places whole blocks, shuffled anew in each pass.

Defined results: null and empty texts have no tokens and are taken once; a null source is
a source of its own; repeated rows share their place in the permutation, so they are taken
alike; a row's places are listed LISTED passes at a time: its first ones, or in as many rows as it takes all of them; an empty table stays empty; columns that clash with the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import prefix_scan
from .common import WS, fresh, small_side, written

SECTIONS = 32
ROUNDS = 4
#: Rows of a block, by default; passes whose places mixed() lists; copies of a row that one step of arranged() makes.
BLOCK_ROWS, LISTED, STEP = 1024, 16, 65_536
#: Parts that a source's rows are dealt into where the table of sources is too large to broadcast.
SALTS = 64


def word_tokens(text_col: str = "text") -> Column:
    """The default token measure: words of the whole text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def source_shares(sized: DataFrame) -> DataFrame:
    """source, rows, tokens, share, top (the largest share), kinds (sources with tokens), from source and n_tokens."""
    totals = written(sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    whole = totals.where(F.col("tokens") > 0).agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m"), F.count(F.lit(1)).alias("kinds")).first()
    t, m = whole["t"] or 1, whole["m"] or 1
    return totals.withColumns({"share": F.col("tokens") / F.lit(float(t)), "top": F.lit(m / t), "kinds": F.lit(whole["kinds"])})


def find_exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, sections: int = SECTIONS, rounds: int = ROUNDS) -> float:
    """The largest exponent in [0, 1] at which the entropy is reached, or the smallest that keeps the repetition limit; of both, the larger.

    entropy: target as a share of log(number of sources). repeats: limit on the passes
    over the scarcest source when the most plentiful one has one pass.
    """
    if entropy is None and repeats is None:
        raise ValueError("one of entropy and repeats is needed")
    if entropy is not None and repeats is not None:
        return max(find_exponent(shares, entropy, None, sections, rounds), find_exponent(shares, None, repeats, sections, rounds))
    low, high = 0.0, 1.0
    counted = shares.where(F.col("tokens") > 0)
    for _ in range(rounds):
        grid = [low + (high - low) * i / sections for i in range(sections + 1)]
        p = F.col("share")
        each = counted.select("share", "top", "kinds", F.posexplode(F.array(*[F.lit(x) for x in grid])).alias("i", "a"))
        powered = F.pow(p, F.col("a"))
        found = each.groupBy("i").agg(
            F.sum(powered).alias("z"), F.sum(powered * F.col("a") * F.log(p)).alias("s"),
            F.max(F.pow(p / F.col("top"), F.col("a") - 1)).alias("repeats"), F.max("kinds").alias("kinds"),
        )
        reached = (F.log("z") - F.col("s") / F.col("z") >= F.lit(entropy or 0.0) * F.log("kinds") - 1e-12) if repeats is None else (F.col("repeats") <= repeats)
        ok = {r["i"]: r["ok"] for r in found.select("i", reached.alias("ok")).collect()}  # sections + 1 rows
        if not ok:
            return 1.0
        if repeats is None:  # the entropy falls as the exponent grows
            best = max((i for i, good in ok.items() if good), default=0)
            low, high = grid[best], grid[min(best + 1, sections)]
        else:  # so does the number of repeats
            best = min((i for i, good in ok.items() if good), default=sections)
            low, high = grid[max(best - 1, 0)], grid[best]
    return low if repeats is None else high


def epochs_of(shares: DataFrame, exponent: float, least_epochs: float = 1.0) -> DataFrame:
    """Adds weight and epochs: passes over each source within the budget. Sources without tokens pass once."""
    powered = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(F.lit(0.0))
    z = shares.agg(F.sum(powered).alias("z")).first()["z"] or 1.0
    epochs = F.when(F.col("tokens") > 0, least_epochs * F.pow(F.col("share") / F.col("top"), F.lit(exponent - 1))).otherwise(F.lit(1.0))
    return shares.withColumns({"weight": powered / F.lit(z), "epochs": epochs})


def borders(sized: DataFrame, plan: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """plan with whole (passes) and border: the last hash of the permutation that the part of a pass takes."""
    blocks = F.ceil(F.col("rows") / block_rows)
    goal = plan.select("source", "rows", F.floor("epochs").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("part"))
    keyed = with_plan(sized, goal.withColumn("blocks", blocks)).withColumn("block", block_of(F.col("place"), F.col("blocks")))
    by_block = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("part").alias("part"))
    # a source may have very many blocks, so their running totals are a prefix scan
    summed = prefix_scan(written(by_block, "mix-by-block"), ["source"], ["block"], {"after": ("sum", F.col("tokens"))})
    at_border = summed.where((F.col("after") > F.col("part")) & (F.col("after") - F.col("tokens") <= F.col("part")))
    at_border = at_border.groupBy("source").agg(F.min(F.struct("block", (F.col("after") - F.col("tokens")).alias("before"))).alias("x"))
    at_border = small_side(written(at_border.select(F.col("source").alias("source_"), F.col("x.block").alias("block_"), "x.before"), "mix-blocks"))
    inner = keyed.join(at_border, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    places = inner.groupBy("source", "block", "place").agg(F.sum("n_tokens").alias("tokens"), F.max("part").alias("part"), F.max("before").alias("before"))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("place"))
    # before the first place that breaks the budget all are taken
    broke = places.withColumn("run", run).where(F.col("run") > F.col("part")).groupBy("source").agg(F.min("place").alias("border"))
    joined = goal.join(broke.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    return plan.join(joined.select(F.col("source").alias("source_"), "whole", "border", "part"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def with_plan(rows: DataFrame, plan: DataFrame, source_col: str = "source", place_col: str = "place") -> DataFrame:
    """Joins the sources' plan to rows: by broadcast within the bound, else on source and salt."""
    of, salt, salt_of = fresh(rows, "source_", "salt", "salt_")
    side = plan.withColumnRenamed("source", of)
    marked = small_side(side)
    same = F.col(source_col).eqNullSafe(F.col(of))
    if marked is not side:
        return rows.join(marked, same, "left").drop(of)
    salted = side.withColumn(salt_of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(salt, F.pmod(F.col(place_col), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col(salt) == F.col(salt_of)), "left").drop(of, salt, salt_of)


def repeated(rows: DataFrame, copies: Column, turn: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from 1 in `turn`; no step makes a list of more than STEP numbers."""
    (step,) = fresh(rows, "_step")
    steps = rows.where(copies > 0).withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / STEP).cast("long"))))
    return steps.withColumn(turn, F.explode(F.sequence(F.col(step) * STEP + 1, F.least(copies, (F.col(step) + 1) * STEP)))).drop(step)


def block_of(place: Column, blocks: Column) -> Column:
    """The block of a place: equal ranges of the hash."""
    return F.floor((F.shiftright(place, 10) / F.lit(float(2**53))) * blocks)


def mixing_plan(docs: DataFrame, id_col: str, source_col: str, tokens: Column, entropy: float | None, repeats: float | None, least_epochs: float, seed: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows' id, source, n_tokens and place (written), and the sources' plan (written)."""
    place = F.xxhash64(F.lit(seed), F.col(id_col))
    # places are positive, so that they sort as they are dealt into blocks
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens.alias("n_tokens"), F.shiftrightunsigned(place, 1).alias("place"))
    sized = written(sized, "mix-rows")
    shares = source_shares(sized)
    exponent = find_exponent(shares, entropy, repeats)
    plan = written(epochs_of(shares, exponent, least_epochs), "mix-epochs")
    return sized, written(borders(sized, plan, block_rows).withColumn("exponent", F.lit(exponent)), "mix-plan")


def copies_of(place: Column, whole: Column, part: Column, border: Column) -> Column:
    """How often a row is taken: the whole passes, and once more within the part of a pass."""
    extra = (part > 0) & (border.isNull() | (place < border))
    return whole.cast("long") + extra.cast("long")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None,
    entropy: float | None = None, repeats: float | None = None, least_epochs: float = 1.0, seed: int = 17, block_rows: int = BLOCK_ROWS, listed: int = LISTED, every: bool = False,
) -> DataFrame:
    """One row id, source, n_tokens, weight, epochs, copies, whole, extra, block, exponent, passes for each row of docs.

    copies: the whole passes, and one more if the row is extra. passes: for each of the first `listed` times that the row is
    taken the pass and its place there: the hash by which the pass shuffles blocks, and the hash by which it
    shuffles the rows of a block (see arranged()); every: a row that is taken more often comes again for each `listed`
    further passes, so that all of them are there and no row is longer than others; else later passes follow from turn_order().
    """
    tokens = word_tokens(text_col) if tokens is None else tokens
    sized, plan = mixing_plan(docs, id_col, source_col, tokens, entropy, repeats, least_epochs, seed, block_rows)
    out = with_plan(sized, plan.select("source", "rows", "weight", "epochs", "whole", "part", "border", "exponent"))
    out = out.withColumns({
        "copies": copies_of(F.col("place"), F.col("whole"), F.col("part"), F.col("border")), "block": block_of(F.col("place"), F.ceil(F.col("rows") / block_rows)),
    })
    stretches = F.greatest(F.ceil(F.col("copies") / listed), F.lit(1)).cast("long")
    out = repeated(out, stretches, "stretch") if every else out.withColumn("stretch", F.lit(1).cast("long"))
    first, last = (F.col("stretch") - 1) * listed + 1, F.least("copies", F.col("stretch") * listed)
    turn = lambda t: F.struct(t.alias("pass"), *[x.alias(n) for n, x in zip(("block_order", "row_order"), turn_order(seed, t.cast("long"), F.col("source"), F.col("block"), F.col("place")), strict=True)])
    none = F.expr("cast(array() as array<struct<pass:int,block_order:bigint,row_order:bigint>>)")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", "epochs",
        "copies", F.col("whole").cast("long").alias("whole"), (F.col("copies") > F.col("whole")).alias("extra"), "block", "exponent",
        F.when(F.col("copies") > 0, F.transform(F.sequence(first.cast("int"), last.cast("int")), turn)).otherwise(none).alias("passes"),
    )


def turn_order(seed: int, turn: Column, source: Column, block: Column, place: Column) -> tuple[Column, Column]:
    """Where a pass places a block, and a row within its block."""
    return F.xxhash64(F.lit(seed), turn, source, block), F.xxhash64(F.lit(seed), turn, place)


def arranged(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float | None = None, repeats: float | None = None, least_epochs: float = 1.0, seed: int = 17, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """docs as the mixture: rows repeated as planned, ordered by pass, shuffled block and place; columns as in docs."""
    _, plan = mixing_plan(docs, id_col, source_col, word_tokens(text_col), entropy, repeats, least_epochs, seed, block_rows)
    own, place, turn = fresh(docs, "_plan", "_place", "_turn")
    packed = written(plan.select("source", F.struct("whole", "part", "border", "rows").alias(own)), "mix-join")
    out = with_plan(docs.withColumn(place, F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)), packed, source_col, place)
    out = repeated(out, copies_of(F.col(place), F.col(f"{own}.whole"), F.col(f"{own}.part"), F.col(f"{own}.border")), turn)
    block = block_of(F.col(place), F.ceil(F.col(f"{own}.rows") / block_rows))
    order = [F.col(turn), *turn_order(seed, F.col(turn), F.col(source_col), block, F.col(place))]
    names = fresh(docs, "_a", "_b", "_c")
    keyed = out.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(c) for x, c in zip(order, names, strict=True)])
    return keyed.repartitionByRange(*names).sortWithinPartitions(*names).select(*[F.col(f"`{c}`") for c in docs.columns])
