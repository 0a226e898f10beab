"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes good (2), bad (0) or abstains (1). A document's hidden class is good
or one of the failures that the rules look for (failures differ, so one bad class
would make a document that fails in one way look good in all others). Votes are
independent given the class, and a rule that abstains is missing from the likelihood; EM
estimates how often each rule votes bad within each class and the classes' shares over all
documents, and the posterior of the good class decides (kept from a posterior of `threshold`,
0.5 by default). Priors count as PSEUDO votes of each rule in each class, whatever the number
of documents. A rule of which no document has a good vote is one-sided: there, silence is
what it says of documents without its failure, and counts as not bad.
EM needs only how often each combination of votes occurs, so Spark counts the
combinations (at most 3 ** len(RULES), whatever the input) and the driver iterates
over that bounded table.

Defined results: a null or empty text has zero counts, fails the base rule and is
not kept; repeated rows are judged alike; an empty table stays empty; columns that
clash with the new ones are replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written
from .textstats import COUNTS, text_counts

_STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
BAD, ABSTAIN, GOOD = 0, 1, 2


@F.arrow_udf(_STATS)
def text_statistics(texts: pa.Array) -> pa.Array:
    counts = text_counts(texts)
    return pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes over the columns COUNTS; thresholds are fixed values. Between them, and on texts too short for it, a rule abstains."""
    letters = F.greatest(F.col("n_upper") + F.col("n_lower") + F.col("n_wide"), F.lit(1))
    words, symbols, bangs = F.col("n_words"), _ratio("n_symbols", "n_words"), _ratio("n_bang", "n_words")
    upper, repeat, lines = F.col("n_upper") / letters, _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines")
    ends, length, digits, kinds = _ratio("n_end", "n_words"), _ratio("word_chars", "n_words"), _ratio("n_digit", "word_chars"), F.col("n_distinct")
    some, many = words >= 5, F.col("n_lines") >= 3
    return {
        "symbols": _vote(symbols > 0.25, some & (symbols < 0.1)),
        "upper_case": _vote(some & (upper > 0.5), some & (upper < 0.3)),
        "exclamations": _vote(bangs > 0.5, some & (bangs < 0.2)),
        "repeated_windows": _vote(repeat > 0.3, (words >= 10) & (repeat < 0.1)),
        "repeated_lines": _vote(many & (lines > 0.4), many & (lines < 0.2)),
        "variety": _vote((words >= 50) & (kinds < 3 * F.sqrt(words)), (words >= 50) & (kinds > 4 * F.sqrt(words))),
        "digits": _vote(digits > 0.4, some & (digits < 0.2)),
        "size": _vote(words < 10, words >= 40),
        "sentences": _vote((words >= 10) & (ends > 0.6), (words >= 10) & (ends > 0.01) & (ends < 0.3)),
        "word_length": _vote(some & ((length > 15) | (length < 2)), some & (length > 3) & (length < 9)),
    }


RULES = ("symbols", "upper_case", "exclamations", "repeated_windows", "repeated_lines", "variety", "digits", "size", "sentences", "word_length")
#: EM starts from, and is drawn towards, these rates of bad votes: of a rule on its own failure, on
#: another rule's failure, on a good document; and this share of good documents.
PRIOR_OWN, PRIOR_OTHER, PRIOR_FALSE, PRIOR_GOOD_SHARE = 0.95, 0.005, 0.001, 0.5
#: Votes that the rates above count as, for each rule and class.
PSEUDO = 20.0
ROUNDS = 100


def with_votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds COUNTS and `votes`, the votes of RULES as base-3 digits."""
    had = [c for c in docs.columns if c.lower() not in {*COUNTS, "votes"}]
    (stats,) = fresh(docs, "_stats")
    out = docs.withColumn(stats, text_statistics(F.col(text_col))).select(*[F.col(f"`{c}`") for c in had], F.col(f"{stats}.*"))
    code = F.lit(0)
    votes = rules()
    for name in RULES:
        code = code * 3 + votes[name]
    return out.withColumn("votes", code.cast("int"))


def fit_votes(patterns: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote combination (rows of votes 0..2), and P(bad vote | class, rule, a vote)."""
    bad, good = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    asked = np.where(good.any(0), bad + good, 1.0)  # abstaining is missing, but for one-sided rules
    k = patterns.shape[1]
    # the last class is good; bad class j is the failure that rule j looks for
    prior = np.vstack([np.where(np.eye(k, dtype=bool), PRIOR_OWN, PRIOR_OTHER), np.full((1, k), PRIOR_FALSE)])
    rates, shares = prior.copy(), np.append(np.full(k, (1 - PRIOR_GOOD_SHARE) / k), PRIOR_GOOD_SHARE)
    for _ in range(rounds):
        score = bad @ np.log(rates.T) + (asked - bad) @ np.log1p(-rates.T) + np.log(shares)
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
        mass = post * weights[:, None]
        rates = (mass.T @ bad + PSEUDO * prior) / (mass.T @ asked + PSEUDO)
        shares = np.maximum(mass.sum(0) / weights.sum(), 1e-9)
    return post[:, -1], rates


def decide(voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, posterior (of good) and kept to what with_votes() returned."""
    spark = voted.sparkSession
    counted = voted.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rest = voted.drop("base_failed", "posterior", "kept").withColumn("base_failed", base)
    if not counted:
        return rest.withColumns({"posterior": F.lit(None).cast("double"), "kept": F.lit(None).cast("boolean")})
    codes = np.array([r["votes"] for r in counted], np.int64)
    digits = np.stack([codes // 3**i % 3 for i in range(len(RULES) - 1, -1, -1)], 1)
    quality, _ = fit_votes(digits, np.array([r["count"] for r in counted], float))
    table = spark.createDataFrame([(int(c), float(q)) for c, q in zip(codes, quality, strict=True)], "votes int, posterior double")
    judged = rest.join(F.broadcast(table), "votes", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def quality_rules(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with COUNTS, votes, base_failed, posterior and kept; texts are scanned once."""
    return decide(written(with_votes(docs, text_col), "quality-votes"), threshold)
