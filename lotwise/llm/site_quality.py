"""Quality classifier with hierarchical empirical Bayes over sites and paths.

A logistic model over text statistics is fitted on a bounded sample of labelled rows. The labels
of all labelled documents, and its probabilities for the others, are averaged by site and by path (grouped
aggregation); sparse sites shrink towards the global mean and paths towards their
site, with strengths that the method of moments takes from the spread between groups. A
document's prior is what the other documents of its path and site give (its own label and
probability are left out), and its final odds are its own likelihood ratio times its prior odds.
A document's site and path are those that `places` (say, the hosts and paths of its pages) names for it, the
smallest of several; a document without a place has the columns site_col and path_col instead.

Defined results: null and empty texts have zero statistics and are judged as such; a null
site or path is a group of its own; repeated rows are judged alike; an empty table stays
empty; without labels of both kinds the text evidence is neutral; clashing columns are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written
from .quality_rules import text_statistics

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
#: Bounds of a shrinkage strength, in documents.
STRENGTHS = (1.0, 10_000.0)
FEATURES = ("log_words", "symbols", "upper", "exclamations", "repeated", "same_lines", "variety", "ends", "word_length", "digits")


def features(stats: str) -> list[Column]:
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    words, letters = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("n_upper") + s("n_lower") + s("n_wide"), F.lit(1.0))
    within = lambda x, top: F.least(x, F.lit(top))
    return [
        F.log1p(s("n_words")) / 10, within(s("n_symbols") / words, 1.0), s("n_upper") / letters, within(s("n_bang") / words, 1.0),
        s("n_repeat_words") / words, s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1.0)), within(s("n_distinct") / F.sqrt(words) / 20, 2.0),
        within(s("n_end") / words, 1.0), within(s("word_chars") / words / 20, 1.0), s("n_digit") / F.greatest(s("word_chars"), F.lit(1.0)),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 0.0) * max(1, len(y)) / 1000
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights, and the logit of the good share in the sample; neutral without both kinds of labels."""
    chosen = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), "quality").orderBy(F.xxhash64("_id"), "quality").limit(sample)
    chosen = written(chosen, "site-sample")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")  # at most `sample` rows
    # repeated rows and labels are one each, so the table holds at most `sample` rows (or as many texts as share these ids)
    stats = rows.select("_id", "quality", text_statistics("_t").alias("s")).select("_id", "quality", F.array(*features("s")).alias("x")).groupBy("_id", "x").agg(F.max("quality").alias("quality"))
    got = stats.groupBy("_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("r.*").orderBy("quality", "x").toPandas()
    if got["quality"].nunique() < 2:
        return np.zeros(len(FEATURES) + 1), 0.0
    y = got["quality"].to_numpy(float)
    return fit(np.stack(got["x"].to_numpy()), y), float(np.log(y.mean() / (1 - y.mean())))


def strength(mean: float, between: float, within: float) -> float:
    """Prior documents of a beta prior whose variance is what is left of the spread between groups."""
    spread = max(between - within, 1e-9)
    return float(np.clip(mean * (1 - mean) / spread - 1, *STRENGTHS))


def shrunk(scored: DataFrame) -> DataFrame:
    """site, path, prior: posterior mean of good, from site, path and p of all documents."""
    paths = written(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "site-paths")
    sites = written(paths.groupBy("site").agg(F.sum("n").alias("sn"), F.sum("good").alias("sgood")), "site-sites")
    whole = sites.agg(F.sum("sn").alias("n"), F.sum("sgood").alias("g"), F.avg(F.pow(F.col("sgood") / F.col("sn"), 2)).alias("m2"), F.avg(F.col("sgood") / F.col("sn")).alias("m1"), F.avg(1 / F.col("sn")).alias("inv")).first()
    if not whole["n"]:
        return paths.select(F.col("site").alias("_site"), F.col("path").alias("_path"), F.lit(0.5).alias("prior"), *[F.lit(1.0).alias(c) for c in ("n", "good", "sn", "sgood", "k_site", "k_path", "mean")])
    mean = min(max(whole["g"] / whole["n"], 1e-6), 1 - 1e-6)
    k_site = strength(mean, whole["m2"] - whole["m1"] ** 2, mean * (1 - mean) * whole["inv"])
    both = paths.join(sites, paths["site"].eqNullSafe(sites["site"])).drop(sites["site"])
    site_mean = (F.col("sgood") + k_site * mean) / (F.col("sn") + k_site)
    both = both.withColumn("site_mean", site_mean)
    gaps = both.agg(F.avg(F.pow(F.col("good") / F.col("n") - F.col("site_mean"), 2)).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    k_path = strength(mean, gaps["v"], mean * (1 - mean) * gaps["inv"])
    counts = [F.col(c).cast("double").alias(c) for c in ("n", "good", "sn", "sgood")] + [F.lit(x).alias(c) for c, x in (("k_site", k_site), ("k_path", k_path), ("mean", mean))]
    return both.select(F.col("site").alias("_site"), F.col("path").alias("_path"), ((F.col("good") + k_path * F.col("site_mean")) / (F.col("n") + k_path)).alias("prior"), *counts)


def others_prior(own: Column) -> Column:
    """A path's prior from all documents but one, whose good share is own."""
    c = F.col
    site = (F.greatest(c("sgood") - own, F.lit(0.0)) + c("k_site") * c("mean")) / (F.greatest(c("sn") - 1, F.lit(0.0)) + c("k_site"))
    return (F.greatest(c("good") - own, F.lit(0.0)) + c("k_path") * site) / (F.greatest(c("n") - 1, F.lit(0.0)) + c("k_path"))


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", threshold: float = 0.5, sample: int = SAMPLE, places: DataFrame | None = None) -> DataFrame:
    """One row id, site, path, evidence (logit), prior, quality, kept for each row of docs. places: id, site, path."""
    weights, base = fitted(docs, labels, id_col, text_col, sample)
    stats = docs.select(F.col(id_col).alias(id_col), F.col(site_col).alias("site"), F.col(path_col).alias("path"), text_statistics(F.col(text_col)).alias("_s"))
    logit = F.lit(float(weights[-1]))
    for w, x in zip(weights[:-1], features("_s"), strict=True):
        logit = logit + F.lit(float(w)) * x
    logit = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit))
    scored = written(stats.select(F.col(id_col).alias("_id"), "site", "path", logit.alias("logit")), "site-scores")
    # all labels count (several of one id by their mean); ids, not texts, meet labels and places
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.avg("quality").alias("label"))
    rows = scored.join(small_side(written(known, "site-labels")), F.col("_id") == F.col("_of"), "left").drop("_of")
    if places is not None:
        place = places.where(F.col("site") != "").groupBy(F.col(id_col).alias("_of")).agg(F.min(F.struct("site", "path")).alias("_place"))
        rows = rows.join(small_side(written(place, "site-places")), F.col("_id") == F.col("_of"), "left").drop("_of")
        named = F.col("_place").isNotNull()
        rows = rows.withColumns({"site": F.when(named, F.col("_place.site")).otherwise(F.col("site")), "path": F.when(named, F.col("_place.path")).otherwise(F.col("path"))}).drop("_place")
    rows = written(rows.withColumn("p", F.coalesce("label", 1 / (1 + F.exp(-F.col("logit"))))).withColumnRenamed("_id", id_col), "site-rows")
    priors = small_side(written(shrunk(rows).drop("prior"), "site-priors"))
    out = rows.join(priors, F.col("site").eqNullSafe(F.col("_site")) & F.col("path").eqNullSafe(F.col("_path")), "left").withColumn("prior", others_prior(F.col("p")))
    evidence = F.col("logit") - F.lit(base)
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior")))
    quality = 1 / (1 + F.exp(-(evidence + F.log(prior / (1 - prior)))))
    return out.select(id_col, "site", "path", evidence.alias("evidence"), "prior", quality.alias("quality"), (quality >= threshold).alias("kept"))
