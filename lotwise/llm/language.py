"""Language identification by fusing text, markup, address and host evidence.

Text: byte trigrams hashed into a fixed number of bins; each language's bin counts are
summed over all labelled documents, and the model holds the bins that occur. A label is a language if it starts with
a code of two or three letters (the rest of en-US is left away), which bounds the languages by LANGUAGES. Overlapping
trigrams are not independent, so a text's log likelihood counts as that of their number to the power TEMPER. Markup: the lang attribute of the page. Address: a language
code as top-level domain or as first path segment. Host: the languages that the other evidence
gives the host's other pages (a page's own evidence is left out), shrunk towards those of its domain, and
these towards all pages', by grouped aggregation. The parts add up as log odds; the posterior is normalised.

Defined results: a null or empty page has no text evidence and falls back on address, host
and global priors; repeated rows are judged alike; an empty table stays empty; without
labelled documents there is no result language (null); clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, small_side, written
from .textstats import _UPPER, passes

BINS = 8192
#: Codes of two and three letters: more languages than these a model cannot have.
LANGUAGES = 26**2 + 26**3
CODE = "^([A-Za-z]{2,3})(?:[-_].*)?$"
TEMPER = 0.75
#: How often markup and address tell the truth where they speak.
MARKUP_RIGHT, ADDRESS_RIGHT = 0.9, 0.85
HOST_STRENGTH, DOMAIN_STRENGTH = 10.0, 50.0
#: Distinct bins of documents that a step looks up at once.
SEEN = 200_000
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])


def trigram_bins(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and document of each byte trigram inside a document; A-Z count as a-z."""
    low = np.where(_UPPER[data], data + np.uint8(32), data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)
    doc = np.searchsorted(at, np.arange(len(code)), "right") - 1
    inside = np.arange(2, len(low)) < at[doc + 1]
    return bins[inside], doc[inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes, kinds = np.asarray(names.indices), names.dictionary.to_pylist()
        total = np.zeros(len(kinds) * BINS, np.int64)
        for row, n, data, at in passes(batch.column(1)):
            bins, doc = trigram_bins(data, at)
            total += np.bincount(codes[row : row + n][doc] * BINS + bins, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([kinds[i] for i in some // BINS], pa.string()), pa.array(some % BINS, pa.int32()), pa.array(total[some])], names=["lang", "bin", "n"])


class Model(NamedTuple):
    """log probability of a bin that a language lacks, and by bin (start to start of the next) the languages that have it and what it adds."""

    languages: list[str]
    absent: np.ndarray
    start: np.ndarray
    owner: np.ndarray
    more: np.ndarray


def trigram_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Smoothed log probabilities of the bins over all documents with a language."""
    code = F.lower(F.regexp_extract(F.trim(lang_col), CODE, 1))
    rows = docs.select(code.alias("lang"), F.col(text_col).alias("text")).where(F.col("lang") != "")
    summed = rows.mapInArrow(_counts, _COUNTS).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # a row for each language and bin that occurs; both are bounded
    langs = sorted({*got["lang"], *(r["lang"] for r in rows.select("lang").distinct().collect())})
    owner, bins, n = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["bin"].to_numpy(int), got["n"].to_numpy(float)
    total = np.bincount(owner, weights=n, minlength=len(langs)) + 0.5 * BINS
    order = np.lexsort((owner, bins))
    start = np.searchsorted(bins[order], np.arange(BINS + 1))
    return Model(langs, np.log(0.5 / total), start, owner[order].astype(np.int32), np.log((n[order] + 0.5) / 0.5))


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags; one that is not closed reaches to the page's end, so no page is scanned twice."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)", " "), r"<[^<>]*+>", " ")


def likelihoods(model):
    """A column function from texts to tempered log likelihoods of the model's languages."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array) -> pa.Array:
        _, absent, start, owner, more = model.value
        size, out = len(absent), []
        for _, n, data, at in passes(texts):
            bins, doc = trigram_bins(data, at)
            count = np.bincount(doc, minlength=n)
            # each document's distinct bins, and the languages that have them
            seen, times = np.unique(doc * BINS + bins, return_counts=True)
            ll = count[:, None] * absent
            for first in range(0, len(seen), SEEN):
                own_doc, own_bin, own_times = *np.divmod(seen[first : first + SEEN], BINS), times[first : first + SEEN]
                widths = start[own_bin + 1] - start[own_bin]
                entry = np.repeat(start[own_bin] - np.concatenate([[0], np.cumsum(widths)[:-1]]), widths) + np.arange(widths.sum())
                ll += np.bincount(np.repeat(own_doc, widths) * size + owner[entry], weights=np.repeat(own_times, widths) * more[entry], minlength=n * size).reshape(n, size)
            out.append(ll / np.maximum(count, 1)[:, None] * (count**TEMPER)[:, None])
        flat = np.concatenate(out) if out else np.zeros((0, size))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * size, pa.int32()), pa.array(flat.ravel(), pa.float64()))

    return score


def _said(code: Column, langs: list[str], right: float) -> Column:
    """Log likelihoods of a language code where it names one of the languages, else none."""
    wrong, listed = (1 - right) / max(1, len(langs) - 1), F.lit(langs)
    known = F.array_contains(listed, code)
    return F.when(known, F.transform(listed, lambda x: F.when(x == code, float(np.log(right))).otherwise(float(np.log(wrong))))).otherwise(F.transform(listed, lambda x: F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _softmax(scores: Column) -> Column:
    powered = let(scores, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(powered, lambda e: let(_total(e), lambda mass: F.transform(e, lambda x: x / mass)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def host_prior(own: Column, of_host: Column, of_domain: Column, shares: Column) -> Column:
    """Log probabilities of the languages on a page's host, from all pages but this one, whose evidence is own."""
    less = lambda sums: F.zip_with(sums, own, lambda s, p: F.greatest(s - p, F.lit(0.0)))
    mixed = lambda sums, towards, strength: let(sums, lambda own: let(_total(own) + strength, lambda all: F.zip_with(own, towards, lambda s, t: (s + strength * t) / all)))
    return F.transform(mixed(less(of_host), mixed(less(of_domain), shares, DOMAIN_STRENGTH), HOST_STRENGTH), lambda p: F.log(p))


def languages(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row id, host, declared, addressed, lang, probability, text_lang for each page."""
    from .url_filter import host_of, path_of

    trigrams = trigram_model(labelled, text_col, lang_col)
    langs = trigrams.languages
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), declared.alias("declared"), visible_text(F.col(html_col)).alias("_text"))
    code, ending = F.lower(F.regexp_extract("path", r"^/([A-Za-z]{2})(?:[/_-]|$)", 1)), F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    if not langs:
        return rows.select(id_col, "host", "declared", F.lit("").alias("addressed"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    model = pages.sparkSession.sparkContext.broadcast(trigrams)
    likelihood = likelihoods(model)
    is_one = lambda c: F.array_contains(F.lit(langs), c)
    addressed = F.when(is_one(code), code).when(is_one(ending), ending).otherwise("")
    seen = written(rows.select(id_col, "host", "declared", addressed.alias("addressed"), likelihood("_text").alias("text")), "lang-evidence")
    domain = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    said = _plus(F.col("text"), _plus(_said(F.col("declared"), langs, MARKUP_RIGHT), _said(F.col("addressed"), langs, ADDRESS_RIGHT)))
    scored = seen.withColumns({"own": said, "domain": domain})
    soft = scored.select("host", "domain", F.posexplode(_softmax(F.col("own"))).alias("i", "p"))
    by_host = written(soft.groupBy("domain", "host", "i").agg(F.sum("p").alias("n")), "lang-hosts")
    by_domain = by_host.groupBy("domain", "i").agg(F.sum("n").alias("dn"))
    whole = {r["i"]: r["n"] for r in by_host.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    everything = sum(whole.values()) or 1.0
    shares = F.lit([(whole.get(i, 0.0) + 0.5) / (everything + 0.5 * len(langs)) for i in range(len(langs))])
    listed = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))), lambda x: x["v"])
    # a row for each host: the sums of its pages and of its domain's, by language (a list for each of them)
    domains = by_domain.groupBy("domain").agg(listed("dn").alias("of_domain"))
    hosts = by_host.groupBy("domain", "host").agg(listed("n").alias("of_host")).join(domains, "domain").select(F.col("host").alias("_host"), "of_host", "of_domain")
    hosts = small_side(written(hosts, "lang-priors"))
    final = scored.join(hosts, F.col("host") == F.col("_host"), "left").withColumn("soft", _softmax(F.col("own")))
    final = final.withColumn("prior", host_prior(F.col("soft"), F.col("of_host"), F.col("of_domain"), shares)).withColumn("posterior", _softmax(_plus(F.col("own"), F.col("prior"))))
    best = lambda scores: F.element_at(F.lit(langs), F.array_position(scores, F.array_max(scores)).cast("int"))
    return final.select(
        id_col, "host", "declared", "addressed", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("text")).alias("text_lang")
    )
