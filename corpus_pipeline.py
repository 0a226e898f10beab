"""A training corpus from documents: rules, near copies, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import jaccard_join, mixing, pieces, quality_rules, secret_scan
from lotwise.llm.common import written
from lotwise.llm.queries import PIECE_MODEL, table

#: The scarcest source passes at most so often while the most plentiful one passes once; no document is lost.
REPEATS = 1.5
#: Distinct segmentations of each document: the first is its pieces, the others go beside it.
SAMPLES = 3
#: Bytes of rows that pass between Spark and Python at a time; by default 64 MB of them lie in the executor and in each of its workers.
BATCH_BYTES = 4 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, for the plans of a stage that runs Python, whenever they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    small_batches(spark)
    return jaccard_join.without_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out; n_chars follows the text."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and ordered as the temperature mixture asks."""
    return mixing.arranged(docs, repeats=REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document's best sampled segmentation and of the others, with their scores, and whether the best ones decode to the text."""
    small_batches(spark)
    out = pieces.sampled(docs.select("doc_id", "source", "text"), PIECE_MODEL, k=SAMPLES, decode=True).select("*", F.col("samples")[0].alias("best"))
    return out.select("doc_id", "source", F.col("best.ids").alias("ids"), F.size("best.ids").alias("n_pieces"), F.col("best.logp").alias("logp"), F.col("best.log_inclusion").alias("log_inclusion"), F.slice("samples", 2, SAMPLES).alias("others"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality_rules", rules), ("jaccard_join", near_copies), ("secret_scan", secrets), ("source_mixing", mixture), ("sentencepiece", tokens)]
#: Expectation maximisation, hashing and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
