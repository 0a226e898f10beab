"""The operators applied to the driver's tables, and SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard_join, language, merkle, mixing, personal_data, pieces, quality_rules, secret_scan, site_quality, url_filter, webp, whitening
from .common import written


#: A public vocabulary file; the path is a parameter of the operators.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Verdict, host, path of the explicit URL rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: Entropy of the mixture's sources, as a share of the highest one.
SOURCE_ENTROPY = 0.9998
#: Rows of the mixture's blocks: small ones, so that a pass shuffles several of each source.
MIXING_BLOCK = 32
#: A page's address ends in the number of its document.
DOCUMENT_NUMBER = "try_cast(regexp_extract(url, '/([0-9]+)[^/0-9]*/?(?:[?#].*)?$', 1) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = written(quality_rules.with_votes(docs).drop("text"), "quality-votes")
    out = quality_rules.decide(voted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a document's label is its page's
    number = F.expr(DOCUMENT_NUMBER)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    out = url_filter.url_filter(pages, URL_RULES, labelled)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.sampled(docs, PIECE_MODEL, k=3, decode=True)
    each = lambda f: F.transform("samples", f)
    return out.select(
        "doc_id", F.size("samples").alias("n_samples"), each(lambda x: F.size(x["ids"])).alias("n_pieces"), each(lambda x: F.xxhash64(x["ids"])).alias("ids_hash"),
        each(lambda x: x["logp"]).alias("logp"), each(lambda x: x["score"]).alias("score"), each(lambda x: x["log_inclusion"]).alias("log_inclusion"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = webp.media_column(docs, F.col("text")).withColumn("read", webp.read_back("media"))
    return media.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "read.*")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), entropy=SOURCE_ENTROPY, block_rows=MIXING_BLOCK, every=True)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(F.expr(DOCUMENT_NUMBER).alias("doc_id"), url_filter.host_of(url).alias("site"), F.regexp_extract(url_filter.path_of(url), "^/([^/]*)/", 1).alias("path"))
    return site_quality.site_quality(docs, table(spark, sf_dir, "labels"), places=pages)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang"))


#: A conversation that consists of control strings.
PLANTED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_TURNS, turns.schema)
    return chat.digests(written(chat.segment_windows(turns.unionByName(planted)), "chat-windows"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    # deleting line breaks stands for tampering, in rows whose number has an even checksum
    even = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    changed = F.when(even, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    out = merkle.manifest(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), changed.alias("changed")))
    out = out.withColumn("folded_root", merkle.folded(F.col("changed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(*whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
