"""Landed feeds: purchase documents and the dispatcher's three delimited files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_defined, string_or_none


def purchase_documents(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Current documents of purchase responses (JSON text), numbered per key; retracted ones and those without an address are left out."""
    get = lambda c, path: F.get_json_object(c, path)
    groups = first_defined(*[get(F.col(body), f"$.result.{n}") for n in ("purchasesdocuments", "purchaseDocuments", "documentsByPurchase")])
    loose = get(F.col(body), "$.result.documents")
    as_list = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.array(x))
    boxes = F.coalesce(as_list(groups), F.when(loose.isNotNull(), F.array(F.concat(F.lit('{"documents":'), loose, F.lit("}")))))
    rows = responses.select(*keys, F.posexplode(boxes).alias("group_no", "box"))
    rows = rows.select(*keys, "group_no", F.posexplode(as_list(get(F.col("box"), "$.documents"))).alias("doc_no", "d")).where(F.col("d").startswith("{"))
    one = lambda *names: first_defined(*[string_or_none(get(F.col("d"), f"$.{n}")) for n in names])
    out = rows.select(
        *keys, "group_no", "doc_no", one("Version", "version").alias("version"), one("id", "Id", "documentId").alias("id"), one("urlSeldon").alias("url_primary"), one("urlSource").alias("url_source"),
        one("url", "downloadUrl").alias("_other"), F.regexp_replace(F.lower(F.coalesce(one("fileType", "extension", "ext"), F.lit(""))), r"^\.+", "").alias("file_type"),
        one("name", "fileName", "filename", "title").alias("_name"), one("fileSize", "size").alias("file_size"), get(F.col("d"), "$.publishDate").alias("publish_date"),
    )
    out = out.withColumn("url", F.coalesce("url_primary", "url_source", "_other")).where(~F.coalesce(F.col("version").isin("false", "0"), F.lit(False)) & F.col("url").isNotNull())
    out = out.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("group_no", "doc_no")))
    name = F.coalesce("_name", F.concat(F.lit("seldon_document_"), F.col("index").cast("string")))
    named = F.when((F.col("file_type") != "") & ~F.lower(name).endswith(F.concat(F.lit("."), F.col("file_type"))), F.concat(name, F.lit("."), F.col("file_type"))).otherwise(name)
    source = F.when(F.col("url_primary").isNotNull(), "seldon").when(F.col("url_source").isNotNull(), "source").otherwise("other")
    return out.withColumns({"file_name": named, "source": source}).drop("_other", "_name", "group_no", "doc_no")


def daily_files(spark: SparkSession, paths: dict[int, str], aliases: dict[str, str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Delimited files by report type as one table; headers are renamed by aliases, missing columns are null."""
    frames = []
    for report, path in paths.items():
        own = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True).csv(path)
        frames.append(own.withColumnsRenamed(aliases).withColumn("report_id", F.lit(report)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
