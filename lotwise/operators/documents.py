"""Documents of a tender: availability, combined text within budgets, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FLAGS, first_defined
from ..shared import small_side, written
from .scan import prefix_scan

EMPTY_FILE = FLAGS + r"пуст(?:ой|ые|ого)|empty\s+file|zero[- ]byte"


#: The sentences of a note on documents; what stands between two parts is counted or listed.
NOTE_NOTHING = ("Seldon выдал ссылки на ", " документ(ов), но пригодный текст документации не получен.")
NOTE_EMPTY, NOTE_FAILED, NOTE_UNREAD, NOTE_END = "Пустые файлы: ", "Не удалось скачать или обработать: ", "Файлы без пригодного текста: ", "."


def availability(requested: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """requested, parsed, names by fate, status and note of each tender's documents.

    requested: keys and n_requested; parsed: keys, document_index, file_name, text_ok, status, warning, error.
    """
    failed = (F.col("status") == "error") | F.coalesce(F.length("error") > 0, F.lit(False))
    said = F.coalesce(F.nullif("error", F.lit("")), F.nullif("warning", F.lit("")), F.lit(""))
    rows = parsed.withColumns({"_failed": F.coalesce(failed, F.lit(False)), "_empty": F.coalesce(failed, F.lit(False)) & said.rlike(EMPTY_FILE), "_said": F.coalesce(F.nullif(said, F.lit("")), F.col("status"))})
    ok = F.coalesce(F.col("text_ok"), F.lit(False))
    names = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("document_index", value.alias("x"))))), lambda s: s["x"])
    sums = rows.groupBy(*keys).agg(
        F.count_if(ok).alias("documents_parsed"), F.count_if(F.col("_failed")).alias("documents_failed"),
        names(F.col("_empty"), F.col("file_name")).alias("empty_files"),
        names(F.col("_failed") & ~F.col("_empty"), F.concat(F.col("file_name"), F.lit(" — "), F.substring("_said", 1, 500))).alias("failed_files"),
        names(~ok & ~F.col("_failed"), F.col("file_name")).alias("files_without_text"),
    )
    none = F.expr("cast(array() as array<string>)")
    out = requested.join(sums, keys, "left").fillna(0, ["documents_parsed", "documents_failed"]).withColumns({c: F.coalesce(c, none) for c in ("empty_files", "failed_files", "files_without_text")})
    asked = F.coalesce(F.col("n_requested"), F.lit(0)) > 0
    unavailable = asked & (F.col("documents_parsed") == 0)
    status = F.when(~asked, "seldon_returned_no_documents").when(unavailable, "unavailable").when((F.col("documents_failed") > 0) | (F.size("files_without_text") > 0), "partial").otherwise("available")
    listed = lambda c, sep: F.array_join(F.slice(c, 1, 20), sep)
    note = F.concat_ws(
        " ",
        F.when(unavailable, F.concat(F.lit(NOTE_NOTHING[0]), F.col("n_requested").cast("string"), F.lit(NOTE_NOTHING[1]))),
        F.when(asked & (F.size("empty_files") > 0), F.concat(F.lit(NOTE_EMPTY), listed("empty_files", ", "), F.lit(NOTE_END))),
        F.when(asked & (F.size("failed_files") > 0), F.concat(F.lit(NOTE_FAILED), listed("failed_files", "; "), F.lit(NOTE_END))),
        F.when(asked & (F.size("files_without_text") > 0), F.concat(F.lit(NOTE_UNREAD), listed("files_without_text", ", "), F.lit(NOTE_END))),
    )
    return out.withColumns({"processing_status": status, "documentation_unavailable": unavailable, "documentation_note": F.substring(note, 1, 3000)})


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Adds used (characters before the row) and clips the text where the running total passes the budget.

    keys and order name a row. The running totals are a prefix scan over lengths; texts are joined to them, by broadcast
    within its bounds, and never enter it.
    """
    sizes = df.select(*keys, *order, F.length(text).cast("long").alias("_n"))
    used = prefix_scan(sizes, keys, list(order), {"used": ("before", F.col("_n"))}).drop("_n").withColumnsRenamed({c: f"_{c}" for c in (*keys, *order)})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, *order)]
    out = df.drop("used").join(small_side(written(used, "budget")), same).drop(*[f"_{c}" for c in (*keys, *order)])
    return out.withColumn("clipped", F.substring(F.col(text), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - F.col("used")).cast("int")))


def combined_text(pages: DataFrame, parsed: DataFrame, keys: list[str], limit: int = 500_000) -> DataFrame:
    """Page text and documents in order as one text of at most `limit` characters, and whether it was cut."""
    section = F.concat(
        F.lit("\n--- ДОКУМЕНТ "), F.col("document_index").cast("string"), F.lit(" ---\nfileName: "), F.coalesce("file_name", F.lit("")), F.lit("\nparserStatus: "), F.coalesce("status", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))
    )
    docs = parsed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("document_index", section.alias("s")))).alias("_docs"))
    full = F.concat_ws("\n", F.lit("--- ТЕКСТ СТРАНИЦЫ ТЕНДЕРА / ДОКУМЕНТОВ ---"), F.trim("page_text"), F.array_join(F.transform("_docs", lambda d: d["s"]), "\n"))
    out = pages.join(docs, keys, "left").withColumn("_full", full)
    return out.withColumns({"combined_text": F.substring("_full", 1, limit), "was_cut": F.length("_full") > limit}).drop("_docs", "_full")


def page_text(purchase: Column, names: tuple[str, ...] = ("subject", "notificationNumber", "epName", "purchasePrice", "startDate", "endDate")) -> Column:
    """What a structured purchase says, a line for each member."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.get_json_object(purchase, f"$.{n}")) for n in names])


#: Headings and labels of the page text, and the members of a purchase that each label takes, the first defined one.
PAGE_HEADINGS = ("--- ДАННЫЕ ЗАКУПКИ ИЗ SELDON API ---", "--- ПОЛНЫЕ СТРУКТУРИРОВАННЫЕ ДАННЫЕ SELDON ---", "--- АКТУАЛЬНЫЕ ДОКУМЕНТЫ SELDON ---")
PAGE_NUMBER = ("etpId", "EtpId", "notificationNumber", "purchaseNumber", "number")
PAGE_MEMBERS = (
    ("Предмет закупки", ("subject", "purchaseSubject", "name", "purchaseName", "description")),
    ("Начальная цена / НМЦ", ("price", "purchasePrice", "initialPrice", "maxPrice", "nmck")),
    ("Дата публикации", ("publishDate", "firstPublishDate", "datePublish")),
    ("Дата начала подачи", ("dateStart", "startDate", "submissionStartDate")),
    ("Дата окончания подачи", ("dateEnd", "endDate", "submissionDeadline")),
)


def full_page_text(tenders: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `page_text`: the purchase's data by label, the whole purchase as JSON, and its documents' data as a JSON list.

    tenders: keys, seldon_id, report_id, etp_id, tender_url, purchase (JSON text); documents: keys, index and whatever is to be listed.
    """
    listed = [c for c in documents.columns if c not in (*keys, "index")]
    files = documents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", F.struct(*listed).alias("d")))).alias("_files"))
    get = lambda names: first_defined(*[F.get_json_object("purchase", f"$.{n}") for n in names])
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))
    own = [line("Seldon ID", F.col("seldon_id")), line("Report ID", F.col("report_id")), line("Номер закупки на площадке", F.coalesce(get(PAGE_NUMBER), F.col("etp_id")))]
    own += [line(label, get(names)) for label, names in PAGE_MEMBERS] + [line("Ссылка на источник", F.col("tender_url"))]
    data = F.coalesce(F.to_json(F.transform("_files", lambda f: f["d"]), {"ignoreNullFields": "false"}), F.lit("[]"))
    heads = [F.lit(h) for h in PAGE_HEADINGS]
    text = F.concat_ws("\n", heads[0], *own, F.lit(""), heads[1], F.coalesce("purchase", F.lit("{}")), F.lit(""), heads[2], data)
    return tenders.join(files, keys, "left").withColumn("page_text", text).drop("_files")


def digest(text: Column) -> Column:
    """Hash and length under which equal contents are one."""
    return F.struct(F.md5(text).alias("md5"), F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("chars"))


def equal_contents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """md5, n and the first id of contents that several documents have."""
    own = docs.select(F.col(id_col), digest(F.col(text))["md5"].alias("md5"))
    return own.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias(f"first_{id_col}")).where("n > 1")


#: Shortest text that counts as one, and the shortest that is still worth a mention.
TEXT_LENGTH, SHORT_LENGTH = 500, 100


def text_status(text: Column) -> Column:
    """ok, short or unusable: by length and whether it has letters or digits."""
    n = F.length(text)
    return F.when((n >= TEXT_LENGTH) & text.rlike(r"[\p{L}\p{N}]"), "ok").when(n >= SHORT_LENGTH, "short").otherwise("unusable")


def first_documents(df: DataFrame, keys: list[str], order: str, most: int = 100) -> DataFrame:
    """The first documents of each tender: the limit is part of the contract."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_rn") <= most).drop("_rn")
