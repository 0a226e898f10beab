"""Catalogue matching: candidates from open documents, top-k by cosine, prices of the same product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numbers import parse_money
from ..functions.text import available, catalog_id, currency, first_defined_with_path, string_or_none

#: Spellings of each field, in the order in which they count.
NAMES = {
    "product_id": ("productId", "product_id", "id", "article", "Артикул"),
    "url": ("url", "link", "Ссылка"),
    "price": ("unitPriceRub", "priceRub", "price", "medianPrice", "Медианная цена", "Цена"),
    "currency": ("currencyId", "currency", "currency_id", "Валюта"),
    "name": ("name", "Наименование", "pageContent", "content"),
    "manufacturer": ("vendor", "manufacturer", "Производитель", "brand"),
    "vendor_code": ("vendorCode", "vendor_code", "Код производителя"),
    "available": ("available", "inStock", "in_stock"),
}


def _of(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$['{name}']")


def candidates(points: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue points (keys, pos, id, score, payload as JSON text) as candidates; the first of each point id stays."""
    inner = F.get_json_object("payload", "$.text")
    document = F.when(F.try_parse_json(inner).isNotNull() & inner.startswith("{"), inner).otherwise(F.col("payload"))
    out = points.withColumn("_doc", document)
    out = out.withColumns({"_meta": F.get_json_object("_doc", "$.metadata"), "_nested": F.get_json_object("_doc", "$.payload")})
    sources = (("payload.metadata", "_meta"), ("payload", "_doc"), ("payload.payload", "_nested"))
    found = {k: first_defined_with_path([(f"{path}.{n}", _of(F.col(c), n)) for path, c in sources for n in names]) for k, names in NAMES.items()}
    out = out.withColumns({f"_{k}": v for k, v in found.items()})
    product = F.coalesce(string_or_none(F.col("_product_id.value")), catalog_id(F.col("_url.value")))
    point = F.coalesce(string_or_none(F.col("id")), string_or_none(_of(F.col("_doc"), "id")), product)
    price = parse_money(F.col("_price.value"))
    out = out.select(
        *keys, "pos", point.alias("point_id"), F.coalesce(product, point).alias("product_id"), F.coalesce(F.trim("_name.value"), F.lit("")).alias("name"),
        F.coalesce(F.trim("_manufacturer.value"), F.lit("")).alias("manufacturer"), F.coalesce(F.trim("_vendor_code.value"), F.lit("")).alias("vendor_code"), F.coalesce(F.trim("_url.value"), F.lit("")).alias("url"),
        price.alias("unit_price"), F.coalesce(currency(F.col("_currency.value")), F.when(price.isNotNull(), "RUB")).alias("currency"), F.when(price.isNotNull(), F.col("_price.path")).otherwise("").alias("price_field"),
        available(F.col("_available.value")).alias("available"), "score",
    ).where(F.col("point_id").isNotNull())
    return first_by(out, [*keys, "point_id"], [F.col("pos")])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order: a deduplication that does not depend on how rows lie."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Bytes of a block of queries, and of the vectors that a block of queries is sent to at a time; pairs that a block of queries keeps.
BLOCK_BYTES, BROADCAST_BYTES, KEPT = 4 * 2**20, 8 * 2**20, 2**18
#: Numbers of a matrix of scores, pairs that are sorted at a time, and pairs whose entries fit a core's cache.
CELLS, PAIRS, NEAR = 2**21, 2**17, 2**11
#: What two ways of adding up a cosine may differ by, and the norms within which a matrix product is trusted that far.
SLACK, LEAST_NORM, MOST_NORM = 1e-8, 1e-100, 1e100


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows and the matrix of the vectors that have it; those that are null or hold nulls are in none."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    gone = np.concatenate([[0], np.cumsum(~np.asarray(values.is_valid()))])
    whole = (size >= 0) & (gone[bounds[1:]] == gone[bounds[:-1]])
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = {n: np.flatnonzero(whole & (size == n)) for n in np.unique(size[whole]).tolist()}
    return {n: (at, numbers[bounds[at][:, None] + np.arange(n)]) for n, at in rows.items()}


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of one matrix and j of another, added up in the order of the entries."""
    out = np.zeros(len(i))
    for c in range(0, len(i), NEAR):
        own, x, y = out[c : c + NEAR], a[i[c : c + NEAR]], b[j[c : c + NEAR]]
        for n in range(a.shape[1]):
            own += x[:, n] * y[:, n]
    return out


def _leading(found: np.ndarray, place: np.ndarray, k: int, slack: float) -> np.ndarray:
    """found (query, vector, score, kind) without what cannot be among a query's k best, sorted; kind: 0 not a number, 1 a number, 2 null."""
    query, vector, score, kind = found
    order = np.lexsort((place[vector.astype(np.int64)], -score, kind, query))
    query, vector, score, kind = found = found[:, order]
    n = np.arange(len(query))
    first = np.searchsorted(query, query)
    last = np.minimum(first + k, np.searchsorted(query, query, "right")) - 1
    fresh = np.ones(len(query), bool)
    fresh[1:] = (np.diff(query) != 0) | (np.diff(kind) != 0) | (score[1:] != score[:-1])
    equal = n - np.maximum.accumulate(np.where(fresh, n, 0))  # of equal scores the k smallest numbers are enough
    near = (n - first < k) | ((kind == kind[last]) & (score >= score[last] - slack))
    return found[:, near & (equal < k)]


def _nearest(queries: pa.Table, vectors: pa.Table, k: int, slack: float) -> pa.Table:
    """The pairs of a block of queries and one of vectors that may be among the k best once scores are rounded.

    A matrix product sorts out most pairs; the others' scores are added up in the order of the entries.
    """
    place = pc.rank(vectors.column(1).combine_chunks(), "ascending", null_placement="at_start", tiebreaker="first").to_numpy(zero_copy_only=False)
    sides, others = _by_length(queries.column("_v")), _by_length(vectors.column("_w"))
    kept, unmet = [], np.argsort(place)
    add = lambda own, some: _leading(np.concatenate([own, some], axis=1), place, k, slack) if some.shape[1] else own
    norms = lambda x: np.sqrt(_dots(x, x, np.arange(len(x)), np.arange(len(x))))

    def scored(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        over = qn[i] * wn[j]
        score = np.where(over != 0, _dots(q, w, i, j) / over, 0.0)
        kind = np.where(over == 0, 2, np.where(np.isnan(score), 0, 1))
        return np.array([at[i], rows[j], np.where(kind == 1, score, 0.0), kind], np.float64)

    met = np.zeros(len(queries), bool)
    with np.errstate(all="ignore"):
        for n, (at, q) in sides.items():
            rows, w = others.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
            qn, wn = norms(q), norms(w)
            fair, fair_w = (qn > LEAST_NORM) & (qn < MOST_NORM), (wn > LEAST_NORM) & (wn < MOST_NORM)
            own = np.zeros((4, 0))
            # pairs with a norm out of bounds are all added up
            odd_w, some = np.flatnonzero(~fair_w), np.flatnonzero(fair)
            for i, j in ((np.flatnonzero(~fair), np.arange(len(rows))), (some, odd_w)):
                for c in range(0, len(i) * len(j), PAIRS):
                    pair = np.arange(c, min(c + PAIRS, len(i) * len(j)))
                    own = add(own, scored(i[pair // len(j)], j[pair % len(j)]))
            good = np.flatnonzero(fair_w)
            unit, least = q[some] / qn[some][:, None], np.full(len(some), -np.inf)
            wait_x, wait_y, waiting, settled = [], [], 0, 0
            for a in range(0, len(good), step := max(1, CELLS // max(1, len(some)))):
                j = good[a : a + step]
                rough = unit @ (w[j] / wn[j][:, None]).T
                if a == 0 and len(j) > k:
                    least = np.partition(rough, len(j) - k, axis=1)[:, len(j) - k] - slack
                x, y = np.nonzero(rough >= least[:, None])
                wait_x.append(x)
                wait_y.append(j[y])
                waiting += len(x)
                # pairs wait until the vectors met have doubled: each doubling lets about k pairs of a query through
                if waiting < PAIRS and a + len(j) < min(2 * settled, len(good)):
                    continue
                x, y = np.concatenate(wait_x), np.concatenate(wait_y)
                wait_x, wait_y, waiting, settled = [], [], 0, a + len(j)
                for c in range(0, len(x), PAIRS):
                    own = add(own, scored(some[x[c : c + PAIRS]], y[c : c + PAIRS]))
                if own.shape[1]:
                    bound = np.searchsorted(own[0], at[some]) + k - 1
                    kth = np.minimum(bound, own.shape[1] - 1)
                    there = (bound == kth) & (own[0, kth] == at[some]) & (own[3, kth] == 1)
                    least = np.where(there, np.maximum(least, own[2, kth] - slack), least)
            # vectors that no product is defined with come last
            rest = np.setdiff1d(np.arange(len(vectors)), rows)
            rest = rest[np.argsort(place[rest])][:k]
            own = add(own, np.array([np.repeat(at, len(rest)), np.tile(rest, len(at)), np.zeros(len(at) * len(rest)), np.full(len(at) * len(rest), 2)], np.float64))
            met[at] = True
            kept.append(own)
    none = np.flatnonzero(~met)
    few = unmet[:k]
    kept.append(np.array([np.repeat(none, len(few)), np.tile(few, len(none)), np.zeros(len(none) * len(few)), np.full(len(none) * len(few), 2)], np.float64))
    query, vector, score, kind = np.concatenate(kept, axis=1)
    scores = pa.array(np.where(kind == 0, np.nan, score), pa.float64(), mask=kind == 2)
    return pa.table([queries.column(1).take(pa.array(query.astype(np.int64))), vectors.column(1).take(pa.array(vector.astype(np.int64))), scores], names=["query", "vector", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 50, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """The k most similar vectors of each query, by score, then id.

    Both sides are counted and dealt into blocks, each block of queries meets each block of vectors in a task of its
    own, and a partial top k leaves it, so that a task's memory does not grow with the tables.
    """
    k = min(max(k, 1), 500)
    size = lambda df: df.agg(F.sum(8 * F.greatest(F.coalesce(F.size(vector), F.lit(0)), F.lit(0)).cast("long") + 32).alias("size"), F.count(F.lit(1)).alias("n")).first()
    asked, held = size(queries), size(vectors)
    blocks, parts = max(-(-(asked["size"] or 0) // BLOCK_BYTES), -(-asked["n"] * k // KEPT), 1), -(-(held["size"] or 0) // BROADCAST_BYTES) or 1
    plain = lambda df: F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = queries.select(deal(blocks, query_id).alias("_block"), F.col(query_id).alias("_q"), plain(queries).alias("_v")).withColumn("_part", every(parts))
    right = vectors.select(deal(parts, vector_id, vector).alias("_part"), F.col(vector_id).alias("_id"), plain(vectors).alias("_w")).withColumn("_block", every(blocks))
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vector_id, vectors.schema[vector_id].dataType), T.StructField("_score", T.DoubleType())])
    slack = SLACK + 2 * 10.0**-digits

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k, slack).rename_columns(schema.names)

    scored = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInArrow(met, schema)
    scored = scored.select(query_id, F.round("_score", digits).alias("score"), vector_id)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def same_product_prices(cands: DataFrame, keys: list[str]) -> DataFrame:
    """median price, priced count and the sorted price fields of each key and product."""
    return cands.groupBy(*keys, "product_id").agg(
        F.median("unit_price").alias("median_price"), F.count("unit_price").alias("priced"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(F.col("unit_price").isNotNull(), F.nullif("price_field", F.lit("")))))).alias("fields"),
        F.min_by("point_id", F.when(F.col("unit_price").isNotNull(), F.col("pos"))).alias("first_priced"), F.min_by("price_field", F.when(F.col("unit_price").isNotNull(), F.col("pos"))).alias("first_field"),
        F.min_by("currency", F.when(F.col("unit_price").isNotNull(), F.col("pos"))).alias("first_currency"),
    )


def hydrated(selections: DataFrame, cands: DataFrame, keys: list[str], link_prefix: str = "") -> DataFrame:
    """Selections (keys, point_id, correspondence, rationale) with the chosen candidate and the same product's median price."""
    chosen = cands.select(*keys, "point_id", "product_id", "name", "manufacturer", "url")
    out = selections.join(chosen, [*keys, "point_id"], "left").join(same_product_prices(cands, keys), [*keys, "product_id"], "left")
    unknown = F.col("product_id").isNull() & F.col("point_id").isNotNull()
    method = F.when(F.col("priced") > 1, "median_same_product_id").when((F.col("priced") == 1) & (F.col("first_priced") == F.col("point_id")), "selected_candidate").when(F.col("priced") == 1, "same_product_id_fallback").otherwise("unavailable")
    field = F.when(F.col("priced") > 1, F.concat(F.lit("median("), F.col("fields"), F.lit(")"))).when(F.col("priced") == 1, F.col("first_field")).otherwise("")
    article = F.coalesce(string_or_none(F.col("product_id")), catalog_id(F.col("url")))
    return out.withColumns({
        "correspondence": F.when(unknown | F.col("point_id").isNull(), "Товар не найден").otherwise(F.col("correspondence")),
        "article": article, "link": F.coalesce(string_or_none(F.col("url")), F.when(article.isNotNull(), F.concat(F.lit(link_prefix), article))),
        "price_method": method, "price_source": field, "currency": F.when(F.col("median_price").isNotNull(), F.coalesce("first_currency", F.lit("RUB"))),
        "rationale": F.when(unknown, F.concat(F.lit("LLM вернул неизвестный selectedPointId="), F.col("point_id"), F.lit(". "), F.coalesce("rationale", F.lit("")))).otherwise(F.col("rationale")),
    }).drop("fields", "first_priced", "first_field", "first_currency", "url")


def baseline_selection(scored: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Without a model: the best candidate of each key if its score reaches the threshold."""
    best = first_by(scored, keys, [F.desc("score"), F.col("point_id")])
    return best.select(*keys, F.when(F.col("score") >= least, F.col("point_id")).alias("point_id"), F.when(F.col("score") >= least, "Аналог").otherwise("Товар не найден").alias("correspondence"), F.lit("").alias("rationale"))
