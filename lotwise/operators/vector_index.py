"""Cluster index of vectors: exact nearest vectors that skip what the triangle inequality rules out, or a quick probe.

Centroids are fitted on a bounded sample (SAMPLE rows, those of the smallest hashes); every vector is assigned to its nearest
centroid and to a ring of distances from it. A cell is a cluster and a ring; the table of cells has at most
CLUSTERS * 2 / RING rows. Vectors are compared as directions, so similarity s means distance sqrt(2 - 2 s).

Search: a query first meets the cells that can hold the nearest vectors until they have k of them. The k-th best
score then is a bound; every other cell whose nearest possible vector, by the triangle inequality between query, centroid
and ring, is worse than the bound is skipped, and the rest is read. Queries and vectors of a cell meet in blocks of
bounded size, so neither a popular cell nor a popular query falls to one task.

Vectors without a direction (null, zero or not finite) are not indexed, and such queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import small_side, written

#: Centroids, the sample they are fitted on, and the rounds of fitting.
CLUSTERS, SAMPLE, ROUNDS = 64, 20_000, 12
#: Width of a ring of distances; vectors and queries of a block.
RING, VECTOR_BLOCK, QUERY_BLOCK = 0.05, 4096, 1024
#: Slack of bounds for rounding, and digits of a score.
SLACK, DIGITS = 1e-9, 9
_PLACED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
_PAIRS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
_HITS = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class VectorIndex:
    """centroids: one row each; cells: cell, n, low, high (distances from the centroid); vectors: vec_id, cell, distance, x (unit)."""

    centroids: np.ndarray
    cells: DataFrame
    vectors: DataFrame
    rings: int


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors, and which ones these are."""
    usable, out = [], []
    for i, v in enumerate(column):
        if v.is_valid:
            x = np.array(v.values.to_numpy(zero_copy_only=False), float)
            norm = np.sqrt(x @ x) if len(x) else 0.0
            if np.isfinite(norm) and norm > 0:
                usable.append(i)
                out.append(x / norm)
    return (np.stack(out) if out else np.zeros((0, 0))), np.array(usable, int)


def fit(rows: np.ndarray, clusters: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows."""
    distinct = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(clusters, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = (rows @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def _placed(centroids, width: float, rings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _units(batch.column(1))
            if not len(x):
                continue
            near = x @ centroids.value.T
            own = near.argmax(1)
            distance = np.linalg.norm(x - centroids.value[own], axis=1)
            cell = own * rings + np.minimum((distance / width).astype(int), rings - 1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(distance), listed], names=_PLACED.names)

    return run


def build(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, sample: int = SAMPLE, ring: float = RING, seed: int = 17) -> VectorIndex:
    """Indexes every usable vector; only the centroids come from a sample."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    some = rows.where(F.col("v").isNotNull()).orderBy(F.xxhash64("v"), "vec_id").limit(sample).select("v").toArrow().column("v")
    units = _units(some.combine_chunks())[0] if len(some) else np.zeros((0, 0))
    centroids, rings = (fit(units, clusters, ROUNDS, seed) if len(units) else np.zeros((1, 1))), int(np.ceil(2 / ring))
    shared = spark.sparkContext.broadcast(centroids)
    placed = rows.mapInArrow(_placed(shared, ring, rings), _PLACED) if len(units) else spark.createDataFrame([], _PLACED)
    placed = written(placed.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell"), "vector-index")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    return VectorIndex(centroids, written(cells, "vector-cells"), placed, rings)


def _queries(queries: DataFrame, query_id: str, vector: str) -> DataFrame:
    return queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))


def _choice(index: VectorIndex, k: int, probes: int | None):
    """For a query direction: the cells in order of their nearest possible distance, that distance, and how many come first."""
    cells = index.cells.orderBy("cell").toPandas()  # bounded by clusters and rings
    numbers, n = cells["cell"].to_numpy(int), cells["n"].to_numpy(int)
    low, high, own = cells["low"].to_numpy(float), cells["high"].to_numpy(float), cells["cell"].to_numpy(int) // index.rings
    centroids = index.centroids

    def choose(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        d = np.linalg.norm(q - centroids, axis=1)[own]
        least = np.maximum(0.0, np.maximum(d - high, low - d))
        order = np.lexsort((numbers, d, least)) if probes is None else np.lexsort((numbers, least, d))
        enough = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
        return numbers[order], least[order], min(len(order), max(enough, probes or 0))

    return choose


def _pairs(index: VectorIndex, k: int, probes: int | None, rest: bool):
    """(query, cell) of the first cells, or of all others that the query's bound leaves possible."""
    choose = _choice(index, k, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _units(batch.column(1))
            ids, cells, rows = [], [], []
            for q, i in zip(x, at, strict=True):
                numbers, least, first = choose(q)
                if rest:
                    bound = batch.column(2)[i].as_py()
                    taken = numbers[first:] if bound is None else numbers[first:][1 - least[first:] ** 2 / 2 >= bound - SLACK]
                else:
                    taken = numbers[:first]
                ids += [batch.column(0)[i].as_py()] * len(taken)
                cells += taken.tolist()
                rows += [q] * len(taken)
            if ids:
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(rows[0])), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.int32()), listed], names=_PAIRS.names)

    return run


def _best(k: int, digits: int):
    """A cogroup function: the k best vectors of a block for each query of a block."""

    def run(key, vectors, queries):
        out_q, out_v, out_s = [], [], []
        if len(vectors) and len(queries):
            ids = vectors.column("vec_id").to_numpy()
            matrix = lambda t, c: np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in t.column(c).chunks]).reshape(len(t), -1)
            x, asked, names = matrix(vectors, "x"), matrix(queries, "q"), queries.column("query_id").to_numpy()
            for start in range(0, len(asked), 128):
                scores = np.round(asked[start : start + 128] @ x.T, digits)
                for name, row in zip(names[start : start + 128], scores, strict=True):
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    near = near[np.lexsort((ids[near], -row[near]))][:k]
                    out_q.append(np.full(len(near), name))
                    out_v.append(ids[near])
                    out_s.append(row[near])
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        return pa.table({"query_id": joined(out_q, np.int64), "vec_id": joined(out_v, np.int64), "score": joined(out_s, float)})

    return run


def _met(index: VectorIndex, pairs: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block of vectors that a query meets."""
    asked = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qs"))
    plan = asked.join(index.cells.select(F.col("cell").alias("of"), F.ceil(F.col("n") / VECTOR_BLOCK).cast("int").alias("vs")), F.col("cell") == F.col("of")).select("of", "qs", "vs")
    plan = small_side(written(plan, "vector-plan"))
    deal = lambda df, id_col, own, other: df.join(plan, F.col("cell") == F.col("of")).withColumn(f"{own[0]}b", F.pmod(F.xxhash64(id_col), F.col(own)).cast("int")).withColumn(f"{other[0]}b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    vectors = deal(index.vectors, "vec_id", "vs", "qs").select("cell", "vb", "qb", "vec_id", "x")
    queries = deal(pairs, "query_id", "qs", "vs").select("cell", "vb", "qb", "query_id", "q")
    return vectors.groupBy("cell", "vb", "qb").cogroup(queries.groupBy("cell", "vb", "qb")).applyInArrow(_best(k, digits), _HITS)


def search(index: VectorIndex, queries: DataFrame, k: int = 50, probes: int | None = None, query_id: str = "query_id", vector: str = "embedding", digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, rank) of the k best vectors of each query, by score, then id; and (query_id, cell), what was read.

    probes: only so many cells, the nearest ones (and enough for k vectors), are read; without it the result is exact.
    """
    rows = _queries(queries, query_id, vector)
    pairs = written(rows.mapInArrow(_pairs(index, k, probes, False), _PAIRS), "vector-pairs")
    hits = written(_met(index, pairs, k, digits), "vector-hits")
    if probes is None:
        worst = hits.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rn") == k).select(F.col("query_id").alias("of"), F.col("score").alias("bound"))
        bounded = rows.join(small_side(written(worst, "vector-bounds")), F.col("query_id") == F.col("of"), "left").select("query_id", "v", "bound")
        more = written(bounded.mapInArrow(_pairs(index, k, None, True), _PAIRS), "vector-more")
        hits, pairs = hits.unionByName(_met(index, more, k, digits)), pairs.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), pairs.select("query_id", "cell")


def reads(index: VectorIndex, read: DataFrame) -> DataFrame:
    """query_id, cells and vectors that a search has read for each query."""
    held = index.cells.select(F.col("cell").alias("of"), "n")
    return read.join(F.broadcast(held), F.col("cell") == F.col("of")).groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("vectors"))
