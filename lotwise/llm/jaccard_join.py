"""N-gram Jaccard self-join by prefix filters under several global token orders, and its components.

Documents with equal shingle sets form one class; only classes are compared. Two sets
of sizes a and b have a similarity of 0.8 or more only if each misses at most a fifth
of its tokens, which bounds how deep into any global order the first shared tokens lie.

1. Order by hash, all documents. A set's extended prefix is its first
   missing + share tokens; linked sets share at least the smaller `share` of theirs.
   Tasks first combine what their own documents show, then one shuffle of the prefix
   tokens tells which ones other classes have. Most documents leave here.
2. Rarest first, what is left. With exact document frequencies, all but the
   share - 1 most frequent of the shared prefix tokens form the index, so passages
   that many documents have in common rarely open a candidate group.
3. Another hash order. A pair that is compared directly must share a token of its
   prefixes under this order, too, before the sets are intersected. Pairs of a hub and a member
   of its groups skip it: what a member shares with its hub is needed for the pivots, linked or not.

Tokens that very many classes have are counted by partial aggregation and met by a broadcast within
bounds, else by a join that is split where it is skewed; a hub's set is dealt out in copies, one for SPLIT members each.

Groups are never expanded into pairs. Each index group is compared with one hub (a
star), and what many members of a hub's family have beyond the hub joins the hub's
tokens to a pivot set P. If x and y are in one family and share no token outside P, their
overlap is at most min(|x & P|, |y & P|), and at most the sum of such minima over
hash segments of P; so besides the star only pairs for which that is enough, or that
share a token of the prefix of what P lacks, can link. Those are compared directly
unless the stars have already joined them. No link between classes that the stars leave
apart is lost, so the components are exact.

Defined results: null and empty texts have empty sets and are linked with nothing;
repeated rows share a class; an empty table stays empty; null ids take part and get
the smallest id of their component, if any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, small_side, text_key, written
from .shingles import class_of, mix, shingle_sets, signed

#: The second hash order's key.
OTHER_ORDER = 0x5851F42D4C957F2D
#: Hash segments by which overlaps with a pivot are counted (a power of two).
SEGMENTS = 64
#: Members of a hub that one copy of its set serves.
SPLIT = 4096
#: Members from which a hub's family gets a pivot, and the share of them that a token needs to join it.
FAMILY, POPULAR = 8, 0.25


def missing(size):
    """How many tokens of a set a linked set can lack: size - ceil(0.8 * size)."""
    return F.floor(size / 5) if isinstance(size, Column) else size // 5


def share(size):
    """Tokens by which a prefix is extended."""
    return F.greatest(F.lit(1), F.floor(size / 10)) if isinstance(size, Column) else max(1, size // 10)


def least_shared(size: Column) -> Column:
    """Shared prefix tokens that any link of a set of this size implies: share of the smallest partner."""
    return share(F.ceil(size * 4 / 5))


_CLASSES = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", T.LongType()), T.StructField("c", T.LongType()), T.StructField("size", T.LongType())])
_TOKENS = T.StructType([T.StructField("t", T.LongType()), T.StructField("c", T.LongType()), T.StructField("credit", T.IntegerType())])
_SETS = T.StructType([T.StructField("c", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("other", T.ArrayType(T.LongType()))])


def _classes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """k, id, class and set size of each row."""
    for batch in batches:
        classes, sizes = [], []
        for _, sets in shingle_sets(batch.column(2), size):
            classes += [class_of(x) for x in sets]
            sizes += [len(x) for x in sets]
        c = signed(np.array(classes, np.uint64))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(c), pa.array(sizes, pa.int64())], names=["k", "id", "c", "size"])


def _prefix_tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Extended prefixes under the hash order, combined within a batch.

    (t, c, 0): a token that one class of the batch has. (t, null, 0): one that several have.
    (c, c, n): n tokens of c's prefix were seen in other classes of the batch.
    """
    for batch in batches:
        tokens, owners, seen = [], [], set()
        for _, sets in shingle_sets(batch.column(0), size):
            for own in sets:
                if len(own) and (c := class_of(own)) not in seen:
                    seen.add(c)
                    own = own[: missing(len(own)) + share(len(own))]
                    tokens.append(own)
                    owners.append(np.full(len(own), c, np.uint64))
        if not tokens:
            continue
        t, c = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        credited, n = np.unique(c[~alone], return_counts=True)
        several = t[new & ~alone]
        yield pa.record_batch(
            [
                pa.array(signed(np.concatenate([t[alone], several, credited]))),
                pa.array(signed(np.concatenate([c[alone], several, credited])), mask=np.repeat([False, True, False], [int(alone.sum()), len(several), len(credited)])),
                pa.array(np.concatenate([np.zeros(int(alone.sum()) + len(several), np.int32), n.astype(np.int32)])),
            ],
            names=["t", "c", "credit"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets in hash order, and their prefixes under the other hash order."""
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0), size):
            if not (sets := [x for x in sets if len(x)]):
                continue
            lengths = np.array([len(x) for x in sets])
            others = [x[np.argsort(mix(x ^ np.uint64(OTHER_ORDER)))][: missing(len(x)) + 1] for x in sets]
            listed = lambda arrays: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32), pa.array(signed(np.concatenate(arrays))))
            yield pa.record_batch(
                [pa.array(signed(np.array([class_of(x) for x in sets], np.uint64))), pa.array(lengths, pa.int32()), listed(sets), listed(others)],
                names=["c", "size", "tokens", "other"],
            )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """Written table k, id, c, size: a row for each row of docs, with the class of its shingle set."""
    rows = docs.select(text_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(partial(_classes, size=size), _CLASSES), "jaccard-classes")


def surviving(docs: DataFrame, members: DataFrame, text_col: str = "text", size: int = 5) -> DataFrame:
    """Written table c, size, k of the classes that pass the filter under the hash order (k: a row that has it)."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_prefix_tokens, size=size), _TOKENS)
    by_token = Window.partitionBy("t")
    seen = rows.select("c", "credit", F.min("c").over(by_token).alias("lo"), F.max("c").over(by_token).alias("hi"), F.max(F.col("c").isNull()).over(by_token).alias("several"))
    credit = F.col("credit") + ((F.col("credit") == 0) & (F.col("several") | (F.col("lo") != F.col("hi")))).cast("int")
    credits = seen.where(F.col("c").isNotNull()).select("c", credit.alias("credit")).where(F.col("credit") > 0).groupBy("c").agg(F.sum("credit").alias("credit"))
    whole = members.where(F.col("size") > 0).groupBy("c").agg(F.max("size").alias("size"), F.min("k").alias("k"))
    kept = whole.join(credits, "c").where(F.col("credit") >= least_shared(F.col("size")))
    return written(kept.select("c", "size", "k"), "jaccard-surviving")


def index(sets: DataFrame) -> DataFrame:
    """Written table t, c, score of the rarest-first prefixes; score says how central a class is among its groups."""
    n = missing(F.col("size")) + share(F.col("size"))
    rows = sets.select("c", "size", F.explode(F.slice("tokens", F.lit(1), n.cast("int"))).alias("t"))
    held = written(rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1), "jaccard-tokens")
    rows = rows.join(small_side(held), "t")
    own = Window.partitionBy("c")
    ranked = rows.withColumns({
        "rank": F.row_number().over(own.orderBy("df", "t")),
        "n": F.count(F.lit(1)).over(own),
        "score": F.sum("df").over(own),
    })
    return written(ranked.where(F.col("rank") <= F.col("n") - least_shared(F.col("size")) + 1).select("t", "c", "score"), "jaccard-index")


def stars(groups: DataFrame) -> DataFrame:
    """Distinct (h, c): every class of a group with the group's most central class."""
    hubs = small_side(written(groups.groupBy("t").agg(F.max(F.struct("score", "c"))["c"].alias("h")), "jaccard-hubs"))
    return groups.join(hubs, "t").where(F.col("c") != F.col("h")).select("h", "c").distinct()


def enough(i: Column, a: Column, b: Column) -> Column:
    """100 * i >= 80 * (a + b - i)."""
    return 9 * i >= 4 * (a + b)


_MET = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("hsize", T.IntegerType()),
    T.StructField("i", T.IntegerType()), T.StructField("segments", T.ArrayType(T.IntegerType())), T.StructField("rest", T.ArrayType(T.LongType())),
])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows' token arrays, unsigned; null is empty."""
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    bounds = column.offsets.to_numpy()
    known = np.asarray(column.is_valid())
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(bounds[:-1], bounds[1:], known, strict=True)]


def _within(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which tokens of one sorted set the other has."""
    if not len(other):
        return np.zeros(len(own), bool)
    return other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c's overlap with a token set, by segments, and what is beyond it; adds to what is already counted."""
    for batch in batches:
        h, c, size, hsize, before, counted, tokens, others = batch.columns
        i, segments, rests = [], [], []
        for own, other in zip(_lists(tokens), _lists(others), strict=True):
            hit = _within(own, np.sort(other))
            i.append(int(hit.sum()))
            segments.append(np.bincount((own[hit] & np.uint64(SEGMENTS - 1)).astype(np.int64), minlength=SEGMENTS))
            rests.append(own[~hit])
        segments = np.array(segments, np.int32).ravel() + counted.values.to_numpy() if counted.null_count == 0 else np.array(segments, np.int32).ravel()
        i = np.array(i, np.int32) + before.to_numpy()
        rest = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in rests])]).astype(np.int32), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *rests]))))
        listed = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * SEGMENTS, pa.array(segments.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([h, c, size, hsize, pa.array(i.astype(np.int32)), listed, rest], names=_MET.names)


def star_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written table h, c, size, hsize, i (overlap with h), segments (the same by segments), rest (what h lacks)."""
    pairs = written(pairs, "jaccard-pairs")
    members = written(pairs.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")), "jaccard-members")
    many = small_side(written(members.where("parts > 1"), "jaccard-large"))
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(many, "h", "left").select("h", "c", F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"))
    hubs = sets.select(F.col("c").alias("h"), F.col("size").alias("hsize"), F.col("tokens").alias("htokens")).join(small_side(members), "h")
    hubs = written(hubs.select("h", "hsize", "htokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), "jaccard-hub-sets")
    both = sets.select("c", "size", "tokens").join(small_side(written(left, "jaccard-left")), "c").join(hubs, ["h", "part"])
    rows = both.select("h", "c", "size", "hsize", F.lit(0).alias("i"), F.lit(None).cast("array<int>").alias("segments"), "tokens", "htokens")
    return written(rows.mapInArrow(_overlaps, _MET), "jaccard-stars")


def with_pivots(met: DataFrame) -> DataFrame:
    """Written table as met, counted against the family's pivot: the hub and what a fair share of its members have beyond it."""
    families = met.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= FAMILY)
    beyond = met.join(families, "h").select("h", "members", F.explode("rest").alias("t")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    popular = beyond.where(F.col("n") >= F.greatest(F.lit(3), F.col("members") * POPULAR)).groupBy("h").agg(F.collect_list("t").alias("more"))
    rows = met.join(small_side(written(popular, "jaccard-popular")), "h", "left").select("h", "c", "size", "hsize", "i", "segments", "rest", "more")
    return written(rows.mapInArrow(_overlaps, _MET), "jaccard-pivots")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Written table c, label (the smallest node reachable) of the nodes of edges a, b.

    Each round a node takes the smallest label among its neighbours and then its label's
    label, so the rounds grow with the logarithm of a component's diameter.
    """
    spread = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "jaccard-edges")
    labels = spread.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(rounds):
        labels = written(labels, "jaccard-labels")
        near = spread.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "c").select("c", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("far"))
        new = nearer.join(jump, "label", "left").select("c", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        new = written(new, "jaccard-labels")
        labels = new.select("c", "label")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def open_pairs(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, in different components, that stars and pivots leave possible."""
    named = lambda df: df.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    of_hub = labels.select(F.col("c").alias("h"), F.col("label").alias("hlabel"))
    everyone = named(met).select("h", "c", "size", "i", "segments", "label", F.size("rest").alias("more"), "rest")
    # no token beyond the pivot is shared: one of the two, x, is apart from the hub; y's size lies where the overlap can still suffice
    top, low = F.floor(F.col("i") * 9 / 4).cast("int") - F.col("size"), F.ceil(F.col("size") * 4 / 5).cast("int")
    apart = everyone.join(of_hub, "h", "left").where((F.col("label") != F.coalesce("hlabel", "h")) & (top >= low))
    apart = apart.select("h", F.col("c").alias("x"), F.col("size").alias("xsize"), F.col("i").alias("xi"), F.col("segments").alias("xs"), F.col("label").alias("xlabel"), F.explode(F.sequence(low, top)).alias("size"))
    both = sum((F.least(F.col("segments")[k], F.col("xs")[k]) for k in range(SEGMENTS)), F.lit(0))
    y = everyone.select(F.col("h").alias("yh"), F.col("size").alias("ysize"), F.col("c").alias("y"), "i", "segments", F.col("label").alias("ylabel"))
    inside = apart.join(y, (F.col("h") == F.col("yh")) & (F.col("size") == F.col("ysize")) & (F.col("xlabel") != F.col("ylabel")) & enough(F.least("i", "xi"), F.col("ysize"), F.col("xsize")) & enough(both, F.col("ysize"), F.col("xsize")))
    # tokens beyond the pivot: the first that the least shared number of them allows; groups in one component need no look
    need = F.greatest(F.lit(1), F.col("size") - missing(F.col("size")) - F.col("i"))
    rest = everyone.withColumn("t", F.explode(F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.col("more") - need + 1).cast("int"))))
    several = rest.groupBy("h", "t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("h", "t")
    mixed = rest.join(small_side(written(several, "jaccard-mixed")), ["h", "t"]).select("h", "t", "c", "size", "segments", "more", "label")
    one = mixed.select("h", "t", F.col("c").alias("x"), F.col("size").alias("xsize"), F.col("segments").alias("xs"), F.col("more").alias("xmore"), F.col("label").alias("xlabel"))
    two = mixed.select(F.col("h").alias("yh"), F.col("t").alias("yt"), F.col("c").alias("y"), F.col("size").alias("ysize"), "segments", "more", F.col("label").alias("ylabel"))
    beside = one.join(two, (F.col("h") == F.col("yh")) & (F.col("t") == F.col("yt")) & (F.col("x") < F.col("y")) & (F.col("xlabel") != F.col("ylabel")) & enough(both + F.least("more", "xmore"), F.col("ysize"), F.col("xsize")))
    pairs = inside.select("x", "y").unionByName(beside.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) that are linked: filtered by size and by the other order's prefixes, then by the sets."""
    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("size").alias("asize"), F.col("tokens").alias("at"), F.col("other").alias("ao")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("size").alias("bsize"), F.col("tokens").alias("bt"), F.col("other").alias("bo")), "b")
    near = both.where((5 * F.least("asize", "bsize") >= 4 * F.greatest("asize", "bsize")) & F.arrays_overlap("ao", "bo"))
    return near.where(enough(F.size(F.array_intersect("at", "bt")), F.col("asize"), F.col("bsize"))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """Written table k, id, size, component, root: a row for each row of docs; k is text_key(id, text).

    component: the smallest id reachable by links of a similarity of 0.8 or more.
    root: the component's own class, which no other component shares, whatever the ids; null for rows without words.
    """
    members = classes(docs, id_col, text_col, size)
    left = surviving(docs, members, text_col, size)
    key, own = fresh(docs, "_k", "_own")
    chosen = docs.withColumn(own, text_key(id_col, text_col)).join(small_side(left.select(F.col("k").alias(key))), F.col(own) == F.col(key), "left_semi")
    sets = written(chosen.select(F.col(text_col).alias("text")).mapInArrow(partial(_sets, size=size), _SETS), "jaccard-sets")
    met = star_overlaps(stars(index(sets)), sets)
    linked = met.where(enough(F.col("i"), F.col("size"), F.col("hsize"))).select(F.col("h").alias("a"), F.col("c").alias("b"))
    labels = components(linked)
    more = written(compared(open_pairs(with_pivots(met), labels), sets), "jaccard-more")
    if not more.isEmpty():
        named = lambda x: F.coalesce(F.col(f"{x}l"), F.col(x)).alias(x)
        lifted = more.join(labels.select(F.col("c").alias("a"), F.col("label").alias("al")), "a", "left").join(labels.select(F.col("c").alias("b"), F.col("label").alias("bl")), "b", "left").select(named("a"), named("b"))
        top = components(lifted.where(F.col("a") != F.col("b")))
        lower = labels.join(top.select(F.col("c").alias("label"), F.col("label").alias("over")), "label", "left").select("c", F.coalesce("over", "label").alias("label"))
        single = top.join(labels.select("c"), "c", "left_anti")
        labels = written(lower.unionByName(single.select("c", "label")), "jaccard-final")
    named = members.where(F.col("size") > 0).join(labels, "c", "left").withColumn("root", F.coalesce("label", "c"))
    # written first, so that both sides of the join are plain shuffles, whose large partitions Spark splits
    smallest = written(named.groupBy("root").agg(F.min("id").alias("component")), "jaccard-smallest")
    held = named.join(small_side(smallest), "root").select("k", "id", "size", "component", "root")
    return written(held.unionByName(members.where(F.col("size") == 0).select("k", "id", "size", F.col("id").alias("component"), F.lit(None).cast("long").alias("root"))), "jaccard-components")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest id; rows without words all stay."""
    found = jaccard_components(docs, id_col, text_col)
    key, own = fresh(docs, "_k", "_own")
    # a component's first row: by id, then by key; rows that repeat it in full are copies, too
    best = found.where(F.col("size") > 0).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "k"))["k"].alias("k"))
    gone = found.where(F.col("size") > 0).select("k").distinct().join(best.select("k"), "k", "left_anti")
    gone = small_side(written(gone.select(F.col("k").alias(key)), "jaccard-copies"))
    kept = docs.withColumn(own, text_key(id_col, text_col)).join(gone, F.col(own) == F.col(key), "left_anti")
    repeated = found.where(F.col("size") > 0).groupBy("k").count().where(F.col("count") > 1)
    repeated = written(repeated.join(best.select("k"), "k", "left_semi").select(F.col("k").alias(key)), "jaccard-repeated")
    if not repeated.isEmpty():
        same, side = F.col(own) == F.col(key), small_side(repeated)
        kept = kept.join(side, same, "left_anti").unionByName(kept.join(side, same, "left_semi").dropDuplicates([own]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
