"""Merkle manifest of a dataset: leaves per source, sources under one root, and each row's authentication path.

Leaves of a source ascend by id and get their positions by a prefix scan. While several nodes remain, each
run of ARITY neighbours (the last run may be shorter, even one node) becomes their hash. Aligned blocks of
ARITY ** HEIGHT leaves, however many a source has, are tasks of their own: first each block's root is taken,
then the blocks' roots are the leaves of the next, much smaller level, up to the source's root; the sources'
roots, in order, form one more tree in the same way. What stands above a block is one path that all of its
leaves share.

Within a block paths are made by traversal scheduling: at each height the run that holds the present leaf is
kept, and a treehash stack makes the nodes of the next run, one leaf at a time, so that they are there when
the traversal comes to them. A block's traversal keeps ARITY nodes and a stack of at most ARITY - 1 nodes a
height for each height: a number of nodes that grows with the logarithm of the block. The shared upper path is appended.

Defined results: a null source is a source of its own and comes first; null ids come first and are leaves like others;
equal ids ascend by leaf; repeated rows are leaves of their own; a null leaf counts as empty text; an empty table
has no rows; further columns pass through unless they clash with the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import prefix_scan
from .common import fresh, small_side, written

ARITY, HEIGHT = 3, 8
_STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
PATH = T.ArrayType(_STEP)
_ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf_of(*columns: Column) -> Column:
    """Hash of a row's values: each `-` if null, else its length in UTF-8 bytes, a colon and its text."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def siblings(path: Column) -> Column:
    """The path's nodes, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class TreeHash:
    """A node of one height, made leaf by leaf with a stack of finished subtrees."""

    def __init__(self, height: int, index: int, leaves: list[str], arity: int):
        self.height, self.leaves, self.arity = height, leaves, arity
        self.next, self.end = index * arity**height, min((index + 1) * arity**height, len(leaves))
        self.stack: list[tuple[int, str]] = []
        self.node: str | None = None
        self.exists = self.next < self.end

    def advance(self) -> None:
        """Takes one more leaf; runs of equal height at the top of the stack become their parent."""
        self.stack.append((0, self.leaves[self.next]))
        self.next += 1
        closed = self.next == self.end
        while True:
            height = self.stack[-1][0]
            if height == self.height:
                break
            n = 0
            while n < len(self.stack) and self.stack[-1 - n][0] == height:
                n += 1
            # a run is closed by its last node, or by the end of the leaves
            if n < self.arity and not closed:
                break
            run = [node for _, node in self.stack[-n:]]
            del self.stack[-n:]
            self.stack.append((height + 1, _hash(run)))
        if closed:
            ((_, self.node),) = self.stack

    def finish(self) -> str:
        while self.node is None:
            self.advance()
        return self.node


def root_of(leaves: list[str], height: int, arity: int = ARITY) -> str:
    """The node of this height over all the leaves."""
    return TreeHash(height, 0, leaves, arity).finish()


def traversal(leaves: list[str], height: int, arity: int = ARITY) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn up to this height: the run's nodes before and after its own, per level."""
    # the kept runs, and the treehash instances of the runs that follow
    run = [[t.finish() for t in _run(leaves, h, 0, arity)] for h in range(height)]
    ahead = [_run(leaves, h, 1, arity) for h in range(height)]
    for i in range(len(leaves)):
        if i:
            for h in range(height):
                if i % arity ** (h + 1) == 0:
                    run[h] = [t.finish() for t in ahead[h]]
                    ahead[h] = _run(leaves, h, i // arity ** (h + 1) + 1, arity)
        path = []
        for h in range(height):
            own = i // arity**h % arity
            path.append(("".join(run[h][:own]), "".join(run[h][own + 1 :])))
        yield path
        for waiting in ahead:  # one leaf for each height: the next run is ready when it is needed
            for t in waiting:
                if t.node is None:
                    t.advance()
                    break


def _run(leaves: list[str], height: int, run: int, arity: int) -> list[TreeHash]:
    """The nodes of a run, those that exist."""
    nodes = [TreeHash(height, run * arity + j, leaves, arity) for j in range(arity)]
    return [t for t in nodes if t.exists]


def steps(nodes: int, arity: int = ARITY) -> int:
    """Levels until one node remains."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // arity), n + 1
    return n


def _height(total: int, full: int, arity: int) -> int:
    """Levels that a block of a tree with this many leaves has: all of a block, or as many as the only block needs."""
    return full if total > arity**full else steps(total, arity)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("position")


def _block_root(full: int, arity: int):
    """A group function: the root of a block."""

    def run(key, table):
        leaves = _in_order(table).column("node").to_pylist()
        node = root_of(leaves, _height(table.column("total")[0].as_py(), full, arity), arity)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "position": pa.array([key[1].as_py()], pa.int64()), "node": [node]})

    return run


def _block_paths(full: int, arity: int, kept: list[str]):
    """A cogroup function: the block's rows with their paths, to which the upper path is appended."""

    def run(key, table, upper):
        table = _in_order(table)
        leaves, total = table.column("node").to_pylist(), table.column("total")[0].as_py()
        above = [(x["before"], x["after"]) for x in upper.column("upper")[0].as_py()]
        paths = [[{"before": a, "after": b} for a, b in [*own, *above]] for own in traversal(leaves, _height(total, full, arity), arity)]
        return table.select(kept).append_column("path", pa.array(paths, _ARROW_PATH))

    return run


def block_roots(nodes: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """Written table tree, position, node, total: the roots of the blocks of tree, position, node, total."""
    blocks = nodes.select("tree", F.floor(F.col("position") / arity**height).alias("block"), "position", "node", "total")
    roots = blocks.groupBy("tree", "block").applyInArrow(_block_root(height, arity), "tree long, position long, node string")
    total = nodes.groupBy("tree").agg(F.ceil(F.max("total") / arity**height).alias("total")).withColumnRenamed("tree", "of")
    return written(roots.join(small_side(written(total, "merkle-totals")), F.col("tree") == F.col("of")).drop("of"), "merkle-roots")


def with_paths(nodes: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, position, node, total and more) with `path` up to their tree's root; and tree, node: the roots.

    The levels of blocks grow with the logarithm of the largest tree, to a base of ARITY ** HEIGHT.
    """
    levels = [nodes]
    while (largest := levels[-1].agg(F.max("total").alias("n")).first()["n"] or 0) > 1 or len(levels) == 1:
        levels.append(block_roots(levels[-1], height, arity))
        if largest <= arity**height:
            break
    roots = levels[-1].select("tree", "node")
    upper = None
    for level in reversed(levels[:-1]):
        block = F.floor(F.col("position") / arity**height)
        here = level.withColumn("block", block)
        above = upper if upper is not None else levels[-1].select("tree", F.col("position").alias("block"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("upper"))
        schema = T.StructType([*level.schema.fields, T.StructField("path", PATH)])
        pathed = here.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_block_paths(height, arity, level.columns), schema)
        upper = None if level is nodes else written(pathed.select("tree", F.col("position").alias("block"), F.col("path").alias("upper")), "merkle-upper")
    return pathed, roots


def manifest(leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf", height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """leaves with subroot, root and path, from columns id, source and leaf (see leaf_of()).

    path: array<struct<before, after>> from the leaf to the root; folded(leaf, path) is the root of untampered rows.
    """
    had = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "path")]
    (own,) = fresh(leaves, "_own")
    rows = leaves.select(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), F.coalesce(F.col(leaf_col), F.lit("")).alias("node"), F.struct(*[F.col(f"`{c}`") for c in had]).alias(own)
    )
    placed = prefix_scan(rows, ["source"], ["id", "node"], {"position": ("count", F.lit(1))}, most=0)
    placed = written(placed.withColumn("position", F.col("position") - 1), "merkle-places")
    sources = placed.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    trees = prefix_scan(sources, [], ["source"], {"tree": ("count", F.lit(1))}, most=0)
    trees = small_side(written(trees.select(F.col("source").alias("of"), (F.col("tree") - 1).alias("tree"), "total"), "merkle-sources"))
    nodes = placed.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("tree", "position", "node", "total", own)
    nodes = written(nodes, "merkle-nodes")
    paths, subroots = with_paths(nodes, height, arity)
    # the sources' roots are the leaves of one more tree
    tops = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), "node", F.lit(subroots.count()).cast("long").alias("total")), "merkle-tops")
    over, root = with_paths(tops, height, arity)
    over = small_side(written(over.select(F.col("position").alias("of"), F.col("node").alias("subroot"), F.col("path").alias("over")), "merkle-over"))
    top = root.first()
    out = paths.join(over, F.col("tree") == F.col("of"))
    return out.select(f"{own}.*", "subroot", F.lit(top["node"] if top else None).alias("root"), F.concat("path", "over").alias("path"))
