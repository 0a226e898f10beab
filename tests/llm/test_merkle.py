"""The Merkle manifest against plain trees."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lotwise.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, arity=3):
    """The root, and for each leaf its (before, after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for leaf, p in enumerate(at):
            run, own = runs[p // arity], p % arity
            paths[leaf].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[leaf] = p // arity
        nodes = [h(*run) for run in runs]
    return (nodes or [None])[0], paths


def plain_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


@pytest.mark.parametrize("arity", [2, 3])
def test_traversal(arity):
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 50, 81]:
        leaves = [h(str(i)) for i in range(n)]
        root, paths = plain_tree(leaves, arity)
        height = merkle.steps(n, arity)
        assert merkle.root_of(leaves, height, arity) == root and list(merkle.traversal(leaves, height, arity)) == paths


def test_traversal_memory():
    """Stacks and kept runs together hold a number of nodes that grows with the height alone."""
    leaves = [h(str(i)) for i in range(3**6)]
    held, made = [], []
    init = merkle.TreeHash.__init__

    def spied(self, *a):
        init(self, *a)
        made.append(self)

    merkle.TreeHash.__init__ = spied
    try:
        for _ in merkle.traversal(leaves, 6):
            made = [t for t in made if t.node is None]
            held.append(sum(len(t.stack) for t in made))
    finally:
        merkle.TreeHash.__init__ = init
    assert max(held) <= 6 * 2 * 6


def plain_manifest(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(*r))):
        by.setdefault(r[1], []).append(r)
    subroots, found = [], []
    for own in by.values():
        root, paths = plain_tree([plain_leaf(*r) for r in own])
        subroots.append(root)
        found.append((own, root, paths))
    top, over = plain_tree(subroots)
    return [(r, root, top, [*path, *over[i]]) for i, (own, root, paths) in enumerate(found) for r, path in zip(own, paths, strict=True)]


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    """A hot source over several levels of blocks, sources of one row, null sources and ids, repeated rows, equal ids."""
    r = random.Random(height)
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(100)] + [(i, f"s{i % 9}", None, None, "é" * (i % 5)) for i in range(200, 240)]
    rows += [(1000, "alone", "x", 1, "y"), (None, None, None, None, None), (None, None, None, None, None), (7, None, "", 0, ""), (7, None, "", 0, "other"), (3, "Z", "a", 1, None), (4, "ä", "a", 1, "\n")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(5), "Path": F.lit(6), "_own": F.lit(7)})
    leaves = docs.withColumn("leaf", merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    out = merkle.manifest(leaves, height=height).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert "tree" in out[0].asDict() and "_own" in out[0].asDict()
    want = sorted(repr((plain_leaf(*r), s, t, p)) for r, s, t, p in plain_manifest(rows))
    assert sorted(repr((x.leaf, x.subroot, x.root, [(y.before, y.after) for y in x.path])) for x in out) == want
    assert all(x.folded == x.root for x in out)


def test_manifest_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", "abc")], "doc_id long, source string, leaf string")).first()
    assert one.subroot == one.root == "abc" and one.path == []
    assert merkle.manifest(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, leaf string")).first().subroot == ""


def test_query(spark, tmp_path):
    rows = [(i, f"s{i % 4}", "en", 3, f"a\nb {i}" if i % 3 else "no break") for i in range(60)] + [(60, "s1", "en", None, None), (61, None, None, 1, "")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, source, lang, n, text), sub, top, path in plain_manifest(rows):
        x = got[i]
        assert (x.leaf, x.subroot, x.root) == (plain_leaf(i, source, lang, n, text), sub, top)
        assert x.proof_sha256 == h("".join(a + b for a, b in path))
        node = plain_leaf(i, source, lang, n, text.replace("\n", "") if text is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text)
        for a, b in path:
            node = h(a, node, b)
        assert x.folded_root == node and x.verified == (node == top)
    assert {x.verified for x in got.values()} == {True, False}
