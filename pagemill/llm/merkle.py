"""Merkle manifest of a table of documents, and octopus multiproofs of its leaves.

Every document is a leaf; the leaves of a language form a tree of runs of eight, ordered by id, and
the roots of the languages form one more tree on top. A proof of many leaves shares most of its
nodes: each partition of leaves works out which nodes it can't derive itself (the *octopus* set),
fetches exactly these in one join, derives the rest, and cuts every leaf's own proof out of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagemill.llm.tables import dropped, stored
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

ARITY = 8
#: Levels that a task grows at once; a block is the leaves below one such node.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: Key of the tree over the languages' roots; those of languages begin with "-" (NULL) or "L".
TOP = "top"

NODE = "tree string, level int, idx long, digest string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree of *size* leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def width(size: int, level: int) -> int:
    """Nodes at *level* of a tree of *size* leaves."""
    return -(-size // ARITY**level)


# -- leaves ----------------------------------------------------------------------------


def leaf_digest(**replaced: Column) -> Column:
    """SHA-256 over the fields: ``-`` if NULL, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered_digest() -> Column:
    """The leaf of a changed text, NULL for documents that stay as they are."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(touched, leaf_digest(text=F.translate("text", _UPPER, _LOWER)))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf, changed, pos, size``: the numbered leaves of each language's tree.

    Of a language the leaves ascend by id, NULL first, equal ids by their digest. Equal rows are one
    row while they are sorted and get a position each afterwards. *changed* is a digest to fold
    instead of the leaf's own.
    """
    tree = F.coalesce(F.concat(F.lit("L"), F.hex(F.col("lang").cast("string"))), F.lit("-"))
    changed = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("leaf"), changed.alias("changed")
    )
    equal = rows.groupBy("tree", "doc_id", "leaf").agg(F.min("changed").alias("changed"), F.count("*").alias("n"))
    single = stored(equal, "leaves")
    placed = numbered(single, ["doc_id", "leaf"])
    dropped(single)
    placed = placed.withColumn("pos", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1))).drop("n")
    sizes = placed.groupBy("tree").agg(F.count("*").alias("size"))
    return placed.join(sizes, "tree")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """*rows* (``tree``, ``n``, ...) with ``pos``: how much ``n`` stands before, per tree, by *order*.

    Rows are range-partitioned by tree and order, counted up within each partition, and what the
    partitions before hold of the tree is added; no tree is in one task. *rows* must be stored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = ["tree", *order]
    schema = rows.withColumns({"part": F.lit(0), "before": F.lit(0).cast("long")}).schema
    arrow = to_arrow_schema(schema)

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts = []
            for t, n in zip(batch.column("tree").to_pylist(), batch.column("n").to_pylist()):
                if t != tree:
                    tree, before = t, 0
                firsts.append(before)
                before += n
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(firsts, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ranged = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count_up, schema), "numbered")
    from pyspark.sql import Window as W

    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("tree", "part").agg(F.sum("n").alias("held"))
    sums = sums.select("tree", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    placed = ranged.join(sums, ["tree", "part"]).withColumn("pos", (F.col("offset") + F.col("before")).cast(LongType()))
    return placed.select(*rows.columns, "pos")


# -- trees -----------------------------------------------------------------------------


def runs_above(idx: np.ndarray, digests: list[str]) -> tuple[np.ndarray, list[str]]:
    """Parents of the nodes *idx* (sorted, whole runs)."""
    parents, first = np.unique(idx // ARITY, return_index=True)
    edges = [*first.tolist(), len(idx)]
    return parents, [joined_hash(digests[a:b]) for a, b in zip(edges, edges[1:])]


def _grown(base: int):
    """For `applyInArrow` over one block of nodes at level *base*: its nodes above, up to LEVELS."""

    def run(table: pa.Table) -> pa.Table:
        tree, size = table["tree"][0].as_py(), table["size"][0].as_py()
        at = table["idx"].to_numpy()
        order = np.argsort(at)
        idx, digests = at[order], table["digest"].take(pa.array(order)).to_pylist()
        out: list[tuple] = []
        for level in range(base, base + LEVELS):
            if width(size, level) <= 1:
                break
            idx, digests = runs_above(idx, digests)
            out += [(tree, level + 1, i, d) for i, d in zip(idx.tolist(), digests)]
        trees, levels, at, made = zip(*out) if out else ((), (), (), ())
        return pa.table({
            "tree": pa.array(trees, pa.string()), "level": pa.array(levels, pa.int32()),
            "idx": pa.array(at, pa.int64()), "digest": pa.array(made, pa.string()),
        })

    return run


def grow(bottom: DataFrame) -> DataFrame:
    """All nodes (``NODE``) of the trees over *bottom* (``tree, size, idx, digest``), level 0 included.

    A task grows LEVELS levels over one block; the tops of the blocks are the bottom of the next
    round, so rounds go with the logarithm of the largest tree. A tree of one leaf is that leaf.
    """
    largest = bottom.agg(F.max("size")).first()[0] or 0
    made = [bottom.select("tree", F.lit(0).alias("level"), "idx", "digest")]
    now, base = bottom, 0
    while width(largest, base) > 1:
        blocks = now.withColumn("block", F.col("idx").bitwiseAND(F.lit(-BLOCK)))
        above = stored(blocks.groupBy("tree", "block").applyInArrow(_grown(base), NODE), "nodes")
        made.append(above)
        base += LEVELS
        tops = above.filter(F.col("level") == base)
        now = tops.join(bottom.filter("idx = 0").select("tree", "size"), "tree").select("tree", "size", "idx", "digest")
    nodes = made[0]
    for part in made[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def _height(size: str) -> Column:
    return sum(((F.col(size) > F.lit(ARITY**level)).cast("int") for level in range(21)), F.lit(0))


def manifest(docs: DataFrame, changed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The leaves with where they stand, and all nodes of all trees.

    Leaves: ``tree, doc_id, leaf, changed, pos, size, top_pos, top_size`` (the tree's number of leaves,
    its place among the trees and how many there are). Nodes: ``tree, level, idx, digest``.
    """
    placed = stored(leaves(docs, changed), "leaves")
    own = grow(placed.select("tree", "size", F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    heights = placed.filter("pos = 0").select("tree", _height("size").alias("level"))
    subroots = own.filter("idx = 0").join(heights, ["tree", "level"]).select("tree", "digest")
    # all trees are one list, ordered by the key that they had so far
    listed = stored(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang_tree"), "digest", F.lit(1).cast("long").alias("n")), "subroots")
    top = numbered(listed, ["lang_tree"]).withColumn("size", F.lit(listed.count()).cast("long"))
    top = stored(top, "subroots")
    nodes = stored(own.unionByName(grow(top.select("tree", "size", F.col("pos").alias("idx"), "digest"))), "manifest")
    where = top.select(F.col("lang_tree").alias("tree"), F.col("pos").alias("top_pos"), F.col("size").alias("top_size"))
    return placed.join(where, "tree"), nodes


# -- octopus multiproofs ---------------------------------------------------------------


def octopus(idx: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(level, idx) of the fewest nodes from which, with the leaves *idx*, the root follows."""
    missing, known = [], np.unique(idx)
    for level in range(height(size)):
        parents = np.unique(known // ARITY)
        kids = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        kids = kids[kids < width(size, level)]
        missing += [(level, i) for i in np.setdiff1d(kids, known, assume_unique=True).tolist()]
        known = parents
    return missing


def _wanted(table: pa.Table) -> pa.Table:
    """For `applyInArrow` over one partition of leaves: the coordinates that it has to fetch."""
    tree, block = table["tree"][0].as_py(), table["block"][0].as_py()
    size, top_pos, top_size = (table[c][0].as_py() for c in ("size", "top_pos", "top_size"))
    own = [(tree, level, i) for level, i in octopus(table["pos"].to_numpy(), size)]
    above = [(TOP, level, i) for level, i in octopus(np.array([top_pos]), top_size)]
    rows = [*own, *above, (TOP, height(top_size), 0)]  # the root is what proofs are held against
    of, levels, at = zip(*rows)
    return pa.table({
        "tree": [tree] * len(rows), "block": pa.array([block] * len(rows), pa.int64()), "of": pa.array(of, pa.string()),
        "level": pa.array(levels, pa.int32()), "idx": pa.array(at, pa.int64()),
    })


class Branch:
    """One tree as a partition of leaves sees it: fetched nodes, and those derived from them."""

    def __init__(self, size: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.size, self.height = size, height(size)
        self.nodes = {(0, i): d for i, d in leaves.items()} | fetched
        self._proofs: dict[tuple[int, int], str] = {}
        known = sorted(leaves)
        for level in range(self.height):
            known = sorted({i // ARITY for i in known})
            for p in known:
                self.nodes[level + 1, p] = joined_hash(self.run(level, p))

    def run(self, level: int, parent: int) -> list[str]:
        return [self.nodes[level, i] for i in range(parent * ARITY, min((parent + 1) * ARITY, width(self.size, level)))]

    @property
    def root(self) -> str:
        return self.nodes[self.height, 0]

    def proof(self, level: int, i: int) -> str:
        """The siblings from a node up, concatenated; what nodes share is joined once."""
        if level == self.height:
            return ""
        if (level, i) not in self._proofs:
            kids = self.run(level, i // ARITY)
            del kids[i % ARITY]
            self._proofs[level, i] = "".join(kids) + self.proof(level + 1, i // ARITY)
        return self._proofs[level, i]

    def folded(self, i: int, digest: str) -> str:
        """The root that follows from *digest* in place of leaf *i* and its original siblings."""
        for level in range(self.height):
            kids = self.run(level, i // ARITY)
            kids[i % ARITY] = digest
            digest, i = joined_hash(kids), i // ARITY
        return digest


def _expanded(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """For a cogroup of one partition's leaves and fetched nodes: every leaf's own proof."""
    size, top_pos, top_size = (leaves[c][0].as_py() for c in ("size", "top_pos", "top_size"))
    own: dict[tuple[int, int], str] = {}
    above: dict[tuple[int, int], str] = {}
    for of, level, i, digest in zip(*(fetched[c].to_pylist() for c in ("of", "level", "idx", "digest"))):
        (above if of == TOP else own)[level, i] = digest
    root = above[height(top_size), 0]
    positions, digests = leaves["pos"].to_pylist(), leaves["leaf"].to_pylist()
    branch = Branch(size, dict(zip(positions, digests)), own)
    trunk = Branch(top_size, {top_pos: branch.root}, above)
    rest = trunk.proof(0, top_pos)
    proofs, folds = [], []
    for i, changed in zip(positions, leaves["changed"].to_pylist()):
        proofs.append(sha256((branch.proof(0, i) + rest).encode()).hexdigest())
        folds.append(trunk.root if changed is None else trunk.folded(top_pos, branch.folded(i, changed)))
    n = len(positions)
    return pa.table({
        "doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": pa.array([branch.root] * n), "root": pa.array([root] * n),
        "proof_sha256": pa.array(proofs), "folded_root": pa.array(folds), "verified": pa.array([f == root for f in folds]),
    })


def prove(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """A proof (``PROOF``) for each of the leaves *wanted*, any rows of what :func:`manifest` gives.

    A partition of leaves is what lies below one block of a tree. It asks for the nodes that it
    can't derive, each once, gets them by one join, and expands the proofs locally; the folded root
    is worked out from the leaf (or its changed digest) and the original siblings.
    """
    rows = wanted.withColumn("block", F.col("pos").bitwiseAND(F.lit(-BLOCK)))
    place = rows.select("tree", "block", "pos", "size", "top_pos", "top_size")
    asked = place.groupBy("tree", "block").applyInArrow(_wanted, "tree string, block long, of string, level int, idx long")
    stand = nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    fetched = asked.join(stand, ["of", "level", "idx"]).select("tree", "block", "of", "level", "idx", "digest")
    return rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(_expanded, PROOF)


def proofs(docs: DataFrame) -> DataFrame:
    """Every document's leaf and proof, folded again after tampering with every third document.

    Needs ``doc_id, source, lang, n_chars, text``; NULLs are part of a leaf (``-``), a NULL language
    is a tree of its own and comes first, a NULL id comes first in its tree and is not tampered with.
    Rows of one id are ordered by their digest; repeated rows come back as often as they came in,
    each with a position and proof of its own. No documents, no rows. Other columns are not read.
    """
    placed, nodes = manifest(docs, tampered_digest())
    return prove(placed, nodes)
