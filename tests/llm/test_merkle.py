"""Merkle manifest and octopus multiproofs against a plain recursive version."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import merkle
from pagemill.llm.queries import QUERIES


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def walk(levels, i, digest=None):
    """(siblings, folded root) of leaf *i*."""
    digest, siblings = digest or levels[0][i], []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        siblings += run[: i % 8] + run[i % 8 + 1 :]
        run[i % 8] = digest
        digest, i = h(*run), i // 8
    return siblings, digest


def plain_proofs(rows):
    """Rows (doc_id, source, lang, n_chars, text) as sorted result tuples."""
    trees = {}
    for row in rows:
        changed = None
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
            text = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            changed = h(*map(field, (*row[:4], text)))
        trees.setdefault(row[2], []).append((row[0], h(*map(field, row)), changed))
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[lang] = levels_of([leaf for _, leaf, _ in trees[lang]])
    top = levels_of([built[k][-1][0] for k in langs])
    root, out = top[-1][0] if langs else None, []
    for place, lang in enumerate(langs):
        for i, (doc, leaf, changed) in enumerate(trees[lang]):
            below, sub = walk(built[lang], i, changed)
            above, folded = walk(top, place, sub)
            out.append((doc, leaf, built[lang][-1][0], root, h(*below, *above), folded, folded == root))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op12_against_brute_force(spark, sf, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(QUERIES["op12_merkle"](spark, sf)) == plain_proofs(rows)


def test_op12_edges(spark, edges, empty):
    rows = [tuple(r) for r in edges.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(merkle.proofs(edges)) == plain_proofs(rows)
    assert merkle.proofs(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 9, "b": 64, "ä": 65, None: 2}, {f"l{i:02}": i % 3 + 1 for i in range(20)}])
def test_shapes_of_trees(spark, sizes):
    rows = [(i, None, lang, i, "Text A") for lang, n in sizes.items() for i in range(n)]
    assert result(merkle.proofs(spark.createDataFrame(rows, FIELDS))) == plain_proofs(rows)


def test_blocks_of_blocks(spark, monkeypatch):
    """More leaves than a task grows at once, half of them one repeated row."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(300)] + [(7, "s", "en", 1, "same")] * 300
    assert result(merkle.proofs(spark.createDataFrame(rows, FIELDS))) == plain_proofs(rows)


def test_some_leaves_only(spark):
    """A proof of a few leaves fetches the missing siblings too, and no node twice."""
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"T{i}") for i in range(900)]
    placed, nodes = merkle.manifest(spark.createDataFrame(rows, FIELDS))
    some = placed.filter(F.col("doc_id").isin(5, 7, 400, 402, 899))
    want = {r[0]: r for r in plain_proofs(rows)}
    for r in merkle.prove(some, nodes).collect():
        assert r.verified and r.proof_sha256 == want[r.doc_id][4]


def test_octopus_is_least():
    given = np.random.default_rng(3)
    for size in (1, 2, 8, 9, 63, 64, 65, 600):
        for _ in range(20):
            some = np.unique(given.integers(0, size, given.integers(1, 9)))
            missing = merkle.octopus(some, size)
            assert len(set(missing)) == len(missing)
            known = {(0, int(i)) for i in some} | set(missing)
            for level in range(merkle.height(size)):
                for p in range(merkle.width(size, level + 1)):
                    kids = {(level, i) for i in range(8 * p, min(8 * p + 8, merkle.width(size, level)))}
                    if kids <= known:
                        known.add((level + 1, p))
            assert (merkle.height(size), 0) in known
            derivable = {(level, int(i) // 8**level) for i in some for level in range(merkle.height(size) + 1)}
            assert not derivable & set(missing)
