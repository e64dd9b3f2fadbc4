"""Repeated byte strings by blockwise suffix sorting, against a plain index of all strings."""

import random

import numpy as np
import pytest

from pagemill.llm import repeats


def plain(rows, length=repeats.LENGTH):
    """(doc_id, n_bytes, spans, kept) of rows (doc_id, text)."""
    least, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for s in range(len(b) - length + 1 if d is not None else 0):
            w = b[s : s + length]
            least[w] = min(d, least.get(w, d))
    for d, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - length + 1 if d is not None else 0):
            if least[b[s : s + length]] < d:
                gone[s + 1 : s + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).tolist()
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((d, len(b), spans, bytes(c for c, g in zip(b, gone[1:]) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.first, s.past) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def made(seed, n=150):
    """Texts with shared passages, copies, edits, periods and few letters."""
    given = random.Random(seed)
    passages = ["".join(given.choice("ab é\n") for _ in range(given.randrange(20, 160))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = given.randrange(6)
        parts = [given.choice(passages) if given.random() < 0.5 else "".join(given.choice("abcdefgh ") for _ in range(given.randrange(90))) for _ in range(given.randrange(6))]
        text = "".join(parts)
        if kind == 0 and rows:
            text = given.choice(rows)[1] or ""
        elif kind == 1 and rows:
            text = given.choice(rows)[1] or ""
            at = given.randrange(len(text) + 1)
            text = text[:at] + "X" + text[at + 1 :]
        elif kind == 2:
            text = given.choice(("ab", "a", "xyz ")) * given.randrange(120)
        rows.append((given.randrange(n) if given.random() < 0.2 else i, text))
    return rows + [(None, passages[0] * 2), (None, None), (3, None), (4, "")]


@pytest.mark.parametrize("seed,hot,chunk", [(0, repeats.HOT, 1 << 20), (1, 3, 1 << 20), (2, repeats.HOT, 600), (3, 2, 600), (4, 6, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, hot, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    rows = made(seed)
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(repeats.without_repeats(given, hot)) == plain(rows)


def test_documents_against_brute_force(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(repeats.without_repeats(documents)) == plain(rows)


def test_edges(spark, edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert result(repeats.without_repeats(edges)) == plain(rows)
    assert repeats.without_repeats(empty).count() == 0


def test_long_documents_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 256)
    text = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    found = repeats.segments(text, np.array([10, 60, 900, 3000]), np.array([True] * 4))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last)])
    assert starts.tolist() == [10, *range(60, 851), *range(900, 2951)]
    assert ((found.anchor >= found.last) & (found.anchor + repeats.ANCHOR <= found.first + repeats.LENGTH)).all()


@pytest.mark.parametrize("letters,bucket", [(2, 1 << 18), (2, 50), (3, 7), (26, 50)])
def test_sorted_buckets(letters, bucket):
    """Any places of any residues, few letters and long ties; text and places as they come."""
    given = np.random.default_rng(letters)
    piece = given.integers(97, 97 + letters, 300).astype(np.uint8)
    text = np.concatenate((piece, given.integers(97, 97 + letters, 211).astype(np.uint8), piece[:203], np.full(150, 97, np.uint8), piece))
    places = given.permutation(len(text) - repeats.LENGTH + 1)
    owner = given.integers(0, 1000, len(places))
    least = {}
    for p, o in zip(places.tolist(), owner.tolist()):
        key = text[p : p + repeats.LENGTH].tobytes()
        least[key] = min(o, least.get(key, o))
    got = repeats.least_owners(text, places, owner, bucket)
    assert got.tolist() == [least[text[p : p + repeats.LENGTH].tobytes()] for p in places.tolist()]


def test_merged_is_suffix_order():
    given = np.random.default_rng(9)
    text = np.concatenate((np.tile(given.integers(97, 99, 40), 5), given.integers(97, 99, 100), np.full(90, 97), np.zeros(80))).astype(np.uint8)
    words = repeats.words_at(text, swap=True)
    rank = repeats.cover_ranks(words, np.flatnonzero(np.resize(repeats._IN_COVER, len(text))))
    places = given.permutation(300)
    raw = text.tobytes()
    heads = {h: i for i, h in enumerate(sorted({raw[p : p + repeats.PERIOD] for p in places.tolist()}))}
    group = np.array([heads[raw[p : p + repeats.PERIOD]] for p in places.tolist()])
    order = places[repeats.merged(group, places, rank)].tolist()
    assert [raw[p : p + repeats.LENGTH] for p in order] == sorted(raw[p : p + repeats.LENGTH] for p in places.tolist())


def test_a_cover_that_meets():
    for r in range(repeats.PERIOD):
        for s in range(repeats.PERIOD):
            d = repeats.MEETING[r, s]
            assert {(r + d) % repeats.PERIOD, (s + d) % repeats.PERIOD} <= set(repeats.COVER)


def test_very_common_anchors_take_no_further_pass(spark, monkeypatch):
    """Chunks are cut into segments to count anchors and to find candidates, and not once more for hot ones."""
    rows = made(5, 60)
    given, cut = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.sparkContext.accumulator(0)
    one = repeats._chunk_segments

    def counted(row):
        cut.add(1)
        return one(row)

    monkeypatch.setattr(repeats, "_chunk_segments", counted)
    passes = []
    for hot in (repeats.HOT, 2):
        before = cut.value
        assert result(repeats.without_repeats(given, hot)) == plain(rows)
        passes.append(cut.value - before)
    assert passes[0] == passes[1]
