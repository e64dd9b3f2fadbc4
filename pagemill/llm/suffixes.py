"""Benchmark decontamination by suffix arrays of the training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import Shared, slices, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of test items that are broadcast together; more are searched block by block.
BLOCK_WORDS = 2_000_000
#: Words of training text in one suffix array.
SHARD_WORDS = 1_000_000


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only); NULL has none."""
    return WORD.findall(text.encode().lower()) if text else []


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the *depth* codes that follow; codes are 0 (a border) or more.

    The first sort packs as many codes as fit in one number; then the sorted length doubles, and
    only suffixes that are still tied are sorted again.
    """
    n, bits = len(codes), max(1, int(codes.max(initial=0)).bit_length())
    reach = max(1, min(63 // bits, depth))
    padded = np.concatenate((codes, np.zeros(reach, np.int64)))
    key = codes.astype(np.int64)
    for i in range(1, reach):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = np.diff(key[order]) != 0
    rank = np.zeros(n + 1, np.int64)
    while True:
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start + 1  # 0 is what follows the end
        tied = ~new
        tied[:-1] |= ~new[1:]
        if reach >= depth or not tied.any():
            return order
        slots = np.flatnonzero(tied)
        items = order[slots]
        key = rank[items] * (n + 2) + rank[np.minimum(items + reach, n)]
        by = np.argsort(key, kind="stable")
        order[slots] = items[by]
        new[slots[1:]] |= np.diff(key[by]) != 0
        reach *= 2


@dataclass
class TestBlock:
    """Test items: the words of all of them, each followed by a border (code 0)."""

    items: list[str | None]
    vocabulary: list[bytes]
    codes: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]]) -> TestBlock:
        found = [(i, w) for i, text in rows if (w := words(text))]
        flat = [w for _, ws in found for w in ws]
        codes, vocabulary = pd.factorize(np.array(flat, object)) if flat else (np.empty(0, np.int64), [])
        sizes = np.array([len(ws) for _, ws in found], np.int64)
        at = np.arange(len(flat)) + np.repeat(np.arange(len(found)), sizes)
        joined = np.zeros(len(flat) + len(found), np.int64)
        joined[at] = codes + 1
        return TestBlock([i for i, _ in found], list(vocabulary), joined, np.repeat(np.arange(len(found)), sizes + 1))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes that may hold a window, and the window's length at each."""
        if not len(self.item):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = np.bincount(self.item) - 1
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        offset = np.arange(len(self.item)) - first[self.item]
        need = np.minimum(sizes, WINDOW)[self.item]
        starts = np.flatnonzero(offset + need <= sizes[self.item])
        return starts, need[starts]


def narrowed(codes: np.ndarray, order: np.ndarray, at: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within order[low:high], all sorted by the code *at* words on, the part equal to *wanted*: a
    binary search of every query at once."""
    bounds = []
    for upper in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            value = codes[np.minimum(order[np.minimum(mid, len(order) - 1)] + at, len(codes) - 1)]
            right = open_ & ((value <= wanted) if upper else (value < wanted))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        bounds.append(a)
    return bounds[0], bounds[1]


def matches(codes: np.ndarray, order: np.ndarray, test: np.ndarray, starts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of training suffixes that begin with its window.

    *codes* ends with a border; *test* has -1 for words that the shard lacks.
    """
    n = len(starts)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    live, depth = np.arange(n), 0
    while len(live):
        wanted = test[starts[live] + depth]
        a, b = narrowed(codes, order, depth, low[live], high[live], wanted)
        low[live], high[live] = a, b
        depth += 1
        live = live[(a < b) & (need[live] > depth)]
    return low, high


def longest_runs(doc: np.ndarray, place: np.ndarray, start: np.ndarray, need: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, words, place, start) of each document's longest verbatim match: windows at
    consecutive places of consecutive starts are one match; of equal ones the first."""
    by = np.lexsort((place, place - start, doc))
    doc, place, start, need = doc[by], place[by], start[by], need[by]
    new = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(start) != 1) | (np.diff(doc) != 0)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(place)])) - 1
    words = place[last] - place[first] + need[last]
    best = np.lexsort((start[first], place[first], -words, doc[first]))
    top = best[np.concatenate(([True], np.diff(doc[first][best]) != 0))]
    return list(zip(doc[first][top].tolist(), words[top].tolist(), place[first][top].tolist(), start[first][top].tolist()))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and the range each is of."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def searched(found: list[list[bytes]], block: TestBlock, shard_words: int = SHARD_WORDS) -> list[tuple]:
    """For each document (its words): ranges of hit words, items with windows in it (those that have
    an id), and its longest verbatim match (words, first word here, item, first word there)."""
    sizes = np.array([len(w) for w in found], np.int64)
    starts, need = block.suffixes()
    nothing = ([], [], 0, None, None, None)
    if not len(starts) or not sizes.sum():
        return [nothing] * len(found)
    flat = [w for ws in found for w in ws]
    codes, vocabulary = pd.factorize(np.array(flat, object))
    ids = pd.Index(vocabulary).get_indexer(np.array([b"", *block.vocabulary], object)) + 1
    ids[ids == 0] = -1
    ids[0] = 0
    test = ids[block.codes]
    first = np.cumsum(sizes + 1) - sizes - 1
    doc = np.repeat(np.arange(len(found)), sizes + 1)
    text = np.zeros(len(doc), np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(found)), sizes)] = codes + 1
    depth = int(need.max())
    cover = np.zeros(len(text) + 1, np.int32)
    pairs: set[tuple[int, int]] = set()
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(shard_words, 4 * depth)
    for begin in range(0, len(text), step):
        shard = text[begin : begin + step + depth]
        if shard[-1] != 0:
            shard = np.append(shard, 0)
        order = suffix_array(shard, depth)
        low, high = matches(shard, order, test, starts, need)
        hit = np.flatnonzero(low < high)
        if not len(hit):
            continue
        slot, which = spread(low[hit], high[hit])
        place, which = order[slot] + begin, hit[which]
        own = place < begin + step  # the next shard has the others again
        place, which = place[own], which[own]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + need[which], -1)
        pairs.update(zip(doc[place].tolist(), block.item[starts[which]].tolist()))
        seen.append((place, which))
    out = [nothing] * len(found)
    if not pairs:
        return out
    hits = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hits.astype(np.int8), [0]))))
    ranges: dict[int, list] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(doc[a])
        ranges.setdefault(d, []).append({"first": a - int(first[d]), "past": b - int(first[d])})
    items: dict[int, list[str]] = {}
    for d, i in pairs:
        if block.items[i] is not None:
            items.setdefault(d, []).append(block.items[i])
    begins = np.concatenate(([0], np.flatnonzero(block.codes == 0)[:-1] + 1))
    place, which = (np.concatenate(x) for x in zip(*seen))
    for d, words, at, start in longest_runs(doc[place], place, starts[which], need[which]):
        i = int(block.item[start])
        out[d] = (ranges[d], sorted(set(items.get(d, ()))), words, at - int(first[d]), block.items[i], start - int(begins[i]))
    return out


RESULT = (
    "doc_id long, text_hash long, n_words long, ranges array<struct<first:long,past:long>>, items array<string>, "
    "longest long, longest_at long, longest_item string, longest_item_at long"
)


def _scan(block, hits_only: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [words(t) for t in texts(part)]
            rows = []
            for i, h, w, hit in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), found, searched(found, block.value)):
                if hit[0] or not hits_only:
                    rows.append((i, h, len(w), *hit))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def test_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, named_only: bool = True) -> list:
    """The items (item_id, text) as broadcast blocks of about *block_words* words or less each.

    How many blocks there are follows from the counted words, so what an executor holds of a block
    is bounded; only one item longer than a block can exceed it.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    items = items.filter("item_id IS NOT NULL") if named_only else items
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (3 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [Shared(spark, TestBlock.of([(r.item_id, r.text) for r in items.filter(part == b).toLocalIterator()])) for b in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, named_only: bool = True) -> DataFrame:
    """One row per document: words, ranges of words inside benchmark windows, items found, and the
    longest verbatim match with its place in the document and in its item.

    A window is ten consecutive words of an item (all of them, if it has fewer). The training text
    is cut into shards; each gets a suffix array, in which every suffix of every item is looked up
    by binary search. NULL or wordless texts have no words and no hits; NULL items and items
    without words have no windows; items without id have none either with
    *named_only*, else they hit like any other but are not among the items found; repeated rows come back as often as they came in; items of
    one id count as one. An empty benchmark finds nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    blocks = test_blocks(benchmark, block_words, named_only)
    first = rows.mapInArrow(_scan(blocks[0], False), RESULT)
    if len(blocks) == 1:
        return first
    key = ["doc_id", "text_hash"]
    hits = first.filter("size(ranges) > 0").select(*first.columns, F.lit(0).alias("block"))
    for b, block in enumerate(blocks[1:], 1):
        hits = hits.unionAll(rows.mapInArrow(_scan(block, True), RESULT).withColumn("block", F.lit(b)))
    merged = (
        hits.dropDuplicates([*key, "block"])
        .groupBy(key)
        .agg(
            F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.min(F.struct(-F.col("longest"), "longest_at", "longest_item", "longest_item_at")).alias("top"),
        )
        .select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), "ranges", "items", "top")
    )
    none = first.select(*key, "n_words", F.col("ranges").alias("no_range"), F.col("items").alias("no_item"))
    joined = none.join(merged, F.col("doc_id").eqNullSafe(F.col("k")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    empty = lambda c, other: F.coalesce(c, F.filter(other, lambda _: F.lit(False)))
    return joined.select(
        *key, "n_words", empty("ranges", "no_range").alias("ranges"), empty("items", "no_item").alias("items"),
        F.coalesce(-F.col("top.col1"), F.lit(0)).alias("longest"), "top.longest_at", "top.longest_item", "top.longest_item_at",
    )


def covered(ranges: str) -> Column:
    """Words inside any of the ranges, which are sorted and may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("past"))
    return F.aggregate(
        ranges,
        start,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["past"] - F.greatest(s["past"], r["first"]))).alias("n"),
            F.greatest(s["past"], r["past"]).alias("past"),
        ),
        lambda s: s["n"],
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, named_only: bool = True) -> DataFrame:
    """The documents without any benchmark window; all columns stay and no text is shuffled."""
    kept = docs
    for block in test_blocks(benchmark, block_words, named_only):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hit = searched([words(t) for t in texts(part)], block.value)
                yield part.filter(pa.array([not h[0] for h in hit]))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
