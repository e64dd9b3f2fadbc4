"""SimHash near-duplicates: fingerprints, and links found through segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import bucket_links, components, linked_runs
from pagemill.llm.lines import shared_members
from pagemill.llm.tables import slices, stored, texts, unused
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

SEED = 42
DISTANCE = 4
#: Segments of two bits; the blocks are the runs of segments between these borders.
SEGMENT_BITS = 2
BORDERS = (0, 5, 10, 15, 20, 24, 28, 32)
#: Most fingerprints of one cell compared in one go.
LARGEST_CELL = 20_000
#: What the pipeline's stage links besides: texts whose sets of five-word shingles have a Jaccard
#: similarity of 0.8 or more. Such a pair meets in one of 16 bands of four with probability 0.9998.
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Most texts of one bucket compared in one go.
LARGEST_BUCKET = 500

_GIVEN = np.random.default_rng(21)
FACTORS = _GIVEN.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
OFFSETS = _GIVEN.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """64-bit hashes of the text's word shingles, in order; no word gives none."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint; no word gives 0."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = 2 * np.count_nonzero(bits, axis=0) > len(hashes)
    return int.from_bytes(np.packbits(most).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): 64-bit SimHash of every text's word shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text of fewer words than
    a shingle is one shingle; NULL, empty and blank texts have fingerprint 0. text_hash tells rows
    of one doc_id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [fingerprint(t, shingle) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(made, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def _block(first: int, last: int) -> Column:
    """The popcounts of segments first..last-1 of `fp` as one number."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))) for s in range(first, last)]
    number = F.lit(0).cast("long")
    for c in counts:
        number = number * (SEGMENT_BITS + 1) + c
    return number


def cells(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(bucket, id): the grid cells of each fingerprint.

    A fingerprint is embedded as its popcounts per segment. The Manhattan distance of two
    embeddings never exceeds their Hamming distance. The seven blocks of segments share a distance
    of at most four, so three blocks at least have none: two fingerprints in reach meet in the cell
    of one of the choices of three blocks.
    """
    blocks = list(zip(BORDERS, BORDERS[1:]))
    same = len(blocks) - distance
    if same < 1:
        raise ValueError(f"distance must be below {len(blocks)}")
    wide = fps.select("fp", *(_block(a, b).alias(f"b{i}") for i, (a, b) in enumerate(blocks)))
    side = (SEGMENT_BITS + 1) ** max(b - a for a, b in blocks)
    keys = []
    for n, chosen in enumerate(combinations(range(len(blocks)), same)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = key * side + F.col(f"b{i}") if same <= 6 else F.xxhash64(key, F.col(f"b{i}"))
        keys.append(key)
    return wide.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("id"))


def _popcounts(fp: np.ndarray) -> np.ndarray:
    """Two-bit segment popcounts, packed two bits each."""
    pairs = np.uint64(0x5555555555555555)
    return (fp & pairs) + ((fp >> np.uint64(1)) & pairs)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcounts (digits 0..2): |x - y| is (x ^ y) but for 1 against 2."""
    low = np.uint64(0x5555555555555555)
    x = a ^ b
    three = x & (x >> np.uint64(1)) & low  # 1 against 2: differ by one
    two = (x >> np.uint64(1)) & low & ~three  # 0 against 2
    one = x & low & ~three  # 0 against 1
    return np.bitwise_count(three) + np.bitwise_count(one) + 2 * np.bitwise_count(two)


def _near(distance: int):
    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = _manhattan(_popcounts(a), _popcounts(b)) <= distance
        ok[ok] = np.bitwise_count((a ^ b)[ok]) <= distance
        return ok

    def prepare(table: pa.Table):
        fp = table["id"].to_numpy().view(np.uint64)
        return lambda i, rest: close(np.broadcast_to(fp[i], rest.shape), fp[rest])

    def pair(table: pa.Table, at: np.ndarray) -> np.ndarray:
        fp = table["id"].to_numpy().view(np.uint64)
        return close(fp[at], fp[at + 1])

    return prepare, pair


def shingle_set(text: str | None) -> np.ndarray:
    """The text's distinct shingles of five words as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def set_bands(found: np.ndarray) -> np.ndarray:
    """One key per band: sets with equal MinHash numbers in a band share its key."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.min([(x[a : a + 1024, None] * FACTORS + OFFSETS).min(0) for a in range(0, len(x), 1024)], axis=0)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _set_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        made = [(h, set_bands(s)) for h, t in zip(part.column("id").to_pylist(), texts(part)) if len(s := shingle_set(t))]
        if made:
            ids = np.repeat(np.array([h for h, _ in made], np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, k in made])), pa.array(ids)], ["bucket", "id"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        made = [shingle_set(t).view(np.int64) for t in texts(part)]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.list_(pa.int64()))], ["id", "shingles"])


def _overlapping(table: pa.Table):
    """Exact Jaccard similarity of a bucket's sets, for `spanning_links`."""
    column = table["shingles"].combine_chunks()
    sets = [column[i].values.to_numpy() for i in range(len(column))]

    def like(a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9

    return lambda i, rest: np.fromiter((like(sets[i], sets[j]) for j in rest.tolist()), bool, len(rest))


def similar_texts(docs: DataFrame, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """Links (u, v) between hashes of the texts of *docs*: a spanning forest, bucket by bucket, of the
    texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates come from MinHash bands and not from fingerprints: at that similarity fingerprints
    differ in about ten bits, twice as many at times, and cells for that many would tell little apart.
    """
    rows = docs.select(F.xxhash64("text").alias("id"), "text").filter("text IS NOT NULL")
    members = shared_members(rows, _set_buckets)
    wanted = rows.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    sets = wanted.mapInArrow(_shingle_sets, "id long, shingles array<long>")
    held = stored(members.join(sets, "id").select("bucket", "id", "shingles"), "text-shingles")
    return bucket_links(held, linked_runs(_overlapping), largest_bucket)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, distance: int = DISTANCE, largest_cell: int = LARGEST_CELL, by_words: bool = False
) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row: who is linked, directly or not, at
    *distance* or fewer differing bits (and, with *by_words*, by :func:`similar_texts`); component_id
    is the smallest doc_id reachable.

    Equal fingerprints collapse before the search, so copies never meet as pairs. Rows without a
    doc_id are linked like any other; component_id is NULL only if no row of the group has an id.
    Repeated rows come back as often as they came in; no document gives no row.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = bucket_links(cells(own.select("fp"), distance), linked_runs(*_near(distance)), largest_cell)
    if by_words:
        named = prints.select("text_hash", "fp").distinct()  # texts of one fingerprint are linked anyhow
        pairs = stored(similar_texts(docs), "text-links")
        pairs = pairs.join(named.select(F.col("text_hash").alias("u"), F.col("fp").alias("fu")), "u")
        pairs = pairs.join(named.select(F.col("text_hash").alias("v"), F.col("fp").alias("fv")), "v")
        links = links.unionAll(pairs.filter("fu <> fv").select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v")))
    roots = stored(components(links), "roots")
    grouped = own.join(roots, own.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def dedup(docs: DataFrame, shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """The documents with one row left of each near-duplicate group: that of the smallest doc_id
    (and of the smallest text hash, should rows share an id). All columns stay.

    Linked are fingerprints within *distance* bits and texts similar by five-word shingles."""
    groups = near_duplicates(docs, shingle, distance, by_words=True)
    best = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("best")
    )
    own_id, own_hash, other_id, other_hash = (unused(docs.columns, n) for n in ("__id0", "__hash0", "__id", "__hash"))
    keep = best.select(F.col("best.doc_id").alias(other_id), F.col("best.text_hash").alias(other_hash)).distinct()
    marked = docs.withColumn(own_hash, F.xxhash64("text")).withColumn(own_id, F.col("doc_id").cast("long"))
    kept = marked.join(keep, (F.coalesce(own_id, F.lit(0)) == F.coalesce(other_id, F.lit(0))) & (F.col(own_hash) == F.col(other_hash)) & F.col(own_id).eqNullSafe(F.col(other_id)))
    return kept.dropDuplicates([own_id, own_hash]).select(*[docs[c] for c in docs.columns])
