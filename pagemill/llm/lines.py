"""Line dedup: fuzzy lines by MinHash, one line kept of each group."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import bucket_links, components, linked_runs
from pagemill.llm.tables import Shared, slices, stored, texts, unused
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: Characters of a shingle, and of one where the shorter line of a pair has fewer than SHORT
#: characters: one changed character spoils as many shingles, which a short line can't afford.
SHINGLE, SHORT_SHINGLE, SHORT = 5, 3, 50
SIMILARITY = 0.8
#: Different short shingles of a line that may still be a copy of one below SHORT characters.
FEWEST = int((SHORT - SHORT_SHINGLE) / SIMILARITY)
#: Characters that tell of most lines that they have more than FEWEST.
BEGUN = 130
#: At a similarity of 0.8 a pair meets in one of eighteen bands of six with probability 0.995. Small
#: shingles are common ones: with fewer rows unlike lines would meet, ever more in larger tables.
BANDS, ROWS = 18, 6
#: Most lines of one bucket compared in one go.
LARGEST_BUCKET = 2_000
#: Lines of a bucket that are compared one by one; more are compared with one in a single step.
FEW = 12
#: Most lines of a bucket that is compared together with others, and characters of pairs compared at once.
TOGETHER, COMPARED = 64, 1 << 15
#: Bits of a line's sketch, by which most unlike lines are told apart.
CELLS = 4096
#: Characters hashed at once (fits a core's cache).
PART = 1 << 16
#: Lines that a task remembers to give their bands once only.
HELD_IDS = 1_000_000
#: Rows (bucket, id) that travel as one packed part, rows of parts that a task holds at most before it
#: gives out what it can, and rows that a task packs at once.
PART_ROWS, HELD_ROWS, PACKED_ROWS = 1 << 17, 1 << 22, 1 << 20
#: log2 of the bits of the filter of lines whose text is wanted, at most: 16 MB.
FILTER_BITS = 27
#: Words of the filter that reach the driver as one row: 256 KB before packing.
PIECE = 1 << 16

#: Where a text has none of these, nor a space at either end, the white space in its lines is even.
ODD_SPACE = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

_GIVEN = np.random.default_rng(20)
FACTORS = _GIVEN.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
OFFSETS = _GIVEN.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def normal(line: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """:func:`normal` of each line."""
    lines, even = text.lower().split("\n"), True
    for odd in ODD_SPACE:
        if odd in text:
            even = False
            break
    if even and text[0] != " " != text[-1]:
        return lines
    return [" ".join(line.split()) for line in lines]


def line_id(line: str) -> int:
    """64-bit id of a normal line. Among a billion distinct lines two share one with probability 0.03."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shingles(line: str, size: int = SHINGLE) -> list[str]:
    """Character shingles; a line shorter than one is its own."""
    return [line[i : i + size] for i in range(max(1, len(line) - size + 1))]


def as_numbers(line: str, size: int) -> bool:
    """Whether every shingle of the line has a number: it is no shorter, and its characters fit."""
    return len(line) >= size and (line.isascii() or 21 * size <= 63 or ord(max(line)) >> 63 // size == 0)


def shingle_set(line: str, size: int) -> set[int | str]:
    """The different shingles, each as a number that stands for it alone, its characters side by side;
    those with a character that does not fit, and a line shorter than a shingle, as they are."""
    if len(line) < size:
        return {line}
    c, n, bits = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), len(line) - size + 1, 63 // size
    codes = c[:n].copy()
    for i in range(1, size):
        codes <<= bits
        codes |= c[i : i + n]
    if as_numbers(line, size):
        return set(codes.tolist())
    wide = np.convolve(c >> bits != 0, np.ones(size, int))[size - 1 :][:n] > 0
    return set(codes[~wide].tolist()) | {line[i : i + size] for i in np.flatnonzero(wide).tolist()}


def shingle_codes(line: str, size: int) -> np.ndarray | None:
    """:func:`shingle_set` in ascending order where every shingle has a number, else nothing."""
    if len(line) < size:
        return None
    c, n, bits = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), len(line) - size + 1, 63 // size
    if bits < 21 and not line.isascii() and int(c.max()) >> bits:
        return None
    wide = c.astype(np.int64)
    codes = wide[:n].copy()
    for i in range(1, size):
        codes <<= bits
        codes |= wide[i : i + n]
    codes.sort()
    new = np.ones(n, bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def shingle_sizes(line: str) -> tuple[int, ...]:
    """The sizes of shingle by which the line is compared with some other."""
    if len(line) < SHORT:
        return (SHORT_SHINGLE,)
    return (SHINGLE, SHORT_SHINGLE) if near_short(line) else (SHINGLE,)


def near_short(line: str) -> bool:
    """Whether the line has so few different short shingles that one below SHORT characters, which
    has at most SHORT - SHORT_SHINGLE of them, can be similar to it. Long lines seldom need to be read on."""
    seen: set[str] = set()
    for start in range(0, max(1, len(line) - SHORT_SHINGLE + 1), 128):
        seen.update(shingles(line[start : start + 128 + SHORT_SHINGLE - 1], SHORT_SHINGLE))
        if len(seen) > FEWEST:
            return False
    return True


def sizes_of(lines: list[str]) -> list[tuple[int, ...]]:
    """:func:`shingle_sizes` of each line. Long lines are read together as far as most of them need be."""
    out, long = [(SHINGLE,)] * len(lines), []
    for i, line in enumerate(lines):
        if len(line) < SHORT:
            out[i] = (SHORT_SHINGLE,)
        elif len(line) - SHORT_SHINGLE < FEWEST:
            out[i] = (SHINGLE, SHORT_SHINGLE)
        else:
            long.append(i)
    n = BEGUN - SHORT_SHINGLE + 1
    for start in range(0, len(long), 512):
        some = long[start : start + 512]
        begun = [lines[i][:BEGUN] for i in some]
        counts = np.fromiter(map(len, begun), np.int64, len(some)) - SHORT_SHINGLE + 1
        c = np.frombuffer("".join([x.ljust(BEGUN) for x in begun]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, BEGUN)
        h = np.zeros((len(some), n), np.uint32)
        for i in range(SHORT_SHINGLE):
            h += c[:, i : i + n]
            h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(21)  # shingles of different places here are different ones
        if counts.min() < n:
            h = np.where(np.arange(n) < counts[:, None], h, h[:, :1])
        h += np.arange(len(some), dtype=np.uint32)[:, None] << np.uint32(11)
        seen = np.zeros(len(some) << 11, np.uint8)
        seen[h.reshape(-1)] = 1
        eight = seen.view(np.uint64).reshape(-1, 1 << 8).sum(1)  # eight sums side by side, of 128 at most
        for i in np.flatnonzero(eight * np.uint64(0x0101010101010101) >> np.uint64(56) <= FEWEST).tolist():
            out[some[i]] = shingle_sizes(lines[some[i]])
    return out


def signatures(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """MinHash signatures, one row of BANDS * ROWS numbers per line."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    start = held = 0
    for i, line in enumerate(lines):
        held += len(line)
        if held >= PART:
            out[start : i + 1] = _signatures(lines[start : i + 1], size)
            start, held = i + 1, 0
    if start < len(lines):
        out[start:] = _signatures(lines[start:], size)
    return out


def _signatures(lines: list[str], size: int) -> np.ndarray:
    padded = [x if len(x) >= size else x.ljust(size, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, p = len(c) - size + 1, 0x9E3779B97F4A7C15
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h *= np.uint64(p)
        h += c[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(sizes)
    inside = np.ones(len(c), bool)
    for back in range(1, size):
        inside[ends - back] = False  # a shingle that would reach into the next line
    x = (h >> np.uint64(32)).astype(np.uint32)[inside[:n]]
    counts = sizes - size + 1
    starts = np.cumsum(counts) - counts
    out, y = np.empty((len(lines), BANDS * ROWS), np.uint32), np.empty_like(x)
    for k, (a, b) in enumerate(zip(FACTORS, OFFSETS)):
        np.multiply(x, a, out=y)
        y += b
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(made: np.ndarray, size: int = SHINGLE, rows: int = ROWS) -> np.ndarray:
    """(line, band) keys of 64 bits: lines with equal numbers in a band of one size share its key."""
    bands = made.shape[1] // rows
    parts = made.reshape(len(made), bands, rows).astype(np.uint64)
    key = np.broadcast_to(size * 1000 + np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).astype(np.uint64)
    for i in range(rows):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= parts[:, :, i]
        key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _lines(part: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    """(row, position, normal line) of the lines with a word."""
    for row, text in enumerate(texts(part)):
        if text:
            for pos, line in enumerate(normal_lines(text)):
                if line:
                    yield row, pos, line


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [(line_id(line), row, pos) for row, pos, line in _lines(part)]
        ids, rows, at = zip(*found) if found else ((), (), ())
        rows = pa.array(rows, pa.int32())
        columns = [pa.array(ids, pa.int64()), part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(at, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["line_id", "doc_id", "text_hash", "pos"])


def occurrences(docs: DataFrame) -> DataFrame:
    """(line_id, doc_id, text_hash, pos): one row per line with a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_occurrences, "line_id long, doc_id long, text_hash long, pos int")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for part in slices(batches):
        if len(seen) > HELD_IDS:
            seen.clear()
        own: dict[int, str] = {}
        for _, _, line in _lines(part):
            i = line_id(line)
            if i not in seen:
                own[i] = line
        seen.update(own)
        asked = sizes_of(list(own.values()))
        for size in (SHINGLE, SHORT_SHINGLE):
            chosen = {i: line for (i, line), sizes in zip(own.items(), asked) if size in sizes}
            if chosen:
                keys = band_keys(signatures(list(chosen.values()), size), size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.array(list(chosen), np.int64), BANDS))], ["bucket", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, id) the distinct ones of buckets with two ids or more; what is
    held is the last row."""
    last: tuple[int, int] | None = None
    told = False  # whether the last row came out already
    for batch in batches:
        bucket, ids = batch.column("bucket").to_numpy(), batch.column("id").to_numpy()
        if last is not None:
            bucket, ids = np.concatenate(([last[0]], bucket)), np.concatenate(([last[1]], ids))
        if not len(bucket):
            continue
        new = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(ids) != 0))))
        bucket, ids = bucket[new], ids[new]
        same = bucket[1:] == bucket[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if told:
            keep[0] = False
        told = bool(keep[-1]) or told and len(keep) == 1
        last = int(bucket[-1]), int(ids[-1])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(ids[keep])], ["bucket", "id"])


def part_of(bucket: np.ndarray, parts: int) -> np.ndarray:
    """A part from 0 to parts - 1 for each bucket, by its high bits."""
    high = (bucket.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)
    return (high >> np.uint64(32)).astype(np.int32)


def packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id) as (part, rows): the rows of one part side by side."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held)
        part = part_of(np.ascontiguousarray(rows[:, 0]), parts)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.concatenate((first, [len(rows)])).astype(np.int32) * 16
        made = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(part[first]), made], ["part", "rows"])

    for batch in batches:
        rows = np.stack([batch.column(name).to_numpy() for name in ("bucket", "id")], 1)
        for start in range(0, len(rows), PACKED_ROWS):
            held.append(rows[start : start + PACKED_ROWS])
            if sum(map(len, held)) >= PACKED_ROWS:
                yield out()
                held.clear()
    if held:
        yield out()


def in_order(rows: np.ndarray) -> np.ndarray:
    """The rows (bucket, id) in that order."""
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def together(rows: np.ndarray) -> np.ndarray:
    """Which rows have a bucket that another row has too."""
    order = np.argsort(rows[:, 0])
    same = np.diff(rows[order, 0]) == 0
    out = np.empty(len(rows), bool)
    out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return out


def unpacked(batches: Iterator[pa.RecordBatch], most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by part the distinct ones of buckets with two ids or more. Of a part of more
    than *most* rows those that are known to be such come out before the part ends, and perhaps again
    after that; `again` marks them."""
    told = np.empty(0, np.int64)  # buckets of which rows came out already
    held: list[np.ndarray] = []
    count, limit, now = 0, most, None

    def batch(rows: np.ndarray, again: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(len(rows), again))], ["bucket", "id", "again"])

    def settle() -> tuple[np.ndarray, np.ndarray]:
        """Rows to give out, and those that are alone so far."""
        rows = np.concatenate(held)
        some = together(rows) | np.isin(rows[:, 0], told) if len(told) else together(rows)
        alone, rows = rows[~some], in_order(rows[some])
        new = np.concatenate(([True], (np.diff(rows, axis=0) != 0).any(1)))[: len(rows)]
        rows = rows[new]  # several times the same one may be left: alone as well
        shared = together(rows) | np.isin(rows[:, 0], told) if len(told) else together(rows)
        return rows[shared], np.concatenate((alone, rows[~shared]))

    for packs in batches:
        for part, bytes_of in zip(packs.column("part").to_pylist(), packs.column("rows")):
            if part != now:
                if held:
                    yield batch(settle()[0], len(told) > 0)
                told, held, count, limit, now = told[:0], [], 0, most, part
            held.append(np.frombuffer(bytes_of.as_buffer(), np.int64).reshape(-1, 2))
            count += len(held[-1])
            if count > limit:
                rows, alone = settle()
                told = np.union1d(told, rows[:, 0])
                yield batch(rows, True)
                held, count = [alone], len(alone)
                limit = max(most, 2 * count)
    if held:
        yield batch(settle()[0], len(told) > 0)


def shared_buckets(docs: DataFrame, lines: int | None = None) -> DataFrame:
    """(bucket, id): distinct lines of the bands' buckets that hold two or more; of buckets with the
    same lines only one. *lines*: how many lines there are, if that is known."""
    return shared_members(docs.select("text"), _buckets, None if lines is None else BANDS * lines)


def shared_members(given: DataFrame, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], count: int | None = None) -> DataFrame:
    """Of the rows (bucket, id) that *rows_of* makes of *given* the distinct ones of buckets that hold two
    ids or more; of buckets with the same ids only one. They travel packed, in parts that are even where
    *count*, about how many rows there are, is known."""
    parts = max(8 * int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), (count or 0) // PART_ROWS)
    packs = given.mapInArrow(lambda batches: packed(rows_of(batches), parts), "part int, rows binary")
    found = packs.repartition("part").sortWithinPartitions("part").mapInArrow(unpacked, "bucket long, id long, again boolean")
    members = stored(found, "line-buckets")
    once = members.select("bucket", "id")
    if not members.filter("again").isEmpty():
        once = stored(once.distinct(), "line-buckets")
    sets = once.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor(F.xxhash64("id")).alias("x"))
    one = sets.groupBy("n", "a", "b", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    return stored(once.join(one, "bucket"), "line-members")


def _filter_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a filter (piece, place in it, bits), those of one piece side by side, as whole pieces."""
    piece, made = None, np.zeros(PIECE, np.uint32)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(made.tobytes(), 1)], pa.binary())], ["piece", "words"])

    for batch in batches:
        pieces, place, bits = (batch.column(name).to_numpy() for name in ("piece", "place", "bits"))
        edges = np.flatnonzero(np.diff(pieces)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(pieces)]):
            if start == end:
                continue
            if piece is not None and piece != pieces[start]:
                yield out()
                made[:] = 0
            piece = int(pieces[start])
            made[place[start:end]] = bits[start:end].astype(np.uint32)
    if piece is not None:
        yield out()


def id_filter(ids: DataFrame) -> Shared:
    """A bit for each id's last bits, broadcast: at most 16 MB however many ids there are. The driver gets
    it piece by piece, each a row of packed words: words as rows of their own would be gigabytes there."""
    spark, count = ids.sparkSession, ids.count()
    bits = min(FILTER_BITS, max(10, (16 * count).bit_length()))
    place = F.col("id").bitwiseAND(F.lit((1 << bits) - 1))
    words = ids.groupBy(F.shiftright(place, 5).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((id & {(1 << bits) - 1}) & 31 AS INT))")).alias("bits"))
    placed = words.select(F.floor(F.col("word") / PIECE).cast("int").alias("piece"), F.pmod("word", F.lit(PIECE)).alias("place"), "bits")
    pieces = placed.repartition("piece").sortWithinPartitions("piece").mapInArrow(_filter_pieces, "piece int, words binary")
    made = np.zeros(1 << bits - 5, np.uint32)
    for row in pieces.toLocalIterator():
        at, held = row.piece * PIECE, np.frombuffer(zlib.decompress(row.words), np.uint32)
        made[at : at + PIECE] = held[: len(made) - at]
    return Shared(spark, made)


def wanted_lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): the normal lines of the distinct *ids*; only what passes their filter is shuffled."""
    passed = id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = passed.value
        mask = 32 * len(words) - 1
        for part in slices(batches):
            lines: dict[int, str] = {}
            for _, _, line in _lines(part):
                i = line_id(line)
                if int(words[(i & mask) >> 5]) >> (i & 31) & 1:
                    lines[i] = line
            yield pa.RecordBatch.from_arrays([pa.array(lines.keys(), pa.int64()), pa.array(lines.values(), pa.string())], ["id", "text"])

    held = docs.select("text").mapInArrow(run, "id long, text string")
    return held.join(ids, "id", "left_semi").dropDuplicates(["id"])


def alike(a: set[str], b: set[str], threshold: float = SIMILARITY) -> bool:
    """Whether two sets have a Jaccard similarity of the threshold or more."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def alike_codes(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """:func:`alike` for ascending arrays of different numbers."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    merged = np.concatenate((a, b))
    merged.sort()
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return both >= threshold * (len(merged) - both) - 1e-9


def alike_lines(a: str, b: str, threshold: float = SIMILARITY) -> bool:
    """Whether two lines are copies, by shingles of the size that the shorter one asks for."""
    size = SHORT_SHINGLE if min(len(a), len(b)) < SHORT else SHINGLE
    own, other = shingle_codes(a, size), shingle_codes(b, size)
    if own is None or other is None:
        return alike(shingle_set(a, size), shingle_set(b, size), threshold)
    return alike_codes(own, other, threshold)


def _sketches(lines: list[str]) -> np.ndarray:
    """CELLS bits for each line: those of the cells to which its shingles are hashed."""
    out = np.zeros((len(lines), CELLS // 64), np.uint64)
    for start in range(0, len(lines), 256):
        some = [x if len(x) >= SHINGLE else x.ljust(SHINGLE) for x in lines[start : start + 256]]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        c = np.frombuffer("".join([*some, " " * (SHINGLE - 1)]).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c) - SHINGLE + 1, np.uint32)
        for i in range(SHINGLE):
            h += c[i : i + len(h)]
            h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - CELLS.bit_length() + 1)
        ends = np.cumsum(sizes)
        for back in range(1, SHINGLE):
            h[ends - back] = h[ends - sizes]  # one that would reach into the next line
        h += np.repeat(np.arange(len(some), dtype=np.uint32) * np.uint32(CELLS), sizes)
        seen = np.zeros(len(some) * CELLS, np.uint8)
        seen[h] = 1
        out[start : start + 256] = np.packbits(seen.reshape(-1, CELLS), axis=1).view(np.uint64)
    return out


def _overlaps(lines: list[str], size: int, threshold: float) -> np.ndarray | None:
    """Whether the first and the second line of each two are similar, by shingles of a size that no
    line falls short of; nothing if the characters are too many to number a shingle by them."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    c = np.frombuffer("".join([*lines, " " * (size - 1)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(c.max())
    if top >= 1 << 16:
        letters = np.unique(c)
        c, top = np.searchsorted(letters, c), len(letters) - 1
    elif top >= 1 << 7:
        seen = np.zeros(top + 1, bool)
        seen[c] = True
        c = (np.cumsum(seen, dtype=np.int32) - 1)[c]
        top = int(c.max())
    one, n = max(1, top.bit_length()), len(c) - size + 1
    if one * size > 60:
        return None
    wide, bits = c.astype(np.int64), one * size
    codes = wide[: n + size - 2] << one
    codes |= wide[1 : n + size - 1]  # two characters
    if size >= 4:
        four = codes[: n + size - 4] << 2 * one
        four |= codes[2 : n + size - 2]
        codes = four
    codes = codes[:n] << one if size % 2 else codes[:n]
    if size % 2:
        codes |= wide[size - 1 :]
    ends = np.cumsum(sizes)
    over = (ends[:, None] - np.arange(1, size)).ravel()
    if bits + len(lines).bit_length() > 60:
        codes = np.unique(codes, return_inverse=True)[1]
        bits = int(codes.max()).bit_length()
    codes[over] = 1 << bits  # what reaches into the next line: one shingle more, of each line
    codes <<= 1
    codes += np.repeat((np.arange(len(lines)) >> 1 << bits + 2) | (np.arange(len(lines)) & 1), sizes)
    codes.sort()  # by pair, shingle, line
    step = np.diff(codes)
    pairs = ends[1::2]
    until = np.searchsorted(np.flatnonzero(step), pairs - 1)  # borders between different ones before the pair's end
    total = np.diff(until, prepend=-1) - 2
    both = np.diff(np.searchsorted(np.flatnonzero((step == 1) & (codes[1:] & 1 == 1)), pairs - 1), prepend=0) - 1
    return both >= threshold * (total - both) - 1e-9


def sketched(lines: list[str], threshold: float = SIMILARITY) -> Callable[..., np.ndarray]:
    """Of lines i and j of SHORT characters or more, whether they can't be similar: shingles in cells that
    only one line's sketch has are not in both, and too many are."""
    length, sketches = np.fromiter(map(len, lines), np.int64, len(lines)), _sketches(lines)

    def apart(i, j: np.ndarray) -> np.ndarray:
        least = np.bitwise_count(sketches[i] ^ sketches[j]).sum(1, dtype=np.int64)
        most = length[i] + length[j] - 2 * (SHINGLE - 1)  # shingles of both
        return most - least < threshold * (most + least) - 1e-6

    return apart


def pairwise(lines: list[str], threshold: float = SIMILARITY) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """:func:`alike_lines` of lines i and j for many pairs, so many at once as have COMPARED characters."""
    length, apart = np.fromiter(map(len, lines), np.int64, len(lines)), sketched(lines, threshold)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shorter, chars = np.minimum(length[i], length[j]), length[i] + length[j]
        short, tiny, out = shorter < SHORT, shorter < SHORT_SHINGLE, np.zeros(len(i), bool)
        for size, here in ((SHORT_SHINGLE, short & ~tiny), (SHINGLE, ~(short | apart(i, j)))):
            at = np.flatnonzero(here)
            ends = np.cumsum(chars[at])
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COMPARED, "right")))
                some = at[start:stop]
                found = _overlaps([lines[k] for two in zip(i[some].tolist(), j[some].tolist()) for k in two], size, threshold)
                if found is None:
                    tiny[some] = True
                else:
                    out[some] = found
                start = stop
        for k in np.flatnonzero(tiny).tolist():
            out[k] = alike_lines(lines[i[k]], lines[j[k]], threshold)
        return out

    return near


def similar_pairs(table: pa.Table, at: np.ndarray) -> np.ndarray:
    """For buckets of two lines, at rows i and i + 1."""
    lines, two = table["text"].to_pylist(), np.arange(0, 2 * len(at), 2)
    return pairwise([lines[i] for k in at.tolist() for i in (k, k + 1)])(two, two + 1)


def similar_rows(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For buckets compared together: which rows i and j of *table* are similar."""
    return pairwise(table["text"].to_pylist())


def _counted(lines: list[str], asked: list[tuple[int, ...]], size: int, threshold: float):
    """For a line and the numbers of others, which of them have a similar set of shingles of *size*; of
    the lines that aren't compared by that size none."""
    none = np.empty(0, np.int64)
    sets = [shingle_codes(x, size) if size in sizes else none for x, sizes in zip(lines, asked)]
    if any(x is None for x in sets):
        sets = [shingle_set(x, size) if size in sizes else set() for x, sizes in zip(lines, asked)]
        flat = np.array([s for x in sets for s in x], object)
    else:
        flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    codes, unique = pd.factorize(flat) if len(flat) else (none, [])
    ends, upto = np.cumsum(sizes), np.zeros(len(codes) + 1, np.int64)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(unique), np.int8)
        mark[codes[ends[i] - sizes[i] : ends[i]]] = 1
        if 2 * len(rest) < len(sizes):  # only their shingles
            of = np.concatenate([codes[ends[j] - sizes[j] : ends[j]] for j in rest.tolist()])
            found, until = np.concatenate(([0], np.cumsum(mark[of], dtype=np.int64))), np.cumsum(sizes[rest])
            both = found[until] - found[until - sizes[rest]]
        else:
            np.cumsum(mark[codes], out=upto[1:])
            both = (upto[ends] - upto[ends - sizes])[rest]
        return (both > 0) & (both >= threshold * (sizes[i] + sizes[rest] - both) - 1e-9)

    return near


def similar(table: pa.Table, threshold: float = SIMILARITY):
    """Exact Jaccard similarity of the shingle sets of a bucket's lines, for `spanning_links`."""
    lines = table["text"].to_pylist()
    if len(lines) <= FEW:
        made: dict[tuple[int, int], np.ndarray | None] = {}

        def own(i: int, size: int) -> np.ndarray | None:
            if (i, size) not in made:
                made[i, size] = shingle_codes(lines[i], size)
            return made[i, size]

        def both(i: int, j: int) -> bool:
            size = SHORT_SHINGLE if min(len(lines[i]), len(lines[j])) < SHORT else SHINGLE
            a, b = own(i, size), own(j, size)
            return alike_lines(lines[i], lines[j], threshold) if a is None or b is None else alike_codes(a, b, threshold)

        def one_by_one(i: int, rest: np.ndarray) -> np.ndarray:
            return np.fromiter((both(i, j) for j in rest.tolist()), bool, len(rest))

        return one_by_one
    asked = sizes_of(lines)
    long, short = (_counted(lines, asked, size, threshold) for size in (SHINGLE, SHORT_SHINGLE))
    below = np.fromiter((len(x) < SHORT for x in lines), bool, len(lines))

    apart = sketched(lines, threshold)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        by_short, out = below[rest] | below[i], np.zeros(len(rest), bool)
        for counted, here in ((short, by_short), (long, ~(by_short | apart(i, rest)))):
            at = np.flatnonzero(here)
            if len(at):
                out[at] = counted(i, rest[at])
        return out

    return near


def duplicate_lines(docs: DataFrame, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """(doc_id, text_hash, n_lines, removed): per document with such lines the positions (from 0) of
    those that are not the one kept of their group.

    A group is a connected component of lines whose sets of five-character shingles have a Jaccard
    similarity of 0.8 or more, over lower-cased lines with white space made even; three-character
    shingles where the shorter line is below 50 characters. The first line in
    the order (doc_id, text hash, position) stays, rows without a doc_id coming last. Blank lines
    belong to no group. Rows that agree in doc_id and text count as one.
    """
    found = stored(occurrences(docs), "lines")
    members = shared_buckets(docs, found.count())
    ids = members.select("id").distinct()
    rows = members.join(wanted_lines(docs, ids), "id").select("bucket", "id", "text")
    links = bucket_links(stored(rows, "line-texts"), linked_runs(similar, similar_pairs, similar_rows, TOGETHER), largest_bucket)
    roots = stored(components(links), "line-roots")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "pos")
    each = found.groupBy("line_id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    named = each.join(roots, each.line_id == roots.node, "left")
    alone = named.filter("node IS NULL AND first <> last").select("line_id", F.col("first").alias("kept"))
    grouped = named.filter("node IS NOT NULL").select("line_id", "root", "first")
    best = grouped.groupBy("root").agg(F.min("first").alias("kept"))
    acts = alone.unionAll(grouped.join(best, "root").select("line_id", "kept"))
    gone = found.join(acts, "line_id").filter(place != F.col("kept"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, largest_bucket: int = LARGEST_BUCKET, count: str | None = None) -> DataFrame:
    """The documents with their duplicate lines taken out of `text`; all rows and columns stay.

    A text all of whose lines are copies becomes empty; NULL stays NULL. With *count*, a column of
    that name has the positions of the lines taken out.
    """
    own_id, own_hash, other_id, other_hash, gone_at = (unused(docs.columns, n) for n in ("__id0", "__hash0", "__id", "__hash", "__removed"))
    removed = duplicate_lines(docs, largest_bucket).select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash), F.col("removed").alias(gone_at))
    marked = docs.withColumns({own_hash: F.xxhash64("text"), own_id: F.col("doc_id").cast("long")})
    same = (F.col(own_hash) == F.col(other_hash)) & F.col(own_id).eqNullSafe(F.col(other_id))
    joined = marked.join(removed, same, "left").select(*[docs[c] for c in docs.columns], gone_at)
    names, with_count = docs.columns, count is not None
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = []
            for text, gone in zip(texts(part), part.column(gone_at).to_pylist()):
                if gone:
                    out = set(gone)
                    text = "\n".join(line for pos, line in enumerate(text.split("\n")) if pos not in out)
                made.append(text)
            part = part.set_column(at, "text", pa.array(made, part.schema.field("text").type))
            yield part if with_count else part.select(names)

    schema = joined.schema if count else docs.schema
    cleaned = joined.mapInArrow(run, schema)
    return cleaned.withColumnRenamed(gone_at, count) if count else cleaned
