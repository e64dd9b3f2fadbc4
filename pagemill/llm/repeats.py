"""Removal of byte strings that an earlier document has too, by blockwise suffix sorting.

Which 50-byte strings occur where is read off sorted suffixes. Suffixes are dealt to buckets so that
equal strings meet: a string goes by its *anchor*, the 24 bytes in it whose hash is least, and the
strings that follow each other with one anchor travel as one segment. A task sorts one bucket of
suffixes at a time; what a bucket leaves tied after 16 bytes is put in order by ranks of a difference
cover, worked out beforehand, so no comparison is longer and memory stays that of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import dropped, slices, stored
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: Bytes of a string that counts as repeated, and of the anchor in it.
LENGTH = 50
ANCHOR = 24
#: Window starts looked at together, so that a place in them fits the low bits of a hash.
STRETCH = 1 << 22
#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of text for each bucket of anchors.
PART_BYTES = 16 << 20
#: Bytes of segments, and suffixes, sorted together.
SLICE_BYTES = 1 << 20
BUCKET = 1 << 18
#: Different segments with one anchor (counted per chunk) from which its strings are grouped one by one.
HOT = 20_000

#: Period and cover: any two places have a distance below the period at which both are covered.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _meeting() -> np.ndarray:
    """For two residues the least distance at which both places are in the cover."""
    at = np.arange(PERIOD)
    both = _IN_COVER[(at[:, None, None] + at) % PERIOD] & _IN_COVER[(at[None, :, None] + at) % PERIOD]
    assert both.any(2).all()
    return both.argmax(2)


MEETING = _meeting()


# -- suffixes --------------------------------------------------------------------------


def words_at(text: np.ndarray, swap: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end; with *swap* in the order
    of the bytes."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    out = np.empty(n, np.uint64)
    for shift in range(min(8, n)):
        part = out[shift::8]
        part[:] = padded[shift : shift + 8 * len(part)].view(np.dtype(">u8" if swap else "<u8"))
    return out


def cover_ranks(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the suffixes at *places*, all of the cover, by their first 64 bytes.

    The first 16 bytes are sorted as two numbers; then the sorted length doubles, since a place one
    period on is of the cover too. Only suffixes still tied are sorted again.
    """
    n = len(words)
    rank = np.zeros(n + 4 * PERIOD, np.int64)
    order = np.lexsort((words[np.minimum(places + 8, n - 1)], words[places]))
    at = places[order]
    first, second = words[at], words[np.minimum(at + 8, n - 1)]
    new = np.concatenate(([True], (np.diff(first) != 0) | (np.diff(second) != 0)))
    reach = PERIOD
    while True:
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = start + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        if reach >= LENGTH or not tied.any():
            return rank
        slots = np.flatnonzero(tied)
        held = at[slots]
        key = rank[held] * (len(at) + 2) + rank[held + reach]
        by = np.argsort(key, kind="stable")
        at[slots] = held[by]
        new[slots[1:]] |= np.diff(key[by]) != 0
        reach *= 2


def merged(group: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of suffixes by group, and within a group (equal in the first PERIOD bytes) by rank.

    Suffixes of one residue compare by the rank one fixed distance on. Groups of several residues are
    merged: each suffix counts, by binary search in each other residue's list, how many stand before it.
    """
    residue = places % PERIOD
    order = np.lexsort((rank[places + MEETING[residue, residue]], residue, group))
    group, places, residue = group[order], places[order], residue[order]
    mixed_with_next = (np.diff(group) == 0) & (np.diff(residue) != 0)
    if not mixed_with_next.any():
        return order
    mixed = np.isin(group, group[1:][mixed_with_next])
    some = np.flatnonzero(mixed)
    g, p, r = group[some], places[some], residue[some]
    runs = g * PERIOD + r
    before = np.arange(len(some)) - np.searchsorted(runs, runs)
    for s in range(PERIOD):
        low, high = np.searchsorted(runs, g * PERIOD + s), np.searchsorted(runs, g * PERIOD + s, "right")
        high = np.where(r == s, low, high)
        start, step = low.copy(), MEETING[r, s]
        mine = rank[p + step]
        while (open_ := low < high).any():
            mid = np.minimum((low + high) >> 1, len(some) - 1)
            other = rank[p[mid] + step]
            right = open_ & ((other < mine) | ((other == mine) & (s < r)))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        before += low - start
    order[some] = order[some][np.lexsort((before, g))]
    return order


def equal_strings(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the strings at neighbouring places of *at* are the same LENGTH bytes."""
    a, b = at[:-1], at[1:]
    same = np.ones(len(a), bool)
    for shift in range(0, LENGTH - 7, 8):
        same &= words[a + shift] == words[b + shift]
    rest = np.uint64(64 - 8 * (LENGTH % 8))
    return same & (words[a + LENGTH // 8 * 8] >> rest == words[b + LENGTH // 8 * 8] >> rest)


def least_owners(text: np.ndarray, places: np.ndarray, owner: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """For each place the least owner of a place with the same LENGTH bytes.

    Suffixes are sorted bucket by bucket: a bucket is a range of their first eight bytes.
    """
    words = words_at(np.concatenate((text, np.zeros(64, np.uint8))), swap=True)
    cover = np.flatnonzero(np.resize(_IN_COVER, len(text)))
    rank = cover_ranks(words, cover)
    heads = words[places]
    parts = -(-len(places) // bucket)
    borders = np.unique(np.sort(heads[:: max(1, len(places) // 4096)])[:: max(1, 4096 // parts)][1:]) if parts > 1 else heads[:0]
    of = np.searchsorted(borders, heads, "right")
    least = np.empty(len(places), np.int64)
    for b in range(len(borders) + 1):
        inside = np.flatnonzero(of == b)
        if not len(inside):
            continue
        first = inside[np.lexsort((words[places[inside] + 8], heads[inside]))]
        at = places[first]
        group = np.cumsum(np.concatenate(([0], (np.diff(words[at]) != 0) | (np.diff(words[at + 8]) != 0))))
        slots = first[merged(group, at, rank)]
        starts = np.flatnonzero(np.concatenate(([True], ~equal_strings(words, places[slots]))))
        sizes = np.diff(np.concatenate((starts, [len(slots)])))
        least[slots] = np.repeat(np.minimum.reduceat(owner[slots], starts), sizes)
    return least


# -- segments --------------------------------------------------------------------------

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _hashed(*words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for word, mix in zip(words, _MIX):
        h += word
        h *= mix
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    return h


def _anchor_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    word, n = words_at(np.concatenate((text, np.zeros(16, np.uint8)))), len(text)
    return _hashed(word[:n], word[8 : 8 + n], word[16 : 16 + n])


def _hashes_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The same of some places only."""
    anchors = text[places[:, None] + np.arange(ANCHOR)]
    return _hashed(*anchors.view("<u8").T)


@dataclass
class Segments:
    """Runs of windows with one anchor: first and last window start, anchor's place and hash, document,
    and a number by which different segments are counted."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    mark: np.ndarray


def segments(text: np.ndarray, ends: np.ndarray, usable: np.ndarray) -> Segments:
    """The segments of a chunk's documents; of equal hashes in a window the first place counts."""
    sizes = np.diff(np.concatenate(([0], ends)))
    doc = np.repeat(np.arange(len(ends)), sizes)
    fine = np.repeat(usable, sizes)
    span = LENGTH - ANCHOR + 1
    found: list[tuple] = []
    for begin in range(0, len(text), STRETCH):
        part = text[begin : begin + STRETCH + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n < 1:
            break
        full = _anchor_hashes(part)
        low = np.uint64(2 * STRETCH - 1)
        least = (full & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n], least[span - width : span - width + n])
        place = (least & low).astype(np.int64)
        start = np.arange(begin, begin + n)
        whole = fine[begin : begin + n] & (start + LENGTH <= ends[doc[begin : begin + n]])
        start, place = start[whole], place[whole]
        if not len(start):
            continue
        new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(start) != 1)))
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(start)])) - 1
        mark = full[start[at] - begin] * _MIX[1] + full[start[last] - begin + LENGTH - ANCHOR]
        found.append((start[at], start[last], place[at] + begin, full[place[at]], doc[start[at]], mark))
    if not found:
        none = np.empty(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none, none.astype(np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*found)))


def keyed(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a chunk's anchors in order, part by part, which of them every segment's anchor
    is, and the segments in that order (those of one anchor stay as they were)."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    joint = (part << 32) | ((hashes // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(joint, kind="stable")
    new = np.diff(joint[order], prepend=-1) != 0
    of = np.empty(len(joint), np.int64)
    of[order] = np.cumsum(new) - 1
    return joint[order][new], of, order


# -- chunks and their anchors ----------------------------------------------------------

_CHUNK = "chunk long, docs array<long>, ends array<long>, size long, text binary"
_KEYS = "part int, chunk long, keys binary, documents binary, different binary"
_CODES = "chunk long, part int, codes binary, hot boolean"
_BLOBS = "part int, chunk long, kind int, data binary"
_CANDIDATES, _LOCAL, _HOT = 0, 1, 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for part in slices(batches, limit=CHUNK_BYTES):
        texts = [t.as_buffer() if t.is_valid else b"" for t in part.column("text").cast(pa.binary())]
        text = b"".join(texts)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()), "docs": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "ends": pa.array([np.cumsum([len(t) for t in texts]).tolist()], pa.list_(pa.int64())), "size": pa.array([len(text)], pa.int64()), "text": pa.array([text], pa.binary()),
        })
        number += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunks one at a time, with their documents' ids, ends and text."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            row["bytes"] = np.frombuffer(row["text"], np.uint8)
            row["ends"] = np.array(row["ends"], np.int64)
            row["usable"] = np.array([d is not None for d in row["docs"]], bool)
            yield row


def _chunk_segments(row: dict) -> Segments:
    return segments(row["bytes"], row["ends"], row["usable"])


def _anchor_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _chunk_segments(row)
            if not len(found.hash):
                continue
            joint, of, order = keyed(found.hash, parts)
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            # documents come in order; one anchor's segments may be equal in any of them
            documents = np.add.reduceat((np.diff(of[order], prepend=-1) != 0) | (np.diff(found.doc[order], prepend=-1) != 0), first, dtype=np.int64)
            marks = np.lexsort((found.mark, of))
            new = (np.diff(of[marks], prepend=-1) != 0) | np.concatenate(([True], np.diff(found.mark[marks]) != 0))
            different = np.add.reduceat(new, first, dtype=np.int64)
            part, keys = joint >> 32, (joint & 0xFFFFFFFF).astype(np.uint32)
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
            pairs = list(zip(edges, edges[1:]))
            few = [np.minimum(x, 255).astype(np.uint8) for x in (documents, different)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part[edges[:-1]], pa.int32()), "chunk": pa.array([row["chunk"]] * len(pairs), pa.int64()),
                **{name: pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for name, x in zip(("keys", "documents", "different"), (keys, *few))},
            })

    return run


def _by_part(finish: Callable[[int, list[dict]], Iterator[pa.RecordBatch]]):
    """For `mapInArrow` over rows sorted by part: *finish* with all rows of one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):  # row by row: a batch may hold many parts
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    if held:
                        yield from finish(part, held)
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield from finish(part, held)

    return run


def _coded(hot: int):
    """What each chunk has to know of its anchors: 0 no other document has it, 1 some, 2 very many."""

    def finish(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
        documents, different = (np.concatenate([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("documents", "different"))
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.diff(keys[order], prepend=np.int64(-1)))
        total, segs = (np.add.reduceat(x[order], starts, dtype=np.int64) for x in (documents, different))
        codes = np.empty(len(keys), np.uint8)
        codes[order] = np.repeat((total > 1).astype(np.uint8) * (1 + (segs >= hot)), np.diff(np.append(starts, len(keys))))
        cuts = np.cumsum([0] + [len(r["documents"]) for r in rows]).tolist()
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()),
            "codes": pa.array([p.tobytes() for p in parts], pa.binary()), "hot": pa.array([bool((p == 2).any()) for p in parts]),
        })

    return _by_part(finish)


# -- candidates ------------------------------------------------------------------------


def _packed(arrays: list[np.ndarray], raw: bytes = b"") -> bytes:
    return zstandard.ZstdCompressor().compress(np.array([len(arrays[0])], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays) + raw)


def _unpacked(data: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, raw[at:]


_SEGMENT = [np.int64, np.int64, np.uint8, np.uint8]  # first start, document id, length, anchor's place
_RUN = [np.int64, np.int64]  # first and last start of hit windows
_COPY = [np.int64, np.int64, np.int64]  # first start of a segment, of its copy in the document, number of windows


def _known(row: dict, found: Segments, parts: int) -> np.ndarray:
    """The code of each segment's anchor."""
    if not len(found.hash):
        return np.empty(0, np.uint8)
    _, of, _ = keyed(found.hash, parts)
    codes = b"".join(c["codes"] for c in sorted(row["codes"], key=lambda c: c["part"]))
    return np.frombuffer(codes, np.uint8)[of]


def _collapsed(row: dict, found: Segments, some: np.ndarray) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of the segments *some*: those to be searched elsewhere, runs of windows that an earlier document
    of the chunk has too, and copies within a document. Equal segments are looked up once per chunk."""
    ids = np.array([0 if d is None else d for d in row["docs"]], np.int64)[found.doc[some]]
    text, seen = row["text"], {}
    asked, runs, copies = [], [], []
    some = some[np.argsort(ids, kind="stable")]
    ids = np.sort(ids, kind="stable")
    for i, doc, a, b in zip(some.tolist(), ids.tolist(), found.first[some].tolist(), found.last[some].tolist()):
        held = seen.setdefault(text[a : b + LENGTH], (doc, a))
        if held[0] < doc:
            runs.append((a, b))
        elif held[1] == a:
            asked.append(i)
        else:
            copies.append((held[1], a, b - a + 1))
    return asked, runs, copies


def _packed_segments(row: dict, found: Segments, some: np.ndarray) -> bytes:
    first, last = found.first[some], found.last[some]
    ids = np.array([0 if d is None else d for d in row["docs"]], np.int64)[found.doc[some]]
    raw = b"".join(row["text"][a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist()))
    return _packed([first, ids, (last - first + LENGTH).astype(np.uint8), (found.anchor[some] - first).astype(np.uint8)], raw)


def _candidates(parts: int):
    """Packed segments for the parts of their anchors, those of very common ones, and what the chunk
    knows by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _chunk_segments(row)
            known = _known(row, found, parts)
            asked, runs, copies = _collapsed(row, found, np.flatnonzero(known > 0))
            out = []
            if runs or copies:
                local = [_packed(list(np.array(x, np.int64).reshape(-1, k).T)) for x, k in ((runs, 2), (copies, 3))]
                size = len(local[0]).to_bytes(8, "little")
                out.append((parts + row["chunk"] % parts, _LOCAL, size + local[0] + local[1]))
            some = np.array(asked, np.int64)
            hot = known[some] == 2
            if hot.any():  # they only travel along
                out.append((parts + row["chunk"] % parts, _HOT, _packed_segments(row, found, some[hot])))
            some = some[~hot]
            part = (found.hash[some] % np.uint64(parts)).astype(np.int64)
            some, part = some[np.argsort(part, kind="stable")], np.sort(part)
            edges = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)])).tolist()
            out += [(int(part[a]), _CANDIDATES, _packed_segments(row, found, some[a:b])) for a, b in zip(edges, edges[1:])]
            if out:
                at, kinds, data = zip(*out)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(at, pa.int32()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                    "kind": pa.array(kinds, pa.int32()), "data": pa.array(data, pa.binary()),
                })

    return run


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of very common anchors one by one: ``string, doc, chunk, at``."""
    for batch in batches:
        for row in batch.to_pylist():
            (first, doc, length, _), raw = _unpacked(row["data"], _SEGMENT)
            text, begin, counts = np.frombuffer(raw, np.uint8), np.cumsum(length, dtype=np.int64) - length, length.astype(np.int64) - LENGTH + 1
            past = np.cumsum(counts)
            for a in range(0, int(counts.sum()), BUCKET):
                window = np.arange(a, min(a + BUCKET, int(past[-1])))
                own = np.searchsorted(past, window, "right")
                step = window - (past - counts)[own]
                strings = text[(begin[own] + step)[:, None] + np.arange(LENGTH)].tobytes()
                offsets = pa.py_buffer(np.arange(0, len(strings) + 1, LENGTH, np.int32))
                yield pa.RecordBatch.from_pydict({
                    "string": pa.Array.from_buffers(pa.binary(), len(window), [None, offsets, pa.py_buffer(strings)]), "doc": pa.array(doc[own]),
                    "chunk": pa.array(np.full(len(window), row["chunk"])), "at": pa.array(first[own] + step),
                })


# -- sorting the parts -----------------------------------------------------------------


def hit_windows(firsts: np.ndarray, docs: np.ndarray, lengths: np.ndarray, leads: np.ndarray, raw: bytes, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window start) of each window that a smaller document has too.

    Segments are taken by anchor, some whole anchors at a time. Equal ones are sorted once, with their
    least document; each is laid out with its anchor on a multiple of the period, so that equal strings
    are of one residue.
    """
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    hashes = _hashes_at(np.frombuffer(raw, np.uint8), begins + leads)
    order = np.argsort(hashes, kind="stable")
    filled = np.cumsum(lengths[order], dtype=np.int64)
    anchors = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
    which, where = [], []
    at = 0
    while at < len(order):
        held = filled[at - 1] if at else 0
        after = anchors[np.searchsorted(anchors, at, "right") :]
        fits = after[filled[after - 1] - held <= slice_bytes]
        past = int(fits[-1]) if len(fits) and filled[-1] - held > slice_bytes else int(after[0]) if len(after) and filled[-1] - held > slice_bytes else len(order)
        some = order[at:past]
        at = past
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[a : a + k], len(seen)) for a, k in zip(begins[some].tolist(), lengths[some].tolist())], np.int64)
        if len(some) < 2:
            continue
        single = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(single, of, docs[some])
        example = np.empty(len(seen), np.int64)
        example[of[::-1]] = some[::-1]
        sizes = lengths[example].astype(np.int64)
        room = (sizes + 2 * PERIOD) // PERIOD * PERIOD
        base = np.cumsum(room) - room + (-leads[example].astype(np.int64)) % PERIOD
        text = np.zeros(int(room.sum()) + PERIOD, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        source = np.frombuffer(b"".join(seen), np.uint8)
        text[np.repeat(base, sizes) + inside] = source
        counts = sizes - LENGTH + 1
        own = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        least = least_owners(text, base[own] + offset, single[own])
        begin = np.cumsum(counts) - counts
        many = counts[of]  # windows of every segment, equal ones included
        seg = np.repeat(np.arange(len(some)), many)
        step = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
        hit = least[begin[of[seg]] + step] < docs[some[seg]]
        which.append(some[seg[hit]])
        where.append(firsts[some[seg[hit]]] + step[hit])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *which]), np.concatenate([none, *where])


def as_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as runs of consecutive ones: first and last of each."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]


def _sorted_part(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    others = [r for r in rows if r["kind"] != _CANDIDATES]
    if others:
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([r["chunk"] for r in others], pa.int64()), "kind": pa.array([r["kind"] for r in others], pa.int32()),
            "data": pa.array([r["data"] for r in others], pa.binary()),
        })
    asked = [r for r in rows if r["kind"] == _CANDIDATES]
    if not asked:
        return
    parts = [_unpacked(r["data"], _SEGMENT) for r in asked]
    columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
    chunk = np.repeat(np.arange(len(asked)), [len(p[0][0]) for p in parts])
    segment, start = hit_windows(*columns, b"".join(p[1] for p in parts))
    order = np.lexsort((start, chunk[segment]))
    segment, start = segment[order], start[order]
    of = chunk[segment]
    edges = np.concatenate((np.flatnonzero(np.diff(of, prepend=-1)), [len(of)])).tolist()
    found = [(asked[int(of[a])]["chunk"], _packed(list(as_runs(start[a:b])))) for a, b in zip(edges, edges[1:])]
    if found:
        chunks, data = zip(*found)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(chunks, pa.int64()), "kind": pa.array([_CANDIDATES] * len(found), pa.int32()), "data": pa.array(data, pa.binary()),
        })


# -- results ---------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, spans array<struct<first:long,past:long>>, kept binary"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), ("kept", pa.binary()),
])


def _hits(row: dict) -> np.ndarray:
    """Which windows of a chunk are hit, by place of their start."""
    hit, copies = np.zeros(len(row["bytes"]) + 1, bool), []
    for found in row["found"] or ():
        if found["kind"] == _LOCAL:
            size = int.from_bytes(found["data"][:8], "little")
            runs, _ = _unpacked(found["data"][8 : 8 + size], _RUN)
            copies.append(_unpacked(found["data"][8 + size :], _COPY)[0])
        else:
            runs, _ = _unpacked(found["data"], _RUN)
        for a, b in zip(runs[0].tolist(), runs[1].tolist()):
            hit[a : b + 1] = True
    for a in row["hot"] or ():
        hit[a] = True
    for group in copies:
        for source, copy, count in zip(*(c.tolist() for c in group)):
            hit[copy : copy + count] |= hit[source : source + count]
    return hit


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        text, ends = row["text"], row["ends"].tolist()
        first, last = as_runs(starts) if len(starts := np.flatnonzero(_hits(row))) else (starts, starts)
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, first, 1)
        np.add.at(cover, last + LENGTH, -1)
        removed = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
        # a run ends with its document, though the next one may begin with a run
        borders = np.array([e for e in sorted(set(ends)) if 0 < e < len(text) and removed[e - 1] and removed[e]], np.int64)
        edges = np.sort(np.concatenate((edges, borders, borders)))
        spans, out, begin, at = list(zip(edges[::2].tolist(), edges[1::2].tolist())), [], 0, 0
        for doc, end in zip(row["docs"], ends):
            own, pieces, past = [], [], begin
            while at < len(spans) and spans[at][0] < end:
                a, b = spans[at]
                own.append({"first": a - begin, "past": b - begin})
                pieces.append(text[past:a])
                past, at = b, at + 1
            pieces.append(text[past:end])
            out.append((doc, end - begin, own, b"".join(pieces)))
            begin = end
        columns = list(zip(*out)) or [()] * len(_RESULT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def without_repeats(docs: DataFrame, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every document (``doc_id, text``): its UTF-8 bytes without
    each one that lies in a 50-byte string which starts in a document of smaller id as well.

    All strings are judged on the text as it came in. Equal copies keep the smallest id's; rows of
    one id remove nothing from each other. A NULL text is empty; an empty or short one has no string
    of 50 bytes. A row without id neither removes nor loses anything. *spans* are the maximal removed runs,
    byte offsets, and *kept* may end in the middle of a character. No documents give no rows. Other
    columns are not read.

    Texts are written once in chunks. Anchors are counted by a shuffle of 32-bit keys; only segments
    whose anchor another document may have too (keys can collide, strings are compared in full) are
    sent to be sorted, equal ones once per chunk. Strings of an anchor with *hot* or more segments, which
    are found in the same pass, are grouped one by one, with partial minima before the shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(rows.mapInArrow(_chunks, _CHUNK), "chunks", compression="zstd")
    parts = max(64, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // part_bytes))
    keys = chunks.mapInArrow(_anchor_keys(parts), _KEYS)
    codes = stored(keys.repartition("part").sortWithinPartitions("part").mapInArrow(_coded(hot), _CODES), "anchor-codes")
    answer = codes.groupBy("chunk").agg(F.collect_list(F.struct("part", "codes")).alias("codes"))
    asking = chunks.join(answer, "chunk")
    blobs = asking.mapInArrow(_candidates(parts), _BLOBS)
    found = stored(blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_by_part(_sorted_part), "chunk long, kind int, data binary"), "repeats")
    per_chunk = found.filter(F.col("kind") != _HOT).groupBy("chunk").agg(F.collect_list(F.struct("kind", "data")).alias("found"))
    cleaned = chunks.join(per_chunk, "chunk", "left")
    none = F.lit(None).cast("array<long>").alias("hot")
    if codes.filter("hot").isEmpty():
        cleaned = cleaned.select("*", none)
    else:
        packed = found.filter(F.col("kind") == _HOT).select("chunk", "data")
        windows = stored(packed.mapInArrow(_hot_windows, "string binary, doc long, chunk long, at long"), "hot-strings")
        least = windows.groupBy("string").agg(F.min("doc").alias("least"))
        hit = windows.join(least, "string").filter("least < doc").groupBy("chunk").agg(F.collect_list("at").alias("hot"))
        cleaned = cleaned.join(stored(hit, "hot-hits"), "chunk", "left")
        dropped(windows)
    dropped(codes)
    return cleaned.mapInArrow(_cleaned, RESULT)
