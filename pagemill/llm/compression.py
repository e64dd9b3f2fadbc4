"""Quality rules: base counts of a text and compression bands."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import slices, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

SYMBOL = re.compile(rb"[#*$%&|<>]")
BLANK = b" \t\n\x0b\x0c\r"
WINDOW = 8
LEVEL = 3
#: Bytes of a chunk; a rest of less than half of it belongs to the chunk before.
CHUNK = 4096

#: Limits of compressed size / size, by length in bytes: (below, least, most). Short texts hardly
#: compress; the longer a text is, the more of it an ordinary one repeats.
DOCUMENT_BANDS = ((256, 0.35, 1.10), (1024, 0.32, 0.88), (4096, 0.27, 0.76), (16384, 0.23, 0.72), (None, 0.18, 0.70))
CHUNK_BANDS = ((1024, 0.20, 1.30), (None, 0.20, 0.78))
#: Share of a text's chunks outside their band from which the text is rejected.
BAD_CHUNKS = 0.5


def band(bands: tuple, size: int) -> tuple[float, float]:
    return next((least, most) for below, least, most in bands if below is None or size < below)


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    words = raw.split()
    joined = b" ".join(words)
    points = joined.translate(None, CONTINUATION + b" ")
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line.strip(BLANK):
            repeated += line in seen
            seen.add(line)
    return len(words), len(points), len(SYMBOL.findall(raw)), repeated, repeat_words(words, joined)


#: UTF-8 bytes that do not begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes], joined: bytes) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    windows = [joined[a:b] for a, b in zip(starts, ends[WINDOW - 1 :].tolist())]
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    cover = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, n))
    cover[at] += 1
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def ratios(raw: bytes, compressor: zstandard.ZstdCompressor, chunk: int) -> tuple[float, list[tuple[int, float]]]:
    """Compressed size / size of the whole text, and (size, ratio) of each chunk."""
    whole = len(compressor.compress(raw)) / len(raw)
    borders = list(range(0, max(1, len(raw) - chunk // 2), chunk))
    parts = [raw[a:b] for a, b in zip(borders, [*borders[1:], len(raw)])]
    if len(parts) == 1:
        return whole, [(len(raw), whole)]
    return whole, [(len(p), len(compressor.compress(p)) / len(p)) for p in parts]


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, chunks long, bad_chunks long, verdict string"
)


def judged(text: str | None, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK, document_bands: tuple = DOCUMENT_BANDS, chunk_bands: tuple = CHUNK_BANDS) -> tuple:
    """The columns of :data:`RESULT` after doc_id for one text."""
    raw = (text or "").encode()
    counts = base_counts(raw)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    if not raw:
        return *counts, failed, False, None, 0, 0, "base"
    whole, parts = ratios(raw, compressor, chunk)
    least, most = band(document_bands, len(raw))
    bad = sum(not (low <= r <= high) for size, r in parts for low, high in [band(chunk_bands, size)])
    verdict = "base" if failed else "repetitive" if whole < least else "incompressible" if whole > most else "chunks" if bad > BAD_CHUNKS * len(parts) else "kept"
    return *counts, failed, verdict == "kept", whole, len(parts), bad, verdict


def compression_rules(docs: DataFrame, chunk: int = CHUNK, document_bands: tuple = DOCUMENT_BANDS, chunk_bands: tuple = CHUNK_BANDS, level: int = LEVEL) -> DataFrame:
    """One row per document: base counts, zstandard ratios and the verdict.

    A text fails the base rules with fewer than 20 words or with over 30 % of its words in repeated
    windows; of the others, one is rejected whose ratio lies outside the band for its length (below:
    repetitive, above: incompressible), or of whose fixed chunks more than half do. NULL and empty
    texts have no words, fail the base rules and have no ratio. Repeated rows come back as often as
    they came in. Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for part in slices(batches):
            rows = [(i, *judged(t, compressor, chunk, document_bands, chunk_bands)) for i, t in zip(part.column("doc_id").to_pylist(), texts(part))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
