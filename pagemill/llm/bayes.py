"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import Shared, slices, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: log2 of the hash buckets, and the lengths of the n-grams.
BITS = 16
ORDERS = (1, 2, 3)
#: Added to every bucket's count of every language.
SMOOTHING = 0.5
#: Characters worked on at once.
PART = 1 << 17

UNKNOWN = "und"

#: Odd multipliers, one for each n-gram length and one to mix.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letters_table() -> np.ndarray:
    """For each code point below 0x34000 its lower-case letter, or a space if it is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x34000))], np.uint32)


def ngram_buckets(text: str, letters: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hash buckets of all n-grams of the text's letters; runs of other characters are one space.

    Empty if the text has no letter.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = letters[np.minimum(points, len(letters) - 1)]
    blank = points == 32
    if blank.all():
        return np.empty(0, np.uint32)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    found = []
    for n in orders:
        if len(points) < n:
            break
        h = points[: len(points) - n + 1].copy()
        for i in range(1, n):
            h *= np.uint64(FACTORS[0])
            h += points[i : len(points) - n + 1 + i]
        h += np.uint64(n)
        h *= np.uint64(FACTORS[1])
        h ^= h >> np.uint64(29)
        h *= np.uint64(FACTORS[2])
        h >>= np.uint64(64 - bits)
        found.append(h.astype(np.uint32))
    return np.concatenate(found)


@dataclass
class Model:
    """Languages, log prior of each, and log-probabilities (bucket, language)."""

    labels: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def counted(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(label, bucket, n): n-gram counts of all rows (text, label); bucket -1 counts the texts.

    A task adds up its rows in one vector per label before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, rows = letters_table(), {}, {}
        for part in slices(batches):
            for text, label in zip(texts(part), part.column("label").to_pylist()):
                found = ngram_buckets(text, letters, bits)
                if len(found):
                    if label not in held:
                        held[label], rows[label] = np.zeros(1 << bits, np.int64), 0
                    held[label] += np.bincount(found, minlength=1 << bits)
                    rows[label] += 1
        for label, counts in held.items():
            at = np.flatnonzero(counts)
            buckets, n = np.concatenate(([-1], at)), np.concatenate(([rows[label]], counts[at]))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.string()), pa.array(buckets, pa.int32()), pa.array(n)], ["label", "bucket", "n"])

    held = rows.filter("text IS NOT NULL AND label IS NOT NULL").select("text", "label").mapInArrow(run, "label string, bucket int, n long")
    return held.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> Shared:
    """The model learned from all rows (text, label) with a text and a label, broadcast.

    Its size is languages times 2^bits numbers, whatever the rows; label values that the data hold
    are languages, so a table with millions of labels is refused.
    """
    spark = rows.sparkSession
    counts = counted(rows, bits)
    vectors = counts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    found = sorted(vectors.limit(4097).collect(), key=lambda r: r.label)
    if len(found) > 4096:
        raise ValueError("more than 4096 labels are no languages")
    matrix = np.full((1 << bits, len(found)), smoothing)
    prior = np.zeros(len(found))
    for k, row in enumerate(found):
        at = np.array([c.bucket for c in row.c], np.int64)
        n = np.array([c.n for c in row.c], float)
        matrix[at[at >= 0], k] += n[at >= 0]
        prior[k] = n[at < 0].sum()
    matrix = np.log(matrix / matrix.sum(0)).astype(np.float32)
    prior = np.log(prior / prior.sum()) if len(found) else prior
    return Shared(spark, Model([r.label for r in found], prior, matrix))


def classify(text: str | None, model: Model, letters: np.ndarray) -> tuple[str, float]:
    found = ngram_buckets(text, letters, int(np.log2(len(model.matrix)))) if text else ()
    if not len(found) or not model.labels:
        return UNKNOWN, 0.0
    total = model.prior.copy()
    for a in range(0, len(found), PART):
        total += model.matrix[found[a : a + PART]].sum(0, dtype=np.float64)
    best = int(total.argmax())  # a tie goes to the label that sorts first
    return model.labels[best], float(1 / np.exp(total - total[best]).sum())


def predicted(docs: DataFrame, model: Shared) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    score is the posterior probability of lang_pred. A text that is NULL or has no letter, or a
    model that learned no language, gives `und` with score 0. Repeated rows come back as often as
    they came in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_table()
        for part in slices(batches):
            made = [classify(t, model.value, letters) for t in texts(part)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
