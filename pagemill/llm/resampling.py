"""Quality classifier: importance resampling with hashed n-gram models of target and raw text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import Shared, slices, stored, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: log2 of the hash buckets of each of the two n-gram families.
BITS = 18
#: A document weighs the mean over all its words of their log ratio, what a word has below -MARGIN
#: counting STEEP times more: a few strong words in a long ordinary text would vanish in a plain mean.
MARGIN, STEEP = 1.0, 30
#: Words without evidence (log ratio 0) that every document has besides its own; they hold the means
#: of very short texts, which scatter most, to one cut with the others.
NEUTRAL = 10
#: Count added to the target's observed and expected counts of a bucket.
SMOOTHING = 0.5
#: Most labelled documents (by hash of the id) that the target model and the cut are fitted on.
LABELS = 100_000
#: Scale of the Gumbel noise.
TEMPERATURE = 0.1
#: Fixed point of log ratios, so that sums don't depend on their order.
UNIT = 1 << 16

RUN = re.compile(rb"([^\n])\1+")
#: Bytes to kinds: capital, small (any non-ASCII letter too), digit; others stay.
KINDS = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))


def features(found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, word buckets, shape-bigram buckets) of the documents' words.

    A shape is a word's kinds of characters, runs as one; a shape bigram also says whether the word
    is the one before it.
    """
    sizes = np.array([len(w) for w in found], np.int64)
    flat = [w for ws in found for w in ws]
    if not flat:
        return sizes, np.empty(0, np.int64), np.empty(0, np.int64)
    codes, unique = pd.factorize(np.array(flat, object))
    mask = (1 << BITS) - 1
    word = np.fromiter((zlib.crc32(w.lower()) & mask for w in unique), np.int64, len(unique))
    shapes = RUN.sub(rb"\1", b"\n".join(unique).translate(KINDS)).split(b"\n")
    shape = np.fromiter((zlib.crc32(s) for s in shapes), np.int64, len(shapes))[codes]
    before = np.concatenate(([0], shape[:-1]))
    same = np.concatenate(([False], codes[1:] == codes[:-1]))
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[firsts], same[firsts] = 0, False
    mixed = (before * 0x9E3779B1 + shape * 0x85EBCA6B + same * 0x27D4EB2F).astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return sizes, word[codes], (mixed & np.uint64(mask)).astype(np.int64)


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


@dataclass
class Ratios:
    """Log ratios target / raw of word and shape-bigram buckets, in units of 1 / :data:`UNIT`."""

    word: np.ndarray
    shape: np.ndarray


def text_weights(found: list[list[bytes]], ratios: Ratios) -> np.ndarray:
    """Each document's log importance weight from all n-grams of its text, as a mean, so that it
    doesn't fall with length; without words 0."""
    sizes, word, shape = features(found)
    value = ratios.word[word].astype(np.int64) + ratios.shape[shape]
    value += STEEP * np.minimum(value + int(MARGIN * UNIT), 0)
    ends = np.concatenate(([0], np.cumsum(value)))
    past = np.cumsum(sizes)
    return (ends[past] - ends[past - sizes]) / (UNIT * (sizes + NEUTRAL))


def weights(found: list[list[bytes]], ratios: Ratios, passage: int, worst: int) -> np.ndarray:
    """The sum over each document's *worst* passages (all, if it has fewer) of their log ratio;
    without words 0. It falls with length and leaves out the rest of the text, so the classifier
    doesn't use it."""
    sizes, word, shape = features(found)
    out = np.zeros(len(found), np.int64)
    if not len(word):
        return out / UNIT
    value = ratios.word[word].astype(np.int64) + ratios.shape[shape]
    some = np.flatnonzero(sizes)
    count = -(-sizes[some] // passage)
    first = np.cumsum(sizes[some]) - sizes[some]
    at = np.repeat(first, count) + passage * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    sums = np.add.reduceat(value, at)
    doc = np.repeat(np.arange(len(some)), count)
    order = np.lexsort((sums, doc))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    low = order[rank < worst]
    np.add.at(out, some[doc[low]], sums[low])
    return out / UNIT


def gumbel(doc_id: int | None, text: str | None) -> float:
    """Gumbel noise that is a function of the row."""
    bits = xxhash.xxh64_intdigest((text or "").encode(), seed=0 if doc_id is None else doc_id & (1 << 63) - 1)
    return float(-np.log(-np.log(((bits >> 11) + 0.5) / (1 << 53))))


@dataclass
class Labels:
    """Ids of the labelled documents used, sorted, and which of them are target text."""

    ids: np.ndarray
    good: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        """1 target, 0 labelled otherwise, -1 not labelled."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.good[at].astype(int), -1)


def kept_back(ids: np.ndarray) -> np.ndarray:
    """The quarter of the ids whose labels choose the cut and aren't learned from."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(62)) == 0


def label_sample(labels: DataFrame, most: int = LABELS) -> Shared:
    """At most about *most* labelled documents, chosen by hash of the id, broadcast.

    Target are those that every row of theirs calls of quality 1 and not toxic; rows without an id
    or a quality say nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("fine"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    total = each.count()
    share = int((1 << 20) * min(1.0, most / max(1, total)))
    chosen = each.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).toPandas().sort_values("doc_id")
    return Shared(labels.sparkSession, Labels(chosen.doc_id.to_numpy(np.int64), (chosen.fine & (chosen.toxic == 0)).to_numpy(bool)))


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    """doc_id with -1 for NULL (no labelled document has a NULL id; -1 may, and then matches)."""
    return pa.compute.fill_null(part.column("doc_id").cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: Shared, smoothing: float = SMOOTHING) -> Shared:
    """Log ratios from the n-gram counts of all documents (raw) and of the target ones, broadcast.

    A bucket's ratio compares its count in target text with the count expected if target text were
    like raw text. Two vectors of 2^18 counts are all that a task gathers, however much it reads.
    """
    spark, size = docs.sparkSession, 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        for part in slices(batches):
            sizes, word, shape = features([split(t) for t in texts(part)])
            ids = ids_of(part)
            chosen = np.repeat((labels.value.of(ids) == 1) & ~kept_back(ids), sizes)
            for offset, buckets in ((0, word), (size, shape)):
                raw[offset : offset + size] += np.bincount(buckets, minlength=size)
                target[offset : offset + size] += np.bincount(buckets[chosen], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, raw long, target long")
    counts = held.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    made = []
    for offset in (0, size):
        own = counts[(counts.bucket >= offset) & (counts.bucket < offset + size)]
        raw, target = np.zeros(size), np.zeros(size)
        raw[own.bucket - offset], target[own.bucket - offset] = own.raw, own.target
        expected = raw * (target.sum() / max(1.0, raw.sum()))
        made.append(np.rint(np.log((target + smoothing) / (expected + smoothing)) * UNIT).astype(np.int32))
    return Shared(spark, Ratios(*made))


def scored(docs: DataFrame, ratios: Shared, labels: Shared, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, weight, key, label) of every row; key is the weight with Gumbel noise, label is that
    of the documents kept back for the cut, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = texts(part)
            weight = text_weights([split(t) for t in found], ratios.value)
            noise = np.array([gumbel(i, t) for i, t in zip(part.column("doc_id").to_pylist(), found)])
            ids = ids_of(part)
            label = np.where(kept_back(ids), labels.value.of(ids), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(weight + temperature * noise), pa.array(label)], ["doc_id", "weight", "key", "label"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, weight double, key double, label int")


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts target from other labelled text with the fewest errors, in the middle
    of the gap there; below all if every cut is worse than none."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    gain = (np.cumsum(~good) - np.cumsum(good)).astype(float)
    gain[:-1][np.diff(weight) == 0] = -np.inf
    at = int(gain.argmax())
    return float((weight[at] + weight[min(at + 1, len(weight) - 1)]) / 2) if gain[at] > 0 else -np.inf


def kth_largest(rows: DataFrame, column: str, k: int, most: int = 10_000, bins: int = 4096) -> float:
    """The k-th largest value of *column*: counts in bins, the bin that holds it cut anew, until
    few enough values are left to look at."""
    if k <= 0:
        return np.inf
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return -np.inf
    while True:
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        above = rows.filter(F.col(column) > high).count()
        step = (high - low) / bins
        if low == high or low + step <= low:
            return low
        number = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.b):
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.low, r.high
        if low == high:
            return low
        if r.n <= most:
            values = sorted((x[0] for x in inside.filter((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


@dataclass
class Classifier:
    ratios: Shared
    labels: Shared
    #: Smallest key that is kept.
    cutoff: float


def classifier(docs: DataFrame, labels: DataFrame, most_labels: int = LABELS) -> tuple[Classifier, DataFrame]:
    """The fitted classifier, and (doc_id, weight, key, label) of every document.

    k, the number of documents to draw, is how many weigh more than the cut that parts the labelled
    documents best that the target model has not seen; the k largest keys are drawn (all that tie with the k-th).
    """
    chosen = label_sample(labels, most_labels)
    ratios = fit(docs, chosen)
    rows = stored(scored(docs, ratios, chosen), "weights")
    known = rows.filter("label >= 0").select("weight", "label").toPandas()
    cut = best_cut(known.weight.to_numpy(float), known.label.to_numpy() == 1)
    k = rows.filter(F.col("weight") > F.lit(cut)).count()
    return Classifier(ratios, chosen, kth_largest(rows, "key", k)), rows


def quality(docs: DataFrame, labels: DataFrame, most_labels: int = LABELS) -> DataFrame:
    """(doc_id, weight, key, kept) of every row of *docs* (doc_id, text).

    NULL, empty and blank texts weigh 0, what a text with no evidence weighs. Without labels, or
    with labels of one kind only, every document is kept. Repeated rows get the same key.
    """
    made, rows = classifier(docs, labels, most_labels)
    return rows.select("doc_id", "weight", "key", (F.col("key") >= F.lit(made.cutoff)).alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, most_labels: int = LABELS) -> DataFrame:
    """The documents drawn; all columns stay and no text is shuffled."""
    made, _ = classifier(docs, labels, most_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = texts(part)
            weight = text_weights([split(t) for t in found], made.ratios.value)
            ids = part.column("doc_id").cast(pa.int64()).to_pylist()
            keep = [w + TEMPERATURE * gumbel(i, t) >= made.cutoff for w, i, t in zip(weight, ids, found)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
