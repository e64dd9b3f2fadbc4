"""Packing: optimal length buckets and token-budget batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.tables import stored

#: Buckets, and tokens of a batch with its padding.
BUCKETS = 16
BUDGET = 32_768
#: Lengths up to this are bins of their own; longer ones share a bin within 1 part in 2,048. So a
#: histogram never has more than about 110,000 bins.
EXACT = 4_096
#: Rows of one slot, about; ranks are counted within slots and added up over them.
SLOT_ROWS = 50_000


def word_tokens(text: str = "text") -> Column:
    """Words (runs of anything but ASCII white space) and one end mark; NULL text is the end mark."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def length_bin(n: Column) -> Column:
    """The number that the bin of length *n* goes by."""
    step = F.greatest(F.lit(0), F.floor(F.log2(n)).cast("int") - 11)
    return F.when(n <= EXACT, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, step), step))


def optimal_borders(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper borders of at most *buckets* buckets with the least padding in all.

    *histogram* holds (longest length, count) in rising order. With N(j) documents up to length
    L(j), the padded size is least(k, j) = min over i of least(k - 1, i) + (N(j) - N(i)) L(j): lines
    of falling slope -N(i) asked at rising L(j), so a hull of lines answers each step in turn.
    """
    lengths = [n for n, _ in histogram]
    if not lengths:
        return []
    total, sums = 0, [0]
    for _, c in histogram:
        total += c
        sums.append(total)
    m, k = len(lengths), min(buckets, len(lengths))
    cost = [0] + [sums[j] * lengths[j - 1] for j in range(1, m + 1)]
    chosen: list[list[int]] = [[0] * (m + 1)]
    for used in range(2, k + 1):
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, border
        ahead, new, pick = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(used, m + 1):
            line = (-sums[j - 1], cost[j - 1], j - 1)
            while len(hull) - ahead >= 2 and _hidden(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
            x = lengths[j - 1]
            while len(hull) - ahead >= 2 and hull[ahead + 1][0] * x + hull[ahead + 1][1] <= hull[ahead][0] * x + hull[ahead][1]:
                ahead += 1
            slope, value, pick[j] = hull[ahead]
            new[j] = slope * x + value + sums[j] * x
        cost = new
        chosen.append(pick)
    borders, j = [], m
    for pick in reversed(chosen):
        borders.append(lengths[j - 1])
        j = pick[j]
    return borders[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere lowest between a and c (slopes fall)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, place, padding) of every row.

    Buckets are numbered from 0 by length; a batch of a bucket holds as many documents, padded to
    bucket_len, as fit the budget (one, if bucket_len exceeds it: no document is cut). Within a
    bucket documents are numbered slot by slot (a slot is a hash of the row), then by doc_id and
    text hash; NULL ids come first; rows that agree in all of it stand side by side. An empty table
    gives no row. *length* is the token count, by default :func:`word_tokens`.
    """
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), (word_tokens() if length is None else length).cast("long").alias("n_tokens")
    )
    rows = stored(counted, "lengths")
    bins = rows.groupBy(length_bin(F.greatest("n_tokens", F.lit(1))).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"))
    histogram = sorted((r.longest, r.n) for r in bins.collect())
    borders = optimal_borders(histogram, buckets)
    slots = max(1, -(-sum(n for _, n in histogram) // slot_rows))
    bucket = F.lit(0)
    for border in borders[:-1]:
        bucket = bucket + (F.col("n_tokens") > border).cast("int")
    placed = rows.withColumns({"bucket": bucket, "slot": F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(slots)).cast("int")})
    sizes = placed.groupBy("bucket", "slot").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "slot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("doc_id", "text_hash", "n_tokens")) - 1
    ranked = placed.withColumn("within", within).join(offsets, ["bucket", "slot"]).withColumn("rank", F.col("offset") + F.col("within"))
    edge = F.element_at(F.array(*map(F.lit, borders or [1])).cast(T.ArrayType(T.LongType())), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (
        ranked.withColumn("bucket_len", edge)
        .withColumn("fits", fits)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("rank") / F.col("fits")).cast("long").alias("batch"),
            (F.col("rank") % F.col("fits")).cast("long").alias("place"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
