"""Links inside buckets without writing out all pairs, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import dropped, stored
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

LINKS = "u long, v long"

#: near(i, others) of a bucket's payloads: which of the positions `others` are linked to position i.
Near = Callable[[int, np.ndarray], np.ndarray]


def spanning_links(near: Near, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the link graph on positions 0..n-1.

    Breadth first; each position is compared only with those not reached yet, and what comes out
    is at most n - 1 links however dense the group is.
    """
    links, rest = [], np.arange(n)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit].tolist()
                links += [(i, j) for j in found]
                todo += found
                rest = rest[~hit]
    return links


def links_together(near: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`spanning_links` gives for each of many runs, as rows: every step compares a row of
    each run that is not done yet. near(i, j): which rows i and j are linked, pair by pair."""
    us, vs = [], []
    work = [([s], np.arange(s + 1, s + n)) for s, n in zip(starts, sizes) if n > 1]
    while work:
        counts = [len(rest) for _, rest in work]
        i, j = np.repeat([todo.pop() for todo, _ in work], counts), np.concatenate([rest for _, rest in work])
        hit = near(i, j)
        us.append(i[hit])
        vs.append(j[hit])
        after, end = [], 0
        for (todo, rest), n in zip(work, counts):
            own = hit[end : end + n]
            end += n
            if own.any():
                todo += rest[own].tolist()
                rest = rest[~own]
            if not todo and len(rest):
                todo, rest = [int(rest[0])], rest[1:]
            if len(rest):
                after.append((todo, rest))
        work = after
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def linked_runs(
    prepare: Callable[[pa.Table], Near],
    pair: Callable[[pa.Table, np.ndarray], np.ndarray] | None = None,
    rows: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
    few: int = 2,
):
    """For `mapInArrow` over rows sorted by `bucket`: links (u, v) between ids of equal buckets.

    *prepare* gives the comparison for a run of one bucket. *pair*, if given, decides runs of two
    rows together: for positions i it tells whether rows i and i + 1 are linked. *rows*, if given, does
    so for rows i and j of a table; with it runs of up to *few* rows are compared together.
    """

    def of_runs(table: pa.Table) -> pa.RecordBatch:
        bucket, ids = table["bucket"].to_numpy(), table["id"].to_numpy()
        edges = np.flatnonzero(np.diff(bucket)) + 1
        starts = np.concatenate(([0], edges))
        sizes = np.diff(np.concatenate((starts, [len(bucket)])))
        us, vs = [], []
        twos = starts[sizes == 2]
        if pair is not None and len(twos):
            twos = twos[pair(table, twos)]
            us.append(ids[twos])
            vs.append(ids[twos + 1])
        mid = (sizes > 2) & (sizes <= few) if rows is not None else np.zeros(len(sizes), bool)
        if mid.any():
            i, j = links_together(rows(table), starts[mid].tolist(), sizes[mid].tolist())
            us.append(ids[i])
            vs.append(ids[j])
        for start, size in zip(starts[~mid], sizes[~mid]):
            if size > 2 or size == 2 and pair is None:
                made = spanning_links(prepare(table.slice(start, size)), int(size))
                if made:
                    at = np.array(made) + start
                    us.append(ids[at[:, 0]])
                    vs.append(ids[at[:, 1]])
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *us])), pa.array(np.concatenate([none, *vs]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last run may go on in the next batch
            if last or held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
                yield of_runs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield of_runs(pa.Table.from_batches(held))

    return run


def bucket_links(rows: DataFrame, run, largest: int) -> DataFrame:
    """Distinct links (u < v) found by *run* inside the buckets of *rows* (bucket long, id long, ...).

    A bucket of more than *largest* rows is dealt into chunks of about half of that, and every pair
    of chunks is a bucket of its own: no comparison is lost, no task holds more than *largest* rows
    of a bucket at a time, and one hot bucket spreads over many tasks.
    """
    large = stored(rows.groupBy("bucket").count().filter(F.col("count") > largest), "large-buckets")
    counted = large.select("bucket", F.ceil(F.col("count") * 2.5 / largest).cast("int").alias("chunks"))
    usual = rows.join(large.select("bucket"), "bucket", "left_anti")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = (
        rows.join(counted, "bucket")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("bucket", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
        .select(rows.columns)
    )
    parts = [usual] if large.isEmpty() else [usual, dealt]
    found = [p.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, LINKS) for p in parts]
    links = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node reachable from it.

    Distributed union-find by alternating star contraction: each round hangs the neighbours of a
    node on the smallest of them, first the larger ones, then the smaller ones, until nothing
    changes; rounds grow with the logarithm of the longest chain. Links (u long, v long) must not
    be NULL; links of a node to itself and repeated ones are ignored; no link gives no row.
    """
    spark = links.sparkSession
    now = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(larger, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = stored(smaller.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(large)
        dropped(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots) if seen[0] else spark.createDataFrame([], "node long, root long")
