"""Keeping or dropping wide rows by a set of keys, without moving the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize

BROADCAST_BYTES = 128 * 1024 * 1024
#: Bits of one filter; its bitmaps come to 16 MB, however many keys there are.
FILTER_BITS = 1 << 27


def _place(key: str, level: int, bits: int) -> Column:
    """Place from 1 of a key's bit in the filter of a level."""
    return F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits)) + 1


def _with_bit(rows: DataFrame, key: str, bitmap: DataFrame, level: int, bits: int) -> DataFrame:
    """*rows* with whether the key's bit of that level is set. The bitmaps are broadcast."""
    name = f"_in{level}"
    place = F.bitmap_bit_position(_place(key, level, bits))
    byte = F.conv(F.hex(F.substr("_bitmap", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    on = bitmap.withColumnRenamed("_bucket", f"_bucket{level}")
    joined = rows.withColumn(f"_at{level}", F.bitmap_bucket_number(_place(key, level, bits)))
    joined = joined.join(F.broadcast(on), F.col(f"_at{level}") == F.col(f"_bucket{level}"), "left")
    return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_bitmap", f"_bucket{level}", f"_at{level}")


def _bitmap(keys: DataFrame, level: int, bits: int) -> DataFrame:
    place = _place("key", level, bits)
    made = keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap"))
    return materialize(made, "filter")


def filters(listed: DataFrame, others: DataFrame, bits: int = FILTER_BITS) -> tuple[list[DataFrame], bool]:
    """Bitmaps that together tell the keys of *listed* from those of *others* (one column ``key``),
    and whether they do so exactly.

    The first is of the listed keys; the second of the other keys that it takes for listed, the third
    of listed keys that the second takes for one of these, and so on until none is taken wrongly. Where
    a level would have more keys than half the bits, the first one is all there is.
    """
    made: list[DataFrame] = []
    inside, outside = listed, others
    while True:
        level = len(made)
        made.append(_bitmap(inside, level, bits))
        wrong = materialize(_with_bit(outside, "key", made[-1], level, bits).filter(f"_in{level}").select("key"), "taken-wrongly")
        count = wrong.count()
        if count == 0:
            return made, True
        if count > bits // 2:
            return made[:1], False
        inside, outside = wrong, inside


def by_keys(rows: DataFrame, column: str, keys: DataFrame, keep: bool, key_bytes: int, limit_bytes: int = BROADCAST_BYTES, bits: int = FILTER_BITS) -> DataFrame:
    """*rows* whose *column* is among *keys* (one column; ``keep=True``), or the others.

    The keys are written out and counted. As long as they are small they are broadcast; beyond that
    the rows are told apart by a chain of filters of fixed size, which is exact: what the chain was
    built against are the rows' own keys, read without the rest of the row. Either way the rows stay
    where they are. With so many keys that a chain of that size can't tell them apart, rows that the
    first filter lets through are joined; the others stay. A NULL key is never among the keys.
    """
    name = keys.columns[0]
    listed = materialize(keys.select(F.col(name).alias("key")).filter("key IS NOT NULL").distinct(), "keys")
    if listed.count() * key_bytes <= limit_bytes:
        small = F.broadcast(listed.withColumnRenamed("key", "_key"))
        return rows.join(small, F.col(column) == F.col("_key"), "left_semi" if keep else "left_anti")
    own = rows.select(F.col(column).alias("key")).filter("key IS NOT NULL").distinct()
    others = materialize(own.join(listed, "key", "left_anti"), "other-keys")
    told, found = rows, F.lit(False)
    chain, exact = filters(listed, others, bits)
    if not exact:
        told = _with_bit(rows, column, chain[0], 0, bits)
        maybe = told.filter("_in0").join(listed, F.col(column) == listed.key, "left_semi" if keep else "left_anti").select(*rows.columns)
        return maybe if keep else maybe.unionAll(told.filter("NOT _in0").select(*rows.columns))
    for level, bitmap in enumerate(chain):
        told = _with_bit(told, column, bitmap, level, bits)
    for level in reversed(range(len(chain))):
        found = F.col(f"_in{level}") & ~found
    found = found & F.col(column).isNotNull()
    return told.filter(found if keep else ~found).select(*rows.columns)
