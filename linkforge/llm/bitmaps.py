"""Bounded bitmaps: keeping rows out of a shuffle without a broadcast that grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitting(n: int, most: int = 27) -> int:
    """Bits for a bitmap of n keys, some 16 for each. At most 2 ** 27, which take 32 MB to broadcast; past that it fills up."""
    return max(16, min(most, (16 * max(1, n) - 1).bit_length()))


def bit_filter(keys: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """A bitmap with the bits of all values of the long column `key` set, as rows (_word, _bits).

    It has at most 2 ** bits / 64 rows of 16 bytes whatever the number of keys: a proven bound for a broadcast.
    """
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    return (
        keys.select(slot.alias("_slot"))
        .groupBy((F.col("_slot") / 64).cast("long").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))
    )


def may_be_in(rows: DataFrame, key: str, bitmap: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose long column `key` has its bit set. Some others may be among them; the fuller the bitmap, the more."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    marked = rows.withColumn("_word", (slot / 64).cast("long")).join(F.broadcast(bitmap), "_word")
    return marked.where(F.expr(f"shiftright(_bits, cast(pmod({key}, {1 << bits}) % 64 as int)) & 1L = 1L")).drop("_word", "_bits")


def marked(rows: DataFrame, key: str, bitmap: DataFrame, bits: int, mark: str = "_may") -> DataFrame:
    """All rows with a column that is true where the long column `key` has its bit set."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    out = rows.withColumn("_word", (slot / 64).cast("long")).join(F.broadcast(bitmap), "_word", "left")
    return out.withColumn(mark, F.expr(f"coalesce(shiftright(_bits, cast(pmod({key}, {1 << bits}) % 64 as int)) & 1L, 0L) = 1L")).drop("_word", "_bits")
