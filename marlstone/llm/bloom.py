"""Blocked Bloom filters as tables, in DataFrame functions only.

A filter is a row of ``BLOCK_BITS`` bits (4 KiB) for each block with a bit set. A 64-bit hash (column ``HASH``) chooses its block
by its upper bits and two slots of it by its lower ones. A range of hashes is a range of blocks, so a filter of any
size is probed in segments, each with a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
HASH = "__ms_h"


def block_bits(bits: int) -> int:
    """Bits of a block's number, for a filter of at least so many bits."""
    return max(0, (max(bits, 1) - 1).bit_length() - 15)


def _slots(df: DataFrame, of_block: int) -> DataFrame:
    h = F.col(HASH)
    return df.withColumns(
        {
            "__ms_block": F.shiftrightunsigned(h, 64 - of_block) if of_block else F.lit(0).cast("long"),
            "__ms_p1": h.bitwiseAND(F.lit(BLOCK_BITS - 1)),
            "__ms_p2": F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)),
        }
    )


def exploded(df: DataFrame, of_block: int) -> DataFrame:
    """__ms_block and __ms_p for each slot of each row, twice if they differ."""
    return _slots(df, of_block).select("__ms_block", F.explode(F.array_distinct(F.array("__ms_p1", "__ms_p2"))).alias("__ms_p"))


def bitmaps(slots: DataFrame) -> DataFrame:
    """A filter of slots."""
    return slots.groupBy("__ms_block").agg(F.bitmap_construct_agg("__ms_p").alias("__ms_bits"))


def _is_set(p: str) -> Column:
    byte = F.expr(f"cast(conv(hex(substring(__ms_bits, cast({p} / 8 as int) + 1, 1)), 16, 10) as int)")
    return byte.bitwiseAND(F.expr(f"shiftleft(1, cast({p} % 8 as int))")) != 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_bits(of_block: int, most: int) -> int:
    """Bits of a segment's number, for segments of at most ``most`` bytes (one block at least)."""
    return max(0, min(of_block, of_block + 12 - (max(most, 1).bit_length() - 1)))


def probe(df: DataFrame, filter_: DataFrame, of_block: int, most: int) -> DataFrame:
    """``df`` with ``__ms_maybe``: whether the filter has both slots of the hash. A segment of the filter is broadcast at a time."""
    of_segment, out = segment_bits(of_block, most), None
    for s in range(1 << of_segment):
        part, side = df, filter_
        if of_segment:
            low, wide = s << (64 - of_segment), 1 << (64 - of_segment)
            part = df.where(F.col(HASH).between(F.lit(_signed(low)), F.lit(_signed(low + wide - 1))))
            low, wide = s << (of_block - of_segment), 1 << (of_block - of_segment)
            side = filter_.where(F.col("__ms_block").between(F.lit(low), F.lit(low + wide - 1)))
        joined = _slots(part, of_block).join(F.broadcast(side), "__ms_block", "left")
        one = joined.withColumn("__ms_maybe", F.coalesce(_is_set("__ms_p1") & _is_set("__ms_p2"), F.lit(False))).drop("__ms_block", "__ms_p1", "__ms_p2", "__ms_bits")
        out = one if out is None else out.unionByName(one)
    return out
