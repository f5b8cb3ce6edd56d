"""Sets of whole-number ids as bitmaps, and look-ups in them without shuffling the rows that look.

An id belongs to a bucket of 32,768 ids and is one bit of that bucket's 4 KiB. Dense ids therefore take about a bit each, and a hundred million of
them 12 MB: small enough to be sent to every task, after counting the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets of 4 KiB that may be broadcast: 64 MiB, some 540 million dense ids.
MAX_BUCKETS = 16_384


def id_bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """(bucket, bits) of the ids in ``column``; missing ones are left out, repeated ones count once."""
    value = F.col(column).cast("bigint")
    return (
        ids.where(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(value).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    )


def _has_bit(bits: Column, value: Column) -> Column:
    position = F.bitmap_bit_position(value)
    byte = F.substring(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) == 1


def with_found(rows: DataFrame, bitmaps: DataFrame, column: str, found: str, max_buckets: int = MAX_BUCKETS) -> DataFrame | None:
    """``rows`` with ``found``: whether ``column`` is among the ids of stored ``bitmaps``. A missing value is not.

    The bitmaps are broadcast. If ids are so sparse that there are more than ``max_buckets`` buckets, there is no result: None.
    """
    if bitmaps.count() > max_buckets:
        return None
    value = F.col(column).cast("bigint")
    named = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    joined = rows.join(F.broadcast(named), F.bitmap_bucket_number(value) == F.col("_bucket"), "left")
    is_in = F.coalesce(F.when(F.col("_bits").isNotNull(), _has_bit(F.col("_bits"), value)), F.lit(False))
    return joined.withColumn(found, is_in).drop("_bucket", "_bits")
