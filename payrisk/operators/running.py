"""Running totals that no single task has to compute alone."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payrisk.operators.skew import MAX_GROUP_ROWS, broadcast_if_small
from payrisk.session import store

# Small blocks share a range: ranges of fewer rows than this are made up to so many only.
MIN_RANGE_ROWS, SMALL_RANGES = 250_000, 32
# Bits of ``monotonically_increasing_id`` that number the rows of a task.
PLACE_BITS = 33


def _before(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def prior_totals(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    n_rows: int,
    n_groups: int,
    *,
    descending: bool = False,
    rows_per_block: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``prior_<measure>``: the total over all earlier rows of the same keys.

    The rows are range-partitioned by (keys, order) and numbered in that order, so a
    heavy group is cut into blocks of at most ``rows_per_block`` rows however its key,
    time or score is distributed. Each block's totals are carried into the following
    blocks, and the windows only run inside a block. With whole-number measures the
    result is exact. The blocks are stored once, because the totals and the windows
    must see the same cut. A range is one task and one file; it holds many blocks if
    they are small, so the number of files follows the rows, not the size of a block.
    """
    sort = [_sorted(name, descending) for name in order]
    n_blocks = ceil(n_rows / rows_per_block)
    if n_blocks <= 1:
        window = _before(Window.partitionBy(*keys).orderBy(*sort))
        return rows.withColumns({f"prior_{m}": _or_zero(F.sum(m).over(window)) for m in measures})

    cut = [F.col(k).asc_nulls_last() for k in keys] + sort
    n_ranges = min(n_blocks, max(SMALL_RANGES, ceil(n_rows / max(rows_per_block, MIN_RANGE_ROWS))))
    ranges = rows.repartitionByRange(n_ranges, *cut).sortWithinPartitions(*cut)
    placed = store(ranges.withColumn("_block", _block_number(rows_per_block)), "blocks")

    block_totals = placed.groupBy(*keys, "_block").agg(*[F.sum(m).alias(f"_total_{m}") for m in measures])
    across = _before(Window.partitionBy(*keys).orderBy("_block"))
    carried = block_totals.select(
        *[F.col(k).alias(f"_carry_{k}") for k in keys],
        F.col("_block").alias("_carry_block"),
        *[_or_zero(F.sum(f"_total_{m}").over(across)).alias(f"_carry_{m}") for m in measures],
    )
    # One row per block, and one more for each range and for each group that ends inside a block.
    carried = broadcast_if_small(carried, n_blocks + n_ranges + n_groups)

    inside = _before(Window.partitionBy(*keys, "_block").orderBy(*sort))
    within = placed.withColumns({f"prior_{m}": _or_zero(F.sum(m).over(inside)) for m in measures})
    same = [F.col("_block") == F.col("_carry_block")]
    same += [F.col(k).eqNullSafe(F.col(f"_carry_{k}")) for k in keys]
    joined = within.join(carried, reduce(Column.__and__, same))
    totals = {f"prior_{m}": F.col(f"prior_{m}") + F.col(f"_carry_{m}") for m in measures}
    return joined.withColumns(totals).select(*rows.columns, *totals)


def _block_number(rows_per_block: int) -> Column:
    """Number of a row's block among the rows of all tasks, in their order."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return F.shiftleft(F.spark_partition_id().cast("bigint"), PLACE_BITS) + F.floor(place / F.lit(rows_per_block))


def _sorted(name: str, descending: bool) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def _or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))
