"""Average of a key's earlier payments, seen from each payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payrisk.operators.running import prior_totals
from payrisk.operators.skew import MAX_GROUP_ROWS, HotKeys, apart

ORDER = ["transaction_time", "transaction_id"]

# A double holds whole numbers up to this one; and how far it may be from a whole number of units, relatively.
MAX_UNITS, UNIT_ERROR = float(1 << 53), 1e-12


def add_prior_average(
    df: DataFrame,
    key: str,
    output: str,
    *,
    decimals: int | None = None,
    hot: HotKeys | None = None,
    rows_per_block: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``output``: mean absolute amount over the key's payments strictly before this one.

    Payments are ordered by (time, id); those without an amount are skipped; the
    first one of a key has no average. Amounts are averaged as doubles. Given ``decimals``, they
    are summed as whole units of so many decimals, which is exact and independent of how rows are
    spread over tasks; an amount that has more decimals, or is too large for it, fails the run.

    Keys in ``hot`` hold more rows than one task should see; they are cut into
    blocks, all other keys use one window.
    """
    return apart(
        df,
        hot,
        lambda rows: prior_average(rows, key, output, decimals),
        lambda rows: prior_average_in_blocks(rows, key, output, decimals, hot, rows_per_block),
    )


def prior_average(df: DataFrame, key: str, output: str, decimals: int | None = None) -> DataFrame:
    """One window per key."""
    earlier = (
        Window.partitionBy(key)
        .orderBy(*[F.col(name).asc_nulls_last() for name in ORDER])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total, count = F.sum("_size").over(earlier), F.count("_size").over(earlier)
    return sized(df, decimals).withColumn(output, average_of(total, count, decimals)).drop("_size")


def prior_average_in_blocks(
    df: DataFrame, key: str, output: str, decimals: int | None, hot: HotKeys, rows_per_block: int = MAX_GROUP_ROWS
) -> DataFrame:
    """The same for rows of heavy keys only, however many rows each of them has."""
    counted = sized(df, decimals).withColumn("_one", F.col("_size").isNotNull().cast("bigint"))
    totals = prior_totals(
        counted, [key], ORDER, ["_size", "_one"], hot.n_rows, hot.n_keys, rows_per_block=rows_per_block
    )
    average = average_of(F.col("prior__size"), F.col("prior__one"), decimals)
    return totals.withColumn(output, average).drop("_size", "_one", "prior__size", "prior__one")


def sized(df: DataFrame, decimals: int | None) -> DataFrame:
    """Adds ``_size``, what is summed: the absolute amount, or whole units of it."""
    if decimals is None:
        return df.withColumn("_size", F.col("absolute_amount").cast("double"))
    amount = F.col("absolute_amount").cast("double")
    scaled = amount * F.lit(float(10**decimals))
    units = F.round(scaled)
    fits = (F.abs(scaled - units) <= F.lit(UNIT_ERROR) * F.greatest(units, F.lit(1.0))) & (units < F.lit(MAX_UNITS))
    refused = F.raise_error(F.concat(F.lit(f"an amount does not have {decimals} decimals or is too large: "), amount))
    exact = F.when(amount.isNull(), F.lit(None)).when(fits, units.cast("bigint")).otherwise(refused.cast("bigint"))
    return df.withColumn("_size", exact)


def average_of(total: Column, count: Column, decimals: int | None) -> Column:
    """Average amount from a total of sizes."""
    mean = total.cast("double") / count
    if decimals is not None:
        mean = mean / F.lit(float(10**decimals))
    return F.when(count > 0, mean)
