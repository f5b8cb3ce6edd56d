"""Cutting the model matrix into past and future, and sampling it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.operators.quantiles import DIRECT_VALUES, exact_quantiles

# Where the splits lie in time, and how many of 100 buckets are kept.
RECENT_START, TEST_START = 0.60, 0.80
BASELINE_TRAIN_PERCENT, RECENT_TRAIN_PERCENT, TEST_PERCENT = 15, 35, 25


def time_quantiles(clean: DataFrame, fractions: dict[str, float], *, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """One row: the time below which each fraction of the transactions lies.

    Computed on microseconds and rounded to the nearest one.
    """
    micros = clean.select(c.epoch_micros(F.col("transaction_time")).alias("micros"))
    found = exact_quantiles(
        micros, {name: ("micros", fraction) for name, fraction in fractions.items()}, direct_values=direct_values
    )
    return found.select(*[c.from_epoch_micros(F.round(name).cast("bigint")).alias(name) for name in fractions])


def time_cutoffs(clean: DataFrame, *, direct_values: int = DIRECT_VALUES) -> tuple[datetime, datetime]:
    """(start of the recent window, start of the test period), as two plain values."""
    wanted = {"recent_start": RECENT_START, "test_start": TEST_START}
    row = time_quantiles(clean, wanted, direct_values=direct_values).first()
    return row["recent_start"], row["test_start"]


def sample(matrix: DataFrame, percent: int, method: str = "xxhash64") -> DataFrame:
    """Repeatable sample by transaction id: a smaller percent is a subset of a larger one."""
    return matrix.where(c.hash_bucket(F.col("transaction_id"), method) < percent)


def baseline_train(matrix: DataFrame, cutoff, method: str = "xxhash64") -> DataFrame:
    past = matrix.where(F.col("transaction_time") < c.time_literal(cutoff))
    return sample(past, BASELINE_TRAIN_PERCENT, method)


def recent_train(matrix: DataFrame, start, end, method: str = "xxhash64") -> DataFrame:
    time = F.col("transaction_time")
    return sample(matrix.where((time >= c.time_literal(start)) & (time < c.time_literal(end))), RECENT_TRAIN_PERCENT, method)


def future_test(matrix: DataFrame, cutoff, method: str = "xxhash64") -> DataFrame:
    future = matrix.where(F.col("transaction_time") >= c.time_literal(cutoff))
    return sample(future, TEST_PERCENT, method)


def split_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("fraud_cases"))
