"""All fraud-rate reports from one scan of the clean table.

One aggregate over grouping sets counts payments and frauds by method, error flag, hour, weekday, month, category, period, period and
method, and over all. The counts are combined inside each task, so what is shuffled is a row per group and task. The stored result has
as many rows as there are groups, and every report is a selection from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.plans.reports import MIN_CATEGORY_TRANSACTIONS

KEYS = {
    "use_chip": "string", "has_error": "bigint", "transaction_hour": "bigint", "day_of_week": "bigint",
    "month": "timestamp_ntz", "mcc": "int", "dataset": "string",
}
# The groupings, by name. The last two need a cut-off.
GROUPINGS = {
    "overall": [], "method": ["use_chip"], "error": ["has_error"], "hour": ["transaction_hour"], "weekday": ["day_of_week"],
    "month": ["month"], "category": ["mcc"], "period": ["dataset"], "period_method": ["dataset", "use_chip"],
}


def fraud_cube(clean: DataFrame, cutoff=None) -> DataFrame:
    """(grouping, its keys, transactions, fraud_transactions), one row per group of each grouping.

    Keys that a grouping does not have are null; a null key that it has is a group like any other. ``cutoff`` is the time that splits
    periods; without one there are no groupings by period.
    """
    wanted = {n: keys for n, keys in GROUPINGS.items() if cutoff is not None or "dataset" not in keys}
    rows = clean.select(
        "use_chip", "has_error", "transaction_hour", "day_of_week",
        c.month_start(F.col("transaction_time")).alias("month"), "mcc",
        (F.lit(None).cast("string") if cutoff is None else c.period(F.col("transaction_time"), cutoff)).alias("dataset"), "is_fraud",
    )
    names = list(KEYS)
    grouped = rows.groupingSets([[F.col(k) for k in keys] for keys in wanted.values()], *names).agg(
        F.grouping_id(*names).alias("_id"), F.count(F.lit(1)).alias("transactions"), F.sum("is_fraud").alias("fraud_transactions")
    )
    name: Column | None = None
    for label, keys in wanted.items():
        # A bit of the id is set where the key is left out; the first key has the highest.
        number = sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in keys)
        same = F.col("_id") == number
        name = F.when(same, label) if name is None else name.when(same, label)
    return grouped.select(
        name.alias("grouping"), *[F.col(k).cast(t).alias(k) for k, t in KEYS.items()], "transactions", "fraud_transactions"
    )


def _rows(cube: DataFrame, grouping: str) -> DataFrame:
    return cube.where(F.col("grouping") == grouping)


def _rate() -> Column:
    return c.percent(F.col("fraud_transactions"), F.col("transactions"))


def overall_rate(cube: DataFrame, n: str = "transactions", rate: str = "fraud_rate_pct") -> DataFrame:
    return _rows(cube, "overall").select(F.col("transactions").alias(n), "fraud_transactions", _rate().alias(rate))


def rate_by(cube: DataFrame, grouping: str) -> DataFrame:
    """Rate per value of the one key of ``grouping``, in key order."""
    (key,) = GROUPINGS[grouping]
    found = _rows(cube, grouping).select(key, "transactions", "fraud_transactions", _rate().alias("fraud_rate_pct"))
    return found.orderBy(F.col(key).asc_nulls_last())


def rate_by_payment_method(cube: DataFrame) -> DataFrame:
    return rate_by(cube, "method").orderBy(F.col("transactions").desc_nulls_last(), F.col("use_chip").asc_nulls_last())


def payment_method_rates(cube: DataFrame) -> DataFrame:
    found = _rows(cube, "method").select(
        c.method_label(F.col("use_chip")).alias("payment_method"), _rate().alias("fraud_rate_percent")
    )
    return found.orderBy(F.col("fraud_rate_percent").desc_nulls_last(), F.col("payment_method").asc_nulls_last())


def rate_by_month(cube: DataFrame) -> DataFrame:
    return rate_by(cube, "month").select("month", F.col("fraud_rate_pct").alias("fraud_rate_percent"))


def high_risk_categories(
    cube: DataFrame, top: int = 15, min_transactions: int = MIN_CATEGORY_TRANSACTIONS, rate: str = "fraud_rate_pct"
) -> DataFrame:
    """Riskiest merchant categories with enough transactions; the lower code wins a tie."""
    known = _rows(cube, "category").where(F.col("transactions") >= min_transactions)
    ranked = known.select("mcc", "transactions", "fraud_transactions", _rate().alias(rate))
    return ranked.orderBy(F.col(rate).desc_nulls_last(), F.col("mcc").asc_nulls_last()).limit(top)


def drift_overall(cube: DataFrame) -> DataFrame:
    return rate_by(cube, "period").withColumnRenamed("fraud_transactions", "fraud")


def drift_by_payment_method(cube: DataFrame) -> DataFrame:
    found = _rows(cube, "period_method").select(
        "dataset", "use_chip", "transactions", F.col("fraud_transactions").alias("fraud"), _rate().alias("fraud_rate_pct")
    )
    return found.orderBy("dataset", F.col("fraud_rate_pct").desc_nulls_last(), F.col("use_chip").asc_nulls_last())
