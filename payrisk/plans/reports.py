"""Fraud-rate reports, amount statistics and drift over the clean table.

Every report is one grouped aggregate over few columns: counts are combined
inside each task, so a heavy group costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.operators.quantiles import DIRECT_VALUES, exact_quantiles

MIN_CATEGORY_TRANSACTIONS = 10_000


def rate_columns(n: str = "transactions", fraud: str = "fraud_transactions", rate: str = "fraud_rate_pct"):
    total, frauds = F.count(F.lit(1)), F.sum("is_fraud")
    return [total.alias(n), frauds.alias(fraud), c.percent(frauds, total).alias(rate)]


def overall_rate(clean: DataFrame, rate: str = "fraud_rate_pct") -> DataFrame:
    return clean.agg(*rate_columns(rate=rate))


def dashboard_summary(clean: DataFrame) -> DataFrame:
    return clean.agg(*rate_columns(n="total_transactions", rate="fraud_rate"))


def rate_by(clean: DataFrame, key: str) -> DataFrame:
    """Rate per value of ``key``, in key order."""
    return clean.groupBy(key).agg(*rate_columns()).orderBy(F.col(key).asc_nulls_last())


def rate_by_payment_method(clean: DataFrame) -> DataFrame:
    """Busiest method first."""
    grouped = clean.groupBy("use_chip").agg(*rate_columns())
    return grouped.orderBy(F.col("transactions").desc_nulls_last(), F.col("use_chip").asc_nulls_last())


def payment_method_rates(clean: DataFrame) -> DataFrame:
    """Riskiest method first, under its short name. Grouping is by the raw value."""
    rate = c.percent(F.sum("is_fraud"), F.count(F.lit(1))).alias("fraud_rate_percent")
    grouped = clean.groupBy("use_chip").agg(rate)
    named = grouped.select(c.method_label(F.col("use_chip")).alias("payment_method"), "fraud_rate_percent")
    return named.orderBy(F.col("fraud_rate_percent").desc_nulls_last(), F.col("payment_method").asc_nulls_last())


def rate_by_month(clean: DataFrame) -> DataFrame:
    rate = c.percent(F.sum("is_fraud"), F.count(F.lit(1))).alias("fraud_rate_percent")
    monthly = clean.groupBy(c.month_start(F.col("transaction_time")).alias("month")).agg(rate)
    return monthly.orderBy(F.col("month").asc_nulls_last())


def high_risk_categories(
    clean: DataFrame,
    top: int = 15,
    min_transactions: int = MIN_CATEGORY_TRANSACTIONS,
    rate: str = "fraud_rate_pct",
) -> DataFrame:
    """Riskiest merchant categories with enough transactions; the lower code wins a tie."""
    grouped = clean.groupBy("mcc").agg(*rate_columns(rate=rate)).where(F.col("transactions") >= min_transactions)
    return grouped.orderBy(F.col(rate).desc_nulls_last(), F.col("mcc").asc_nulls_last()).limit(top)


def describe_categories(ranked: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the description of each code; unknown codes get NULL. Spark picks the join by the sizes it finds."""
    by_code = categories.withColumnRenamed("mcc", "_code")
    return ranked.join(by_code, F.col("mcc").cast("string") == F.col("_code"), "left").drop("_code")


def high_risk_category_table(
    clean: DataFrame, categories: DataFrame, top: int = 10, min_transactions: int = MIN_CATEGORY_TRANSACTIONS
) -> DataFrame:
    ranked = high_risk_categories(clean, top, min_transactions, rate="fraud_rate_percent")
    described = describe_categories(ranked, categories)
    return described.orderBy(F.col("fraud_rate_percent").desc_nulls_last(), F.col("mcc").asc_nulls_last())


def amount_by_label(clean: DataFrame, *, direct_values: int = DIRECT_VALUES) -> DataFrame:
    known = clean.where(F.col("amount").isNotNull()).select("is_fraud", "amount")
    plain = known.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.round(F.avg("amount"), 2).alias("average_amount"),
        F.round(F.min("amount"), 2).alias("minimum_amount"),
        F.round(F.max("amount"), 2).alias("maximum_amount"),
    )
    medians = exact_quantiles(known, {"median_amount": ("amount", 0.5)}, ["is_fraud"], direct_values=direct_values)
    return _with_medians(plain, medians, ["is_fraud"]).select(
        "is_fraud", "transactions", "average_amount", "median_amount", "minimum_amount", "maximum_amount"
    )


def ratio_by_label(basic: DataFrame, behavior: DataFrame, *, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Median of both spending ratios by label, over payments that have both."""
    has_both = F.col("amount_vs_customer_avg").isNotNull() & F.col("amount_vs_card_avg").isNotNull()
    joined = basic.select("transaction_id", "is_fraud").join(behavior.where(has_both), "transaction_id")
    wanted = {
        "median_vs_customer_avg": ("amount_vs_customer_avg", 0.5),
        "median_vs_card_avg": ("amount_vs_card_avg", 0.5),
    }
    medians = exact_quantiles(joined, wanted, ["is_fraud"], direct_values=direct_values)
    rounded = medians.select("is_fraud", *[F.round(name, 2).alias(name) for name in wanted])
    return rounded.orderBy(F.col("is_fraud").asc_nulls_last())


def drift_overall(clean: DataFrame, cutoff) -> DataFrame:
    dataset = c.period(F.col("transaction_time"), cutoff).alias("dataset")
    return clean.groupBy(dataset).agg(*rate_columns(fraud="fraud")).orderBy("dataset")


def drift_by_payment_method(clean: DataFrame, cutoff) -> DataFrame:
    dataset = c.period(F.col("transaction_time"), cutoff).alias("dataset")
    grouped = clean.groupBy(dataset, "use_chip").agg(*rate_columns(fraud="fraud"))
    return grouped.orderBy("dataset", F.col("fraud_rate_pct").desc_nulls_last(), F.col("use_chip").asc_nulls_last())


def drift_of_amount(clean: DataFrame, cutoff, *, direct_values: int = DIRECT_VALUES) -> DataFrame:
    sized = clean.select(
        c.period(F.col("transaction_time"), cutoff).alias("dataset"), "is_fraud", F.abs("amount").alias("size")
    )
    keys = ["dataset", "is_fraud"]
    plain = sized.groupBy(*keys).agg(F.round(F.avg("size"), 2).alias("avg_amount"))
    medians = exact_quantiles(sized, {"median_amount": ("size", 0.5)}, keys, direct_values=direct_values)
    return _with_medians(plain, medians, keys).select(*keys, "avg_amount", "median_amount")


def _with_medians(plain: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides hold one row per group, of which there are a handful."""
    found = medians.select(*[F.col(k).alias(f"_{k}") for k in keys], F.round("median_amount", 2).alias("median_amount"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return plain.join(found, on, "left").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
