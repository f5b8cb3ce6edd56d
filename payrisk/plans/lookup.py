"""Looking at one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def investigate(clean: DataFrame, behavior: DataFrame, transaction_id: int) -> DataFrame:
    """One transaction with its spending history and verdict texts; empty if unknown.

    The id reaches both scans as a filter if both are stored tables; sorted ones are then read
    only where the id can be. Without a stored history, use ``investigate_payment``.
    """
    wanted = F.lit(transaction_id).cast("bigint")
    payment = clean.where(F.col("transaction_id") == wanted).select(
        "transaction_id", "transaction_time", "amount", "use_chip", "merchant_id", "mcc", "has_error", "is_fraud"
    )
    history = behavior.where(F.col("transaction_id") == wanted).select(
        "transaction_id",
        F.round("customer_previous_avg", 2).alias("customer_avg_spend"),
        F.round("card_previous_avg", 2).alias("card_avg_spend"),
        F.round("amount_vs_customer_avg", 2).alias("amount_vs_customer_avg"),
        F.round("amount_vs_card_avg", 2).alias("amount_vs_card_avg"),
    )
    return _verdict(payment.join(history, "transaction_id", "left").limit(1))


def investigate_payment(clean: DataFrame, transaction_id: int) -> DataFrame:
    """The same from the clean table alone: only the payments of the one customer and of the one card are averaged."""
    wanted = F.lit(transaction_id).cast("bigint")
    found = clean.where(F.col("transaction_id") == wanted)
    one = found.select("transaction_id", "transaction_time", "client_id", "card_id", F.abs("amount").alias("size")).first()
    payment = found.select(
        "transaction_id", "transaction_time", "amount", "use_chip", "merchant_id", "mcc", "has_error", "is_fraud"
    ).limit(1)

    def average(key: str) -> float | None:
        """Mean size of the key's payments before this one, by (time, id); a missing key is a key of its own."""
        if one is None:
            return None
        same = F.col(key).isNull() if one[key] is None else F.col(key) == F.lit(one[key])
        time, when = F.col("transaction_time"), one["transaction_time"]
        if when is None:  # such payments come last
            before = time.isNotNull() | (F.col("transaction_id") < wanted)
        else:
            at = F.lit(when).cast("timestamp_ntz")
            before = (time < at) | ((time == at) & (F.col("transaction_id") < wanted))
        return clean.where(same & before).agg(F.avg(F.abs("amount"))).first()[0]

    def shown(value: float | None):
        return F.round(F.lit(value).cast("double"), 2)

    averages = {"customer": average("client_id"), "card": average("card_id")}
    columns = {f"{name}_avg_spend": shown(value) for name, value in averages.items()}
    for name, value in averages.items():
        ratio = one["size"] / value if one and one["size"] is not None and value and value > 0 else None
        columns[f"amount_vs_{name}_avg"] = shown(ratio)
    return _verdict(payment.withColumns(columns))


def _verdict(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "outcome": F.when(F.col("is_fraud") == 1, "FRAUD").otherwise("LEGITIMATE"),
        "error_warning": F.coalesce(F.col("has_error") == 1, F.lit(False)),
    })
