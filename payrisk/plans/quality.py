"""Checks of the tables and of how they connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.operators.bitmaps import MAX_BUCKETS, id_bitmaps, with_found
from payrisk.operators.skew import MAX_GROUP_ROWS, find_hot_keys_of, left_lookups
from payrisk.plans.tables import labelled
from payrisk.session import store
from payrisk.sources.files import preview


def joined_label_check(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled(transactions, labels).agg(
        F.count(F.lit(1)).alias("joined_transactions"), F.sum("is_fraud").alias("fraudulent_transactions")
    )


def feature_table_check(basic: DataFrame) -> DataFrame:
    return basic.agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("fraud_transactions"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Yes and No are counted on their own; the rate is of Yes among all labels."""
    total, fraud = F.count(F.lit(1)), F.count_if(F.col("label") == "Yes")
    return labels.agg(
        total.alias("total"),
        F.count_if(F.col("label") == "No").alias("legitimate"),
        fraud.alias("fraud"),
        c.percent(fraud, total).alias("fraud_rate_pct"),
    )


def fraud_ids(labels: DataFrame, n: int = 10) -> DataFrame:
    return preview(labels.where(F.col("label") == "Yes").select("transaction_id"), "transaction_id", n)


def fraud_examples(transactions: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """Raw columns of the first fraudulent transactions; only their labels are joined."""
    return preview(labelled(transactions, labels.where(F.col("is_fraud") == 1)), "id", n)


def join_coverage(
    clean: DataFrame, cards: DataFrame, users: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """How many transactions find their card and their customer.

    Transactions are first counted per (card, customer), so a busy card enters
    the joins as one row per customer, not as all its transactions. Pairs of a card with very many customers, or of none, do
    not shuffle.
    """
    pairs = store(clean.groupBy("card_id", "client_id").agg(F.count(F.lit(1)).alias("n")), "pairs")
    card_ids = cards.select(F.col("id").alias("found_card"))
    user_ids = users.select(F.col("id").alias("found_user"))
    hot = find_hot_keys_of(pairs, ["card_id", "client_id"], max_group_rows)
    joined = left_lookups(pairs, [(card_ids, "card_id", "found_card"), (user_ids, "client_id", "found_user")], hot)

    def rows_with(found: Column) -> Column:
        return F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0).cast("bigint"))

    return joined.agg(
        rows_with(F.lit(True)).alias("total_transactions"),
        rows_with(F.col("found_card").isNotNull()).alias("card_matches"),
        rows_with(F.col("found_user").isNotNull()).alias("customer_matches"),
    )


def join_coverage_by_bitmaps(clean: DataFrame, cards: DataFrame, users: DataFrame, *, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """The same coverage from bitmaps of the card and customer ids: the transactions are read once and do not shuffle.

    Each transaction counts once, also if a card or customer is listed repeatedly. Ids too sparse for bitmaps go through joins.
    """
    sides = [(cards, "card_id", "has_card"), (users, "client_id", "has_user")]
    found = clean.select("card_id", "client_id")
    for lookup, column, name in sides:
        bitmaps = store(id_bitmaps(lookup, "id"), "id-bitmaps")
        found = with_found(found, bitmaps, column, name, max_buckets)
        if found is None:
            return join_coverage(clean, cards.select("id").distinct(), users.select("id").distinct())
    return found.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("has_card").alias("card_matches"),
        F.count_if("has_user").alias("customer_matches"),
    )


def connected_transactions(
    clean: DataFrame, cards: DataFrame, users: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Transactions beside the raw attributes of their card and customer."""
    card_side = cards.select(
        F.col("id").alias("found_card"), "card_brand", "card_type", "credit_limit", "has_chip", "card_on_dark_web"
    )
    user_side = users.select(F.col("id").alias("found_user"), "credit_score", "yearly_income")
    hot = find_hot_keys_of(clean, ["card_id", "client_id"], max_group_rows)
    payments = clean.select("transaction_id", "amount", "use_chip", "client_id", "card_id")
    lookups = [(card_side, "card_id", "found_card"), (user_side, "client_id", "found_user")]
    return left_lookups(payments, lookups, hot).select(
        "transaction_id", "amount", "use_chip", "client_id", F.col("found_card").alias("card_id"),
        "card_brand", "card_type", "credit_limit", "has_chip", "card_on_dark_web",
        "credit_score", "yearly_income",
    )


def connected_preview(clean: DataFrame, cards: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The first rows are chosen before the joins, which then only see those."""
    first = preview(clean.select("transaction_id", "amount", "use_chip", "client_id", "card_id"), "transaction_id", n)
    return preview(connected_transactions(first, cards, users), "transaction_id", n)


def clean_preview(clean: DataFrame, n: int = 10) -> DataFrame:
    shown = [
        "transaction_id", "transaction_time", "amount", "use_chip", "merchant_id",
        "transaction_hour", "day_of_week", "has_error", "is_fraud",
    ]
    return preview(clean.select(*shown), "transaction_id", n)


def feature_preview(basic: DataFrame, n: int = 10) -> DataFrame:
    shown = [
        "transaction_id", "amount", "is_online", "is_chip", "is_swipe", "has_error", "card_on_dark_web",
        "credit_limit", F.round("amount_to_credit_limit", 3).alias("amount_to_credit_limit"),
        "credit_score", "yearly_income", "is_fraud",
    ]
    return preview(basic.select(*shown), "transaction_id", n)


def behavior_preview(behavior: DataFrame, n: int = 10) -> DataFrame:
    known = behavior.where(F.col("customer_previous_avg").isNotNull())
    averages = [name for name in behavior.columns if name != "transaction_id"]
    shown = known.select("transaction_id", *[F.round(name, 2).alias(name) for name in averages])
    return preview(shown, "transaction_id", n)
