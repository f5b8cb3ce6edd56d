"""The data products: clean transactions, features, history, and the model matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.operators.history import add_prior_average, prior_average, prior_average_in_blocks
from payrisk.operators.skew import MAX_GROUP_ROWS, HotKeys, apart, find_hot_keys_of, left_lookups, lookup_of_hot
from payrisk.schemas import BASIC_FEATURE_COLUMNS, BEHAVIOR_COLUMNS, CLEAN_COLUMNS, MODEL_FEATURES
from payrisk.session import store


def labelled(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Raw transactions that have a label, with it. Transactions without one drop out."""
    same = F.col("id") == F.col("transaction_id")
    return transactions.join(labels.select("transaction_id", "is_fraud"), same).drop("transaction_id")


def transactions_clean(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    time = F.col("date").cast("timestamp_ntz")
    return (
        labelled(transactions, labels)
        .withColumns({
            "transaction_id": F.col("id"),
            "transaction_time": time,
            "amount": c.parse_amount(F.col("amount")),
            "transaction_hour": c.hour_of_day(time),
            "day_of_week": c.day_of_week(time),
            "has_error": c.has_error(F.col("errors")),
        })
        .select(*CLEAN_COLUMNS)
    )


def _payment_flags() -> dict[str, Column]:
    method = F.col("use_chip")
    return {
        "is_refund": c.flag(F.col("amount") < 0),
        "absolute_amount": F.abs("amount"),
        "is_online": c.flag(method == "Online Transaction"),
        "is_chip": c.flag(method == "Chip Transaction"),
        "is_swipe": c.flag(method == "Swipe Transaction"),
    }


def card_attributes(cards: DataFrame) -> DataFrame:
    """Cards under their own key name, with parsed values, ready to be joined to payments."""
    return cards.select(
        F.col("id").alias("lookup_card_id"),
        F.col("has_chip").cast("boolean").alias("has_chip"),
        F.col("card_on_dark_web").cast("boolean").alias("_dark_web"),
        c.parse_money(F.col("credit_limit")).alias("credit_limit"),
    )


def user_attributes(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("lookup_client_id"),
        "credit_score",
        c.parse_money(F.col("yearly_income")).alias("yearly_income"),
        c.parse_money(F.col("total_debt")).alias("total_debt"),
        "num_credit_cards",
    )


def _card_columns() -> dict[str, Column]:
    return {
        "card_on_dark_web": c.flag(F.col("_dark_web")),
        "amount_to_credit_limit": c.ratio(F.col("absolute_amount"), F.col("credit_limit")),
    }


def behavior_columns() -> dict[str, Column]:
    size = F.col("absolute_amount")
    return {
        "amount_vs_customer_avg": c.ratio(size, F.col("customer_previous_avg")),
        "amount_vs_card_avg": c.ratio(size, F.col("card_previous_avg")),
    }


def model_features_basic(
    clean: DataFrame, cards: DataFrame, users: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Payment, card and customer features; payments without a match are kept."""
    hot = find_hot_keys_of(clean, ["card_id", "client_id"], max_group_rows)
    lookups = [
        (card_attributes(cards), "card_id", "lookup_card_id"),
        (user_attributes(users), "client_id", "lookup_client_id"),
    ]
    payments = clean.select(
        "transaction_id", "client_id", "card_id", "amount", "use_chip", "transaction_hour", "day_of_week",
        "has_error", "mcc", "is_fraud",
    )
    joined = left_lookups(payments, lookups, hot)
    return joined.withColumns(_payment_flags()).withColumns(_card_columns()).select(*BASIC_FEATURE_COLUMNS)


def behavior_features(
    clean: DataFrame, *, decimals: int | None = None, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Each payment against the customer's and the card's earlier payments.

    Only the five columns the windows need are shuffled, once per key.
    """
    hot = find_hot_keys_of(clean, ["client_id", "card_id"], max_group_rows)
    rows = clean.select(
        "transaction_id", "transaction_time", "client_id", "card_id", F.abs("amount").alias("absolute_amount")
    )
    for key, output in (("client_id", "customer_previous_avg"), ("card_id", "card_previous_avg")):
        rows = add_prior_average(
            rows, key, output, decimals=decimals, hot=hot[key], rows_per_block=max_group_rows
        )
        if key == "client_id" and hot["card_id"] is not None:
            rows = store(rows, "customer-history")
    return rows.withColumns(behavior_columns()).select(*BEHAVIOR_COLUMNS)


def _matrix_columns() -> list[Column]:
    extra = {"card_has_chip": F.col("has_chip").cast("boolean").cast("int")}
    names = ["transaction_id", "transaction_time", *MODEL_FEATURES, "is_fraud"]
    return [extra[n].alias(n) if n in extra else F.col(n) for n in names]


def model_matrix_from_tables(
    basic: DataFrame, behavior: DataFrame, clean: DataFrame, *, merge: bool = False
) -> DataFrame:
    """Three-way join of the stored tables on the transaction id.

    ``merge`` asks for sort-merge joins whatever the sizes: of tables bucketed and sorted by the id they need no shuffle.
    """
    times = clean.select("transaction_id", "transaction_time")
    if merge:
        behavior, times = behavior.hint("merge"), times.hint("merge")
    return basic.join(behavior, "transaction_id").join(times, "transaction_id").select(*_matrix_columns())


def model_matrix(
    clean: DataFrame,
    cards: DataFrame,
    users: DataFrame,
    *,
    decimals: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The same matrix in one pass over the clean table.

    The customer window and the customer look-up share one partitioning by
    client, the card window and the card look-up one by card: two shuffles of the
    payments in all, and no join on the transaction id.
    """
    hot = find_hot_keys_of(clean, ["client_id", "card_id"], max_group_rows)
    rows = clean.select(
        "transaction_id", "transaction_time", "client_id", "card_id", "amount", "use_chip",
        "transaction_hour", "day_of_week", "has_error", "is_fraud",
    ).withColumns(_payment_flags()).drop("amount", "use_chip")
    steps = (
        ("client_id", "customer_previous_avg", user_attributes(users), "lookup_client_id"),
        ("card_id", "card_previous_avg", card_attributes(cards), "lookup_card_id"),
    )
    for key, output, lookup, lookup_key in steps:
        rows = _history_and_lookup(rows, key, output, decimals, lookup, lookup_key, hot[key], max_group_rows)
        if key == "client_id" and hot["card_id"] is not None:
            rows = store(rows, "customer-side")
    return rows.withColumns(_card_columns()).withColumns(behavior_columns()).select(*_matrix_columns())


def _history_and_lookup(
    df: DataFrame,
    key: str,
    output: str,
    decimals: int | None,
    lookup: DataFrame,
    lookup_key: str,
    hot: HotKeys | None,
    rows_per_block: int,
) -> DataFrame:
    on = F.col(key) == F.col(lookup_key)
    return apart(
        df,
        hot,
        lambda rows: prior_average(rows, key, output, decimals).join(lookup, on, "left"),
        lambda rows: prior_average_in_blocks(rows, key, output, decimals, hot, rows_per_block).join(
            lookup_of_hot(lookup, lookup_key, hot), on, "left"
        ),
    )
