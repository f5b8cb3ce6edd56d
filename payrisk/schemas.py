"""Explicit schemas, so that no scan has to look at the data first."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


RAW_TRANSACTIONS = _struct(
    id=LongType,
    date=TimestampNTZType,
    client_id=LongType,
    card_id=LongType,
    amount=StringType,
    use_chip=StringType,
    merchant_id=LongType,
    merchant_city=StringType,
    merchant_state=StringType,
    zip=DoubleType,
    mcc=IntegerType,
    errors=StringType,
)

LABELS = _struct(transaction_id=LongType, is_fraud=LongType)

RAW_CARDS = _struct(
    id=LongType,
    card_brand=StringType,
    card_type=StringType,
    has_chip=StringType,
    card_on_dark_web=StringType,
    credit_limit=StringType,
)

RAW_USERS = _struct(
    id=LongType,
    credit_score=IntegerType,
    yearly_income=StringType,
    total_debt=StringType,
    num_credit_cards=IntegerType,
)

CLEAN_COLUMNS = [
    "transaction_id",
    "transaction_time",
    "client_id",
    "card_id",
    "amount",
    "use_chip",
    "merchant_id",
    "merchant_city",
    "merchant_state",
    "zip",
    "mcc",
    "errors",
    "transaction_hour",
    "day_of_week",
    "has_error",
    "is_fraud",
]

BASIC_FEATURE_COLUMNS = [
    "transaction_id",
    "amount",
    "is_refund",
    "absolute_amount",
    "is_online",
    "is_chip",
    "is_swipe",
    "transaction_hour",
    "day_of_week",
    "has_error",
    "mcc",
    "has_chip",
    "card_on_dark_web",
    "credit_limit",
    "amount_to_credit_limit",
    "credit_score",
    "yearly_income",
    "total_debt",
    "num_credit_cards",
    "is_fraud",
]

BEHAVIOR_COLUMNS = [
    "transaction_id",
    "customer_previous_avg",
    "card_previous_avg",
    "amount_vs_customer_avg",
    "amount_vs_card_avg",
]

# The model's inputs, in the order the vector holds them.
MODEL_FEATURES = [
    "absolute_amount",
    "is_refund",
    "is_online",
    "is_chip",
    "is_swipe",
    "transaction_hour",
    "day_of_week",
    "has_error",
    "card_has_chip",
    "card_on_dark_web",
    "credit_limit",
    "amount_to_credit_limit",
    "credit_score",
    "yearly_income",
    "total_debt",
    "num_credit_cards",
    "customer_previous_avg",
    "card_previous_avg",
    "amount_vs_customer_avg",
    "amount_vs_card_avg",
]
