"""Raw payment inputs derived from the test tables, as set out in FIXTURES.md.

Every input has a row for every row of its table. Some cards, customers and labels have
ids beyond those of the payments, so that the joins have rows without a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payrisk.functions.columns import hash_bucket
from payrisk.plans import tables
from payrisk.session import store
from payrisk.sources.files import encode_labels

BUCKETS = "md5"

# Added to the ids of labels, cards and customers that no payment is to find.
OUT_OF_REACH = 1_000_000_000

# The amounts have two decimals, so averages are summed in whole cents, exactly.
DECIMALS = 2


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    with_commas = F.format_number("value", 2)
    plain = F.replace(with_commas, F.lit(","), F.lit(""))
    mcc = F.element_at(F.array(*[F.lit(m) for m in (5812, 5541, 5411, 4829, 5311, 3000, 9999)]), (number % 7 + 1).cast("int"))
    errors = F.element_at(F.array(F.lit("   "), F.lit(""), F.lit("Bad PIN,Insufficient Balance")), (number % 3 + 1).cast("int"))
    return _table(spark, folder, "events").select(
        number.alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.col("user_id").alias("client_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("card_id"),
        F.when(number % 97 == 0, "$1,234.56")
        .when(number % 20 == 0, F.concat(F.lit("$-"), plain))
        .otherwise(F.concat(F.lit("$"), plain))
        .alias("amount"),
        F.when(kind == "click", "Online Transaction")
        .when(kind == "view", "Chip Transaction")
        .when(kind == "purchase", "Swipe Transaction")
        .otherwise(kind)
        .alias("use_chip"),
        (number % 500).alias("merchant_id"),
        F.concat(F.lit("CITY_"), F.col("user_id") % 25).alias("merchant_city"),
        F.when(kind != "click", F.concat(F.lit("S"), F.col("user_id") % 5)).alias("merchant_state"),
        F.when(kind != "click", F.col("user_id") * 100).alias("zip"),
        mcc.alias("mcc"),
        F.when(kind == "error", errors).alias("errors"),
    )


def raw_labels(spark: SparkSession, folder: str) -> DataFrame:
    kind, number, time = F.col("event_type"), F.col("event_id"), F.col("ts")
    later = F.lit("2024-01-20").cast("timestamp_ntz")
    share = F.when((kind == "click") & (time < later), 12).when((kind == "view") & (time >= later), 15).otherwise(2)
    label = F.when(hash_bucket(number, BUCKETS) < share, "Yes").otherwise("No")
    known = F.when(number % 10 == 9, number + OUT_OF_REACH).otherwise(number)
    return _table(spark, folder, "events").select(known.alias("transaction_id"), label.alias("label"))


def raw_cards(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("p_partkey")
    limit = F.concat(F.lit("$"), F.format_number(F.col("p_retailprice") * 10, 2))
    return (
        _table(spark, folder, "part")
        .select(
            F.when(number % 10 == 3, number + OUT_OF_REACH).otherwise(number).alias("id"),
            F.col("p_brand").alias("card_brand"),
            F.col("p_type").alias("card_type"),
            F.when(F.col("p_size") > 10, "YES").otherwise("NO").alias("has_chip"),
            F.when(number % 25 == 0, "Yes").otherwise("No").alias("card_on_dark_web"),
            F.when(number % 50 == 7, "$0").otherwise(limit).alias("credit_limit"),
        )
    )


def raw_users(spark: SparkSession, folder: str) -> DataFrame:
    number, balance = F.col("c_custkey"), F.abs("c_acctbal")

    def dollars(amount):
        return F.concat(F.lit("$"), F.format_number(amount, 2))

    return (
        _table(spark, folder, "customer")
        .select(
            F.when(number % 50 == 49, number + OUT_OF_REACH).otherwise(number).alias("id"),
            (300 + (number * 37) % 550).cast("int").alias("credit_score"),
            dollars(balance * 100).alias("yearly_income"),
            dollars(balance * 10).alias("total_debt"),
            (1 + number % 7).cast("int").alias("num_credit_cards"),
        )
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return encode_labels(raw_labels(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return tables.transactions_clean(raw_transactions(spark, folder), labels(spark, folder))


def stored_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table as a user would have it: written once, whatever reads it and however often."""
    return store(clean(spark, folder), "clean")


def clean_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table with a large part of all rows on one customer, one card and no card."""
    kind = F.col("use_chip")
    skewed = clean(spark, folder).withColumns({
        "client_id": F.when(kind == "Online Transaction", 1).otherwise(F.col("client_id")),
        "card_id": F.when(kind == "Chip Transaction", 7).when(kind != "Swipe Transaction", F.col("card_id")),
    })
    return store(skewed, "clean-skewed")


def basic(spark: SparkSession, folder: str) -> DataFrame:
    return tables.model_features_basic(stored_clean(spark, folder), raw_cards(spark, folder), raw_users(spark, folder))


def behavior(spark: SparkSession, folder: str) -> DataFrame:
    return tables.behavior_features(stored_clean(spark, folder), decimals=DECIMALS)


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    return tables.model_matrix(
        stored_clean(spark, folder), raw_cards(spark, folder), raw_users(spark, folder), decimals=DECIMALS
    )


def long_period(spark: SparkSession, folder: str) -> DataFrame:
    """Clean-like table over many months, from orders."""
    number, time, priority = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderpriority")
    urgent, high = priority == "1-URGENT", priority == "2-HIGH"
    turn = F.lit("1999-01-01").cast("timestamp_ntz")
    share = F.when(urgent & (time < turn), 20).when(high & (time >= turn), 25).otherwise(3)
    method = F.when(urgent, "Online Transaction").when(high, "Chip Transaction").otherwise("Swipe Transaction")
    orders = _table(spark, folder, "orders").select(
        number.alias("transaction_id"),
        time.cast("timestamp_ntz").alias("transaction_time"),
        F.col("o_custkey").alias("client_id"),
        (number % 500).alias("card_id"),
        F.col("o_totalprice").alias("amount"),
        method.alias("use_chip"),
        F.when(hash_bucket(number, BUCKETS) < share, 1).otherwise(0).cast("bigint").alias("is_fraud"),
    )
    return store(orders, "long-period")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(transaction_id, is_fraud, score) with many tied scores."""
    bucket = hash_bucket(F.col("transaction_id") * 7 + 1, BUCKETS)
    score = (bucket + 30 * F.col("is_fraud")).cast("double") / 130
    return clean(spark, folder).select("transaction_id", "is_fraud", score.alias("score"))

