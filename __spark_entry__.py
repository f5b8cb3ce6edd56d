
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import oracle  # noqa: E402
from payrisk import fixtures as fx  # noqa: E402
from payrisk.functions.columns import month_start  # noqa: E402
from payrisk.operators.quantiles import exact_quantiles  # noqa: E402
from payrisk.operators.sketches import quantile_from_sketches, value_sketches  # noqa: E402
from payrisk.plans import carried, cube, datasets, leafwise, lookup, metrics, models, newton, quality, reports, tables  # noqa: E402
from payrisk.schemas import MODEL_FEATURES, RAW_TRANSACTIONS  # noqa: E402
from payrisk.session import scratch_path, store  # noqa: E402
from payrisk.sources import files, layout, sniffing  # noqa: E402
from payrisk.sources.snapshots import Snapshots  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

# Operations of the training-data pipeline are registered where they are delivered.
try:
    import corpus_pipeline  # noqa: E402
    from payrisk.llm import queries as llm_queries  # noqa: E402

    WITH_LLM = True
except ImportError:
    WITH_LLM = False

# The test tables are small: the volume a category needs, and the row counts from
# which the split paths start, are lowered so that the queries use them.
MIN_TRANSACTIONS = 100
SMALL_GROUP = 150
SMALL_DIRECT = 200
SMALL_FILE = 100
PERIOD_CUT = "2024-01-20"
TREE_ROUNDS = 6


def entry(spark: SparkSession) -> DataFrame:
    """Fraud rate by payment method, from raw transactions and labels."""
    return reports.rate_by_payment_method(fx.clean(spark, "/root/testdata/sf0.001"))


def on_clean(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: report(fx.clean(spark, folder), *args, **kwargs)


def on_stored_clean(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """For reports that read their input more than once."""
    return lambda spark, folder: report(fx.stored_clean(spark, folder), *args, **kwargs)


def _with_cards(build: Callable[..., DataFrame], clean: Query = fx.stored_clean, **kwargs) -> Query:
    return lambda s, d: build(clean(s, d), fx.raw_cards(s, d), fx.raw_users(s, d), **kwargs)


def _skewed(build: Callable[..., DataFrame]) -> Query:
    """Some keys own a large part of the rows, and a group may have few rows."""
    return _with_cards(build, clean=fx.clean_skewed, max_group_rows=SMALL_GROUP)


def clean_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered CSV files to the clean table: both files are written, then read back."""
    transactions, labels = scratch_path(spark, "transactions-csv"), scratch_path(spark, "labels-csv")
    files.write_csv(fx.raw_transactions(spark, folder), transactions)
    files.write_csv(fx.labels(spark, folder), labels)
    return tables.transactions_clean(
        files.read_transactions(spark, transactions), files.read_labels(spark, labels)
    )


def stored_table_rates(spark: SparkSession, folder: str) -> DataFrame:
    stored = files.replace_table(fx.clean(spark, folder), scratch_path(spark, "clean"), sort_by="transaction_id")
    return reports.rate_by_payment_method(stored)


def clustered_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table by customer and card, in many small files."""
    path = scratch_path(spark, "clean-clustered")
    return layout.write_clustered(
        fx.stored_clean(spark, folder), path, ["client_id", "card_id"], "transaction_id", file_rows=SMALL_FILE
    )


def rewritten_table_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates from a table that was rewritten from itself without its refunds."""
    table = Snapshots(spark, scratch_path(spark, "clean-snapshots"))
    first = table.replace(fx.clean(spark, folder))
    table.replace(first.where("amount >= 0"), sort_by="transaction_id", expect=table.current())
    table.drop_old()
    return reports.rate_by_payment_method(table.read())


def stored_cube(spark: SparkSession, folder: str) -> DataFrame:
    return files.replace_table(cube.fraud_cube(fx.clean(spark, folder), PERIOD_CUT), scratch_path(spark, "cube"))


def median_from_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Median amount by label, from sketches kept by month and label."""
    clean = fx.stored_clean(spark, folder).withColumn("month", month_start(F.col("transaction_time")))
    kept = files.replace_table(value_sketches(clean, ["month", "is_fraud"], "amount"), scratch_path(spark, "sketches"))
    found = quantile_from_sketches(clean, kept, ["is_fraud"], "amount", 0.5, "median_amount")
    return found.select("is_fraud", F.round("median_amount", 2).alias("median_amount"))


def baseline_equations(spark: SparkSession, folder: str) -> DataFrame:
    train = store(splits(spark, folder)["baseline_train"], "train")
    return newton.score_equations(newton.fit_newton(train), train)


def cards_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered with other columns, in another order."""
    path = scratch_path(spark, "cards-csv")
    cards = fx.raw_cards(spark, folder)
    files.write_csv(cards.select(F.lit("x,y").alias("card_number"), *reversed(cards.columns), F.lit(1).alias("cvv")), path)
    return files.read_cards(spark, path)


def users_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "users-csv")
    users = fx.raw_users(spark, folder)
    shuffled = ["num_credit_cards", "id", "total_debt", "credit_score", "yearly_income"]
    files.write_csv(users.select(*shuffled, F.lit(None).cast("string").alias("address")), path)
    return files.read_users(spark, path)


def labels_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """All labels as one JSON document in many files, read back; a tenth of the ids has an earlier pair that does not count."""
    path, labels = scratch_path(spark, "labels-json"), fx.raw_labels(spark, folder)
    flipped = F.when(F.col("label") == "Yes", "No").otherwise("Yes")
    earlier = labels.where(F.col("transaction_id") % 10 == 0).withColumn("label", flipped)
    both = earlier.withColumn("turn", F.lit(0)).unionByName(labels.withColumn("turn", F.lit(1)))
    place = F.struct("turn", "transaction_id").alias("place")
    files.write_label_json(both.select("transaction_id", "label", place), path, "place")
    return files.encode_labels(files.read_label_json(spark, path))


def behavior_in_loads(spark: SparkSession, folder: str) -> DataFrame:
    """History of three loads: the first days, the others, and last the payments that came late."""
    clean = fx.stored_clean(spark, folder)
    late, early = F.col("transaction_id") % 13 == 0, F.col("transaction_time") < F.lit(PERIOD_CUT).cast("timestamp_ntz")
    history = carried.CarriedHistory(spark, scratch_path(spark, "carried"), fx.DECIMALS)
    for part in (~late & early, ~late & ~early, late):
        history.extend(clean.where(part))
    return history.features()


def delivery(spark: SparkSession, folder: str) -> sniffing.Delivery:
    """Payments with columns nobody agreed on, and rows with a wrong customer or time; read back with their types."""
    path, number = scratch_path(spark, "delivery-csv"), F.col("id")
    raw = fx.raw_transactions(spark, folder)
    files.write_csv(
        raw.withColumns({
            "client_id": F.when(number % 41 == 0, "n/a").otherwise(F.col("client_id").cast("string")),
            "date": F.when(number % 43 == 0, "yesterday").otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
            "terminal": number % 1000,
            "fee": F.format_number((number % 100) / 4, 2),
            "booked": F.to_date("date").cast("string"),
            "remote": F.col("use_chip") == "Online Transaction",
            "batch": F.when(number % 100 == 3, "A7").otherwise((number % 9).cast("string")),
        }),
        path,
    )
    return sniffing.read_delivery(spark, path, RAW_TRANSACTIONS)


def sniffed_types(spark: SparkSession, folder: str) -> DataFrame:
    """Type of each column outside the agreed schema, and how many rows have a value of it."""
    found = delivery(spark, folder)
    extra = [c for c in found.types if c not in RAW_TRANSACTIONS.names]
    counted = found.rows.agg(*[F.count(c).alias(c) for c in extra])
    types = F.create_map(*[F.lit(x) for c in extra for x in (c, found.types[c])])
    return counted.unpivot([], extra, "column_name", "n_values").select(
        "column_name", F.element_at(types, F.col("column_name")).alias("column_type"), "n_values"
    )


def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the delivery that do not parse, by their id, with the reason."""
    rejected = delivery(spark, folder).rejected
    number = F.get_json_object("raw", "$.id").cast("bigint")
    return rejected.select(number.alias("id"), "reason", F.col("file").isNotNull().alias("has_file"))


def accepted_rows(spark: SparkSession, folder: str) -> DataFrame:
    return delivery(spark, folder).rows.select("id", "client_id", "date", "amount", "terminal", "fee", "remote", "batch")


def matrix_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The three tables joined where they lie: 8, 4 and 4 buckets of the transaction id."""
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")

    def saved(df: DataFrame, buckets: int) -> DataFrame:
        path = scratch_path(spark, "bucketed")
        return files.replace_bucketed_table(df, path.rsplit("/", 1)[-1].replace("-", "_"), "transaction_id", buckets, path)

    parts = saved(fx.basic(spark, folder), 8), saved(fx.behavior(spark, folder), 4), saved(fx.clean(spark, folder), 4)
    return tables.model_matrix_from_tables(*parts, merge=True)


def matrix_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    clean = fx.clean(spark, folder)
    return tables.model_matrix_from_tables(fx.basic(spark, folder), fx.behavior(spark, folder), clean)


def behavior_of_fine_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of amounts with many decimals, as doubles."""
    fine = fx.stored_clean(spark, folder).withColumn("amount", F.col("amount") * 0.7310585786300049)
    history = tables.behavior_features(fine)
    return history.select("transaction_id", *[F.round(c, 6).alias(c) for c in history.columns if c != "transaction_id"])


def median_by_many_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Median amount of each of many customers, by counting."""
    orders = fx.long_period(spark, folder)
    found = exact_quantiles(orders, {"median_amount": ("amount", 0.5)}, ["client_id"], direct_values=SMALL_DIRECT)
    return found.select("client_id", F.round("median_amount", 6).alias("median_amount"))


def describe_top(spark: SparkSession, folder: str) -> DataFrame:
    return reports.high_risk_category_table(
        fx.clean(spark, folder), files.category_lookup(spark), min_transactions=MIN_TRANSACTIONS
    )


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ratio_by_label(fx.basic(spark, folder), fx.behavior(spark, folder))


def cutoffs(clean: DataFrame, **kwargs) -> DataFrame:
    wanted = {"recent_start": datasets.RECENT_START, "test_start": datasets.TEST_START}
    found = datasets.time_quantiles(clean, wanted, **kwargs)
    return found.select(*[F.date_trunc("second", name).cast("timestamp_ntz").alias(name) for name in wanted])


def drift(report: Callable[..., DataFrame], **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        clean = fx.long_period(spark, folder)
        _, test_start = datasets.time_cutoffs(clean)
        return report(clean, test_start, **kwargs)

    return run


def splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three sets, cut from a matrix that is stored once."""
    matrix = store(fx.matrix(spark, folder), "matrix")
    recent_start, test_start = datasets.time_cutoffs(matrix)
    return {
        "baseline_train": datasets.baseline_train(matrix, test_start, fx.BUCKETS),
        "recent_train": datasets.recent_train(matrix, recent_start, test_start, fx.BUCKETS),
        "future_test": datasets.future_test(matrix, test_start, fx.BUCKETS),
    }


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        datasets.split_counts(part).withColumn("split", F.lit(name)) for name, part in splits(spark, folder).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", "rows", "fraud_cases")


def imputed(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits(spark, folder)
    fills = models.fill_values(parts["baseline_train"])
    return models.fill_missing(parts["future_test"], fills).select("transaction_id", *MODEL_FEATURES, "is_fraud")


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    train = splits(spark, folder)["baseline_train"]
    filled = models.fill_missing(train, models.fill_values(train))
    shown = models.scale(filled, models.scaling_values(filled))
    return shown.select("transaction_id", *[F.round(f, 6).alias(f) for f in MODEL_FEATURES], "is_fraud")


def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits(spark, folder)
    return models.score(models.fit_baseline(parts["baseline_train"]), parts["future_test"])


def recent_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits(spark, folder)
    return models.score(models.fit_recent(parts["recent_train"]), parts["future_test"])


def baseline_balance(spark: SparkSession, folder: str) -> DataFrame:
    """A fit with a free intercept gives the weighted mean label as its weighted mean score."""
    train = store(splits(spark, folder)["baseline_train"], "train")
    scored = models.score(models.fit_baseline(train), train)
    weighed = models.with_balanced_weight(store(scored, "scored"))

    def mean(name: str):
        return F.round(F.sum(F.col("weight") * F.col(name)) / F.sum("weight"), 4).alias(f"mean_{name}")

    return weighed.agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("fraud_cases"), mean("is_fraud"), mean("score"))


def recent_check(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, and what any sound fit of the trees has to show on its own train set."""
    train = store(splits(spark, folder)["recent_train"], "train")
    scored = models.with_fraud_weight(store(models.score(models.fit_recent(train), train), "scored"))
    fraud = F.col("is_fraud") == 1
    sizes = scored.agg((F.sum(F.when(fraud, F.col("weight"))) / F.sum("weight")).alias("share")).first()
    near = F.greatest(F.least("score", F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = F.sum(-F.col("weight") * F.when(fraud, F.log(near)).otherwise(F.log(1 - near)))
    constant = F.sum(-F.col("weight") * F.when(fraud, F.lit(log(sizes["share"]))).otherwise(F.lit(log(1 - sizes["share"]))))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_fraud").alias("fraud_cases"),
        F.min(F.col("score").between(0, 1)).alias("scores_in_range"),
        F.min((F.col("predicted") == 1) == (F.col("score") >= models.THRESHOLD)).alias("decisions_match"),
        (loss < constant).alias("better_than_constant"),
    )


def recent_trees_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Per tree of a leaf-wise fit: its size, and whether its leaves hold the rows that their thresholds select."""
    train = store(splits(spark, folder)["recent_train"], "train")
    forest = leafwise.fit_leafwise(train, TREE_ROUNDS)
    counts = [leafwise.leaf_rows(train, forest, t).withColumn("tree", F.lit(t).cast("bigint")) for t in range(len(forest.trees))]
    found = reduce(DataFrame.unionByName, counts)
    return found.groupBy("tree").agg(
        (F.count(F.lit(1)) <= leafwise.MAX_LEAVES).alias("leaves_within_limit"),
        F.sum("rows").alias("leaf_rows"),
        F.sum("fraud_rows").alias("fraud_rows"),
        F.min(F.col("rows") >= models.MIN_LEAF_ROWS).alias("no_leaf_too_small"),
        F.min(F.col("rows") == F.col("rows_when_grown")).alias("rows_as_when_grown"),
    )


def saved_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a fitted model beside those of the same model saved and loaded."""
    parts, path = splits(spark, folder), scratch_path(spark, "model")
    model = models.fit_baseline(parts["baseline_train"])
    models.save_model(model, path)
    first, second = (models.score(m, parts["future_test"]) for m in (model, models.load_model(path)))
    again = second.select(F.col("transaction_id").alias("_id"), F.col("score").alias("_score"))
    both = first.join(again, F.col("transaction_id") == F.col("_id"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") != F.col("_score")).alias("rows_that_differ"))


def evaluated(scores: Query) -> Query:
    return lambda spark, folder: models.evaluate(scores(spark, folder))


def on_scored(report: Callable[..., DataFrame]) -> Query:
    return lambda spark, folder: report(metrics.decide(fx.scored(spark, folder)))


def ranking(*names: str, **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = metrics.ranking_scores(fx.scored(spark, folder), **kwargs)
        return found.select(*[F.round(name, 9).alias(name) for name in names])

    return run


def queries() -> dict[str, Query]:
    return own_queries() | (llm_queries.queries() | {"pipeline": corpus_pipeline.run} if WITH_LLM else {})


def own_queries() -> dict[str, Query]:
    return {
        # Data products
        "transactions_clean": fx.clean,
        "transactions_clean_from_csv": clean_from_csv,
        "stored_table_rates": stored_table_rates,
        "fraud_labels": fx.labels,
        "labels_from_json": labels_from_json,
        "cards_from_csv": cards_from_csv,
        "users_from_csv": users_from_csv,
        "model_features_basic": _with_cards(tables.model_features_basic),
        "model_features_basic_hot_keys": _skewed(tables.model_features_basic),
        "behavior_features": on_stored_clean(tables.behavior_features, decimals=fx.DECIMALS),
        "behavior_features_any_decimals": behavior_of_fine_amounts,
        "behavior_features_hot_keys": lambda s, d: tables.behavior_features(
            fx.clean_skewed(s, d), max_group_rows=SMALL_GROUP, decimals=fx.DECIMALS
        ),
        "behavior_features_long_period": lambda s, d: tables.behavior_features(
            fx.long_period(s, d), decimals=fx.DECIMALS
        ),
        "model_matrix": _with_cards(tables.model_matrix, decimals=fx.DECIMALS),
        "model_matrix_hot_keys": _with_cards(
            tables.model_matrix, clean=fx.clean_skewed, max_group_rows=SMALL_GROUP, decimals=fx.DECIMALS
        ),
        "model_matrix_from_tables": matrix_from_tables,
        "model_matrix_bucketed": matrix_bucketed,
        "behavior_features_incremental": behavior_in_loads,
        # Deliveries that are not all as agreed
        "sniffed_types": sniffed_types,
        "rejected_rows": rejected_rows,
        "accepted_rows": accepted_rows,
        # Checks and previews
        "label_summary": lambda s, d: quality.label_summary(fx.raw_labels(s, d)),
        "fraud_ids": lambda s, d: quality.fraud_ids(fx.raw_labels(s, d)),
        "fraud_examples": lambda s, d: quality.fraud_examples(fx.raw_transactions(s, d), fx.labels(s, d)),
        "cards_preview": lambda s, d: files.preview(fx.raw_cards(s, d), "id", 5),
        "users_preview": lambda s, d: files.preview(fx.raw_users(s, d), "id", 5),
        "joined_label_check": lambda s, d: quality.joined_label_check(fx.raw_transactions(s, d), fx.labels(s, d)),
        "feature_table_check": lambda s, d: quality.feature_table_check(fx.basic(s, d)),
        "behavior_row_count": lambda s, d: quality.row_count(fx.behavior(s, d)),
        "join_coverage": _with_cards(quality.join_coverage),
        "join_coverage_hot_keys": _skewed(quality.join_coverage),
        "join_coverage_bitmaps": _with_cards(quality.join_coverage_by_bitmaps),
        "connected_transactions": _with_cards(quality.connected_transactions),
        "connected_transactions_hot_keys": _skewed(quality.connected_transactions),
        "connected_preview": _with_cards(quality.connected_preview),
        "clean_preview": on_clean(quality.clean_preview),
        "feature_preview": lambda s, d: quality.feature_preview(fx.basic(s, d)),
        "behavior_preview": lambda s, d: quality.behavior_preview(fx.behavior(s, d)),
        "transaction_investigation": lambda s, d: lookup.investigate_payment(
            files.replace_table(fx.clean(s, d), scratch_path(s, "clean"), sort_by="transaction_id"), 842
        ),
        "investigation_clustered": lambda s, d: lookup.investigate_payment(clustered_clean(s, d), 842),
        "rewritten_table_rates": rewritten_table_rates,
        # Fraud rates, amounts, drift
        "fraud_rate_cube": lambda s, d: cube.fraud_cube(fx.clean(s, d), PERIOD_CUT),
        "rate_by_hour_from_cube": lambda s, d: cube.rate_by(stored_cube(s, d), "hour"),
        "high_risk_mcc_from_cube": lambda s, d: cube.high_risk_categories(stored_cube(s, d), min_transactions=MIN_TRANSACTIONS),
        "drift_payment_method_from_cube": lambda s, d: cube.drift_by_payment_method(stored_cube(s, d)),
        "median_from_sketches": median_from_sketches,
        "overall_summary": on_clean(reports.overall_rate),
        "dashboard_summary": on_clean(reports.dashboard_summary),
        "rate_by_payment_method": on_clean(reports.rate_by_payment_method),
        "payment_method_rate_label": on_clean(reports.payment_method_rates),
        "rate_by_error": on_clean(reports.rate_by, "has_error"),
        "rate_by_hour": on_clean(reports.rate_by, "transaction_hour"),
        "rate_by_weekday": on_clean(reports.rate_by, "day_of_week"),
        "rate_by_month": lambda s, d: reports.rate_by_month(fx.long_period(s, d)),
        "high_risk_mcc_top": on_clean(reports.high_risk_categories, min_transactions=MIN_TRANSACTIONS),
        "high_risk_mcc_described": describe_top,
        "amount_stats_by_label": on_stored_clean(reports.amount_by_label),
        "amount_stats_narrowed": on_stored_clean(reports.amount_by_label, direct_values=SMALL_DIRECT),
        "behavior_median_by_label": ratios,
        "median_by_many_groups": median_by_many_groups,
        "drift_overall": drift(reports.drift_overall),
        "drift_payment_method": drift(reports.drift_by_payment_method),
        "drift_amount": drift(reports.drift_of_amount),
        "drift_amount_narrowed": drift(reports.drift_of_amount, direct_values=SMALL_DIRECT),
        "time_quantile_cutoffs": on_stored_clean(cutoffs),
        "time_quantile_cutoffs_narrowed": lambda s, d: cutoffs(fx.long_period(s, d), direct_values=SMALL_DIRECT),
        # Data sets and model inputs
        "baseline_train_set": lambda s, d: splits(s, d)["baseline_train"],
        "recent_train_set": lambda s, d: splits(s, d)["recent_train"],
        "future_test_set": lambda s, d: splits(s, d)["future_test"],
        "split_counts": split_counts,
        "median_imputed_features": imputed,
        "standard_scaled_features": scaled,
        "balanced_class_weights": on_stored_clean(models.balanced_class_weights),
        "fraud_sample_weights": lambda s, d: models.with_fraud_weight(
            fx.clean(s, d).select("transaction_id", "is_fraud")
        ),
        # Models and evaluation
        "baseline_model_scores": baseline_scores,
        "recent_model_scores": recent_scores,
        "baseline_model_evaluation": evaluated(baseline_scores),
        "recent_model_evaluation": evaluated(recent_scores),
        "baseline_model_balance": baseline_balance,
        "baseline_score_equations": baseline_equations,
        "recent_model_check": recent_check,
        "recent_trees_structure": recent_trees_structure,
        "saved_model_scores": saved_model_scores,
        "threshold_decision": lambda s, d: metrics.decide(fx.scored(s, d)),
        "confusion_matrix": on_scored(metrics.confusion_matrix),
        "classification_report": on_scored(metrics.classification_report),
        "average_precision": ranking("average_precision"),
        "roc_auc": ranking("roc_auc"),
        "ranking_scores_blocks": ranking("average_precision", "roc_auc", max_block_rows=SMALL_GROUP // 2),
    }


def oracle_sql() -> dict[str, str]:
    twins = oracle.oracle_sql()
    if WITH_LLM:
        twins = twins | llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return twins
