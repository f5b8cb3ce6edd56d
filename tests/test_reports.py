"""Reports, drift, look-up and data-set invariants."""

import os
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as registry
from payrisk import fixtures as fx
from payrisk.plans import datasets, lookup, quality, reports, tables
from payrisk.schemas import MODEL_FEATURES
from payrisk.session import scratch_scope, store
from payrisk.sources import files


def test_tie_between_categories_goes_to_the_lower_code(spark):
    rows = [(mcc, i % 2) for mcc in (30, 10, 20) for i in range(10)] + [(5, 1)]
    clean = spark.createDataFrame(rows, "mcc int, is_fraud bigint")
    found = reports.high_risk_categories(clean, top=2, min_transactions=10).collect()
    assert [tuple(r) for r in found] == [(10, 10, 5, 50.0), (20, 10, 5, 50.0)]
    assert reports.high_risk_categories(clean).count() == 0  # default needs 10,000


def test_unknown_category_has_no_description(spark):
    ranked = spark.createDataFrame([(5812,), (9999,)], "mcc int")
    found = {r["mcc"]: r["merchant_category"] for r in reports.describe_categories(ranked, files.category_lookup(spark)).collect()}
    assert found == {5812: "Eating Places and Restaurants", 9999: None}


def test_missing_time_is_in_the_drift_report_but_in_no_data_set(spark):
    rows = [(1, datetime(2024, 1, 1), 0), (2, datetime(2024, 3, 1), 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "transaction_id bigint, transaction_time timestamp_ntz, is_fraud bigint")
    cut = datetime(2024, 2, 1)
    found = {r["dataset"]: (r["transactions"], r["fraud"]) for r in reports.drift_overall(df, cut).collect()}
    assert found == {"TRAIN - Past": (1, 0), "TEST - Future": (2, 2)}
    many = df.crossJoin(spark.range(400).withColumnRenamed("id", "n")).withColumn(
        "transaction_id", F.col("transaction_id") * 1000 + F.col("n")
    )
    kept = datasets.baseline_train(many, cut).unionByName(datasets.future_test(many, cut))
    assert kept.where(F.col("transaction_time").isNull()).count() == 0 and kept.count() > 0


def test_row_counts_hold_through_the_flow(spark, folder):
    clean = fx.clean(spark, folder)
    joined = quality.joined_label_check(fx.raw_transactions(spark, folder), fx.labels(spark, folder)).first()
    overall = reports.overall_rate(clean).first()
    assert (joined[0], joined[1]) == (overall[0], overall[1]) == (900, 36) and overall[2] == 4.0
    assert tuple(quality.feature_table_check(fx.basic(spark, folder)).first()) == (900, 36)
    assert quality.row_count(fx.behavior(spark, folder)).first()[0] == 900
    coverage = quality.join_coverage(clean, fx.raw_cards(spark, folder), fx.raw_users(spark, folder)).first()
    assert tuple(coverage) == (900, 804, 900)


def test_coverage_counts_repeated_lookup_rows_as_the_joins_would(spark):
    clean = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (None, 7)], "card_id bigint, client_id bigint")
    cards = spark.createDataFrame([(1,), (1,)], "id bigint")
    users = spark.createDataFrame([(7,)], "id bigint")
    found = quality.join_coverage(clean, cards, users).first()
    assert tuple(found) == (6, 4, 5)
    empty = quality.join_coverage(clean.limit(0), cards, users).first()
    assert tuple(empty) == (0, 0, 0)


def test_both_ways_to_the_model_matrix_agree(spark, folder):
    clean, cards, users = fx.clean(spark, folder), fx.raw_cards(spark, folder), fx.raw_users(spark, folder)
    one_pass = tables.model_matrix(clean, cards, users, decimals=fx.DECIMALS)
    joined = tables.model_matrix_from_tables(fx.basic(spark, folder), fx.behavior(spark, folder), clean)
    assert one_pass.columns == joined.columns == ["transaction_id", "transaction_time", *MODEL_FEATURES, "is_fraud"]
    key = lambda r: r["transaction_id"]
    assert sorted(one_pass.collect(), key=key) == sorted(joined.collect(), key=key)


def test_one_pass_matrix_shuffles_payments_twice(spark, folder, tmp_path):
    stored = [
        files.replace_table(df, str(tmp_path / name))
        for df, name in (
            (fx.clean(spark, folder), "clean"), (fx.raw_cards(spark, folder), "cards"),
            (fx.raw_users(spark, folder), "users"),
        )
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = tables.model_matrix(*stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Two for the payments, one for each look-up table.
    assert plan.count("Exchange hashpartitioning") == 4


def test_train_and_test_are_disjoint_and_samples_nested(spark, folder):
    matrix = fx.matrix(spark, folder).select("transaction_id", "transaction_time", "is_fraud").cache()
    start, end = datasets.time_cutoffs(fx.clean(spark, folder))
    ids = lambda df: {r[0] for r in df.select("transaction_id").collect()}
    recent, past, test = (
        ids(d) for d in (
            datasets.recent_train(matrix, start, end), datasets.baseline_train(matrix, end), datasets.future_test(matrix, end)
        )
    )
    assert recent and past and test and not (recent | past) & test
    assert ids(datasets.sample(matrix, 15)) < ids(datasets.sample(matrix, 25)) < ids(datasets.sample(matrix, 35))


def test_investigation(spark, folder):
    clean, behavior = fx.clean(spark, folder), fx.behavior(spark, folder)
    row = lookup.investigate(clean, behavior, 842).first()
    assert row["transaction_id"] == 842 and row["outcome"] in ("FRAUD", "LEGITIMATE")
    assert row["customer_avg_spend"] == round(row["customer_avg_spend"], 2)
    assert lookup.investigate(clean, behavior, 10**9).count() == 0


def test_previews_are_ordered_and_bounded(spark, folder):
    shown = quality.clean_preview(fx.clean(spark, folder).repartition(5))
    ids = [r["transaction_id"] for r in shown.collect()]
    assert ids == sorted(ids) and len(ids) == 10


def test_look_up_pushes_its_filters_and_needs_no_window(spark, folder, tmp_path):
    clean = files.replace_table(fx.clean(spark, folder), str(tmp_path / "clean"), sort_by="transaction_id")
    plan = lookup.investigate_payment(clean, 842)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "EqualTo(transaction_id,842)" in plan


def test_windows_run_once_for_all_three_sets(spark, folder):
    for part in registry.splits(spark, folder).values():
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_scratch_scope_removes_what_it_stored(spark):
    with scratch_scope(spark):
        kept = store(spark.range(5), "scoped")
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
