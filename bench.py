"""Time the whole flow on one test folder: one JSON line on standard output.

The raw inputs are derived from the test tables and stored first, untimed. Then
the data products are built and stored from them, and the reports, data sets and
metrics run over the stored products, as a user of the library would run them.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk import fixtures as fx
from payrisk.operators.quantiles import exact_quantiles
from payrisk.plans import datasets, lookup, metrics, models, quality, reports, tables
from payrisk.session import build_session, scratch_path, scratch_scope
from payrisk.sources import files


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    stored = ExitStack()
    stored.enter_context(scratch_scope(spark))  # what the run writes goes when it ends

    def save(df: DataFrame, name: str) -> DataFrame:
        return files.replace_table(df, scratch_path(spark, name))

    def build(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        start = time.perf_counter()
        table = save(make(), name)
        seconds[name] = round(time.perf_counter() - start, 3)
        return table

    def run(name: str, make: Callable[[], DataFrame]) -> None:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    raw = save(fx.raw_transactions(spark, folder), "raw")
    raw_labels = save(fx.raw_labels(spark, folder), "labels")
    cards, users = save(fx.raw_cards(spark, folder), "cards"), save(fx.raw_users(spark, folder), "users")
    orders, skewed = save(fx.long_period(spark, folder), "orders"), save(fx.clean_skewed(spark, folder), "skewed")

    labels = build("fraud_labels", lambda: files.encode_labels(raw_labels))
    clean = build("transactions_clean", lambda: tables.transactions_clean(raw, labels))
    basic = build("model_features_basic", lambda: tables.model_features_basic(clean, cards, users))
    behavior = build("behavior_features", lambda: tables.behavior_features(clean, decimals=fx.DECIMALS))
    matrix = build("model_matrix", lambda: tables.model_matrix(clean, cards, users, decimals=fx.DECIMALS))

    run("overall_summary", lambda: reports.overall_rate(clean))
    run("rate_by_payment_method", lambda: reports.rate_by_payment_method(clean))
    run("rate_by_error", lambda: reports.rate_by(clean, "has_error"))
    run("rate_by_hour", lambda: reports.rate_by(clean, "transaction_hour"))
    run("rate_by_weekday", lambda: reports.rate_by(clean, "day_of_week"))
    run("rate_by_month", lambda: reports.rate_by_month(orders))
    run("high_risk_mcc_top", lambda: reports.high_risk_categories(clean, min_transactions=100))
    run("amount_stats_by_label", lambda: reports.amount_by_label(clean))
    run("behavior_median_by_label", lambda: reports.ratio_by_label(basic, behavior))
    run("join_coverage", lambda: quality.join_coverage(clean, cards, users))
    run("transaction_investigation", lambda: lookup.investigate(clean, behavior, 842))
    by_id = build("clean_sorted", lambda: clean.repartitionByRange("transaction_id").sortWithinPartitions("transaction_id"))
    run("investigation_sorted", lambda: lookup.investigate_payment(by_id, 842))
    wide = 500  # lowered, so that the paths for heavy keys and large tables run
    run("behavior_features_hot_keys", lambda: tables.behavior_features(skewed, decimals=fx.DECIMALS, max_group_rows=wide))
    run("model_matrix_hot_keys", lambda: tables.model_matrix(skewed, cards, users, decimals=fx.DECIMALS, max_group_rows=wide))
    run("amount_stats_narrowed", lambda: reports.amount_by_label(clean, direct_values=wide))
    run("median_by_many_groups", lambda: exact_quantiles(orders, {"m": ("amount", 0.5)}, ["client_id"], direct_values=wide))
    csv, document = scratch_path(spark, "csv"), scratch_path(spark, "json")
    files.write_csv(raw, csv)
    files.write_label_json(raw_labels, document, "transaction_id")
    run("transactions_csv", lambda: files.read_transactions(spark, csv))
    run("labels_json", lambda: files.read_label_json(spark, document))
    run("drift_payment_method", lambda: reports.drift_by_payment_method(orders, datasets.time_cutoffs(orders)[1]))
    run("drift_amount", lambda: reports.drift_of_amount(orders, datasets.time_cutoffs(orders)[1]))

    start = time.perf_counter()
    recent_start, test_start = datasets.time_cutoffs(clean)
    seconds["time_quantile_cutoffs"] = round(time.perf_counter() - start, 3)
    run("model_matrix_from_tables", lambda: tables.model_matrix_from_tables(basic, behavior, clean))
    run("baseline_train_set", lambda: datasets.baseline_train(matrix, test_start))
    run("recent_train_set", lambda: datasets.recent_train(matrix, recent_start, test_start))
    run("column_medians", lambda: models.column_medians(datasets.recent_train(matrix, recent_start, test_start)))

    past, recent = datasets.baseline_train(matrix, test_start), datasets.recent_train(matrix, recent_start, test_start)
    future = datasets.future_test(matrix, test_start)
    for name, fit, train in (("baseline", models.fit_baseline, past), ("recent", models.fit_recent, recent)):
        start = time.perf_counter()
        model = fit(train)
        seconds[f"fit_{name}"] = round(time.perf_counter() - start, 3)
        run(f"score_{name}", lambda: models.score(model, future))
        run(f"evaluate_{name}", lambda: models.evaluate(models.score(model, future)))

    bucket = (F.xxhash64("transaction_id") % 1_000_000).cast("double") / 1_000_000
    scored = save(clean.select("transaction_id", "is_fraud", F.abs(bucket).alias("score")), "scored")
    run("classification_report", lambda: metrics.classification_report(metrics.decide(scored)))
    run("ranking_scores", lambda: metrics.ranking_scores(scored))
    stored.close()
    spark.stop()

    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "flow_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
