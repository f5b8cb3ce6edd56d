"""Evaluation numbers against brute force, with many tied scores."""

from random import Random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from payrisk.plans import metrics


def scored_rows(n=1500, seed=2, levels=60):
    rng = Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.08)
        rows.append((i, label, round(min(rng.random() + 0.25 * label, 1.0) * levels) / levels))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "transaction_id bigint, is_fraud bigint, score double")


def brute_ranking(rows):
    positives = sum(r[1] for r in rows)
    ap = 0.0
    for s in sorted({r[2] for r in rows}, reverse=True):
        above = [r for r in rows if r[2] >= s]
        ap += sum(r[1] for r in rows if r[2] == s) / positives * sum(r[1] for r in above) / len(above)
    wins = sum(
        (p[2] > n[2]) + (p[2] == n[2]) / 2 for p in rows if p[1] == 1 for n in rows if n[1] == 0
    )
    return ap, wins / (positives * (len(rows) - positives))


@pytest.mark.parametrize("block", [7, 10**6])
def test_ranking_scores_match_brute_force(spark, block):
    rows = scored_rows()
    found = metrics.ranking_scores(frame(spark, rows).repartition(6), max_block_rows=block).first()
    ap, auc = brute_ranking(rows)
    assert found["average_precision"] == pytest.approx(ap, rel=1e-12)
    assert found["roc_auc"] == pytest.approx(auc, rel=1e-12)


def test_roc_auc_matches_the_evaluator(spark):
    df = frame(spark, scored_rows(800, 9))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    expected = evaluator.evaluate(df.withColumn("label", F.col("is_fraud").cast("double")))
    assert metrics.ranking_scores(df).first()["roc_auc"] == pytest.approx(expected, rel=1e-9)


def test_one_class_only(spark):
    none = metrics.ranking_scores(frame(spark, [(1, 0, 0.1), (2, 0, 0.2)])).first()
    assert none["average_precision"] == 0.0 and none["roc_auc"] is None
    every = metrics.ranking_scores(frame(spark, [(1, 1, 0.1)])).first()
    assert every["average_precision"] == 1.0 and every["roc_auc"] is None


def test_decision_at_exactly_the_threshold(spark):
    df = metrics.decide(frame(spark, [(1, 0, 0.5), (2, 0, 0.4999)]))
    assert {r["transaction_id"]: r["predicted"] for r in df.collect()} == {1: 1, 2: 0}


def test_report_and_matrix(spark):
    counts = {(0, 0): 50, (0, 1): 10, (1, 0): 4, (1, 1): 6}
    rows = [(a, d) for (a, d), n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "is_fraud int, predicted int")
    assert {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df).collect()} == counts
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert list(report) == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["support"]) == (0.375, 0.6, 10)
    assert report["1"]["f1_score"] == 0.4615 and report["0"]["precision"] == 0.9259
    assert report["accuracy"]["f1_score"] == 0.8 and report["accuracy"]["precision"] is None
    assert report["macro avg"]["recall"] == 0.7167 and report["weighted avg"]["support"] == 70


def test_nothing_predicted_gives_zero_not_an_error(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "is_fraud int, predicted int")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["f1_score"] == 0.0
    assert [r["transactions"] for r in metrics.confusion_matrix(df).collect()] == [1, 0, 1, 0]
