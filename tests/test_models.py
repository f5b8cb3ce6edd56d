"""Model inputs and the two classifiers."""

import pytest
from pyspark.sql import functions as F

from payrisk import fixtures as fx
from payrisk.plans import metrics, models
from payrisk.schemas import MODEL_FEATURES


@pytest.fixture(scope="module")
def planted(spark):
    """A matrix in which large online payments are mostly fraud, with gaps to fill."""
    u = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(10_000)) / 10_000.0
    df = spark.range(3000).withColumn("is_fraud", F.when(u(0) < 0.06, 1).otherwise(0).cast("bigint"))
    fraud = F.col("is_fraud")
    made = {f: u(i + 10) * 10 for i, f in enumerate(MODEL_FEATURES)}
    made["absolute_amount"] = u(1) * 50 + fraud * 60 * u(2)
    made["is_online"] = F.when(u(3) < F.lit(0.2) + fraud * 0.6, 1).otherwise(0)
    made["credit_limit"] = F.when(u(4) > 0.1, u(5) * 1000)
    made["total_debt"] = F.lit(None).cast("double")
    df = df.withColumns(made).withColumnRenamed("id", "transaction_id")
    train, test = df.where("transaction_id < 2000"), df.where("transaction_id >= 2000")
    return train.cache(), test.cache()


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "a double, b double")
    fills = models.fill_values(df, ["a", "b"])
    assert fills == {"a": 2.5, "b": 0.0}
    assert sorted(r["a"] for r in models.fill_missing(df, fills).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    scaling = models.scaling_values(df, ["a", "b"])
    assert scaling["a"] == models.Scaling(2.0, 1.0)
    assert sorted(tuple(r) for r in models.scale(df, scaling).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "is_fraud int")
    assert {r[0]: r[1] for r in models.balanced_class_weights(df).collect()} == {0: 10 / 18, 1: 5.0}
    weighted = models.with_balanced_weight(df).groupBy("is_fraud").agg(F.sum("weight").alias("w"))
    assert {r[0]: round(r[1], 9) for r in weighted.collect()} == {0: 5.0, 1: 5.0}
    fixed = models.with_fraud_weight(df).groupBy("is_fraud").agg(F.max("weight").alias("w"))
    assert {r[0]: r[1] for r in fixed.collect()} == {0: 1.0, 1: 40.0}


FITS = {
    "baseline": lambda train: models.fit_baseline(train, max_passes=50),
    "recent": lambda train: models.fit_recent(train, rounds=5),
}


@pytest.mark.parametrize("kind", FITS)
def test_model_learns_repeats_and_survives_saving(spark, planted, tmp_path, kind):
    train, test = planted
    model = FITS[kind](train)
    scored = models.score(model, test)
    assert scored.columns == ["transaction_id", "is_fraud", "score", "predicted"] and scored.count() == test.count()
    assert metrics.ranking_scores(scored).first()["roc_auc"] > 0.8
    assert scored.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0

    first = sorted(map(tuple, scored.collect()))
    path = str(tmp_path / kind)
    models.save_model(model, path)
    models.save_model(model, path)
    assert sorted(map(tuple, models.score(models.load_model(path), test).collect())) == first
    again = sorted(map(tuple, models.score(FITS[kind](train), test).collect()))
    assert [r[2] for r in again] == pytest.approx([r[2] for r in first], abs=1e-9)


def test_early_stop_is_asked_for(spark, planted):
    model = models.fit_recent(planted[0], rounds=4, held_out_percent=10, tolerance=0.5)
    assert len(model.stages[-1].trees) < 4
    assert len(models.fit_recent(planted[0], rounds=4).stages[-1].trees) == 4


def test_medians_of_the_fixture(spark, folder):
    row = models.column_medians(fx.matrix(spark, folder), ["absolute_amount"]).first()
    narrowed = models.column_medians(fx.matrix(spark, folder), ["absolute_amount"], direct_values=10).first()
    assert row == narrowed
