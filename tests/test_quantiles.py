"""Exact quantiles: the narrowing path against numpy and the built-in."""

from datetime import datetime, timedelta
from random import Random

import numpy as np
import pytest

from payrisk.operators import quantiles
from payrisk.operators.quantiles import exact_quantiles
from payrisk.plans import datasets


def table(spark, n, seed):
    rng, rows = Random(seed), []
    for i in range(n):
        group = rng.choice([0, 1, None])
        tied = 5.0 if i % 3 == 0 else round(rng.gauss(0, 10), 1)
        rows.append((group, tied, None if i % 7 == 0 else rng.random() ** 9 * 1e6))
    return rows, spark.createDataFrame(rows, "g int, tied double, skewed double")


WANTED = {"a": ("tied", 0.5), "b": ("skewed", 0.5), "c": ("skewed", 0.9), "d": ("tied", 0.0), "e": ("tied", 1.0)}


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("limit", [1, 50])
def test_narrowing_matches_brute_force(spark, monkeypatch, accuracy, limit):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    rows, df = table(spark, 2000, 3)
    found = {r["g"]: r for r in exact_quantiles(df.repartition(5), WANTED, ["g"], direct_values=limit).collect()}
    for g in (0, 1, None):
        for name, (column, fraction) in WANTED.items():
            values = [r[1 if column == "tied" else 2] for r in rows if r[0] == g]
            expected = np.quantile([v for v in values if v is not None], fraction)
            assert found[g][name] == pytest.approx(expected, rel=1e-12), (g, name)


def test_both_paths_agree_without_groups(spark):
    _, df = table(spark, 999, 8)
    assert exact_quantiles(df, WANTED, direct_values=10).first() == exact_quantiles(df, WANTED).first()


def test_group_without_values_gives_null(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, 4.0)] * 5, "g int, v double")
    for limit in (1, 1000):
        found = {r["g"]: r["m"] for r in exact_quantiles(df, {"m": ("v", 0.5)}, ["g"], direct_values=limit).collect()}
        assert found == {1: None, 2: 3.5}


@pytest.mark.parametrize("limit", [1, 100_000])
def test_any_number_of_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 2)
    rows, df = table(spark, 2000, 5)
    rows.append((7, None, None))
    df = df.union(spark.createDataFrame(rows[-1:], df.schema))
    found = {r["g"]: r for r in exact_quantiles(df.repartition(5), WANTED, ["g"], direct_values=limit).collect()}
    assert found.keys() == {0, 1, None, 7}
    for g in (0, 1, None, 7):
        for name, (column, fraction) in WANTED.items():
            values = [r[1 if column == "tied" else 2] for r in rows if r[0] == g]
            values = [v for v in values if v is not None]
            expected = np.quantile(values, fraction) if values else None
            assert found[g][name] == (pytest.approx(expected, rel=1e-12) if values else None), (g, name)


def test_thousand_groups_like_the_built_in(spark):
    df = spark.range(5000).selectExpr("id % 1000 AS k", "double(id * 7919 % 5000) AS v")
    small, large = (
        {r["k"]: r["m"] for r in exact_quantiles(df, {"m": ("v", 0.5)}, ["k"], direct_values=n).collect()} for n in (10, 10**6)
    )
    assert small == large and len(small) == 1000


def test_time_quantiles_on_both_paths(spark):
    start = datetime(2020, 2, 28, 23, 59, 59, 7)
    times = [start + timedelta(microseconds=i * i * 1_000_003) for i in range(301)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "transaction_time timestamp_ntz")
    expected = (times[180], times[240])
    assert datasets.time_cutoffs(df) == expected
    assert datasets.time_cutoffs(df, direct_values=5) == expected
