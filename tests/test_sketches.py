"""Quantiles from stored sketches are exact, by one pass over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from payrisk.operators import sketches as sk

SCHEMA = "month int, label int, value double"


def drawn(spark, n, seed=1, ties=False):
    draw = np.random.default_rng(seed)
    values = draw.lognormal(3, 2, n)
    values = np.round(values) if ties else values
    label = (draw.random(n) < 0.1).astype(int)
    rows = [(int(m), int(k), float(v) if u > 0.02 else None) for m, k, v, u in zip(draw.integers(1, 13, n), label, values, draw.random(n))]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("n", "ties"), [(1, False), (2, False), (57, True), (20_000, False), (20_000, True)])
@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.6, 1.0])
def test_exact(spark, n, ties, fraction):
    rows, df = drawn(spark, n, seed=n, ties=ties)
    kept = sk.value_sketches(df, ["month", "label"], "value", k=64 if n > 1000 else sk.SKETCH_K)
    found = {r["label"]: r["q"] for r in sk.quantile_from_sketches(df, kept, ["label"], "value", fraction, "q", margin=0.08).collect()}
    for label in {r[1] for r in rows if r[2] is not None}:
        known = [v for _, k, v in rows if k == label and v is not None]
        assert found.pop(label) == pytest.approx(np.quantile(known, fraction), rel=1e-12)
    assert not found


def test_a_sketch_that_is_off_is_found_out(spark):
    """Sketches of other rows: their bounds miss the rank, and the answer is right all the same."""
    rows, df = drawn(spark, 3000)
    other = df.withColumn("value", F.col("value") * 1000 + 5e6)
    n_known = sum(v is not None for _, k, v in rows)
    kept = sk.value_sketches(other, ["label"], "value")
    found = {r["label"]: r["q"] for r in sk.quantile_from_sketches(df, kept, ["label"], "value", 0.5, "q").collect()}
    for label in (0, 1):
        assert found[label] == pytest.approx(np.median([v for _, k, v in rows if k == label and v is not None]))
    assert n_known > 0


def test_missing_keys_and_no_rows(spark):
    rows = [(1, None, 5.0), (2, None, 7.0), (1, 3, 1.0), (1, 4, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sk.value_sketches(df, ["month", "label"], "value")
    found = {r["label"]: r["q"] for r in sk.quantile_from_sketches(df, kept, ["label"], "value", 0.5, "q").collect()}
    assert found == {None: 6.0, 3: 1.0}
    none = df.limit(0)
    out = sk.quantile_from_sketches(none, sk.value_sketches(none, ["label"], "value"), ["label"], "value", 0.5, "q")
    assert out.columns == ["label", "q"] and out.count() == 0


def test_rows_are_read_once(spark, tmp_path):
    _, df = drawn(spark, 5000)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = sk.value_sketches(stored, ["month", "label"], "value")
    kept.write.parquet(str(tmp_path / "k"))
    wanted = sk.brackets(spark.read.parquet(str(tmp_path / "k")), ["label"], 0.5)
    plain = stored.select(F.col("label").alias("_by0"), F.col("value").alias("_value"))
    plan = sk._counted(plain, ["_by0"], wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "IsNotNull(value)" in plan
    # Only a small part of the rows goes into the counts by value.
    counted = sk._counted(plain, ["_by0"], wanted).where(F.col("_value") > float("-inf")).agg(F.sum("_n")).first()[0]
    assert counted < 0.05 * 5000
