"""History kept load by load equals the one computed at once."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from payrisk.plans import tables
from payrisk.plans.carried import CarriedHistory

SCHEMA = "transaction_id bigint, transaction_time timestamp_ntz, client_id bigint, card_id bigint, amount double"
START = datetime(2024, 1, 1)


def payments(spark, items):
    """(id, minute or None, client, card, amount)"""
    rows = [(i, None if m is None else START + timedelta(minutes=m), c, k, a) for i, m, c, k, a in items]
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("again", F.lit(7))


def some(n, seed):
    """Ties in time, missing times, keys and amounts, and a third of all on one customer and card."""
    rng, items = Random(seed), []
    for i in range(n):
        hot = rng.random() < 0.33
        client = 1 if hot else rng.choice([None, *range(2, 12)])
        card = 1 if hot else rng.choice([None, *range(2, 20)])
        minute = None if rng.random() < 0.03 else rng.randrange(200)
        items.append((i, minute, client, card, None if rng.random() < 0.05 else rng.randrange(-5000, 5000) / 100))
    rng.shuffle(items)
    return items


def by_id(df, columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r for r in found}


COLUMNS = ["transaction_id", "customer_previous_avg", "card_previous_avg", "amount_vs_customer_avg", "amount_vs_card_avg"]


@pytest.mark.parametrize(("limit", "in_order"), [(4_000_000, False), (40, False), (4_000_000, True)])
def test_loads_in_any_order_equal_one_pass(spark, tmp_path, limit, in_order):
    items = some(200, 3)
    if in_order:
        items.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    kept = CarriedHistory(spark, str(tmp_path / "h"), 2, limit)
    for k in range(0, 200, 100):
        changed = kept.extend(payments(spark, items[k : k + 100]))
        # Nothing is written anew unless something came late.
        assert (changed.count() == 100) == (in_order or k == 0)
    want = by_id(tables.behavior_features(payments(spark, items), decimals=2), COLUMNS)
    assert by_id(kept.features(), COLUMNS) == want
    assert kept.drop_old() and kept.drop_old() == []
    assert by_id(kept.features(), COLUMNS) == want


def test_totals(spark, tmp_path):
    kept = CarriedHistory(spark, str(tmp_path / "h"), 2)
    kept.extend(payments(spark, [(1, 5, 1, 1, 2.0), (2, 6, None, 1, 3.0)]))
    kept.extend(payments(spark, [(3, 4, 1, 2, -4.0), (4, 9, 2, 2, None)]))
    found = {r["key"]: (r["units"], r["payments"], r["last"]["id"]) for r in kept.totals("client_id").collect()}
    assert found == {1: (600, 2, 1), None: (300, 1, 2), 2: (0, 0, 4)}
    assert by_id(kept.features(), ["transaction_id", "customer_previous_avg"])[1] == (1, 4.0)


def test_empty_loads(spark, tmp_path):
    kept = CarriedHistory(spark, str(tmp_path / "h"), 2)
    assert kept.features().count() == 0
    for items in ([], [(1, 5, 1, 1, 2.0)], []):
        assert kept.extend(payments(spark, items)).count() == len(items)
    assert kept.features().count() == 1


def test_a_failed_load_leaves_the_history_as_it_was(spark, tmp_path):
    kept = CarriedHistory(spark, str(tmp_path / "h"), 2)
    kept.extend(payments(spark, [(1, 5, 1, 1, 2.0)]))
    with pytest.raises(Exception, match="decimals"):
        kept.extend(payments(spark, [(2, 6, 1, 1, 2.0001)]))
    assert by_id(kept.features(), ["transaction_id"]) == {1: (1,)}
    kept.extend(payments(spark, [(2, 6, 1, 1, 4.0), (3, 7, 1, 1, 1.0)]))
    assert by_id(kept.features(), ["transaction_id", "customer_previous_avg"])[3] == (3, 3.0)


def test_doubles(spark, tmp_path):
    items = some(100, 9)
    kept = CarriedHistory(spark, str(tmp_path / "h"))
    kept.extend(payments(spark, items[:60]))
    kept.extend(payments(spark, items[60:]))
    want = by_id(tables.behavior_features(payments(spark, items)), COLUMNS)
    for number, row in by_id(kept.features(), COLUMNS).items():
        for found, wanted in zip(row, want[number]):
            assert found == wanted if wanted is None else found == pytest.approx(wanted, rel=1e-12)


def test_files_of_earlier_times_are_skipped(spark, tmp_path):
    """Reopening reads from the first late payment on: the filter reaches the scan."""
    kept = CarriedHistory(spark, str(tmp_path / "h"), 2)
    kept.extend(payments(spark, some(100, 1)))
    late = spark.createDataFrame([(1, (False, START + timedelta(minutes=150), 5))], "key bigint, first struct<late: boolean, time: timestamp_ntz, id: bigint>")
    bounds = late.agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).first()
    rows = kept._kept().rows.limit(0).withColumn("again", F.lit(False))
    plan = kept._with_reopened(rows, kept._kept().rows, late, bounds, "client_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_time" in plan
