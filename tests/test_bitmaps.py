"""Ids as bitmaps: every id is found, no other, and the rows that look do not shuffle."""

import pytest

from payrisk import fixtures as fx
from payrisk.operators.bitmaps import id_bitmaps, with_found
from payrisk.plans import quality

SIDES = 'id bigint, bucket string'


@pytest.mark.parametrize("ids", [[], [0], [1, 1, 2, 32768, 32769], [-1, -32768, -32769, 5], [2**62, -(2**62), None, 7]])
def test_exactly_the_ids_are_found(spark, ids):
    looked = sorted({x + d for x in ids if x is not None for d in (-8, -1, 0, 1, 8, 32768)} | {0, 1, -1, 99})
    rows = spark.createDataFrame([(x, "clash") for x in [*looked, None]], SIDES)
    bitmaps = id_bitmaps(spark.createDataFrame([(x, "b") for x in ids], SIDES), "id")
    found = {r["id"]: r["found"] for r in with_found(rows, bitmaps, "id", "found").collect()}
    assert found == {x: x is not None and x in ids for x in [*looked, None]}


def test_coverage_without_a_shuffle_of_payments(spark, folder):
    clean, cards, users = fx.stored_clean(spark, folder), fx.raw_cards(spark, folder), fx.raw_users(spark, folder)
    by_joins = quality.join_coverage(clean, cards, users).collect()
    found = quality.join_coverage_by_bitmaps(clean, cards, users)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2
    assert found.collect() == by_joins
    # Listed twice is found once; ids too sparse for bitmaps go through joins.
    assert quality.join_coverage_by_bitmaps(clean, cards.union(cards), users).collect() == by_joins
    assert quality.join_coverage_by_bitmaps(clean, cards.union(cards), users, max_buckets=0).collect() == by_joins
