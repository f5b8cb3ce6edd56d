"""Spending history: order, gaps, no look-ahead, and the split path for heavy keys."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from payrisk import session
from payrisk.operators import skew
from payrisk.operators.history import add_prior_average
from payrisk.operators.running import prior_totals
from payrisk.operators.skew import find_hot_keys, find_hot_keys_of, left_lookup, split_hot
from payrisk.plans import lookup, tables
from payrisk.schemas import RAW_CARDS, RAW_USERS

SCHEMA = "transaction_id bigint, transaction_time timestamp_ntz, client_id bigint, card_id bigint, amount double"
START = datetime(2024, 1, 1)


def payments(spark, items):
    """(id, minute or None, client, card, amount)"""
    return spark.createDataFrame(
        [(i, None if m is None else START + timedelta(minutes=m), c, k, a) for i, m, c, k, a in items], SCHEMA
    )


def history_of(df, **kwargs):
    return {r["transaction_id"]: r for r in tables.behavior_features(df, **({"decimals": 2} | kwargs)).collect()}


def test_average_of_strictly_earlier_payments(spark):
    df = payments(spark, [(1, 0, 1, 1, 1.0), (2, 1, 1, 1, None), (3, 2, 1, 1, 3.0), (4, 3, 1, 2, 5.0)])
    found = history_of(df)
    assert [found[i]["customer_previous_avg"] for i in (1, 2, 3, 4)] == [None, 1.0, 1.0, 2.0]
    assert [found[i]["card_previous_avg"] for i in (1, 2, 3, 4)] == [None, 1.0, 1.0, None]
    assert found[4]["amount_vs_customer_avg"] == 2.5 and found[4]["amount_vs_card_avg"] is None


def test_equal_times_are_ordered_by_id(spark):
    found = history_of(payments(spark, [(7, 0, 1, 1, 10.0), (5, 0, 1, 1, 4.0)]))
    assert found[5]["customer_previous_avg"] is None and found[7]["customer_previous_avg"] == 4.0


def test_refunds_count_by_size(spark):
    found = history_of(payments(spark, [(1, 0, 1, 1, -10.0), (2, 1, 1, 1, 20.0)]))
    assert found[2]["customer_previous_avg"] == 10.0 and found[2]["amount_vs_customer_avg"] == 2.0


def test_average_of_zero_gives_no_ratio(spark):
    found = history_of(payments(spark, [(1, 0, 1, 1, 0.0), (2, 1, 1, 1, 5.0)]))
    assert found[2]["customer_previous_avg"] == 0.0 and found[2]["amount_vs_customer_avg"] is None


def test_missing_time_comes_last_and_missing_keys_form_a_group(spark):
    found = history_of(payments(spark, [(1, None, None, 1, 9.0), (2, 5, None, 1, 3.0), (3, 4, None, 2, 1.0)]))
    assert [found[i]["customer_previous_avg"] for i in (3, 2, 1)] == [None, 1.0, 2.0]


def skewed(n=3000, seed=5):
    """A third of all rows on one client and one card, many of them at one moment."""
    rng, items = Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        client = 1 if hot else None if i % 11 == 0 else rng.randrange(2, 400)
        card = 1 if hot else rng.randrange(2, 300)
        minute = 100 if hot and i % 2 else None if i % 97 == 0 else rng.randrange(2000)
        amount = None if i % 13 == 0 else round(rng.uniform(-50, 300), 2)
        items.append((i, minute, client, card, amount))
    rng.shuffle(items)
    return items


def brute(items):
    result = {}
    ordered = sorted(items, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    for position, name in ((2, "customer_previous_avg"), (3, "card_previous_avg")):
        seen = {}
        for row in ordered:
            total, n = seen.get(row[position], (0, 0))
            result.setdefault(row[0], {})[name] = total / n / 100 if n else None
            if row[4] is not None:
                seen[row[position]] = (total + round(abs(row[4]) * 100), n + 1)
    return result


@pytest.mark.parametrize("limit", [50, 400, 10**6])
def test_heavy_keys_match_brute_force(spark, limit):
    items = skewed()
    expected, found = brute(items), history_of(payments(spark, items), max_group_rows=limit)
    assert found.keys() == expected.keys()
    for i, want in expected.items():
        assert {k: found[i][k] for k in want} == want


def test_plain_doubles_are_an_option(spark):
    items = [(1, 0, 1, 1, 0.001), (2, 1, 1, 1, 0.002), (3, 2, 1, 1, 1.0)]
    assert history_of(payments(spark, items), decimals=None)[3]["customer_previous_avg"] == pytest.approx(0.0015)
    split = history_of(payments(spark, skewed(600)), decimals=None, max_group_rows=50)
    whole = history_of(payments(spark, skewed(600)))
    for i, row in whole.items():
        assert split[i]["customer_previous_avg"] == pytest.approx(row["customer_previous_avg"])


def test_doubles_are_averaged_as_they_are(spark):
    items = [(k + 1, k, 1, 1, a) for k, a in enumerate([0.004, 1.005, 2.0, 1e17, 2.0])]
    found = history_of(payments(spark, items), decimals=None)
    means = [found[k + 1]["customer_previous_avg"] for k in range(5)]
    assert means[0] is None and means[1:] == pytest.approx([0.004, 0.5045, 1.003, 2.5e16], rel=1e-12)


@pytest.mark.parametrize("amount", [0.004, 1e17, float("nan"), float("inf")])
def test_amounts_that_do_not_fit_are_refused(spark, amount):
    items = [(1, 0, 1, 1, 5.0), (2, 1, 1, 1, amount), (3, 2, 1, 1, 1.0)]
    with pytest.raises(Exception, match="an amount does not have 2 decimals"):
        history_of(payments(spark, items), decimals=2)


def test_later_amounts_do_not_reach_back(spark):
    items = skewed(400)
    before = history_of(payments(spark, items))
    ordered = sorted(items, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    changed_id = ordered[200][0]
    changed = [(*r[:4], 99999.0) if r[0] == changed_id else r for r in items]
    after = history_of(payments(spark, changed))
    for row in ordered[:201]:
        for name in ("customer_previous_avg", "card_previous_avg"):
            assert before[row[0]][name] == after[row[0]][name]
    assert any(before[r[0]] != after[r[0]] for r in ordered[201:])


def test_input_order_does_not_matter(spark):
    items = skewed(500)
    shuffled = items[:]
    Random(1).shuffle(shuffled)
    assert history_of(payments(spark, items).repartition(7)) == history_of(payments(spark, shuffled).coalesce(1))


def test_hot_keys_are_found_with_their_rows(spark, monkeypatch):
    df = payments(spark, skewed())
    hot = find_hot_keys(df, "client_id", 3000, 150)
    assert {r[0] for r in hot.keys.collect()} == {1, None}
    assert hot.n_keys == 2 and hot.n_rows > 1000
    monkeypatch.setattr(skew, "MIN_BUCKETS", 2)  # ordinary keys share full buckets with heavy ones
    monkeypatch.setattr(skew, "BUCKETS_PER_GROUP", 0)
    again = find_hot_keys(df, "client_id", 3000, 150)
    assert {r[0] for r in again.keys.collect()} == {1, None} and again.n_rows == hot.n_rows
    ordinary, heavy = split_hot(df, hot)
    assert heavy.count() == hot.n_rows and ordinary.count() + heavy.count() == df.count()
    assert find_hot_keys(df, "client_id", 3000, 10**6) is None
    assert find_hot_keys_of(df, ["client_id", "card_id"], 10**6) == {"client_id": None, "card_id": None}


def test_blocks_are_bounded(spark):
    """The cut by (key, order) spreads one key over blocks of about the asked size."""
    df = payments(spark, skewed()).where("client_id = 1").withColumn("one", F.lit(1).cast("bigint"))
    n = df.count()
    out = prior_totals(df, ["client_id"], ["transaction_time", "transaction_id"], ["one"], n, 1, rows_per_block=100)
    assert sorted(r["prior_one"] for r in out.collect()) == list(range(n))


def files_of_blocks(spark, build):
    """Files of each stored cut into blocks, and the rows of its largest block."""
    before = len(session.written())
    build().collect()
    cuts = [path for path in session.written()[before:] if "/blocks-" in path]
    largest = [spark.read.parquet(p).groupBy("_block").count().agg(F.max("count")).first()[0] for p in cuts]
    return [len(spark.read.parquet(p).inputFiles()) for p in cuts], largest


def test_small_blocks_share_files(spark):
    df = payments(spark, skewed()).withColumn("one", F.lit(1).cast("bigint"))
    order = ["transaction_time", "transaction_id"]
    plain = prior_totals(df, ["client_id"], order, ["one"], 3000, 400)
    cut = prior_totals(df, ["client_id"], order, ["one"], 3000, 400, rows_per_block=10)
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()
    n_files, largest = files_of_blocks(
        spark, lambda: prior_totals(df, ["client_id"], order, ["one"], 3000, 400, rows_per_block=10)
    )
    assert len(n_files) == 1 and n_files[0] <= 40 and largest == [10]  # 300 blocks


def test_matrix_of_small_blocks_has_few_files(spark):
    clean = payments(spark, skewed()).withColumns({
        "use_chip": F.lit("x"), "transaction_hour": F.lit(1), "day_of_week": F.lit(1), "has_error": F.lit(0), "is_fraud": F.lit(0),
    })
    cards, users = spark.createDataFrame([], RAW_CARDS), spark.createDataFrame([], RAW_USERS)
    n_files, largest = files_of_blocks(
        spark, lambda: tables.model_matrix(clean, cards, users, decimals=2, max_group_rows=5)
    )
    assert len(n_files) == 2 and max(n_files) <= 40 and largest == [5, 5]


def test_left_lookup_of_heavy_keys_keeps_all_rows(spark):
    df = payments(spark, skewed())
    lookup = spark.createDataFrame([(k, k * 10) for k in range(1, 200)], "key bigint, worth bigint")
    hot = find_hot_keys(df, "card_id", 3000, 150)
    split = left_lookup(df, lookup, "card_id", "key", hot)
    whole = left_lookup(df, lookup, "card_id", "key")
    pick = lambda d: sorted((r["transaction_id"], r["worth"] or -1) for r in d.collect())
    assert pick(split) == pick(whole) and split.count() == df.count()
    assert hot is not None


@pytest.mark.parametrize("wanted", [1, 7, 300, 10**9])
def test_one_payment_like_its_whole_history(spark, wanted):
    clean = payments(spark, skewed(500)).withColumns({
        "use_chip": F.lit("x"), "merchant_id": F.lit(1), "mcc": F.lit(1), "has_error": F.lit(0), "is_fraud": F.lit(0),
    })
    one = lookup.investigate_payment(clean, wanted).collect()
    whole = lookup.investigate(clean, tables.behavior_features(clean), wanted).collect()
    assert one == whole and lookup.investigate_payment(clean, wanted).columns == whole_columns(clean)


def whole_columns(clean):
    return lookup.investigate(clean, tables.behavior_features(clean), 1).columns


def test_no_window_without_a_key_on_the_plain_path(spark):
    plan = add_prior_average(
        payments(spark, skewed(10)).withColumn("absolute_amount", F.abs("amount")), "client_id", "before"
    )._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
