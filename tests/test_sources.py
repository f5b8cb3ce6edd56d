"""Files and tables in and out."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from payrisk import fixtures as fx
from payrisk.functions.mcc import MCC_DESCRIPTIONS
from payrisk.plans import quality, tables
from payrisk.schemas import BASIC_FEATURE_COLUMNS, CLEAN_COLUMNS, RAW_USERS
from payrisk.sources import files

TRANSACTIONS = '''id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors
1,2024-01-07 13:05:00,10,100,$-77.00,Chip Transaction,5,"Saint ""Q"", City",CA,90210.0,5812,
2,2024-01-08 00:00:00,10,100,"$1,234.56",Swipe Transaction,5,X,,,5411,"Bad PIN,Insufficient Balance"
3,2024-01-09 23:59:59,11,101,$5.00,Online Transaction,6,ONLINE,,,4829,   
'''


def written(path, text):
    path.write_text(text)
    return str(path)


def test_transactions_csv(spark, tmp_path):
    df = files.read_transactions(spark, written(tmp_path / "t.csv", TRANSACTIONS))
    first, second, third = df.orderBy("id").collect()
    assert first["merchant_city"] == 'Saint "Q", City' and first["errors"] is None and first["zip"] == 90210.0
    assert second["amount"] == "$1,234.56" and second["errors"] == "Bad PIN,Insufficient Balance"
    assert second["merchant_state"] is None and third["date"].hour == 23


def test_clean_table_from_csv_files(spark, tmp_path):
    transactions = files.read_transactions(spark, written(tmp_path / "t.csv", TRANSACTIONS))
    labels = files.read_labels(spark, written(tmp_path / "l.csv", "transaction_id,is_fraud\n1,1\n2,0\n9,1\n"))
    clean = tables.transactions_clean(transactions, labels)
    assert clean.columns == CLEAN_COLUMNS
    one, two = clean.orderBy("transaction_id").collect()
    assert (one["amount"], one["transaction_hour"], one["day_of_week"], one["has_error"], one["is_fraud"]) == (
        -77.0, 13, 0, 0, 1,
    )
    assert two["amount"] is None and two["has_error"] == 1


def test_cards_and_users_csv_and_missing_matches(spark, tmp_path):
    cards = files.read_cards(
        spark,
        written(
            tmp_path / "c.csv",
            'id,card_brand,card_type,has_chip,card_on_dark_web,credit_limit\n'
            '100,Visa,Debit,YES,No,"$24,295"\n101,Visa,Debit,NO,Yes,$0\n',
        ),
    )
    users = files.read_users(
        spark,
        written(
            tmp_path / "u.csv",
            'id,credit_score,yearly_income,total_debt,num_credit_cards\n10,700,"$59,696","$127,613",5\n',
        ),
    )
    rows = [(1, 10, 100, -50.0), (2, 11, 101, 5.0), (3, 12, 999, None)]
    clean = spark.createDataFrame(rows, "transaction_id bigint, client_id bigint, card_id bigint, amount double")
    clean = clean.select(
        "*", F.lit("Chip Transaction").alias("use_chip"), F.lit(1).alias("mcc"), F.lit(3).alias("transaction_hour"),
        F.lit(0).alias("day_of_week"), F.lit(0).alias("has_error"), F.lit(0).alias("is_fraud"),
    )
    basic = tables.model_features_basic(clean, cards, users)
    assert basic.columns == BASIC_FEATURE_COLUMNS
    one, two, three = basic.orderBy("transaction_id").collect()
    assert (one["is_refund"], one["absolute_amount"], one["has_chip"], one["credit_limit"]) == (1, 50.0, True, 24295.0)
    assert one["amount_to_credit_limit"] == 50.0 / 24295.0 and one["yearly_income"] == 59696.0
    assert (two["card_on_dark_web"], two["credit_limit"], two["amount_to_credit_limit"]) == (1, 0.0, None)
    assert (three["card_on_dark_web"], three["has_chip"], three["credit_limit"]) == (0, None, None)
    assert (three["is_refund"], three["absolute_amount"], three["credit_score"]) == (0, None, None)


def test_label_json(spark, tmp_path):
    path = written(tmp_path / "l.json", '{"target": {"11":"Yes","12":"No", "13" : "yes"}}')
    found = files.encode_labels(files.read_label_json(spark, path)).orderBy("transaction_id").collect()
    assert [tuple(r) for r in found] == [(11, 1), (12, 0), (13, 0)]


def test_label_json_keeps_every_pair(spark, tmp_path):
    pairs = {"-12": "Yes", "0": "No", "7": 'quo"ted \\ text', "9": "é", "10": ""}
    path = written(tmp_path / "odd.json", json.dumps({"target": pairs}, indent=1))
    assert {r[0]: r[1] for r in files.read_label_json(spark, path).collect()} == {int(k): v for k, v in pairs.items()}
    assert files.read_label_json(spark, written(tmp_path / "empty.json", '{"target": {}}')).count() == 0


@pytest.mark.parametrize("pair", ['"a13": "Yes"', '"13": "Yes, no"', '"13": 1', '"13" "Yes"', '"other": {"1": "Yes"}'])
def test_label_json_that_is_no_pair_fails(spark, tmp_path, pair):
    path = written(tmp_path / "bad.json", '{"target": {"1": "Yes", ' + pair + ', "2": "No"}}')
    with pytest.raises(Exception, match="not one pair"):
        files.read_label_json(spark, path).collect()


def test_label_json_is_written_and_read(spark, tmp_path):
    rows = [(k, ["Yes", 'a "b", \\ c'.replace(",", ";")][k % 2]) for k in range(50)]
    labels = spark.createDataFrame(rows, "transaction_id bigint, label string")
    files.write_label_json(labels, str(tmp_path / "out"), "transaction_id")
    assert {r[0]: r[1] for r in files.read_label_json(spark, str(tmp_path / "out")).collect()} == dict(rows)


def test_csv_columns_go_by_name(spark, tmp_path):
    path = written(tmp_path / "u.csv", 'num_credit_cards,extra,id,"total_debt",yearly_income,credit_score\n3,"x, y",1,$5,$7,700\n')
    assert tuple(files.read_users(spark, path).first()) == (1, 700, "$7", "$5", 3)
    assert files.read_users(spark, path).columns == [f.name for f in RAW_USERS]


def test_csv_without_a_column_is_refused(spark, tmp_path):
    path = written(tmp_path / "u.csv", "id,credit_score,yearly_income,num_credit_cards\n1,700,$7,3\n")
    with pytest.raises(ValueError, match="no column total_debt"):
        files.read_users(spark, path)


def test_csv_files_that_disagree_are_refused(spark, tmp_path):
    (tmp_path / "two").mkdir()
    written(tmp_path / "two" / "a.csv", "transaction_id,is_fraud\n1,0\n")
    written(tmp_path / "two" / "b.csv", "is_fraud,transaction_id\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_labels(spark, str(tmp_path / "two")).collect()


def test_csv_line_breaks_are_an_option(spark, tmp_path):
    path = written(tmp_path / "t.csv", TRANSACTIONS.replace("Bad PIN,Insufficient", "Bad PIN\nInsufficient"))
    rows = files.read_transactions(spark, path, line_breaks=True).orderBy("id").collect()
    assert len(rows) == 3 and rows[1]["errors"] == "Bad PIN\nInsufficient Balance"


def test_label_json_is_cut_anywhere_and_the_last_of_a_repeated_id_counts(spark, tmp_path):
    pairs = [(i % 900, "Yes" if i % 7 == 0 else "No") for i in range(4000)]
    expected = dict(pairs)
    text = '{"target": {' + ", ".join(f'"{k}": "{v}"' for k, v in pairs) + "}}"
    path = written(tmp_path / "big.json", text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        labels = files.read_label_json(spark, path)
        assert spark.read.text(path, lineSep=",").rdd.getNumPartitions() > 8
        assert {r[0]: r[1] for r in labels.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_label_summary_counts_yes_and_no_apart(spark):
    labels = spark.createDataFrame([(1, "Yes"), (2, "No"), (3, "yes"), (4, "Unknown")], "transaction_id bigint, label string")
    assert tuple(quality.label_summary(labels).first()) == (4, 1, 1, 25.0)


def test_category_json(spark, tmp_path):
    path = written(tmp_path / "mcc.json", json.dumps(MCC_DESCRIPTIONS, indent=4))
    found = files.read_category_json(spark, path)
    assert {tuple(r) for r in found.collect()} == set(MCC_DESCRIPTIONS.items())
    assert files.category_lookup(spark).count() == len(MCC_DESCRIPTIONS) == 109
    shown = files.preview(found, "mcc", 10).collect()
    assert [r["mcc"] for r in shown] == sorted(MCC_DESCRIPTIONS)[:10]


def test_label_csv_sink(spark, tmp_path, folder):
    labels = fx.labels(spark, folder)
    path = str(tmp_path / "labels")
    for _ in range(2):  # written again, it replaces what was there
        files.write_csv(labels, path)
    back = files.read_labels(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, labels.collect()))


def test_replaced_table_and_lookup_filter(spark, tmp_path, folder):
    path = str(tmp_path / "clean")
    files.replace_table(fx.clean(spark, folder).limit(3), path)
    clean = files.replace_table(fx.clean(spark, folder), path, sort_by="transaction_id")
    assert clean.count() == 900
    plan = clean.where("transaction_id = 42").select("amount")._jdf.queryExecution().toString()
    assert "EqualTo(transaction_id,42)" in plan and "ReadSchema: struct<transaction_id:bigint,amount:double>" in plan


def test_month_partitions_are_pruned(spark, tmp_path, folder):
    monthly = fx.long_period(spark, folder).withColumn("month", F.date_format("transaction_time", "yyyy-MM"))
    stored = files.replace_table(monthly, str(tmp_path / "m"), partition_by="month")
    plan = stored.where("month = '1997-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    saved = [
        files.replace_bucketed_table(df, name, "transaction_id", 4)
        for df, name in (
            (fx.basic(spark, folder), "t_basic"), (fx.behavior(spark, folder), "t_behavior"),
            (fx.clean(spark, folder), "t_clean"),
        )
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        matrix = tables.model_matrix_from_tables(*saved)
        assert "Exchange" not in matrix._jdf.queryExecution().executedPlan().toString()
        assert matrix.count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("t_basic", "t_behavior", "t_clean"):
            spark.sql(f"DROP TABLE {name}")


def test_unlike_bucket_counts_join_without_a_shuffle(spark, folder):
    matrix = registry.matrix_bucketed(spark, folder)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "(Coalesced to 4)" in plan
    assert matrix.count() == 900


def test_schema_listing(spark, folder):
    listed = files.describe_columns(fx.raw_cards(spark, folder))
    assert [(r["col_name"], r["data_type"]) for r in listed.collect()] == [
        ("id", "bigint"), ("card_brand", "string"), ("card_type", "string"), ("has_chip", "string"),
        ("card_on_dark_web", "string"), ("credit_limit", "string"),
    ]
