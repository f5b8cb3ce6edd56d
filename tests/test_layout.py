"""Clustered tables: same rows, few files left for a filter on any of the columns."""

import glob
from datetime import datetime

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from payrisk import fixtures as fx
from payrisk.plans import lookup
from payrisk.sources import layout

FOLDER = "/root/testdata/sf0.01"


def files_left(path, column, value):
    """Share of the files whose minimum and maximum allow the value."""
    kept, names = 0, glob.glob(f"{path}/*.parquet")
    for name in names:
        meta = pq.ParquetFile(name).metadata
        at = [meta.schema.column(k).path for k in range(meta.num_columns)].index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        kept += any(s.has_min_max and s.min <= value <= s.max for s in stats)
    return kept / len(names)


def rows_scanned(df):
    """Rows that the scans of a query gave, after files, row groups and pages were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if "Adaptive" not in plan.getClass().getName() else plan.executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_filters_on_customer_card_and_id_skip_most_files(spark, tmp_path):
    clean = fx.stored_clean(spark, FOLDER)
    n = clean.count()
    laid = layout.write_clustered(clean, str(tmp_path / "t"), ["client_id", "card_id"], "transaction_id", file_rows=25)
    assert laid.exceptAll(clean).isEmpty() and clean.exceptAll(laid).isEmpty()
    some = clean.where("client_id is not null and card_id is not null").orderBy(F.xxhash64("transaction_id")).limit(12).collect()
    for column in ("client_id", "card_id"):
        left = [files_left(str(tmp_path / "t"), column, r[column]) for r in some]
        assert sum(left) / len(left) < 0.10, (column, left)
        for r in some[:3]:
            assert rows_scanned(laid.where(F.col(column) == r[column])) < 0.10 * n
    for r in some[:3]:
        assert rows_scanned(laid.where(F.col("transaction_id") == r["transaction_id"])) < 0.10 * n


def test_many_small_pieces_share_files_and_are_skipped_as_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "SMALL_FILES", 16, raising=False)
    draw = F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(500)), F.pmod(F.xxhash64("transaction_id", F.lit(2)), F.lit(700))
    rows = spark.range(8000).select(F.col("id").alias("transaction_id"), draw[0].alias("client_id"), draw[1].alias("card_id"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    laid = layout.write_clustered(df, str(tmp_path / "t"), ["client_id", "card_id"], "transaction_id", file_rows=50)
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) <= 16
    assert laid.exceptAll(df).isEmpty() and df.exceptAll(laid).isEmpty()
    for column, value in (("client_id", 17), ("card_id", 333)):
        same = laid.where(F.col(column) == value)
        assert same.count() == df.where(F.col(column) == value).count() > 0
        # One of 16 files has 500 rows; of the files that a filter on one column leaves, only some pages are read.
        assert rows_scanned(same) <= 0.16 * 8000, column


def test_investigation_reads_little_and_says_the_same(spark, tmp_path):
    clean = fx.stored_clean(spark, FOLDER)
    laid = layout.write_clustered(clean, str(tmp_path / "t"), ["client_id", "card_id"], "transaction_id", file_rows=50)
    for number in (842, 17, 4321, -1):
        assert lookup.investigate_payment(laid, number).collect() == lookup.investigate_payment(clean, number).collect()


def test_heavy_missing_and_single_values(spark, tmp_path):
    rows = [(k, 7 if k % 3 else k, None if k % 4 == 0 else k % 50, datetime(2024, 1, 1)) for k in range(2000)]
    df = spark.createDataFrame(rows, "transaction_id bigint, client_id bigint, card_id bigint, t timestamp_ntz")
    for k, columns in enumerate((["client_id", "card_id"], ["card_id"], ["client_id", "card_id", "transaction_id"])):
        laid = layout.write_clustered(df, str(tmp_path / f"t{k}"), columns, "transaction_id", file_rows=100)
        assert laid.exceptAll(df).isEmpty() and laid.count() == 2000
        sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t{k}/*.parquet")]
        # A third of the rows share a customer, a quarter have no card; no file is much larger for that.
        assert max(sizes) <= 400 and len(sizes) >= 10
    empty = layout.write_clustered(df.limit(0), str(tmp_path / "e"), ["client_id"], "transaction_id")
    assert empty.count() == 0
    none = df.withColumn("client_id", F.lit(None).cast("bigint"))
    assert layout.write_clustered(none, str(tmp_path / "n"), ["client_id"], "transaction_id").count() == 2000


def test_places_on_the_curve(spark):
    near = spark.range(64).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).cast("bigint").alias("b"))
    found = near.withColumn("z", layout.interleaved([F.col("a"), F.col("b")], 3)).collect()
    assert sorted(r["z"] for r in found) == list(range(64))
    want = {(a, b): sum(((a >> k) & 1) << (2 * k + 1) | ((b >> k) & 1) << (2 * k) for k in range(3)) for a in range(8) for b in range(8)}
    assert all(r["z"] == want[r["a"], r["b"]] for r in found)


def test_the_hilbert_curve_has_no_jumps(spark):
    grid = spark.range(256).select((F.col("id") % 16).alias("a"), F.floor(F.col("id") / 16).cast("bigint").alias("b"))
    found = grid.withColumn("place", layout.hilbert(F.col("a"), F.col("b"), 4)).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(256))
    assert all(abs(r["a"] - s["a"]) + abs(r["b"] - s["b"]) == 1 for r, s in zip(found, found[1:]))
