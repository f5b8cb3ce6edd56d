"""Tables replaced in one step."""

import pytest
from pyspark.sql import functions as F

from payrisk.sources.snapshots import Snapshots


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_rewriting_a_table_from_itself(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.current() is None and table.versions() == []
    first = table.replace(spark.range(10))
    for k in range(3):
        table.replace(table.read().withColumn("id", F.col("id") + 1), sort_by="id", expect=table.current())
    assert ids(table.read()) == list(range(3, 13))
    # A reader keeps the version that it opened.
    assert ids(first) == list(range(10)) and len(table.versions()) == 4


def test_a_failed_job_leaves_the_table_as_it_was(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.replace(spark.range(5))
    before = table.current()
    odd = table.read().withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("bad row")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="bad row"):
        table.replace(odd)
    assert table.current() == before and ids(table.read()) == list(range(5))
    table.replace(spark.range(7))
    gone = table.drop_old()
    assert before in gone and table.versions() == [table.current()] and ids(table.read()) == list(range(7))


def test_a_writer_that_came_late_is_refused(spark, tmp_path):
    table, other = Snapshots(spark, str(tmp_path / "t")), Snapshots(spark, str(tmp_path / "t") + "/")
    seen = (table.replace(spark.range(3)), table.current())[1]
    other.replace(spark.range(4))
    with pytest.raises(RuntimeError, match="no longer"):
        table.replace(table.read(seen), expect=seen)
    assert ids(table.read()) == [0, 1, 2, 3] and len(table.versions()) == 2


def test_versions_kept(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    for k in range(4):
        table.replace(spark.range(k + 1))
    assert len(table.drop_old(keep=2)) == 2
    assert len(table.versions()) == 2 and ids(table.read()) == [0, 1, 2, 3]
