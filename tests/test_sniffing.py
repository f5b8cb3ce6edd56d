"""Deliveries with odd rows and columns: nothing is lost, and nothing ends the run."""

from datetime import date, datetime

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from payrisk.sources.sniffing import read_delivery

SCHEMA = StructType([StructField("id", LongType()), StructField("at", TimestampNTZType()), StructField("who", StringType())])
HEADER = "who,id,at,count,share,day,moment,yes,odd,empty"
GOOD = [
    "ann,1,2024-01-01 10:00:00,4,0.5,2024-02-29,2024-01-01 00:00:00,true,1,",
    '"b ""x"", c",2,2024-01-01 10:00:00.5,-7,3,2023-01-01,2024-01-01T05:00:00,false,x,',
    ",,,,,,,,,",
]


def deliver(tmp_path, *lines, header=HEADER):
    (tmp_path / "in.csv").write_text("\n".join([header, *lines]) + "\n")
    return str(tmp_path / "in.csv")


def test_types_and_rejected_rows(spark, tmp_path):
    bad = [
        "x,1.5,2024-01-01 10:00:00,1,1,2024-01-01,2024-01-01 00:00:00,true,1,",
        "x,9,2024,oops,1,2024-01-01,2024-01-01 00:00:00,true,1,",
        "x,one,2024-02-30 10:00:00,1,1,2024-01-01,2024-01-01 00:00:00,true,1,",
        "too,few",
        "x,1,2024-01-01 10:00:00,1,1,2024-01-01,2024-01-01 00:00:00,true,1,,many",
    ]
    found = read_delivery(spark, deliver(tmp_path, *GOOD, *bad), SCHEMA)
    assert found.types == {
        "who": "string", "id": "bigint", "at": "timestamp_ntz", "count": "bigint", "share": "double", "day": "date",
        "moment": "timestamp_ntz", "yes": "boolean", "odd": "string", "empty": "string",
    }
    rows = {r["id"]: r for r in found.rows.collect()}
    assert set(rows) == {1, 2, None} and found.rows.columns == HEADER.split(",")
    assert rows[2]["who"] == 'b "x", c' and rows[2]["at"] == datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert rows[1]["day"] == date(2024, 2, 29) and rows[1]["yes"] is True and set(rows[None]) == {None}
    rejected = found.rejected.collect()
    assert sorted(r["reason"] for r in rejected) == sorted([
        "id is no bigint", "at is no timestamp_ntz", "id is no bigint; at is no timestamp_ntz",
        "other number of fields", "other number of fields",
    ])
    assert all(r["file"].endswith("in.csv") for r in rejected) and {"too,few"} <= {r["raw"] for r in rejected}


def test_one_odd_value_among_many_makes_a_text(spark, tmp_path):
    lines = [f"w,{k},2024-01-01 10:00:00,{k if k != 777 else 'n/a'}" for k in range(2000)]
    found = read_delivery(spark, deliver(tmp_path, *lines, header="who,id,at,count"), SCHEMA)
    assert found.types["count"] == "string" and found.rows.count() == 2000
    assert read_delivery(spark, deliver(tmp_path, *lines[:700], header="who,id,at,count"), SCHEMA).types["count"] == "bigint"


def test_no_rows_no_column_no_sniffing(spark, tmp_path):
    empty = read_delivery(spark, deliver(tmp_path), SCHEMA)
    assert empty.rows.count() == 0 and empty.rejected.count() == 0 and empty.types["count"] == "string"
    plain = read_delivery(spark, deliver(tmp_path, *GOOD), SCHEMA, sniff=False)
    assert plain.types["count"] == "string" and plain.rows.count() == 3
    with pytest.raises(ValueError, match="no column at"):
        read_delivery(spark, deliver(tmp_path, header="id,who"), SCHEMA)


def test_names_with_dots(spark, tmp_path):
    found = read_delivery(spark, deliver(tmp_path, "a,1,2024-01-01 10:00:00,5", header="who,id,at,a.b"), SCHEMA)
    assert found.types["a.b"] == "bigint" and found.rows.first()["a.b"] == 5
