"""Reading the delivered files and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from payrisk.functions.columns import yes_no_label
from payrisk.functions.mcc import MCC_DESCRIPTIONS
from payrisk.schemas import LABELS, RAW_CARDS, RAW_TRANSACTIONS, RAW_USERS

# Fractions of a second are optional when read, and written in full.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "timestampNTZFormat": TIME_FORMAT}


def read_csv(spark: SparkSession, path: str, schema: StructType, *, line_breaks: bool = False) -> DataFrame:
    """The columns of ``schema``, found by their names in the header; their order and further columns do not matter.

    A quote inside a quoted field is doubled. The header of every file is checked against that of one, so files that do not
    agree fail instead of being read by position. Files split freely; with ``line_breaks`` quoted fields may hold
    line breaks, and each file is one task.
    """
    options = CSV_OPTIONS | {"multiLine": line_breaks}
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    wanted = {f.name: f for f in schema}
    in_file = StructType([wanted.get(name, StructField(name, StringType())) for name in names])
    rows = spark.read.schema(in_file).options(**options, mode="FAILFAST", enforceSchema=False).csv(path)
    return rows.select(*[f.name for f in schema])


def read_transactions(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, RAW_TRANSACTIONS, line_breaks=line_breaks)


def read_labels(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, LABELS, line_breaks=line_breaks)


def read_cards(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, RAW_CARDS, line_breaks=line_breaks)


def read_users(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, RAW_USERS, line_breaks=line_breaks)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` reads back unchanged: blank texts keep their spaces."""
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**CSV_OPTIONS, **keep_spaces).csv(path)


# A string of a JSON document, and what may stand in a piece beside its pair.
JSON_STRING = r'"((?:[^"\\]|\\.)*)"'
LABEL_PAIR = rf"{JSON_STRING}\s*:\s*{JSON_STRING}"
LABEL_PIECE = rf'^\s*(?:\{{\s*"target"\s*:\s*\{{\s*)?(?:{LABEL_PAIR})?[\s}}]*$'


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"target": {"<id>": "Yes" | "No", ...}}`` as (transaction_id, label).

    The document is one huge object, so it is not parsed as JSON: the text is cut
    at commas, which Spark can do from any offset in the file, and each piece
    holds one pair. A piece that is anything else, such as a label with a comma or an id that is no whole number, fails
    the read. Of a repeated id the last pair counts, as in any JSON object.
    """
    pieces = spark.read.text(path, lineSep=",").select(
        "value",
        F.regexp_extract("value", LABEL_PIECE, 1).alias("id"),
        F.regexp_extract("value", LABEL_PIECE, 2).alias("label"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("place"),
    )
    number = F.col("id").try_cast("bigint")
    odd = ~F.col("value").rlike(LABEL_PIECE) | ((F.col("id") != "") & number.isNull())
    plain = F.get_json_object(F.concat(F.lit('{"text":"'), F.col("label"), F.lit('"}')), "$.text")
    pairs = pieces.where(odd | (F.col("id") != "")).select(
        F.when(odd, F.raise_error(F.concat(F.lit("not one pair of id and label: "), F.col("value"))).cast("bigint"))
        .otherwise(number)
        .alias("transaction_id"),
        F.when(F.instr("label", "\\") > 0, plain).otherwise(F.col("label")).alias("label"),
        "place",
    )
    return pairs.groupBy("transaction_id").agg(F.max_by("label", "place").alias("label"))


def write_label_json(labels: DataFrame, path: str, order: str) -> None:
    """(transaction_id, label) as the pairs of such a document, in many part files; later ones by ``order`` come last."""
    quoted = F.to_json(F.struct("label"))
    pair = F.concat(F.lit('"'), F.col("transaction_id"), F.lit('":'), F.regexp_extract(quoted, r'^\{"label":(.*)\}$', 1))
    rows = labels.repartitionByRange(order).sortWithinPartitions(order).select(pair.alias("value"))
    rows.write.mode("overwrite").text(path, lineSep=",")


def encode_labels(labels: DataFrame) -> DataFrame:
    """(transaction_id, label) to (transaction_id, is_fraud)."""
    return labels.select("transaction_id", yes_no_label(F.col("label")).alias("is_fraud"))


def read_category_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"<code>": "<description>", ...}`` as (mcc, merchant_category)."""
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("codes"))
    return document.select(F.explode("codes").alias("mcc", "merchant_category"))


def category_lookup(spark: SparkSession) -> DataFrame:
    """The known merchant categories as (mcc, merchant_category)."""
    return spark.createDataFrame(list(MCC_DESCRIPTIONS.items()), "mcc string, merchant_category string")


def replace_table(df: DataFrame, path: str, *, sort_by: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in place of what was there, and read it back.

    ``sort_by`` range-partitions and sorts, so that look-ups by that column skip
    files and row groups by their min/max. ``partition_by`` makes one folder per
    value, for filters on few values such as a month.
    """
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_bucketed_table(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save as a catalog table bucketed and sorted by ``key``, in the folder ``path`` or in the warehouse.

    Tables with the same key and bucket count join without a shuffle. So do tables of which one has a multiple of the other's buckets, while
    ``spark.sql.bucketing.coalesceBucketsInJoin.enabled`` is set, as ``build_session`` does.
    Each bucket is written by one task, as one file.
    """
    placed = df.repartition(buckets, key)
    writer = placed.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def describe_columns(df: DataFrame) -> DataFrame:
    """(col_name, data_type, comment) of a table, without reading its rows."""
    return df.sparkSession.sql("DESCRIBE QUERY SELECT * FROM {table}", table=df)


def preview(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the lowest key: each task keeps its own ``n`` at most."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)
