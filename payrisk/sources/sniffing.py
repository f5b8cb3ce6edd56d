"""Reading delivered CSV files whose rows or columns are not all as agreed.

Every row ends in one of two tables: the rows that fit, with their types, and the rejected ones with file, reason and their raw text, so
that one bad row does not end the run. Columns outside the agreed schema get the narrowest type that all their values have,
found in one pass over the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from payrisk.sources.files import CSV_OPTIONS

# Types that are tried for a column outside the schema, narrowest first; a text is what fits none.
CANDIDATES = ["bigint", "double", "boolean", "date", "timestamp_ntz"]
PATTERNS = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$",
    "boolean": r"^(?i)(true|false|yes|no)$",
}
RAW = "_raw_line"


@dataclass(frozen=True)
class Delivery:
    """``rows`` that fit; ``rejected`` as (file, reason, raw); ``types`` of all columns in the order of the header."""

    rows: DataFrame
    rejected: DataFrame
    types: dict[str, str]


def typed(column: Column, kind: str) -> Column:
    """The value as this type, or null where the text is no such value. Times need a full date and time."""
    cast = column.try_cast(kind)
    return F.when(F.trim(column).rlike(PATTERNS[kind]), cast) if kind in PATTERNS else cast


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_delivery(spark: SparkSession, path: str, schema: StructType, *, sniff: bool = True) -> Delivery:
    """Columns are found by their names in the header, as ``files.read_csv`` finds them.

    A row is rejected if it has another number of fields than the header, or if a field of ``schema`` holds a text that is no value of its
    type; the reason names the columns. Empty fields are null and fit. Columns outside ``schema`` keep every text: without ``sniff``,
    or if their values agree on no type, they stay texts; a column without any value is a text too.
    """
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    texts = StructType([StructField(n, StringType()) for n in names] + [StructField(RAW, StringType())])
    read = spark.read.schema(texts).options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, enforceSchema=False)
    lines = read.csv(path).withColumn("_file", F.col("_metadata.file_path"))
    agreed = {f.name: f.dataType.simpleString() for f in schema}

    bad = [
        F.when(_quoted(n).isNotNull() & typed(_quoted(n), kind).isNull(), F.lit(f"{n} is no {kind}"))
        for n, kind in agreed.items() if kind != "string"
    ]
    reason = F.when(F.col(RAW).isNotNull(), F.lit("other number of fields")).otherwise(F.concat_ws("; ", *bad))
    judged = lines.withColumn("_reason", reason)
    fits = judged.where(F.col("_reason") == "")
    kinds = agreed | (sniffed_types(fits, [n for n in names if n not in agreed]) if sniff else {})
    kinds = {n: kinds.get(n, "string") for n in names}
    rows = fits.select(*[typed(_quoted(n), k).alias(n) if k != "string" else _quoted(n) for n, k in kinds.items()])
    raw = F.coalesce(RAW, F.to_json(F.struct(*[_quoted(n) for n in names])))
    rejected = judged.where(F.col("_reason") != "").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), raw.alias("raw"))
    return Delivery(rows, rejected, kinds)


def sniffed_types(rows: DataFrame, names: list[str]) -> dict[str, str]:
    """The first of ``CANDIDATES`` that every value of a text column has: one aggregate for all columns and types."""
    if not names:
        return {}
    counted = [F.count(_quoted(n)).alias(f"n{i}") for i, n in enumerate(names)]
    counted += [F.count(typed(_quoted(n), k)).alias(f"n{i}_{k}") for i, n in enumerate(names) for k in CANDIDATES]
    found = rows.agg(*counted).first()

    def kind_of(i: int) -> str:
        fitting = (k for k in CANDIDATES if found[f"n{i}"] and found[f"n{i}_{k}"] == found[f"n{i}"])
        return next(fitting, "string")

    return {n: kind_of(i) for i, n in enumerate(names)}


def type_table(spark: SparkSession, deliveries: dict[str, Delivery]) -> DataFrame:
    """(table, column, type) of what was read."""
    listed = [
        spark.createDataFrame([(name, c, k) for c, k in d.types.items()], "table string, column string, type string")
        for name, d in deliveries.items()
    ]
    return reduce(DataFrame.unionByName, listed)
