"""Exact quantiles from stored sketches and one filtered pass.

Sketches are kept per fine group, such as a month and a label, and merged for whatever groups a question has. A merged sketch gives two
values around a wanted rank. One pass over the rows then counts those below the lower one and, per value, those between the two, which
is few rows; running counts find the value at the rank. What a sketch says is checked against these counts, so the answer is exact.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.operators.quantiles import FEW_GROUPS
from payrisk.operators.running import prior_totals
from payrisk.session import store

# Size of a sketch; ranks are then off by about a tenth of a percent.
SKETCH_K = 4096
MARGIN = 0.004


def value_sketches(df: DataFrame, by: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """One row per group: sketch, count, minimum and maximum of the known values of ``column``."""
    known = df.select(*by, F.col(column).cast("double").alias("_value")).where(F.col("_value").isNotNull())
    return known.groupBy(*by).agg(
        F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"),
        F.count(F.lit(1)).alias("n"), F.min("_value").alias("lowest"), F.max("_value").alias("highest"),
    )


def brackets(sketches: DataFrame, by: list[str], fraction: float, margin: float = MARGIN) -> list[dict]:
    """Per group of ``by`` the wanted position and two values that should enclose it."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("_sketch"), F.sum("n").alias("_n"),
        F.min("lowest").alias("_lowest"), F.max("highest").alias("_highest"),
    )
    below, above = max(0.0, fraction - margin), min(1.0, fraction + margin)
    found = merged.select(
        *by, "_n", "_lowest", "_highest",
        F.kll_sketch_get_quantile_double("_sketch", F.lit(below)).alias("_low"),
        F.kll_sketch_get_quantile_double("_sketch", F.lit(above)).alias("_high"),
    ).limit(FEW_GROUPS + 1).collect()
    if len(found) > FEW_GROUPS:
        raise ValueError(f"more than {FEW_GROUPS} groups: use exact_quantiles, which counts values")
    out = []
    for r in found:
        low = r["_lowest"] if below == 0.0 else r["_low"]
        high = r["_highest"] if above == 1.0 else r["_high"]
        out.append({"key": [r[b] for b in by], "position": (r["_n"] - 1) * fraction, "low": low, "high": high})
    return out


def _value_at(rank: Column) -> Column:
    inside = (F.col("prior__n") <= rank) & (rank < F.col("prior__n") + F.col("_n"))
    return F.max(F.when(inside, F.col("_value")))


def quantile_from_sketches(
    df: DataFrame, sketches: DataFrame, by: list[str], column: str, fraction: float, name: str, margin: float = MARGIN
) -> DataFrame:
    """One row per group with known values: the exact quantile of ``column``, neighbours interpolated.

    ``sketches`` are ``value_sketches`` of the same rows by ``by`` and any further columns. Reads ``df`` once; only if a
    sketch was off by more than ``margin`` is its group read again with the whole range.
    """
    wanted = brackets(sketches, by, fraction, margin)
    keys = [f"_by{i}" for i in range(len(by))]
    plain = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(column).cast("double").alias("_value"))
    done: list[DataFrame] = []
    while wanted:
        counts = store(_counted(plain, keys, wanted), "sketch-counts")
        sizes = counts.groupBy("_group").agg(
            F.sum("_n").alias("size"), F.sum(F.when(F.col("_value") == float("-inf"), F.col("_n")).otherwise(0)).alias("below")
        )
        held = {r["_group"]: (r["below"], r["size"]) for r in sizes.collect()}
        good = [g for g, w in enumerate(wanted) if g in held and held[g][0] <= floor(w["position"]) and ceil(w["position"]) < held[g][1]]
        if good:
            done.append(_found(counts, wanted, good, by, df, name))
        wanted = [w | {"low": float("-inf"), "high": float("inf")} for g, w in enumerate(wanted) if g not in good]
    if not done:
        return df.select(*by, F.lit(None).cast("double").alias(name)).limit(0)
    return reduce(DataFrame.unionByName, done)


def _counted(plain: DataFrame, keys: list[str], wanted: list[dict]) -> DataFrame:
    """Rows per group and value between the bounds; those below the lower bound count under minus infinity."""
    value, group = F.col("_value"), None
    kept = F.lit(None).cast("double")
    for g, w in enumerate(wanted):
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, w["key"])], F.lit(True))
        inside = same & (value <= w["high"])
        group = F.when(inside, g) if group is None else group.when(inside, g)
        kept = F.when(inside, F.when(value < w["low"], float("-inf")).otherwise(value)).otherwise(kept)
    rows = plain.where(value.isNotNull()).select(group.alias("_group"), kept.alias("_value")).where("_group is not null")
    return rows.groupBy("_group", "_value").agg(F.count(F.lit(1)).alias("_n"))


def _found(counts: DataFrame, wanted: list[dict], good: list[int], by: list[str], df: DataFrame, name: str) -> DataFrame:
    some = counts.where(F.col("_group").isin(good))
    totals = prior_totals(some, ["_group"], ["_value"], ["_n"], some.count(), len(good))
    position = F.lit(None).cast("double")
    for g in good:
        position = F.when(F.col("_group") == g, wanted[g]["position"]).otherwise(position)
    placed = totals.withColumn("_position", position)
    ends = placed.groupBy("_group", "_position").agg(
        _value_at(F.floor("_position")).alias("_low"), _value_at(F.ceil("_position")).alias("_high")
    )
    share = F.col("_position") - F.floor("_position")
    mixed = (1 - share) * F.col("_low") + share * F.col("_high")
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(mixed)
    columns = []
    for i, b in enumerate(by):
        key = F.lit(None)
        for g in good:
            key = F.when(F.col("_group") == g, F.lit(wanted[g]["key"][i])).otherwise(key)
        columns.append(key.cast(df.schema[b].dataType).alias(b))
    return ends.select(*columns, value.alias(name))
