"""Exact continuous quantiles that do not gather all distinct values in one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from payrisk.operators.running import prior_totals
from payrisk.session import store

# The built-in exact percentile keeps all distinct values in one task's memory; it
# is used where there are at most this many, over all groups and columns.
DIRECT_VALUES = 1_000_000

# Distinct values are estimated to within a few percent.
DISTINCT_MARGIN = 1.25

# Accuracy of the sketches that bracket a rank on larger tables.
SKETCH_ACCURACY = 10_000

# Narrowing builds one aggregate expression per group, column and rank; with more groups, values are counted instead.
FEW_GROUPS = 64


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[str, float]],
    by: list[str] | None = None,
    *,
    direct_values: int = DIRECT_VALUES,
) -> DataFrame:
    """One row per group: each output name maps to (column, fraction).

    Values between two neighbours are interpolated; NULLs are skipped; a group
    with no values gets NULL. Tables with few rows or few distinct values use
    ``percentile``. For others the needed columns are stored once, and an open
    interval around each wanted rank is narrowed: a sketch proposes two values
    near it, one counting pass tells on which side the rank lies, and only when
    few rows remain between them are those ordered. Nothing is shuffled but
    sketches, counts and those few rows. With many groups the rows of each distinct value are
    counted, and running counts show which values hold the wanted ranks.
    """
    by = by or []
    columns = sorted({column for column, _ in wanted.values()})
    rows = store(df.select(*by, *columns), "quantile-values")  # the input is computed once
    if rows.count() * len(columns) <= direct_values:
        return _percentiles(rows, wanted, by)
    sizes = [F.count(c).alias(f"_n_{c}") for c in columns]
    distinct = [F.approx_count_distinct(c).alias(f"_d_{c}") for c in columns]
    groups = rows.groupBy(*by).agg(*sizes, *distinct).limit(FEW_GROUPS + 1).collect()
    if len(groups) > FEW_GROUPS:
        return _by_counting(rows, wanted, by, columns)
    if sum(g[f"_d_{c}"] for g in groups for c in columns) * DISTINCT_MARGIN <= direct_values:
        return _percentiles(rows, wanted, by)
    return _by_narrowing(rows, wanted, by, groups, direct_values)


def _percentiles(df: DataFrame, wanted: dict, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.percentile(c, fraction).alias(name) for name, (c, fraction) in wanted.items()])


def _by_counting(rows: DataFrame, wanted: dict, by: list[str], columns: list[str]) -> DataFrame:
    """Any number of groups: the values around each rank are found by running counts over the distinct values."""
    keys = [f"_by{i}" for i in range(len(by))]
    named = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[F.col(c).cast("double").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).alias("_value")) for i, c in enumerate(columns)])
    long = named.select(*keys, F.inline(pairs)).where(F.col("_value").isNotNull())
    counts = store(long.groupBy(*keys, "_column", "_value").agg(F.count(F.lit(1)).alias("_n")), "quantile-counts")
    group = [*keys, "_column"]
    sizes = store(counts.groupBy(*group).agg(F.sum("_n").alias("_size")), "quantile-sizes")
    totals = prior_totals(counts, group, ["_value"], ["_n"], counts.count(), sizes.count())

    asked = F.array(*[
        F.struct(F.lit(i).alias("_wanted"), F.lit(columns.index(c)).alias("_of"), F.lit(float(fraction)).alias("_fraction"))
        for i, (c, fraction) in enumerate(wanted.values())
    ])
    ranks = sizes.select(*[F.col(k).alias(f"r{k}") for k in group], "_size", F.inline(asked)).where("r_column = _of")
    position = (F.col("_size") - 1) * F.col("_fraction")
    ranks = ranks.withColumns({"_position": position, "_below": F.floor(position), "_above": F.ceil(position)})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in group])

    def value_at(rank: str) -> Column:
        inside = (F.col("prior__n") <= F.col(rank)) & (F.col(rank) < F.col("prior__n") + F.col("_n"))
        return F.max(F.when(inside, F.col("_value")))

    found = totals.join(ranks, same).groupBy(*keys, "_wanted", "_position", "_below", "_above").agg(
        value_at("_below").alias("_low"), value_at("_above").alias("_high")
    )
    mixed = (F.col("_above") - F.col("_position")) * F.col("_low") + (F.col("_position") - F.col("_below")) * F.col("_high")
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(mixed)
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_wanted") == i, value)).alias(name) for i, name in enumerate(wanted)]
    )
    # A group whose values are all missing has a row too.
    every = named.select(*[F.col(k).alias(f"g{k}") for k in keys]).distinct()
    on = reduce(Column.__and__, [F.col(f"g{k}").eqNullSafe(F.col(k)) for k in keys])
    return every.join(wide, on, "left").select(*[F.col(f"g{k}").alias(b) for b, k in zip(by, keys)], *wanted)


@dataclass
class _Rank:
    """A wanted rank (from 0) among the values of one column in one group."""

    group: int
    column: str
    rank: int
    inside: int  # rows strictly between low and high
    low: float | None = None
    high: float | None = None
    base: int = 0  # rows at or below low
    value: float | None = None

    @property
    def interval(self):
        return self.group, self.column, self.low, self.high


def _by_narrowing(rows: DataFrame, wanted: dict, by: list[str], groups: list[Row], direct_values: int) -> DataFrame:
    in_group = [
        reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(row[k])) for k in by], F.lit(True)) for row in groups
    ]

    ranks: dict[tuple, _Rank] = {}
    for g, row in enumerate(groups):
        for column, fraction in wanted.values():
            n = row[f"_n_{column}"]
            position = (n - 1) * fraction
            for rank in {floor(position), ceil(position)} if n else ():
                ranks[g, column, rank] = _Rank(g, column, rank, n)

    while open_ranks := [r for r in ranks.values() if r.value is None and r.inside > direct_values]:
        _narrow(rows, open_ranks, in_group)
        if left := _open(ranks):
            near = reduce(Column.__or__, [_within(r, in_group) for r in left])
            rows = store(rows.where(near), "quantile-rows")
    _pick(rows, _open(ranks), in_group)

    def interpolate(g: int, row, column: str, fraction: float):
        n = row[f"_n_{column}"]
        if not n:
            return None
        position = (n - 1) * fraction
        below, above = floor(position), ceil(position)
        low, high = ranks[g, column, below].value, ranks[g, column, above].value
        if below == above or low == high:
            return float(low)
        return (above - position) * low + (position - below) * high

    result = [
        (*[row[k] for k in by], *[interpolate(g, row, column, fraction) for column, fraction in wanted.values()])
        for g, row in enumerate(groups)
    ]
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields]
    return rows.sparkSession.createDataFrame(result, ", ".join(keys + [f"`{name}` double" for name in wanted]))


def _open(ranks: dict) -> list[_Rank]:
    return [r for r in ranks.values() if r.value is None]


def _within(r: _Rank, in_group: list[Column]) -> Column:
    inside = in_group[r.group] & F.col(r.column).isNotNull()
    if r.low is not None:
        inside = inside & (F.col(r.column) > F.lit(r.low))
    if r.high is not None:
        inside = inside & (F.col(r.column) < F.lit(r.high))
    return inside


def _narrow(rows: DataFrame, open_ranks: list[_Rank], in_group: list[Column]) -> None:
    """Shrink the interval of every open rank, in two passes over the rows."""
    margin = 2.0 / SKETCH_ACCURACY
    sharing: dict[tuple, list[_Rank]] = {}
    for r in open_ranks:
        sharing.setdefault(r.interval, []).append(r)

    sketches = []
    for i, members in enumerate(sharing.values()):
        values = F.when(_within(members[0], in_group), F.col(members[0].column))
        fractions = []
        for r in members:
            at = (r.rank - r.base) / max(r.inside - 1, 1)
            fractions += [max(at - margin, 0.0), min(at + margin, 1.0)]
        sketches.append(F.approx_percentile(values, fractions, SKETCH_ACCURACY).alias(f"s{i}"))
    proposed = rows.agg(*sketches).first()

    brackets, counts = [], []
    for i, members in enumerate(sharing.values()):
        for j, r in enumerate(members):
            a, b = proposed[f"s{i}"][2 * j : 2 * j + 2]
            inside, v, k = _within(r, in_group), F.col(r.column), len(brackets)
            brackets.append((r, a, b))
            counts += [
                F.count_if(inside & (v < F.lit(a))).alias(f"under{k}"),
                F.count_if(inside & (v == F.lit(a))).alias(f"at_a{k}"),
                F.count_if(inside & (v > F.lit(a)) & (v < F.lit(b))).alias(f"between{k}"),
                F.count_if(inside & (v == F.lit(b)) & F.lit(a != b)).alias(f"at_b{k}"),
            ]
    counted = rows.agg(*counts).first()

    for k, (r, a, b) in enumerate(brackets):
        under, at_a, between, at_b = (counted[f"{c}{k}"] for c in ("under", "at_a", "between", "at_b"))
        at = r.rank - r.base
        if at < under:
            r.high, r.inside = a, under
        elif at < under + at_a:
            r.value = a
        elif at < under + at_a + between:
            r.low, r.high, r.base, r.inside = a, b, r.base + under + at_a, between
        elif at < under + at_a + between + at_b:
            r.value = b
        else:
            passed = under + at_a + between + at_b
            r.low, r.base, r.inside = b, r.base + passed, r.inside - passed


def _pick(rows: DataFrame, open_ranks: list[_Rank], in_group: list[Column]) -> None:
    """Order the few rows left in each interval and read off the wanted ranks."""
    if not open_ranks:
        return
    sharing: dict[tuple, list[_Rank]] = {}
    for r in open_ranks:
        sharing.setdefault(r.interval, []).append(r)
    tagged = F.array(*[
        F.when(
            _within(members[0], in_group),
            F.struct(F.lit(i).alias("i"), F.col(members[0].column).cast("double").alias("v")),
        )
        for i, members in enumerate(sharing.values())
    ])
    candidates = rows.select(F.explode(F.array_compact(tagged)).alias("c")).select("c.i", "c.v")
    tied = candidates.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = tied.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    hits = []
    for i, members in enumerate(sharing.values()):
        for r in members:
            at = F.lit(r.rank - r.base)
            hits.append((F.col("i") == i) & (at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
    found = upto.where(reduce(Column.__or__, hits)).collect()
    for i, members in enumerate(sharing.values()):
        for r in members:
            at = r.rank - r.base
            r.value = next(row["v"] for row in found if row["i"] == i and row["upto"] - row["n"] <= at < row["upto"])
