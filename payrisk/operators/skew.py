"""Finding keys that own too many rows for one task, and treating them apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.session import store

Step = Callable[[DataFrame], DataFrame]

# A key with more rows than this is split over several tasks.
MAX_GROUP_ROWS = 4_000_000

# Sides with at most this many narrow rows may be broadcast; checked by counting.
MAX_BROADCAST_ROWS = 500_000


# Hash buckets for finding heavy keys: enough that an ordinary bucket stays well below the limit.
BUCKETS_PER_GROUP, MIN_BUCKETS, MAX_BUCKETS = 16, 1024, 1 << 22


@dataclass(frozen=True)
class HotKeys:
    """Stored list of the heavy values of one column, and how much they hold."""

    column: str
    keys: DataFrame
    n_keys: int
    n_rows: int


def find_hot_keys(df: DataFrame, column: str, n_rows: int, max_group_rows: int = MAX_GROUP_ROWS) -> HotKeys | None:
    """Values of ``column`` (NULL included) with more than ``max_group_rows`` of the ``n_rows`` rows.

    A key cannot have more rows than its hash bucket. So buckets are counted
    first, which shuffles a small table however many keys there are, and keys
    only within the buckets that are too full. Neither can be more than
    n_rows / max_group_rows, and counts are combined on the map side.
    """
    n_buckets = min(max(BUCKETS_PER_GROUP * n_rows // max_group_rows, MIN_BUCKETS), MAX_BUCKETS)
    keyed = df.select(column, F.pmod(F.xxhash64(column), F.lit(n_buckets)).alias("_bucket"))
    full, n_full, _ = _over_limit(keyed, "_bucket", max_group_rows)
    if n_full == 0:
        return None
    suspects = keyed.join(broadcast_if_small(full, n_full), "_bucket", "left_semi")
    keys, n_keys, n_hot = _over_limit(suspects, column, max_group_rows)
    return HotKeys(column, keys, n_keys, n_hot) if n_keys else None


def _over_limit(df: DataFrame, column: str, limit: int) -> tuple[DataFrame, int, int]:
    """(stored values of ``column`` with more rows than the limit, how many, their rows)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    stored = store(counts, "hot-keys")
    found = stored.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
    return stored.select(column), found["n"], found["rows"] or 0


def find_hot_keys_of(
    df: DataFrame, columns: list[str], max_group_rows: int = MAX_GROUP_ROWS
) -> dict[str, HotKeys | None]:
    """Heavy keys per column; one plain row count is enough for a small table."""
    n_rows = df.count()
    if n_rows <= max_group_rows:
        return dict.fromkeys(columns)
    return {column: find_hot_keys(df, column, n_rows, max_group_rows) for column in columns}


def broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast only for a side whose rows were counted; else Spark shuffles."""
    return F.broadcast(df) if n_rows <= MAX_BROADCAST_ROWS else df


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of heavy keys)."""
    marks = broadcast_if_small(hot.keys.select(F.col(hot.column).alias("_hot_key")), hot.n_keys)
    same_key = F.col(hot.column).eqNullSafe(F.col("_hot_key"))
    return df.join(marks, same_key, "left_anti"), df.join(marks, same_key, "left_semi")


def apart(df: DataFrame, hot: HotKeys | None, ordinary: Step, heavy: Step) -> DataFrame:
    """Treat the rows of heavy keys with one step and all others with another."""
    if hot is None:
        return ordinary(df)
    ordinary_rows, heavy_rows = split_hot(df, hot)
    return ordinary(ordinary_rows).unionByName(heavy(heavy_rows))


def lookup_of_hot(lookup: DataFrame, lookup_key: str, hot: HotKeys) -> DataFrame:
    """The lookup rows of the heavy keys only: few, and counted before they are broadcast."""
    wanted = broadcast_if_small(hot.keys.select(F.col(hot.column).alias("_hot_key")), hot.n_keys)
    few = store(lookup.join(wanted, F.col(lookup_key) == F.col("_hot_key"), "left_semi"), "hot-lookup")
    return broadcast_if_small(few, few.count())


def left_lookup(df: DataFrame, lookup: DataFrame, column: str, lookup_key: str, hot: HotKeys | None = None) -> DataFrame:
    """Left join to a lookup table.

    Ordinary keys use whichever join Spark picks from its own size estimates.
    Rows of heavy keys never shuffle: only the lookup rows of those few keys are
    sent to them. Should even these be many, AQE's skew join has to split them.
    """
    on = F.col(column) == F.col(lookup_key)
    return apart(
        df,
        hot,
        lambda rows: rows.join(lookup, on, "left"),
        lambda rows: rows.join(lookup_of_hot(lookup, lookup_key, hot), on, "left"),
    )


def left_lookups(
    df: DataFrame, lookups: list[tuple[DataFrame, str, str]], hot: dict[str, HotKeys | None]
) -> DataFrame:
    """Several left look-ups, each given as (lookup, column, lookup key).

    Rows already joined are stored before they are split by the next column's
    heavy keys, since a split reads its input twice.
    """
    for i, (lookup, column, lookup_key) in enumerate(lookups):
        if i > 0 and hot[column] is not None:
            df = store(df, "looked-up")
        df = left_lookup(df, lookup, column, lookup_key, hot[column])
    return df
