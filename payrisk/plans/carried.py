"""Spending history kept up to date load by load, from totals that are carried along.

Kept are the payments with their averages, in one folder per load, and for each customer and each card the totals of all
its payments and the place (time, id) of the last one. A load only windows its own payments: they follow on from the totals. A
payment that comes late, before the last place of its customer or card, reopens that key: the key's payments from there on are read
again, and those whose averages change are written anew; they stand in for the earlier rows. A load becomes visible in one step or
not at all.

Each payment must be delivered once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payrisk.operators.history import ORDER, average_of, sized
from payrisk.operators.running import prior_totals
from payrisk.operators.skew import MAX_GROUP_ROWS, broadcast_if_small, find_hot_keys, split_hot
from payrisk.plans.tables import behavior_columns
from payrisk.schemas import BEHAVIOR_COLUMNS
from payrisk.session import delete_folder, folders_in, store
from payrisk.sources.snapshots import Snapshots

AVERAGES = {"client_id": "customer_previous_avg", "card_id": "card_previous_avg"}
PAYMENT = ["transaction_id", "transaction_time", "client_id", "card_id", "absolute_amount"]
ROW = (
    "transaction_id bigint, transaction_time timestamp_ntz, client_id bigint, card_id bigint, absolute_amount double, "
    "customer_previous_avg double, card_previous_avg double, turn int, again boolean"
)
TOTALS = "key bigint, units {units}, payments bigint, last struct<late: boolean, time: timestamp_ntz, id: bigint>"
# Parts of the manifest: the loads in their order, and the totals of each key.
LOAD = "load"


@dataclass(frozen=True)
class _Kept:
    rows: DataFrame
    totals: dict[str, DataFrame]
    parts: list[tuple[str, int, str]]


def _place() -> Column:
    """Sorts as the windows do: no time comes last."""
    time, number = (F.col(name) for name in ORDER)
    return F.struct(time.isNull().alias("late"), time.alias("time"), number.alias("id"))


class CarriedHistory:
    """The history kept in the folder ``path``, which all executors must reach.

    ``decimals`` are those of the amounts, which are summed in whole units, so that the result does not depend on the loads. Without it
    they are summed as doubles, and averages may differ from those of one pass in the last digits.
    """

    def __init__(self, spark: SparkSession, path: str, decimals: int | None = None, max_group_rows: int = MAX_GROUP_ROWS):
        self.spark, self.path, self.decimals, self.max_group_rows = spark, path.rstrip("/"), decimals, max_group_rows
        self.manifest = Snapshots(spark, f"{self.path}/manifest")
        self._totals = TOTALS.format(units="double" if decimals is None else "bigint")

    def _kept(self) -> _Kept:
        # One row per load and key: the manifest is as small as the list of loads.
        parts = []
        if self.manifest.current() is not None:
            parts = sorted((r["kind"], r["turn"], r["folder"]) for r in self.manifest.read().collect())
        folders = {kind: f"{self.path}/{folder}" for kind, _, folder in parts if kind != LOAD}
        totals = {key: self._read([folders[key]] if key in folders else [], self._totals) for key in AVERAGES}
        return _Kept(self._payments([p for p in parts if p[0] == LOAD]), totals, parts)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _payments(self, loads: list[tuple[str, int, str]]) -> DataFrame:
        """The current row of each payment; those written anew replace the rows of earlier loads."""
        paths = [f"{self.path}/{folder}" for _, _, folder in loads]
        rows = self._read(paths, ROW)
        later = rows.where("again").groupBy(F.col("transaction_id").alias("_id")).agg(F.max("turn").alias("_turn"))
        later = broadcast_if_small(later, rows.where("again").count())
        joined = rows.join(later, F.col("transaction_id") == F.col("_id"), "left")
        return joined.where("_turn is null or turn = _turn").drop("_id", "_turn", "turn", "again")

    def features(self) -> DataFrame:
        """What ``tables.behavior_features`` gives for all payments so far."""
        return self._kept().rows.withColumns(behavior_columns()).select(*BEHAVIOR_COLUMNS)

    def totals(self, key: str) -> DataFrame:
        """(key, units, payments, last) of every customer (``client_id``) or card (``card_id``)."""
        return self._kept().totals[key]

    def extend(self, clean: DataFrame) -> DataFrame:
        """Add the payments of ``clean`` and return the rows that are new or changed.

        Payments without a time come after all others; those without a customer or a card form a group; those without an amount have
        averages but do not count in later ones. Other columns of ``clean`` are left out.
        """
        before, kept = self.manifest.current(), self._kept()
        turn = sum(kind == LOAD for kind, _, _ in kept.parts)
        missing = {average: F.lit(None).cast("double") for average in AVERAGES.values()}
        fresh = clean.withColumn("absolute_amount", F.abs(F.col("amount")).cast("double"))
        rows = store(fresh.select(*PAYMENT).withColumns(missing).withColumn("again", F.lit(False)), "carried-load")
        written = []
        for key, average in AVERAGES.items():
            rows, totals = self._step(rows, kept, key, average)
            rows = store(rows, "carried-rows")
            written.append((key, 0, self._write(totals, key)))
        changed = rows.withColumn("turn", F.lit(turn)).select(*PAYMENT, *missing, "turn", "again")
        loads = [p for p in kept.parts if p[0] == LOAD] + [(LOAD, turn, self._write(changed, LOAD))]
        parts = self.spark.createDataFrame(loads + written, "kind string, turn int, folder string").coalesce(1)
        self.manifest.replace(parts, expect=before)
        return rows.drop("again")

    def drop_old(self) -> list[str]:
        """Delete totals that later loads replaced, and what failed loads left. Call it when nothing reads or writes the history."""
        self.manifest.drop_old()
        wanted = {folder for _, _, folder in self._kept().parts} | {"manifest"}
        gone = [name for name in folders_in(self.spark, self.path) if name not in wanted]
        for name in gone:
            delete_folder(self.spark, f"{self.path}/{name}")
        return gone

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _step(self, rows: DataFrame, kept: _Kept, key: str, average: str) -> tuple[DataFrame, DataFrame]:
        """(rows with the averages over one kind of key, the key's new totals); reopened payments join the rows."""
        totals = kept.totals[key]
        same = F.col(key).eqNullSafe(F.col("key"))
        new = rows.where("not again").withColumn("place", _place())
        touched = new.groupBy(key).agg(F.min("place").alias("first"))
        late = touched.join(totals, same).where("first < last").select(F.col(key).alias("key"), "first")
        late = store(late, "reopened")
        bounds = late.agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).first()
        if bounds["n"]:
            rows = self._with_reopened(rows, kept.rows, late, bounds, key)
        else:
            rows = rows.withColumn("open", ~F.col("again"))
        rows = store(sized(rows, self.decimals).withColumn("_one", F.col("_size").isNotNull().cast("bigint")), "opened")

        # What a key had before the first of its open rows.
        again = _sums(rows.where("open and again"), key, "_again")
        base = touched.select(F.col(key).alias("_key")).join(totals, F.col("_key").eqNullSafe(F.col("key")), "left")
        base = base.select("_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "payments")])
        base = base.join(again, F.col("_key").eqNullSafe(F.col("_again")), "left").select(
            "_key",
            (F.col("units") - F.coalesce("_again_units", F.lit(0))).alias("_units"),
            (F.col("payments") - F.coalesce("_again_payments", F.lit(0))).alias("_payments"),
        )
        base = store(base, "carried-base")
        done = self._running(rows.where("open"), base, key)
        done = done.withColumn(
            average,
            average_of(F.col("prior__size") + F.col("_units"), F.col("prior__one") + F.col("_payments"), self.decimals),
        )
        columns = [c for c in rows.columns if c not in ("open", "_size", "_one")]
        found = done.select(*columns).unionByName(rows.where("not open").select(*columns))

        added = _sums(rows.where("not again"), key, "_new", F.max(_place()).alias("_new_last"))
        joined = totals.join(added.withColumn("_added", F.lit(True)), F.col("key").eqNullSafe(F.col("_new")), "full")
        return found, joined.select(
            F.when(F.col("_added"), F.col("_new")).otherwise(F.col("key")).alias("key"),
            (F.coalesce("units", F.lit(0)) + F.coalesce("_new_units", F.lit(0))).alias("units"),
            (F.coalesce("payments", F.lit(0)) + F.coalesce("_new_payments", F.lit(0))).alias("payments"),
            F.greatest("last", "_new_last").alias("last"),
        )

    def _with_reopened(self, rows: DataFrame, current: DataFrame, late: DataFrame, bounds, key: str) -> DataFrame:
        """``rows`` and the kept payments of reopened keys from their first late payment on; ``open`` marks what is averaged again."""
        keys = broadcast_if_small(late.select(F.col("key").alias("_late"), "first"), bounds["n"])
        first = bounds["first"]
        # Payments before the first late one of any key are skipped by the times of their files.
        since = F.col("transaction_time").isNull()
        if first["time"] is not None:
            since |= F.col("transaction_time") >= F.lit(first["time"].isoformat(" ")).cast("timestamp_ntz")
        is_late = F.col(key).eqNullSafe(F.col("_late")) & (_place() > F.col("first"))
        old = current.where(since).join(keys, is_late, "left_semi").withColumn("again", F.lit(True))
        known = rows.where("again").select(F.col("transaction_id").alias("_known"))
        old = old.join(broadcast_if_small(known, known.count()), F.col("transaction_id") == F.col("_known"), "left_anti")
        joined = rows.unionByName(old).join(keys, is_late, "left")
        return joined.withColumn("open", ~F.col("again") | F.col("first").isNotNull()).drop("_late", "first")

    def _running(self, rows: DataFrame, base: DataFrame, key: str) -> DataFrame:
        """Totals of the earlier open rows of the key, beside what it had before; heavy keys are cut into blocks."""
        n_rows = rows.count()
        on = F.col(key).eqNullSafe(F.col("_key"))
        hot = find_hot_keys(rows, key, n_rows, self.max_group_rows) if n_rows > self.max_group_rows else None
        if hot is None:
            return prior_totals(rows, [key], ORDER, ["_size", "_one"], 1, 1).join(base, on)
        ordinary, heavy = split_hot(rows, hot)
        few = store(base.join(broadcast_if_small(hot.keys, hot.n_keys), on, "left_semi"), "hot-base")
        cut = prior_totals(heavy, [key], ORDER, ["_size", "_one"], hot.n_rows, hot.n_keys, rows_per_block=self.max_group_rows)
        plain = prior_totals(ordinary, [key], ORDER, ["_size", "_one"], 1, 1)
        return plain.join(base, on).unionByName(cut.join(broadcast_if_small(few, hot.n_keys), on))


def _sums(rows: DataFrame, key: str, name: str, *more: Column) -> DataFrame:
    return rows.groupBy(F.col(key).alias(name)).agg(
        F.coalesce(F.sum("_size"), F.lit(0)).alias(f"{name}_units"), F.sum("_one").alias(f"{name}_payments"), *more
    )
