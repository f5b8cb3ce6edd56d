"""Codes of vectors by one codebook per part of the vector, fitted by exact Lloyd rounds with norm-of-sum bounds.

Components become integers, so that sums, means and squared distances are exact and do not depend on how rows are spread.
In each round every part of a vector is assigned to the nearest entry of its codebook, and entries move to the mean
of their parts.

What a row knows from earlier rounds spares it most of the distances. Entries are put into groups; per part and group a
row keeps a lower bound of its distance to the entries of the group (its own one aside), with the round it was measured
in. The codebooks of all rounds are kept, so in round t a bound of round T is lowered by the largest net
displacement |C_t(j) - C_T(j)| in the group: the norm of the sum of all moves since, which is at most the
sum of their norms. A group whose bound still lies beyond the row's own entry is passed over; the others are
measured again, exactly.

A round is one pass: rows with their bounds are written to the shared folder, and each task adds one row with
its sums per entry. Nothing but these sums, a few numbers per codebook entry, is shuffled or reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from payrisk.llm.common import Batches, over_batches, remove, store
from payrisk.operators.skew import broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 16
# Rows whose distances are held at once.
CHUNK = 2048
# Rounding of square roots and of stored bounds never makes a bound too high.
SAFE = 1e-6
# Squared distances below this are whole numbers as doubles.
EXACT = 1 << 53


def largest_component(width: int) -> int:
    """Integers up to this have squared distances that a long holds."""
    return min(isqrt((1 << 62) // max(width, 1)) // 2, (1 << 31) - 1)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints): floor(scale * x) of each kept vector, as little-endian 32-bit integers.

    Vectors that are null or empty, or hold null or non-finite components, are dropped; so are those with a component beyond
    ``largest_component``, whose distances no long could hold.
    """
    label = vectors.schema["label"].dataType
    schema = StructType([StructField("vec_id", LongType()), StructField("label", label), StructField("ints", BinaryType())])
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>"))

    def convert(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False)  # null components are NaN
            starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
            found = []
            for k, known in enumerate(lists.is_valid().to_pylist()):
                own = values[starts[k] : ends[k]]
                ok = known and len(own) and np.isfinite(own).all()
                whole = np.floor(own * scale) if ok else None
                ok = ok and np.abs(whole).max() <= largest_component(len(own))
                found.append(whole.astype("<i4").tobytes() if ok else None)
            ints = pa.array(found, pa.binary())
            keep = ints.is_valid()
            columns = [batch.column(0), batch.column(1), ints]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["vec_id", "label", "ints"])

    return over_batches(rows, convert, schema)


def groups_of(book: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of each entry: of the nearest of heads that lie far from each other."""
    points = book.astype(np.float64)
    heads, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(heads) < min(n_groups, len(book)):
        heads.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[heads[-1]]) ** 2).sum(1))
    return ((points[:, None] - points[heads][None]) ** 2).sum(2).argmin(1)


@dataclass
class Codebooks:
    """Codebooks of all rounds so far, each (parts, entries, width of a part), and the groups of their entries."""

    rounds: list[np.ndarray]
    groups: list[list[np.ndarray]] = field(default_factory=list)
    accumulate: bool = False

    def __post_init__(self):
        if not self.groups:
            for book in self.rounds[0]:
                of = groups_of(book, GROUPS)
                self.groups.append([np.flatnonzero(of == g) for g in range(of.max() + 1)])

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]

    @property
    def n_groups(self) -> int:
        return max(map(len, self.groups))

    def displacement(self) -> np.ndarray:
        """(rounds, parts, groups): how far an entry of the group has got since each round at most.

        ``accumulate`` adds up the moves of the rounds instead, which is looser; it is there for comparing.
        """
        moved = np.zeros((len(self.rounds), len(self.groups), self.n_groups))
        books = [b.astype(np.float64) for b in self.rounds]
        steps = [np.sqrt(((b - a) ** 2).sum(2)) for a, b in zip(books, books[1:])]
        for t, book in enumerate(books):
            net = np.sqrt(((books[-1] - book) ** 2).sum(2))
            if self.accumulate:
                net = sum(steps[t:], np.zeros_like(net))
            for p, groups in enumerate(self.groups):
                for g, members in enumerate(groups):
                    moved[t, p, g] = net[p, members].max()
        return moved * (1 + SAFE)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 2 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None].astype(np.int64) - book[None, :, k].astype(np.int64)) ** 2
    return out


@dataclass
class Known:
    """Per row, what is known of one part: own entry, and by group a lower bound and the round it is of."""

    own: np.ndarray
    low: np.ndarray
    stamp: np.ndarray


def assign(x: np.ndarray, known: Known | None, books: Codebooks, part: int, moved: np.ndarray) -> tuple[Known, np.ndarray, int]:
    """Nearest entry of each row (ties to the lower index), its squared distance, and how many distances were measured."""
    book, groups, now = books.now[part], books.groups[part], len(books.rounds) - 1
    n, width = len(x), books.n_groups
    if known is None:
        own, best = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        low, stamp = np.full((n, width), np.inf), np.full((n, width), now, np.uint8)
        stale = np.ones((n, len(groups)), bool)
        measured = 0
    else:
        own = known.own.astype(np.int64)
        entry = book[own].astype(np.int64)
        best = ((x.astype(np.int64) - entry) ** 2).sum(1)
        low, stamp = known.low.astype(np.float64), known.stamp.copy()
        low = np.maximum(low - moved[stamp, part, np.arange(width)], 0)
        stale = ~(low[:, : len(groups)] > np.sqrt(best.astype(np.float64))[:, None] * (1 + SAFE))
        measured = n
    before, before_best = own.copy(), best.copy()
    found = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(stale[:, g])
        d = squared(x[rows], book[members])
        measured += d.size
        found.append((rows, d))
        at = d.argmin(1) if d.size else np.zeros(0, np.int64)
        nearest, index = d[np.arange(len(rows)), at], members[at]
        better = (nearest < best[rows]) | ((nearest == best[rows]) & (index < own[rows]))
        best[rows[better]], own[rows[better]] = nearest[better], index[better]
    # Bounds of the groups that were measured, the own entry aside.
    for g, (members, (rows, d)) in enumerate(zip(groups, found)):
        others = np.where(members[None, :] == own[rows, None], np.inf, d.astype(np.float64))
        low[rows, g] = np.sqrt(others.min(1, initial=np.inf)) * (1 - SAFE)
        stamp[rows, g] = now
    if known is not None:
        # The entry that a row has left counts again for its group, unless that was measured just now.
        of = np.zeros(len(book), np.int64)
        for g, members in enumerate(groups):
            of[members] = g
        left = np.flatnonzero(own != before)
        left = left[~stale[left, of[before[left]]]]
        g = of[before[left]]
        low[left, g] = np.minimum(low[left, g], np.sqrt(before_best[left].astype(np.float64)) * (1 - SAFE))
        # All of these bounds are as of now: the displacement has been taken off.
        stamp[left, g] = now
        old = known.low.astype(np.float64)
        keep = stamp != now
        low[keep] = old[keep]
    return Known(own, low, stamp), best, measured


def spread(values: np.ndarray, kind: str) -> pa.Array:
    """One binary cell per row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values.astype(kind))], pa.binary())


def gathered(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def assigned(rows: DataFrame, books: Codebooks, first: bool, last: bool) -> DataFrame:
    """One round over all rows. ``last`` gives codes and errors, else rows with bounds, and rows with sums."""
    parts, n_entries, size = books.now.shape
    n_groups, moved = books.n_groups, books.displacement()
    label = rows.schema["label"]
    head = [StructField("vec_id", LongType()), label]
    tail = [("code", StringType()), ("error", LongType())]
    if not last:
        tail = [(c, BinaryType()) for c in ("ints", "own", "low", "stamp", "sums")]
    schema = StructType(head + [StructField(n, t) for n, t in tail])

    def round_of(batches: Batches) -> Batches:
        sums = np.zeros((parts, n_entries, size + 1), np.int64)
        measured, names, kinds = 0, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                x = gathered(some.column(2), "<i4").reshape(some.num_rows, parts, size)
                state, errors = [], np.zeros(some.num_rows, np.int64)
                if not first:
                    own = gathered(some.column(3), "<u2")
                    low = gathered(some.column(4), "<f4").reshape(-1, parts, n_groups)
                    stamp = gathered(some.column(5), "u1").reshape(-1, parts, n_groups)
                for p in range(parts):
                    known = None if first else Known(own[:, p], low[:, p], stamp[:, p])
                    now, best, n = assign(x[:, p], known, books, p, moved)
                    measured += n
                    errors += best
                    state.append(now)
                    if not last:
                        order = np.argsort(now.own, kind="stable")
                        used, starts = np.unique(now.own[order], return_index=True)
                        sums[p, used, :size] += np.add.reduceat(x[order, p].astype(np.int64), starts, axis=0)
                        sums[p, used, size] += np.diff(np.append(starts, len(order)))
                names, kinds = schema.names, batch.schema.field(1).type
                if last:
                    codes = np.stack([s.own for s in state], 1).astype(np.uint8)
                    tail = [pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)]
                else:
                    lows = np.stack([s.low for s in state], 1)
                    # A bound never grows by being stored.
                    tail = [some.column(2), spread(np.stack([s.own for s in state], 1), "<u2")]
                    tail += [spread(np.nextafter(lows.astype(np.float32), np.float32(-1)), "<f4")]
                    tail += [spread(np.stack([s.stamp for s in state], 1), "u1"), pa.nulls(some.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *tail], names=names)
        if measured and not last:
            cell = np.append(sums.ravel(), measured).astype("<i8").tobytes()
            blank = [pa.nulls(1, pa.int64()), pa.nulls(1, kinds), *[pa.nulls(1, pa.binary())] * 4, pa.array([cell], pa.binary())]
            yield pa.RecordBatch.from_arrays(blank, names=names)

    columns = ["vec_id", "label", "ints"] + ([] if first else ["own", "low", "stamp"])
    return over_batches(rows.select(*columns), round_of, schema)


SLOT_SCHEMA = "slot int, total decimal(38,0)"


def totals(stored: DataFrame, n_slots: int) -> np.ndarray:
    """The tasks' sums added up: within a task first, then one number per slot."""

    def add(batches: Batches) -> Batches:
        total = np.zeros(n_slots, object)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                total += np.frombuffer(cell, "<i8")
        used = np.flatnonzero(total)
        columns = [pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.int64()).cast(pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "total"])

    cells = over_batches(stored.where("sums is not null").select("sums"), add, SLOT_SCHEMA)
    out = np.zeros(n_slots, object)
    for r in cells.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[r["slot"]] = int(r["total"])
    return out


def moved_entries(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries at the floor of the mean of their parts; unused ones where they were."""
    new = book.copy()
    parts, n, size = book.shape
    for p in range(parts):
        for j in range(n):
            count = sums[p, j, size]
            if count:
                new[p, j] = [int(s) // int(count) for s in sums[p, j, :size]]
    return new


@dataclass
class Fitted:
    """``codes``: (vec_id, label, code, error) of all kept rows; the codebooks of all rounds; distances measured per round."""

    codes: DataFrame
    books: Codebooks | None
    measured: list[int]

    def digest(self) -> str:
        """Of all final entries' components as decimal integers."""
        values = self.books.now.ravel().tolist() if self.books else []
        return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def fit_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, accumulate: bool = False
) -> Fitted:
    """Codebooks fitted on all kept rows of ``vectors`` (vec_id, embedding, label; others are left out), and every row's code.

    Codebooks start as the parts of the ``entries`` (256 at most) smallest vec_ids, ties by the vector's integers, rows without
    vec_id last; with fewer rows they are smaller. Null, empty and non-finite vectors are dropped (``integers``), as are those of another length than that
    of the first entry, or of one that cannot be cut into equal parts. Repeated rows count each. An empty table gives no codes.
    """
    base = store(integers(vectors, scale), "vector-integers")
    smallest = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    some = base.orderBy(*smallest).limit(1).collect()
    width = len(some[0]["ints"]) // 4 if some else 0
    if not width or width % parts:
        empty = base.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Fitted(empty, None, [])
    rows = base.where(F.octet_length("ints") == 4 * width)
    seeds = rows.orderBy(*smallest).limit(min(entries, 256)).select("ints").collect()
    start = np.stack([np.frombuffer(r["ints"], "<i4") for r in seeds]).astype(np.int64)
    start = start.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    books, state, measured = Codebooks([start], accumulate=accumulate), rows, []
    shape = (*start.shape[:2], start.shape[2] + 1)
    for k in range(rounds):
        before, state = state, store(assigned(state, books, first=k == 0, last=False), "vector-bounds")
        remove(base if k == 0 else before)
        sums = totals(state, int(np.prod(shape)) + 1)
        measured.append(int(sums[-1]))
        new = moved_entries(books.now, sums[:-1].reshape(shape))
        books = Codebooks([*books.rounds, new], books.groups, accumulate)
        state = state.where("sums is null")
    codes = store(assigned(state, books, first=rounds == 0, last=True), "vector-codes")
    remove(state if rounds else base)
    return Fitted(codes, books, measured)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over rows of equal label, null ones together."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = store(sums, "label-errors")
    return codes.join(broadcast_if_small(sums, sums.count()), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
