"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Nodes are numbered in an order that keeps near ones together (by the signs of random
projections), and ``BLOCK`` consecutive numbers are a block: one row that holds its nodes' vectors and neighbour lists
as packed columns. Blocks talk by messages, which are Spark joins on the block:

1. The first lists are the best within runs of as many nodes, under several such orders (two at least: with one, nothing leads out of a run).
2. NN-descent: a node introduces its neighbours, and nodes that have it as a neighbour, to each other. Its
   block asks the blocks of these for their vectors, joins every list with itself, and sends pairs that are new and better
   than the last neighbour they would replace. Lists take the best; pairs of old neighbours are not joined again. This goes on
   until few lists change.
3. Queries are nodes themselves. Each starts from its own node and expands the best nodes found that are not expanded yet,
   along edges in both directions, until all nodes of its beam are.
4. The beam is scored again in double precision on the original vectors, and its nodes are replaced by their rows.

Inner products are no metric, and a graph of them is all hubs. So the graph is built on the sphere: with norms divided by the
largest one, a vector x gets a further component sqrt(1 - |x|^2); on the sphere the nearest of (q, 0) is the one with the
largest <q, x>. Searching goes by <q, x> itself. Vectors are kept as a direction in single precision and a norm. A popular node sends its vector once to a block that asks for it, however many lists of the block hold it; lists take a
bounded number of reverse edges, the nearest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, over_batches, ready, remove, store
from payrisk.operators.skew import broadcast_if_small

FOUND, EVERY = 20, 20
# Neighbours of a node, and reverse edges that it takes besides; nodes that a query holds.
NEIGHBOURS, REVERSE, BEAM = 48, 32, 128
BLOCK = 8192
ORDERS = 3
# Descent ends after so many rounds, or when fewer than this share of all list places have changed.
ROUNDS, SETTLED = 10, 0.01
# Pairs that one list may send for one of its nodes: the best.
SENT = 12
# Rows of a distance matrix, and lists joined at once.
ROWS, LISTS = 512, 64
NONE = -1

KEPT_SCHEMA = "vec_id bigint, vector binary"
GRAPH_SCHEMA = "block int, points binary, ids binary, sims binary, fresh binary, changed bigint"
GRAPH_TYPES = pa.schema(
    [("block", pa.int32())] + [(c, pa.binary()) for c in ("points", "ids", "sims", "fresh")] + [("changed", pa.int64())]
)
ASK_SCHEMA = "block int, asker int, nodes binary, extra binary"
ASK_TYPES = pa.schema([("block", pa.int32()), ("asker", pa.int32()), ("nodes", pa.binary()), ("extra", pa.binary())])
ANSWER_SCHEMA = "block int, nodes binary, payload binary"
ANSWER_TYPES = pa.schema([("block", pa.int32()), ("nodes", pa.binary()), ("payload", pa.binary())])
PAIR_SCHEMA = "block int, u binary, w binary, sim binary"
PAIR_TYPES = pa.schema([("block", pa.int32())] + [(c, pa.binary()) for c in ("u", "w", "sim")])


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>"))

    def convert(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found = []
            for k, known in enumerate(lists.is_valid().to_pylist()):
                own = values[offsets[k] : offsets[k + 1]]
                ok = known and len(own) and np.isfinite(own).all() and own.any()
                found.append(own.astype("<f8").tobytes() if ok else None)
            column = pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(column.is_valid()), column.filter(column.is_valid())], names=["vec_id", "vector"]
            )

    return over_batches(rows.where("vec_id is not null"), convert, KEPT_SCHEMA)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the norms relative to the largest component, which squares cannot overflow or lose."""
    most = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / most
    length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return (scaled / length).astype("<f4"), (most * length)[:, 0]


def largest_norm(placed: DataFrame, width: int) -> float:
    def norms(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                most = directions(matrix(batch.column(0), "<f8", width))[1].max()
                yield pa.RecordBatch.from_arrays([pa.array([most])], names=["norm"])

    return over_batches(placed.select("vector"), norms, "norm double").agg(F.max("norm")).first()[0]


def lift(norm: np.ndarray) -> np.ndarray:
    """The further component that puts a vector on the sphere."""
    return np.sqrt(np.maximum(1 - norm * norm, 0))


def point_bytes(vectors: np.ndarray, most: float) -> np.ndarray:
    """One row of bytes per vector: direction, and norm as a part of the largest one."""
    unit, norm = directions(vectors)
    norm = norm / most
    return np.hstack([unit.view("u1").reshape(len(unit), -1), norm.astype("<f8").view("u1").reshape(len(unit), 8)])


def points_from(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms."""
    unit = np.ascontiguousarray(rows[:, :-8]).view("<f4")
    return unit, np.ascontiguousarray(rows[:, -8:]).view("<f8")[:, 0]


def planes(width: int, n_bits: int, order: int) -> np.ndarray:
    """Random projections of one order: signs of all but the last give the code."""
    return np.random.default_rng([7, order]).normal(size=(width, n_bits + 1))


def in_order(points: DataFrame, names: list[str], width: int, n: int, order: int, block: int) -> DataFrame:
    """Rows dealt out and sorted so that near vectors come together; equal shares of rows however they cluster."""
    n_bits = min(max(0, (4 * n // block - 1).bit_length()), 40)
    axes = planes(width, n_bits, order)
    fields = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)

    def code(batches: Batches) -> Batches:
        for batch in batches:
            vectors = matrix(batch.column("vector"), "<f8", width)
            unit, _ = directions(vectors)
            along = unit.astype(np.float64) @ axes
            bits = (along[:, :-1] > 0) @ (1 << np.arange(n_bits, dtype=np.int64))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bits.astype(np.int64)), pa.array(along[:, -1])], names=[*names, "_code", "_along"]
            )

    coded = over_batches(points.select(*names), code, f"{fields}, _code bigint, _along double")
    n_parts = max(1, -(-n // block))
    keys = ["_code", "_along", names[0]]
    return coded.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).drop("_code", "_along")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


@dataclass
class Nodes:
    """``placed``: (node, digest, vector, vec_ids, asked), stored. Node numbers have no gaps."""

    placed: DataFrame
    n: int
    width: int
    block: int
    norm: float


def place_nodes(rows: DataFrame, every: int, found: int, block: int) -> Nodes | None:
    """Nodes of the kept rows, numbered. ``vec_ids``: the smallest of a node's rows, one more than a search returns;
    ``asked``: whether any row of it is a query."""
    first = rows.orderBy("vec_id", "vector").limit(1).collect()
    if not first:
        return None
    width = len(first[0]["vector"]) // 8
    rows = rows.where(F.octet_length("vector") == 8 * width)
    keyed = rows.withColumn("digest", F.unhex(F.md5("vector")))
    once = keyed.dropDuplicates(["vec_id", "digest"])
    smallest = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    few = once.withColumn("_rank", smallest).where(F.col("_rank") <= found + 1)
    nodes = few.groupBy("digest").agg(
        F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("vec_ids")
    )
    asking = once.where(F.col("vec_id") % every == 0).select(F.col("digest").alias("_digest")).distinct()
    nodes = nodes.join(asking, F.col("digest") == F.col("_digest"), "left")
    nodes = store(nodes.withColumn("asked", F.col("_digest").isNotNull()).drop("_digest"), "nodes")
    n = nodes.count()
    names = ["digest", "vector", "vec_ids", "asked"]

    def number(batches: Batches) -> Batches:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*place, *batch.columns], names=["part", "at", *names])

    schema = "part int, at bigint, digest binary, vector binary, vec_ids array<bigint>, asked boolean"
    sorted_nodes = store(over_batches(in_order(nodes, names, width, n, 0, block), number, schema), "nodes-in-order")
    remove(nodes)
    # One row per task of the sort.
    parts = sorted_nodes.groupBy("part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    n_parts = sorted_nodes.select("part").distinct().count()
    numbered = sorted_nodes.join(broadcast_if_small(parts, n_parts), "part")
    placed = store(numbered.select((F.col("_before") + F.col("at")).alias("node"), *names), "placed-nodes")
    remove(sorted_nodes)
    return Nodes(placed, n, width, block, largest_norm(placed, width))


def best_within(unit: np.ndarray, norm: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some vectors the nearest of the others on the sphere: places and values, as many as there are up to ``keep``."""
    n, high = len(unit), lift(norm)
    keep = min(keep, n - 1)
    ids, sims = np.zeros((n, keep), np.int64), np.zeros((n, keep), np.float64)
    for at in range(0, n, ROWS):
        rows = slice(at, at + ROWS)
        z = (unit[rows] @ unit.T) * norm[rows, None] * norm + high[rows, None] * high
        z[np.arange(len(z)), np.arange(at, at + len(z))] = -np.inf
        if keep:
            some = np.argpartition(-z, keep - 1, axis=1)[:, :keep]
            ids[at : at + ROWS], sims[at : at + ROWS] = some, np.take_along_axis(z, some, 1)
    return ids, sims


def top_lists(
    n: int, keep: int, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, u: np.ndarray, w: np.ndarray, s: np.ndarray, mark: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists with the pairs (u, w, s) merged in: the best ``keep``, ties to lower numbers. ``mark``: flags of the pairs."""
    old = np.flatnonzero(ids.ravel() != NONE)
    u = np.concatenate([old // ids.shape[1] if ids.shape[1] else old, u])
    w, s = np.concatenate([ids.ravel()[old], w]), np.concatenate([sims.ravel()[old], s])
    mark = np.concatenate([fresh.ravel()[old].astype(bool), mark])
    later = np.arange(len(u)) >= len(old)
    order = np.lexsort((later, w, u))
    u, w, s, mark = u[order], w[order], s[order], mark[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, s, mark = u[once], w[once], s[once], mark[once]
    order = np.lexsort((w, -s, u))
    u, w, s, mark = u[order], w[order], s[order], mark[order]
    rank = np.arange(len(u)) - np.searchsorted(u, np.arange(n))[u]
    good = rank < keep
    out = np.full((n, keep), NONE, np.int64), np.full((n, keep), -np.inf), np.zeros((n, keep), bool)
    for into, values in zip(out, (w, s, mark)):
        into[u[good], rank[good]] = values[good]
    return out


def pairs_by_block(u: np.ndarray, w: np.ndarray, s: np.ndarray, block: int) -> pa.Table:
    """Pairs as one row per block of u."""
    order = np.argsort(u, kind="stable")
    u, w, s = u[order], w[order], s[order]
    blocks, starts = np.unique(u // block, return_index=True)
    rows = [
        {"block": int(b), "u": u[a:z].astype("<i8").tobytes(), "w": w[a:z].astype("<i8").tobytes(), "sim": s[a:z].astype("<f8").tobytes()}
        for b, a, z in zip(blocks, starts, [*starts[1:], len(u)])
    ]
    return pa.Table.from_pylist(rows, schema=PAIR_TYPES)


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def first_pairs(nodes: Nodes, order: int, keep: int) -> DataFrame:
    """Best pairs within runs of ``block`` rows of one order."""
    rows = in_order(nodes.placed.select("node", "vector"), ["node", "vector"], nodes.width, nodes.n, order, nodes.block)
    width, block, most = nodes.width, nodes.block, nodes.norm

    def pairs(batches: Batches) -> Batches:
        held, n = [], 0

        def flush():
            ids = np.concatenate([h[0] for h in held])
            unit, norm = directions(np.concatenate([h[1] for h in held]))
            place, sims = best_within(unit, norm / most, keep)
            u, w = np.repeat(ids, place.shape[1]), ids[place].ravel()
            yield from pairs_by_block(u, w, sims.ravel(), block).to_batches()

        for batch in batches:
            held.append((batch.column(0).to_numpy(), matrix(batch.column(1), "<f8", width)))
            n += batch.num_rows
            if n >= block:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return over_batches(rows, pairs, PAIR_SCHEMA)


def first_graph(nodes: Nodes, keep: int, orders: int) -> DataFrame:
    """Blocks with their points and first lists."""
    blocks = nodes.placed.select((F.col("node") / nodes.block).cast("int").alias("block"), "node", "vector")
    width, block, most = nodes.width, nodes.block, nodes.norm
    pairs = first_pairs(nodes, 0, keep)
    for order in range(1, orders):
        pairs = pairs.unionByName(first_pairs(nodes, order, keep))

    def build(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("node").to_numpy())
        points = point_bytes(matrix(rows.column("vector").combine_chunks(), "<f8", width)[order], most)
        n, base = len(points), rows.column("block")[0].as_py() * block
        none = np.zeros((n, 0))
        u, w, s = joined(found, "u", "<i8") - base, joined(found, "w", "<i8"), joined(found, "sim", "<f8")
        ids, sims, fresh = top_lists(n, keep, none.astype(np.int64), none, none, u, w, s, np.ones(len(u), bool))
        return graph_row(base // block, points, ids, sims, fresh)

    found = blocks.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(build, GRAPH_SCHEMA)
    return store(found, "graph")


def graph_row(block: int, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.Table:
    row = [block, points.tobytes(), ids.astype("<i8").tobytes(), sims.astype("<f8").tobytes(), fresh.astype("u1").tobytes(), int(fresh.sum())]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, GRAPH_TYPES)], schema=GRAPH_TYPES)


def asks(asker: int, nodes: np.ndarray, block: int) -> list[dict]:
    """One message to each block that holds any of the nodes."""
    nodes = np.unique(nodes[nodes != NONE])
    blocks, starts = np.unique(nodes // block, return_index=True)
    return [
        {"block": int(b), "asker": asker, "nodes": nodes[a:z].astype("<i8").tobytes(), "extra": None}
        for b, a, z in zip(blocks, starts, [*starts[1:], len(nodes)])
    ]


def fetch(graph: DataFrame, requests: DataFrame, payload: Callable[[dict], np.ndarray], block: int) -> DataFrame:
    """Answers to ``asks``: the payload (one row of bytes per node of the block) of the nodes asked for."""

    def answer(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return ANSWER_TYPES.empty_table()
        row = rows.to_pylist()[0]
        every, out = payload(row), []
        for asker, raw in zip(wanted.column("asker").to_pylist(), wanted.column("nodes").to_pylist()):
            own = np.frombuffer(raw, "<i8") - row["block"] * block
            out.append({"block": asker, "nodes": raw, "payload": every[own].tobytes()})
        return pa.Table.from_pylist(out, schema=ANSWER_TYPES)

    return graph.groupBy("block").cogroup(requests.groupBy("block")).applyInArrow(answer, ANSWER_SCHEMA)


def answered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and their payloads as rows of bytes."""
    nodes = joined(answers, "nodes", "<i8")
    if not len(nodes):
        return nodes, np.zeros((0, 8), np.uint8)
    rows = joined(answers, "payload", "u1").reshape(len(nodes), -1)
    order = np.argsort(nodes)
    return nodes[order], rows[order]


def lists_with_reverse(graph: DataFrame, keep: int, reverse: int, block: int, only_fresh: bool) -> DataFrame:
    """Per block the lists of its nodes with up to ``reverse`` edges that lead to them, and the blocks' asks for all that they hold.

    Rows with asker -1 are lists: ``nodes`` (numbers, ``keep + reverse`` a node) and ``extra`` (flags of what is new). With
    ``only_fresh``, lists without anything new are left empty.
    """

    def turn(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8").reshape(-1, keep)
                u = np.repeat(np.arange(len(ids)) + row["block"] * block, keep)
                hub, sim, new = ids.ravel(), np.frombuffer(row["sims"], "<f8"), np.frombuffer(row["fresh"], "u1")
                some = hub != NONE
                u, hub, sim, new = u[some], hub[some], sim[some], new[some]
                # The nearest of one block, at most as many as a list takes.
                order = np.lexsort((u, -sim, hub))
                u, hub, sim, new = u[order], hub[order], sim[order], new[order]
                heads, starts = np.unique(hub, return_index=True)
                rank = np.arange(len(hub)) - np.repeat(starts, np.diff([*starts, len(hub)]))
                some = rank < reverse
                marked = (u[some] << 1) | new[some]
                yield from pairs_by_block(hub[some], marked, sim[some], block).to_batches()

    back = over_batches(graph.select("block", "ids", "sims", "fresh"), turn, PAIR_SCHEMA)

    def assemble(rows: pa.Table, edges: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        ids = np.frombuffer(row["ids"], "<i8").reshape(-1, keep)
        fresh, n = np.frombuffer(row["fresh"], "u1").reshape(-1, keep), len(ids)
        none = np.zeros((n, 0))
        hub, marked = joined(edges, "u", "<i8") - row["block"] * block, joined(edges, "w", "<i8")
        more, _, new = top_lists(
            n, reverse, none.astype(np.int64), none, none, hub, marked >> 1, joined(edges, "sim", "<f8"), (marked & 1).astype(bool)
        )
        members, flags = np.hstack([ids, more]), np.hstack([fresh, new]).astype("u1")
        if only_fresh:
            members[~flags.any(1)] = NONE
        out = [{"block": row["block"], "asker": -1, "nodes": members.astype("<i8").tobytes(), "extra": flags.tobytes()}]
        return pa.Table.from_pylist(out + (asks(row["block"], members, block) if only_fresh else []), schema=ASK_TYPES)

    lists = graph.select("block", "ids", "fresh").groupBy("block").cogroup(back.groupBy("block"))
    return store(lists.applyInArrow(assemble, ASK_SCHEMA), "lists")


def descend(graph: DataFrame, nodes: Nodes, keep: int, reverse: int) -> DataFrame:
    """One round of NN-descent over the whole graph."""
    block, size = nodes.block, keep + reverse
    lists = lists_with_reverse(graph, keep, reverse, block, True)

    def vector_and_last(row: dict) -> np.ndarray:
        """The point of each node, and the value that a new neighbour has to beat."""
        last = np.frombuffer(row["sims"], "<f8").reshape(-1, keep)[:, -1:]
        points = np.frombuffer(row["points"], "u1").reshape(len(last), -1)
        return np.hstack([np.ascontiguousarray(last).view("u1"), points])

    answers = fetch(graph.select("block", "points", "sims"), lists.where("asker >= 0"), vector_and_last, block)

    def introduce(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, payload = answered(found)
        if not rows.num_rows or not len(known):
            return PAIR_TYPES.empty_table()
        last = np.ascontiguousarray(payload[:, :8]).view("<f8")[:, 0]
        unit, norm = points_from(payload[:, 8:])
        high = lift(norm)
        members = joined(rows, "nodes", "<i8").reshape(-1, size)
        flags = joined(rows, "extra", "u1").reshape(-1, size).astype(bool)
        live = np.flatnonzero(flags.any(1))
        out = []
        for at in range(0, len(live), LISTS):
            own, new = members[live[at : at + LISTS]], flags[live[at : at + LISTS]]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            there, y, r, h = own != NONE, unit[place], norm[place], high[place]
            z = (y @ y.transpose(0, 2, 1)) * r[:, :, None] * r[:, None, :] + h[:, :, None] * h[:, None, :]
            wanted = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :])
            wanted &= (own[:, :, None] != own[:, None, :]) & (z > last[place][:, :, None])
            z[~wanted] = -np.inf
            if size > SENT:
                wanted &= z >= np.partition(z, size - SENT, axis=2)[:, :, size - SENT, None]
            i, j, k = np.nonzero(wanted)
            out.append((place[i, j], place[i, k], z[i, j, k]))
        u, w, s = (np.concatenate(c) for c in zip(*out))
        # A list takes no more than ``keep`` of what one block sends.
        order = np.lexsort((w, -s, u))
        u, w, s = u[order], w[order], s[order]
        once = np.ones(len(u), bool)
        once[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        u, w, s = u[once], w[once], s[once]
        heads, starts = np.unique(u, return_index=True)
        some = np.arange(len(u)) - np.repeat(starts, np.diff([*starts, len(u)])) < keep
        return pairs_by_block(known[u[some]], known[w[some]], s[some], block)

    own = lists.where("asker < 0").select("block", "nodes", "extra")
    pairs = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(introduce, PAIR_SCHEMA)

    def merge(rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        ids, sims = (np.frombuffer(row[c], k).reshape(-1, keep) for c, k in (("ids", "<i8"), ("sims", "<f8")))
        u, w, s = joined(found, "u", "<i8") - row["block"] * block, joined(found, "w", "<i8"), joined(found, "sim", "<f8")
        # What was in a list before has been joined by now.
        merged = top_lists(len(ids), keep, ids, sims, np.zeros(ids.shape, bool), u, w, s, np.ones(len(u), bool))
        return graph_row(row["block"], np.frombuffer(row["points"], "u1"), *merged)

    new = store(graph.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(merge, GRAPH_SCHEMA), "graph")
    remove(lists)
    remove(graph)
    return new


def neighbour_graph(
    nodes: Nodes, keep: int = NEIGHBOURS, reverse: int = REVERSE, orders: int = ORDERS, rounds: int = ROUNDS, settled: float = SETTLED
) -> DataFrame:
    """Blocks with ``keep`` neighbours for every node, descended until few lists change."""
    graph = first_graph(nodes, keep, orders)
    for _ in range(rounds):
        graph = descend(graph, nodes, keep, reverse)
        if graph.agg(F.sum("changed")).first()[0] < settled * nodes.n * keep:
            break
    return graph


STATE_SCHEMA = "block int, asker int, nodes binary, extra binary, sims binary, done binary"
STATE_TYPES = pa.schema(
    [("block", pa.int32()), ("asker", pa.int32())] + [(c, pa.binary()) for c in ("nodes", "extra", "sims", "done")]
)


def state_rows(block: int, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray, done: np.ndarray, size: int) -> pa.Table:
    """The queries of a block with their beams, and asks for the lists of the nodes that are to be expanded."""
    open_nodes = ids[(ids != NONE) & ~done]
    state = {"block": block, "asker": -1, "nodes": queries.astype("<i8").tobytes(), "extra": ids.astype("<i8").tobytes()}
    state |= {"sims": sims.astype("<f8").tobytes(), "done": done.astype("u1").tobytes()}
    return pa.Table.from_pylist([state, *asks(block, open_nodes, size)], schema=STATE_TYPES)


def beams(nodes: Nodes, graph: DataFrame, keep: int, reverse: int, beam: int) -> DataFrame:
    """Greedy search for all asked nodes: per block the queries and the nodes they hold at the end."""
    block, size = nodes.block, keep + reverse
    asked = nodes.placed.where("asked").select((F.col("node") / block).cast("int").alias("block"), "node")

    def begin(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return STATE_TYPES.empty_table()
        queries = np.sort(wanted.column("node").to_numpy())
        # Open at first is the query itself, which whatever is found displaces.
        ids = np.full((len(queries), beam), NONE, np.int64)
        ids[:, 0] = queries
        return state_rows(rows.column("block")[0].as_py(), queries, ids, np.full(ids.shape, -np.inf), np.zeros(ids.shape, bool), block)

    start = graph.select("block").groupBy("block").cogroup(asked.groupBy("block"))
    state = store(start.applyInArrow(begin, STATE_SCHEMA), "beams")
    lists = lists_with_reverse(graph, keep, reverse, block, False)

    def lists_of(row: dict) -> np.ndarray:
        return np.frombuffer(row["nodes"], "u1").reshape(-1, size * 8)

    def points_of(row: dict) -> np.ndarray:
        n = len(row["ids"]) // (8 * keep)
        return np.frombuffer(row["points"], "u1").reshape(n, -1)

    def expand(rows: pa.Table, found: pa.Table) -> pa.Table:
        """What each query finds behind its open nodes, and asks for the vectors of these and of the queries."""
        if not rows.num_rows:
            return ASK_TYPES.empty_table()
        row = rows.to_pylist()[0]
        queries, ids, _, done = read_state(row, beam)
        known, payload = answered(found)
        members = payload.view("<i8") if len(known) else np.zeros((0, size), np.int64)
        starts, every = [0], []
        for k in range(len(queries)):
            use = ids[k][(ids[k] != NONE) & ~done[k]]
            new = np.unique(members[np.searchsorted(known, use)])
            new = np.setdiff1d(new, np.append(ids[k], [queries[k], NONE]))
            every.append(new)
            starts.append(starts[-1] + len(new))
        flat = np.concatenate(every)
        held = {"block": row["block"], "asker": -1, "nodes": flat.astype("<i8").tobytes(), "extra": np.array(starts, "<i8").tobytes()}
        wanted = asks(row["block"], np.concatenate([flat, queries]), block) if len(flat) else []
        return pa.Table.from_pylist([held, *wanted], schema=ASK_TYPES)

    def improve(rows: pa.Table, found: pa.Table) -> pa.Table:
        """Beams with what was found, all open nodes expanded."""
        if not rows.num_rows:
            return STATE_TYPES.empty_table()
        by = {r["asker"]: r for r in rows.to_pylist()}
        queries, ids, sims, done = read_state(by[-1], beam)
        done = done | (ids != NONE)
        flat, starts = np.frombuffer(by[-2]["nodes"], "<i8"), np.frombuffer(by[-2]["extra"], "<i8")
        if len(flat):
            known, payload = answered(found)
            unit, norm = points_from(payload)
            place, own = np.searchsorted(known, flat), np.searchsorted(known, queries)
            s = np.zeros(len(flat))
            for k in range(len(queries)):
                part = place[starts[k] : starts[k + 1]]
                s[starts[k] : starts[k + 1]] = (unit[part] @ unit[own[k]]).astype(np.float64) * norm[part]
            u = np.repeat(np.arange(len(queries)), np.diff(starts))
            ids, sims, done = top_lists(len(queries), beam, ids, sims, done, u, flat, s, np.zeros(len(u), bool))
        return state_rows(by[-1]["block"], queries, ids, sims, done, block)

    points = graph.select("block", "points", "ids")
    while not state.where("asker >= 0").isEmpty():
        own = state.where("asker < 0").drop("asker")
        to_expand = fetch(lists.where("asker < 0").select("block", "nodes"), state.where("asker >= 0"), lists_of, block)
        seen = store(own.groupBy("block").cogroup(to_expand.groupBy("block")).applyInArrow(expand, ASK_SCHEMA), "expanded")
        answers = fetch(points, seen.where("asker >= 0"), points_of, block)
        kept_rows = seen.where("asker < 0").select(
            "block", F.lit(-2).alias("asker"), "nodes", "extra", *[F.lit(None).cast("binary").alias(c) for c in ("sims", "done")]
        )
        both = state.where("asker < 0").unionByName(kept_rows)
        new = store(both.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(improve, STATE_SCHEMA), "beams")
        remove(seen)
        remove(state)
        state = new
    remove(lists)
    return state


def read_state(row: dict, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    queries = np.frombuffer(row["nodes"], "<i8")
    ids, sims = (np.frombuffer(row[c], k).reshape(-1, beam) for c, k in (("extra", "<i8"), ("sims", "<f8")))
    return queries, ids, sims, np.frombuffer(row["done"], "u1").reshape(-1, beam).astype(bool)


SCORE_SCHEMA = "query bigint, node bigint, score double"
SCORE_TYPES = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


def scored(nodes: Nodes, state: DataFrame, found: int, beam: int) -> DataFrame:
    """(query, node, score) of the best ``found + 1`` nodes of each beam, and of the query's own node, in double precision.

    Products are added up from the first component to the last."""
    block, width = nodes.block, nodes.width
    originals = nodes.placed.select((F.col("node") / block).cast("int").alias("block"), "node", "vector")

    def wanted(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                queries, ids, _, _ = read_state(row, beam)
                table = pa.Table.from_pylist(asks(row["block"], np.append(ids.ravel(), queries), block), schema=ASK_TYPES)
                yield from table.to_batches()

    def answer(rows: pa.Table, requests: pa.Table) -> pa.Table:
        if not requests.num_rows:
            return ANSWER_TYPES.empty_table()
        order = np.argsort(rows.column("node").to_numpy())
        vectors, base = rows.column("vector").combine_chunks(), rows.column("block")[0].as_py() * block
        every, out = matrix(vectors, "u1", 8 * width)[order], []
        for asker, raw in zip(requests.column("asker").to_pylist(), requests.column("nodes").to_pylist()):
            own = np.frombuffer(raw, "<i8") - base
            out.append({"block": asker, "nodes": raw, "payload": every[own].tobytes()})
        return pa.Table.from_pylist(out, schema=ANSWER_TYPES)

    requests = over_batches(state, wanted, ASK_SCHEMA)
    answers = originals.groupBy("block").cogroup(requests.groupBy("block")).applyInArrow(answer, ANSWER_SCHEMA)

    def score(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SCORE_TYPES.empty_table()
        queries, ids, _, _ = read_state(rows.to_pylist()[0], beam)
        known, payload = answered(replies)
        vectors, out = payload.view("<f8"), []
        for query, own in zip(queries, ids):
            own = np.union1d(own[own != NONE], query)
            x, y = vectors[np.searchsorted(known, query)], vectors[np.searchsorted(known, own)]
            with np.errstate(over="ignore", invalid="ignore"):
                s = np.cumsum(y * x, axis=1)[:, -1]
            best = np.lexsort((own, -s))[: found + 1]
            best = np.union1d(best, np.searchsorted(own, query))
            out.append((np.full(len(best), query), own[best], s[best]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORE_TYPES)], schema=SCORE_TYPES)

    own = state.select("block", "asker", "nodes", "extra", "sims", "done")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORE_SCHEMA)


def search(
    vectors: DataFrame,
    every: int = EVERY,
    found: int = FOUND,
    keep: int = NEIGHBOURS,
    reverse: int = REVERSE,
    beam: int = BEAM,
    block: int = BLOCK,
    orders: int = ORDERS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``vectors`` (vec_id, embedding; others are left out) whose vec_id is divisible by
    ``every`` the ``found`` rows with the largest inner product that the search finds, ties to smaller vec_ids.

    All rows are indexed but those without vec_id, with a null, empty or zero vector, null or non-finite components, or another length than
    the vector of the smallest vec_id. Repeated rows count once; rows that share a query's vec_id are no candidates of
    it. Any number of equal vectors is one node of the graph. With fewer candidates than ``found`` all are returned; an empty table gives none.
    """
    spark: SparkSession = vectors.sparkSession
    ready(spark)
    rows = store(kept(vectors), "kept-vectors")
    nodes = place_nodes(rows, every, found, block)
    if nodes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    graph = neighbour_graph(nodes, keep, reverse, orders, rounds)
    state = store(beams(nodes, graph, keep, reverse, beam).where("asker < 0"), "last-beams")
    remove(graph)
    scores = store(scored(nodes, state, found, beam), "scores")
    # Nodes stand for their rows, of which the smallest vec_ids are enough.
    members = nodes.placed.select(F.col("node").alias("_node"), "vec_ids")
    each = scores.join(members, F.col("node") == F.col("_node")).select("query", "score", F.explode("vec_ids").alias("vec_id"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id")))
    lists = each.groupBy("query").agg(F.slice(best, 1, found + 1).alias("best"))
    asked = nodes.placed.where("asked").select("node", "digest")
    lists = lists.join(asked, F.col("query") == F.col("node")).select(F.col("digest").alias("_digest"), "best")
    queries = rows.where((F.col("vec_id") % every == 0) & (F.octet_length("vector") == 8 * nodes.width))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.unhex(F.md5("vector")).alias("digest")).distinct()
    answers = queries.join(lists, F.col("digest") == F.col("_digest"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, found)
    ranked = answers.select("query_id", F.posexplode(others).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))
