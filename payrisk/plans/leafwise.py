"""Boosted trees that grow leaf by leaf: the leaf with the largest gain is split next, up to a number of leaves.

Columns are binned once; a missing value is a bin of its own, which each split sends to the side where it gains more. The binned rows are
packed into blocks, one record each. A pass over the blocks gives, for some leaves, sums of gradients, hessians and rows by
feature and bin; these histograms are added up from task to task and are all that reaches the driver: leaves times features times bins,
whatever the number of rows. Of two children only the smaller is summed; the other is its parent's histogram less that.

Which leaf is next depends only on gains that are known. So each pass opens, at once, all leaves that could still be chosen, and the order
is settled when the histograms are there: the tree is the one that splitting leaf after leaf would give, in about as many
passes as it is deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.plans import models
from payrisk.plans.metrics import decide
from payrisk.schemas import MODEL_FEATURES
from payrisk.session import store

MAX_LEAVES = 31
BINS = 255
MISSING = 255
LEAST_HESSIAN = 1e-3
# Rows of a block; trees whose effect on the margins is worked out in each pass before it is stored.
BLOCK_ROWS = 250_000
STORED_EVERY = 20


@dataclass
class Tree:
    """Nodes in the order in which they were made; 0 is the root. A node without a feature (-1) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last_bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, last_bin: int, missing_left: bool, gain: float) -> int:
        """Gives ``node`` two children; the number of the left one, the right one follows."""
        self.feature[node], self.last_bin[node], self.missing_left[node], self.gain[node] = feature, last_bin, missing_left, gain
        self.left[node] = len(self.feature)
        for _ in range(2):
            for values, new in ((self.feature, -1), (self.last_bin, 0), (self.missing_left, False), (self.left, -1)):
                values.append(new)
            for values in (self.value, self.gain, self.rows):
                values.append(0)
        return self.left[node]

    @property
    def leaves(self) -> list[int]:
        return [k for k, f in enumerate(self.feature) if f < 0]


def place_rows(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row of binned features."""
    at = np.zeros(len(bins), np.int32)
    for node, f in enumerate(tree.feature):
        if f >= 0:
            here = np.flatnonzero(at == node)
            b = bins[here, f]
            goes_left = np.where(b == MISSING, tree.missing_left[node], b <= tree.last_bin[node])
            at[here] = tree.left[node] + 1 - goes_left
    return at


@dataclass(frozen=True)
class Forest:
    """Trees over binned features; ``edges`` are the values that end the bins of each feature."""

    start: float
    edges: list[np.ndarray]
    trees: list[Tree]
    features: list[str]

    def score(self, df: DataFrame, threshold: float = models.THRESHOLD) -> DataFrame:
        """(transaction_id, is_fraud, score, predicted) of each row."""
        forest = self

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(batch, 2, forest.edges)
                margin = np.full(batch.num_rows, forest.start)
                for tree in forest.trees:
                    margin += np.array(tree.value)[place_rows(tree, bins)]
                scores = pa.array(1 / (1 + np.exp(-margin)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["transaction_id", "is_fraud", "score"])

        rows = df.select(F.col("transaction_id").cast("bigint"), F.col("is_fraud").cast("bigint"), *_numbers(self.features))
        return decide(rows.mapInArrow(apply, "transaction_id bigint, is_fraud bigint, score double"), threshold)

    def structure(self) -> list[tuple[int, int, int, float, float, int]]:
        """(tree, node, feature or -1, threshold, value, rows) of every node."""
        out = []
        for t, tree in enumerate(self.trees):
            for k, f in enumerate(tree.feature):
                threshold = float(self.edges[f][tree.last_bin[k]]) if f >= 0 and tree.last_bin[k] < len(self.edges[f]) else float("inf")
                out.append((t, k, f, threshold, float(tree.value[k]), int(tree.rows[k])))
        return out


def leaf_rows(rows: DataFrame, forest: Forest, tree: int) -> DataFrame:
    """(leaf, rows, fraud_rows, rows_when_grown) of one tree: its thresholds as column expressions over the features themselves."""
    nodes, names, shape = forest.trees[tree], forest.features, {r[1]: r for r in forest.structure() if r[0] == tree}

    def leaf_of(node: int):
        _, _, f, threshold, _, _ = shape[node]
        if f < 0:
            return F.lit(node)
        value, left = F.col(names[f]).cast("double"), nodes.left[node]
        goes_left = F.coalesce(value <= threshold, F.lit(bool(nodes.missing_left[node])))
        return F.when(goes_left, leaf_of(left)).otherwise(leaf_of(left + 1))

    found = rows.groupBy(leaf_of(0).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").alias("fraud_rows"))
    grown = None
    for k in nodes.leaves:
        grown = F.when(F.col("leaf") == k, nodes.rows[k]) if grown is None else grown.when(F.col("leaf") == k, nodes.rows[k])
    return found.withColumn("rows_when_grown", grown.cast("bigint"))


def _numbers(features: list[str]) -> list:
    return [F.col(f).cast("double").alias(f) for f in features]


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values that end its bins but the last, from approximate quantiles: all values if they are few."""
    fractions = ", ".join(f"{k / bins}D" for k in range(1, bins))
    found = rows.agg(
        *[F.expr(f"percentile_approx(double(`{f}`), array({fractions}), {50 * bins})").alias(f) for f in features]
    ).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def binned(batch: pa.RecordBatch, first: int, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the features in the columns from ``first`` on: a value lies in the first bin whose end is not below it."""
    out = np.empty((batch.num_rows, len(edges)), np.uint8)
    for k, ends in enumerate(edges):
        values = batch.column(first + k).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(values), MISSING, np.searchsorted(ends, values, "left"))
    return out


def _blocks(rows: DataFrame, edges: list[np.ndarray], features: list[str], block_rows: int) -> DataFrame:
    """Rows with label, weight and binned features, packed; one record a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def record():
            cells = [np.concatenate([h[k] for h in held]).tobytes() for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["labels", "weights", "bins"])

        for batch in batches:
            label, weight = (batch.column(k).to_numpy(zero_copy_only=False).astype("<f8") for k in (0, 1))
            held.append((label, weight, binned(batch, 2, edges)))
            n += batch.num_rows
            if n >= block_rows:
                yield record()
                held, n = [], 0
        if n:
            yield record()

    plain = rows.select(F.col("is_fraud").cast("double").alias("label"), F.col("weight").cast("double"), *_numbers(features))
    return plain.mapInArrow(pack, "labels binary, weights binary, bins binary")


@dataclass
class Block:
    """Rows in a task: label, weight, bins, and the margin after the trees that are stored in it."""

    label: np.ndarray
    weight: np.ndarray
    bins: np.ndarray
    margin: np.ndarray

    def after(self, trees: list[Tree]) -> np.ndarray:
        margin = self.margin
        for tree in trees:
            margin = margin + np.array(tree.value)[place_rows(tree, self.bins)]
        return margin


def histograms(block: Block, recent: list[Tree], tree: Tree, nodes: list[int], bins: int) -> np.ndarray:
    """(nodes, features, bins, 3): sums of gradient, hessian and rows, for some leaves of a tree that is being grown."""
    p = 1 / (1 + np.exp(-block.after(recent)))
    g, h = block.weight * (p - block.label), block.weight * p * (1 - p)
    n_features = block.bins.shape[1]
    out = np.zeros((len(nodes), n_features, bins, 3))
    at = place_rows(tree, block.bins)
    for k, node in enumerate(nodes):
        here = np.flatnonzero(at == node)
        # One count over all features: each has its own range of slots.
        slots = (block.bins[here].astype(np.int64) + bins * np.arange(n_features)).ravel()
        for m, values in enumerate((g, h, None)):
            weights = None if values is None else np.repeat(values[here], n_features)
            out[k, :, :, m] = np.bincount(slots, weights, n_features * bins).reshape(n_features, bins)
    return out


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    last_bin: int
    missing_left: bool
    left_rows: int


def best_split(h: np.ndarray, min_rows: int, least_hessian: float = LEAST_HESSIAN) -> Split | None:
    """The split of one leaf with the largest gain, the first in order of feature and bin; None if none gains."""
    total = h[0].sum(0)
    known, missing = h[:, :MISSING], h[:, MISSING]
    left = np.cumsum(known, axis=1)
    # Missing values to the right, and to the left.
    both = np.stack([left, left + missing[:, None]], 2)
    right = total - both
    ok = (both[..., 2] >= min_rows) & (right[..., 2] >= min_rows)
    ok &= (both[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = both[..., 0] ** 2 / both[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[0] ** 2 / total[1]
    gains = np.where(ok, gains, -np.inf)
    at = int(gains.argmax())
    f, b, side = np.unravel_index(at, gains.shape)
    gain = float(gains[f, b, side])
    return Split(gain, int(f), int(b), bool(side), int(both[f, b, side, 2])) if gain > 1e-9 else None


def grow(passes, max_leaves: int, min_rows: int) -> Tree:
    """Best-first growth. ``passes(tree, nodes)`` gives the histograms of some leaves of a tree.

    ``trial`` has every split that was opened, ``tree`` is what best-first choice makes of them.
    """
    trial = Tree()
    hist = {0: passes(trial, [0])[0]}
    split, totals = {0: best_split(hist[0], min_rows)}, {0: hist[0][0].sum(0)}
    while True:
        tree, of, heap, order = Tree(), {0: 0}, [], 0
        missing = []
        if split[0]:
            heappush(heap, (-split[0].gain, 0, 0))
        while heap and len(tree.feature) // 2 + 1 < max_leaves:
            _, _, node = heappop(heap)
            s, at = split[of[node]], of[node]
            child = tree.split(node, s.feature, s.last_bin, s.missing_left, s.gain)
            if trial.left[at] < 0:
                missing.append(at)
                continue  # its children are not known yet: see which other leaves may be wanted
            for k in range(2):
                of[child + k] = trial.left[at] + k
                order += 1
                if split[of[child + k]]:
                    heappush(heap, (-split[of[child + k]].gain, order, child + k))
        if not missing:
            break
        small = []
        for at in missing:
            s, h = split[at], hist[at]
            child = trial.split(at, s.feature, s.last_bin, s.missing_left, s.gain)
            small.append(child if 2 * s.left_rows <= h[0, :, 2].sum() else child + 1)
        for at, node, h in zip(missing, small, passes(trial, small)):
            other = trial.left[at] * 2 + 1 - node
            hist[node], hist[other] = h, hist[at] - h
            # Rows are whole numbers; of sums that should be zero only rounding is left.
            hist[other][..., :2][hist[other][..., 2] < 0.5] = 0.0
            for k in (node, other):
                split[k], totals[k] = best_split(hist[k], min_rows), hist[k][0].sum(0)
            del hist[at]
    for node in tree.leaves:
        gradient, hessian, rows = totals[of[node]]
        tree.value[node] = float(-gradient / hessian) if hessian > 0 else 0.0
        tree.rows[node] = round(float(rows))
    return tree


def _passes(blocks: RDD, recent: list[Tree]):
    def run(tree: Tree, nodes: list[int]) -> np.ndarray:
        n = blocks.getNumPartitions()
        parts = blocks.map(lambda b: histograms(b, recent, tree, nodes, MISSING + 1))
        return parts.reduce(np.add) if n <= 32 else parts.treeReduce(np.add, depth=3)

    return run


def fit_leafwise(
    train: DataFrame,
    rounds: int = models.BOOST_ROUNDS,
    *,
    rate: float = models.BOOST_RATE,
    max_leaves: int = MAX_LEAVES,
    min_rows: int = models.MIN_LEAF_ROWS,
    features: list[str] = MODEL_FEATURES,
    block_rows: int = BLOCK_ROWS,
) -> Forest:
    """Fraud-weighted boosted trees of up to ``max_leaves`` leaves each, over all rows and rounds.

    The binned blocks are stored, and with them every ``STORED_EVERY`` rounds the rows' margins; a lost executor costs its blocks'
    passes again. A round in which no split gains ends the fit.
    """
    spark = train.sparkSession
    rows = models.with_fraud_weight(store(train.select("is_fraud", *features), "leafwise-train"))
    totals = rows.agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("is_fraud") == 1, F.col("weight"))).alias("one"), F.count(F.lit(1)).alias("n")).first()
    if not totals["n"] or not totals["one"] or totals["one"] == totals["all"]:
        raise ValueError("needs rows of both classes")
    edges = bin_edges(rows, features)
    n_blocks = max(1, -(-totals["n"] // block_rows))
    packed = store(_blocks(rows.repartition(n_blocks), edges, features, block_rows), "leafwise-blocks")
    start, n_features = float(np.log(totals["one"] / (totals["all"] - totals["one"]))), len(features)

    def opened(r) -> Block:
        label = np.frombuffer(r["labels"], "<f8")
        margin = np.full(len(label), start) if "margin" not in r.__fields__ else np.frombuffer(r["margin"], "<f8")
        return Block(label, np.frombuffer(r["weights"], "<f8"), np.frombuffer(r["bins"], "u1").reshape(-1, n_features), margin)

    trees: list[Tree] = []
    blocks, recent = packed.rdd.map(opened).persist(), []
    for k in range(rounds):
        tree = grow(_passes(blocks, recent), max_leaves, min_rows)
        if len(tree.feature) == 1:
            break
        tree.value = [rate * v for v in tree.value]
        trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == STORED_EVERY and k + 1 < rounds:
            done = recent

            def moved(b: Block, done=done):
                return tuple(a.tobytes() for a in (b.label, b.weight, b.bins, b.after(done)))

            stored = spark.createDataFrame(blocks.map(moved), "labels binary, weights binary, bins binary, margin binary")
            blocks.unpersist()
            blocks, recent = store(stored, "leafwise-margins").rdd.map(opened).persist(), []
    blocks.unpersist()
    return Forest(start, edges, trees, list(features))
