"""Leaf-wise trees: best-first growth against plain recursion over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from payrisk.plans import leafwise as lw
from payrisk.plans import metrics
from payrisk.session import store

NAMES = ["a", "b", "c"]
SCHEMA = "transaction_id bigint, a double, b double, c double, is_fraud bigint"


def drawn(n, seed=1):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), np.round(draw.normal(size=n), 1), draw.integers(0, 4, n).astype(float)])
    odds = -1.5 + 1.5 * (x[:, 0] > 0.5) + (x[:, 1] < -0.4) * (x[:, 2] == 2) * 2.5
    x[draw.random(x.shape) < 0.08] = np.nan
    odds = odds + 2.0 * np.isnan(x[:, 0])
    y = (draw.random(n) < 1 / (1 + np.exp(-odds))).astype(int)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(k, *[None if np.isnan(v) else float(v) for v in r], int(t)) for k, (r, t) in enumerate(zip(x, y))], SCHEMA)


def plain_best(g, h, bins, rows, min_rows):
    """Best split of some rows by trying all of them."""
    best = None
    for f in range(bins.shape[1]):
        own = bins[rows, f]
        for b in range(lw.MISSING):
            for side in (False, True):
                left = np.where(own == lw.MISSING, side, own <= b)
                if min(left.sum(), (~left).sum()) < min_rows:
                    continue
                gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                if min(hl, hr) < lw.LEAST_HESSIAN:
                    continue
                gain = gl**2 / hl + gr**2 / hr - (gl + gr) ** 2 / (hl + hr)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, side, rows[left], rows[~left])
    return best


def plain_tree(g, h, bins, max_leaves, min_rows):
    """Leaves as sets of rows: the one with the largest gain is split until there are enough."""
    leaves = [np.arange(len(g))]
    open_ = {0: plain_best(g, h, bins, leaves[0], min_rows)}
    while len(leaves) < max_leaves and any(open_.values()):
        k = max((k for k in open_ if open_[k]), key=lambda k: open_[k][0])
        _, _, _, _, left, right = open_[k]
        leaves[k] = left
        leaves.append(right)
        for j in (k, len(leaves) - 1):
            open_[j] = plain_best(g, h, bins, leaves[j], min_rows)
    return {frozenset(rows.tolist()) for rows in leaves}


@pytest.mark.parametrize(("n", "max_leaves"), [(400, 8), (300, 31), (60, 4)])
def test_growth_is_best_first(n, max_leaves):
    x, y = drawn(n, seed=n)
    edges = [np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, 9)[1:-1])) for c in x.T]
    bins = np.column_stack([np.where(np.isnan(c), lw.MISSING, np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges)]).astype(np.uint8)
    weight = np.where(y == 1, 4.0, 1.0)
    block = lw.Block(y.astype(float), weight, bins, np.full(n, -0.3))
    p = 1 / (1 + np.exp(0.3))
    opened = []

    def passes(tree, nodes):
        opened.append(len(nodes))
        return lw.histograms(block, [], tree, nodes, lw.MISSING + 1)

    tree = lw.grow(passes, max_leaves, 10)
    at = lw.place_rows(tree, bins)
    got = {frozenset(np.flatnonzero(at == k).tolist()) for k in tree.leaves}
    assert got == plain_tree(weight * (p - y), np.full(n, p * (1 - p)) * weight, bins, max_leaves, 10)
    assert len(tree.leaves) <= max_leaves and len(opened) < max(3, len(tree.leaves))
    for k in tree.leaves:
        rows = at == k
        assert tree.rows[k] == rows.sum() >= 10
        assert tree.value[k] == pytest.approx(-(weight * (p - y))[rows].sum() / (weight * p * (1 - p))[rows].sum())


def test_missing_values_go_where_they_gain(spark):
    x, y = drawn(1500, seed=9)
    forest = lw.fit_leafwise(table(spark, x, y), 1, features=NAMES, max_leaves=4)
    tree = forest.trees[0]
    on_a = [k for k, f in enumerate(tree.feature) if f == 0]
    assert on_a
    # Fraud is frequent where a is missing, as where it is large.
    assert not tree.missing_left[on_a[0]]


def loss(scored):
    p = np.array([[r["is_fraud"], r["score"]] for r in scored.collect()])
    return -(np.where(p[:, 0] == 1, 40 * np.log(p[:, 1]), np.log(1 - p[:, 1]))).sum()


def test_rounds_lower_the_loss_and_blocks_do_not_matter(spark):
    x, y = drawn(1200, seed=4)
    rows = store(table(spark, x, y), "rows")
    one = lw.fit_leafwise(rows, 25, features=NAMES)
    assert len(one.trees) == 25 and all(2 <= len(t.leaves) <= 31 for t in one.trees)
    assert all(sum(t.rows[k] for k in t.leaves) == 1200 for t in one.trees)
    losses = [loss(lw.Forest(one.start, one.edges, one.trees[:k], NAMES).score(rows)) for k in (0, 1, 5, 25)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.9 * losses[0]
    several = lw.fit_leafwise(rows, 3, features=NAMES, block_rows=100)
    for a, b in zip(one.trees, several.trees):
        assert sorted(a.rows[k] for k in a.leaves) == sorted(b.rows[k] for k in b.leaves)
    scored = store(one.score(rows), "scored")
    assert metrics.ranking_scores(scored).first()["roc_auc"] > 0.75
    assert scored.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0


def test_margins_that_are_stored_are_those_of_the_trees(spark, monkeypatch):
    x, y = drawn(500, seed=6)
    rows = store(table(spark, x, y), "rows")
    plain = lw.fit_leafwise(rows, 7, features=NAMES)
    monkeypatch.setattr(lw, "STORED_EVERY", 2)
    stored = lw.fit_leafwise(rows, 7, features=NAMES)
    assert [t.feature for t in plain.trees] == [t.feature for t in stored.trees]
    assert np.allclose([v for t in plain.trees for v in t.value], [v for t in stored.trees for v in t.value])


def test_leaves_counted_by_their_thresholds(spark):
    x, y = drawn(800, seed=2)
    rows = store(table(spark, x, y), "rows")
    forest = lw.fit_leafwise(rows, 2, features=NAMES)
    for t in range(2):
        found = lw.leaf_rows(rows, forest, t).collect()
        assert len(found) == len(forest.trees[t].leaves) and sum(r["rows"] for r in found) == 800
        assert all(r["rows"] == r["rows_when_grown"] for r in found)


def test_one_class_and_no_signal(spark):
    x, y = drawn(100)
    with pytest.raises(ValueError, match="both classes"):
        lw.fit_leafwise(table(spark, x, np.zeros(100)), 2, features=NAMES)
    flat = lw.fit_leafwise(table(spark, np.full((100, 3), np.nan), y), 3, features=NAMES)
    assert flat.trees == [] and lw.Forest.score(flat, table(spark, x, y)).select("score").distinct().count() == 1
