import math

import numpy as np
import pytest

import __spark_entry__ as registry
from payrisk.llm import neighbours as nb

SCHEMA = "vec_id bigint, embedding array<double>, label string, node string, query string"


def usable(rows):
    """Rows that take part, once each."""
    good = {}
    for vec_id, vector, *_ in rows:
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            good[(vec_id, tuple(vector))] = None
    width = len(min(good)[1]) if good else 0
    return [k for k in good if len(k[1]) == width]


def brute(rows, every, found):
    """The best of every query, by sequential sums in double precision."""
    out, good = {}, usable(rows)
    for query, x in good:
        if query % every == 0:
            scores = []
            for vec_id, y in good:
                if vec_id != query:
                    s = 0.0
                    for a, b in zip(y, x):
                        s += a * b
                    scores.append((-s, vec_id))
            out.setdefault(query, []).append([(v, -s) for s, v in sorted(scores)[:found]])
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def drawn(n, width=12, seed=4, centres=20):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(centres, width))
    vectors = heads[draw.integers(0, centres, n)] + 0.7 * draw.normal(size=(n, width))
    return [(k, [float(x) for x in v], "l", "n", "q") for k, v in enumerate(vectors)]


@pytest.mark.parametrize("n", [1, 2, 15, 120])
def test_small_tables_are_exact(spark, n):
    rows = drawn(n)
    got = answers(nb.search(spark.createDataFrame(rows, SCHEMA), every=5, found=20))
    want = {q: best for q, [best] in brute(rows, 5, 20).items() if best}
    assert got == want


def test_hard_rows(spark):
    rows = drawn(90, seed=6)
    same = rows[10][1]
    rows += rows[:30] + [(1000 + k, same, None, None, None) for k in range(70)]
    rows += [(None, same, None, None, None), (-5, None, "x", None, None), (-10, [], "x", None, None), (-15, [0.0] * 12, "x", None, None)]
    rows += [(-20, [1.0, None] * 6, "x", None, None), (-25, [float("nan")] + [0.0] * 11, "x", None, None), (-30, [float("inf")] * 12, None, None, None)]
    rows += [(2000, [1.0, 2.0], "x", None, None), (2005, [1e-200] * 12, "x", None, None), (2010, [5.0] * 12, "x", None, None)]
    got = answers(nb.search(spark.createDataFrame(rows, SCHEMA), every=5, found=20))
    assert got == {q: best for q, [best] in brute(rows, 5, 20).items()}
    # Equal vectors: ties go to the smaller vec_id, and the query's own row is left out.
    assert [v for v, _ in got[1005]][:3] == [10, 1000, 1001] or got[1005][0][1] > sum(x * x for x in same)
    empty = nb.search(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert nb.search(spark.createDataFrame([(20, None, "", "", "")], SCHEMA)).count() == 0


def recall(got, want):
    return np.mean([len({v for v, _ in got.get(q, [])} & {v for v, _ in best}) / len(best) for q, [best] in want.items()])


def test_descent_finds_neighbours_across_blocks(spark):
    """Many small blocks, so that first lists are poor and most neighbours lie elsewhere."""
    rows = drawn(3000, width=16, centres=60)
    vectors = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 50, 10)
    options = dict(every=50, found=10, keep=16, reverse=12, block=64, orders=2)
    first = recall(answers(nb.search(vectors, rounds=0, beam=10, **options)), want)
    got = answers(nb.search(vectors, rounds=6, beam=40, **options))
    assert recall(got, want) >= 0.95 and first < 0.9
    scores = {q: dict(best) for q, [best] in brute(rows, 50, 3000).items()}
    assert all(s == scores[q][v] for q, found in got.items() for v, s in found)


def test_norms_differ(spark):
    """The largest inner product, not the least angle."""
    draw = np.random.default_rng(8)
    rows = [(k, [float(x * f) for x in v], "", "", "") for k, (v, f) in enumerate(zip(draw.normal(size=(1500, 10)), draw.lognormal(0, 1, 1500)))]
    got = answers(nb.search(spark.createDataFrame(rows, SCHEMA), every=25, found=10, keep=16, reverse=12, block=128, orders=2, beam=40))
    assert recall(got, brute(rows, 25, 10)) >= 0.9


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = answers(registry.queries()["op13_nearest_neighbours"](spark, folder))
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and all(len(f) == 20 for f in got.values())
    hits = []
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len({v for v, _ in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.97
