import random

import numpy as np
import pytest

import __spark_entry__ as registry
from checks.compare import connect, differences
from payrisk.llm import cells
from payrisk.llm import substrings as sb


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 20])
def test_window_hashes_equal_rolling(size):
    ids = np.random.default_rng(size).integers(0, 2**63, 60).astype(np.uint64)
    m, base = 1 << 64, int(cells.MULTIPLIER)
    want, rolling = [], 0
    for k, x in enumerate(ids.tolist()):
        rolling = (rolling * base + x) % m
        if k >= size:
            rolling = (rolling - int(ids[k - size]) * pow(base, size, m)) % m
        if k >= size - 1:
            want.append(rolling)
    assert cells.window_hashes(ids, size).tolist() == cells.mixed(np.array(want, np.uint64)).tolist()
    assert len(cells.window_hashes(ids[: size - 1], size)) == 0


def test_planes_and_cells_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (cells.from_planes(cells.by_planes(values), np.uint64) == values).all()
    for size in (1, 10**6, 10**9):
        layout = cells.Layout(size, 100, 1000)
        cuts = layout.cuts(values)
        assert cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) >= 0).all() and len(cuts) == (1 << layout.bits) + 1
        table = cells.cells_of(3, values, np.arange(1000), layout)
        parts = [np.cumsum(cells.from_planes(h, np.uint64), dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        assert (np.concatenate(parts) == values).all()


def brute(rows, window):
    """Removed words by document, windows judged in the order of (doc_id, start)."""
    seen, removed = set(), {}
    for doc_id, text in sorted(rows):
        words = (text or "").split()
        hit = set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                hit.update(range(p, p + window))
            seen.add(key)
        removed[doc_id] = (len(words), len(hit), " ".join(w for k, w in enumerate(words) if k not in hit))
    return removed


def texts(seed, n=250):
    draw = random.Random(seed)
    passages = [" ".join(draw.choices("abcdefghij", k=draw.randint(3, 30))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [" ".join(draw.choices("klmnopqrst", k=draw.randint(0, 12))) if draw.random() < 0.5 else draw.choice(passages) for _ in range(draw.randint(0, 6))]
        rows.append((k * 3, " ".join(parts)))
    rows += [(1000 + k, rows[5][1]) for k in range(60)] + [(2000, None), (2001, ""), (2002, "a " * 30_000), (2003, "\n\t ")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,least,most", [(20, cells.LEAST, cells.MOST), (5, 50, 200), (1, 400, 400), (20, 100, 300)])
def test_removal_equals_brute_force(spark, window, least, most):
    rows = texts(window + least)
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id bigint, text string, seg string, kept string")
    out = sb.remove_repeats(docs, window, least, most).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out} == brute(rows, window)
    by = dict(rows)
    for r in out:
        assert r["text"] == by[r["doc_id"]]
        pairs = list(zip(r["removed"][::2], r["removed"][1::2]))
        assert sum(b - a for a, b in pairs) == r["n_removed"]
        assert all(a < b for a, b in pairs) and all(x[1] < y[0] for x, y in zip(pairs, pairs[1:]))


def test_repeated_ids_and_no_ids(spark):
    p = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(1, p), (1, p), (1, p + " x"), (None, p), (None, None), (None, p)]
    out = sb.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == 6
    assert sorted(r["n_words"] - r["n_removed"] for r in out if r["n_words"])[-1] == 26
    assert sum(r["n_removed"] == 0 for r in out if r["n_words"]) == 1
    assert all(r["n_removed"] == 26 for r in out if r["doc_id"] == 1)
    assert sb.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_gives_the_rows_of_its_sql(spark, folder):
    query, sql = registry.queries()["op6_substring_dedup"], registry.oracle_sql()["op6_substring_dedup"]
    assert differences(query(spark, folder), connect(folder).sql(sql)) == []


def test_segments_are_dealt_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = sb.remove_repeats(docs.select("doc_id", "text"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
