import random

import numpy as np
import pytest

import __spark_entry__ as registry
from checks.compare import connect, differences
from payrisk.llm import cells
from payrisk.llm import jaccard as jc
from payrisk.llm.components import components

SCHEMA = "doc_id bigint, text string, component string, digest string"


def shingles(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    names = {}
    for k, (doc_id, _) in enumerate(rows):
        names[root(k)] = min(names.get(root(k), doc_id), doc_id)
    return {doc_id: (len(s), names[root(k)]) for k, ((doc_id, _), s) in enumerate(zip(rows, sets))}


def corpus(seed, n=260, spread=0.04):
    """Chains and clouds of near copies, shared passages, copies, short texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=3))
    seeds = [[word() for _ in range(draw.randint(4, 120))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(n):
        kind = draw.random()
        if kind < 0.6:
            words = list(seeds[draw.randrange(4 if kind < 0.45 else 12)])
            for _ in range(draw.randint(0, max(1, int(spread * len(words))))):
                words[draw.randrange(len(words))] = word()
            if draw.random() < 0.3:
                seeds[draw.randrange(4)] = words  # a chain
        elif kind < 0.8:
            words = [word() for _ in range(draw.randint(0, 60))] + passage
        else:
            words = draw.choices(["one", "Two", "THREE"], k=draw.randint(0, 6))
        rows.append((draw.choice([k, 1000 + k]), " ".join(words).upper() if draw.random() < 0.1 else "  ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "É é"), (5004, "É É"), (5005, "w " * 20000), (5006, "W " * 9)]


def components_of(links, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert root(a) != root(b)
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_local_join_equals_brute_force(seed):
    rows = corpus(seed, 200, 0.08)
    sets = sorted({jc.shingles_of((t or "").encode()).tobytes() for _, t in rows} - {b""})
    sets = [np.frombuffer(s, np.uint64) for s in sets]
    found = components_of(jc.connect(sets), len(sets))
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                assert found[a] == found[b]


def test_words_hashed_together_are_those_of_each_text():
    draw = random.Random(11)
    some = [bytes(draw.choices(b"abZ \t\n\x0b\x0c\r\x00\x1c\x85\xc2\xa0", k=draw.randint(0, 60))) for _ in range(400)]
    some += [b"x" * n + b" " + b"x" * m for n in (1, 7, 8, 9, 16, 63, 64, 65, 300) for m in (1, 8, 9, 64, 65, 301)]
    ids, counts = cells.word_ids_of_texts(some)
    words = [w for t in some for w in t.split()]
    assert counts == [len(t.split()) for t in some]
    assert len(set(zip(words, ids.tolist()))) == len(set(words)) == len(set(ids.tolist()))
    assert cells.word_ids_of_texts([b""])[1] == [0]
    for size in (1, 2, 5):
        sets = jc.shingles_of_each([*some, None], size)
        own = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in (t.lower().split() for t in some)]
        assert [len(x) for x in sets] == [len(x) for x in own] + [0]
        assert len({x.tobytes() for x in sets}) == len({frozenset(x) for x in own})


def test_only_members_beside_a_cloud_are_compared_with_all(monkeypatch):
    """The middle of a cloud of near copies takes all within the radius; of the others each is looked at once."""
    draw = random.Random(5)
    middle = [f"w{k}" for k in range(150)]
    texts, outside = [middle], 0
    for _ in range(500):
        words, n = list(middle), draw.randint(1, 5)
        for at in draw.sample(range(5, 145, 10), n):
            words[at] = f"e{draw.random()}"
        outside += n > 3
        texts.append(words)
    sets = [jc.shingles_of(" ".join(t).encode()) for t in draw.sample(texts, len(texts))]
    looks, near = [], jc.Group.near
    monkeypatch.setattr(jc.Group, "near", lambda *args: (looks.append(args[1]), near(*args))[1])
    found = components_of(jc.connect(sets), len(sets))
    n_looks = len(looks)
    assert n_looks <= outside + 10
    group = jc.Group(sets, 80)
    for x in range(len(sets)):
        which, _, close = near(group, x, group.in_table_with([x])[x])
        assert {found[y] for y in which[close].tolist()} <= {found[x]}


def test_common_shingles_do_not_connect_large_clouds(spark):
    """Two clouds of 300 share a phrase that is as common as both together: they are groups of their own."""
    draw = random.Random(8)
    phrase = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(600):
        words = [f"h{k % 2}x{j}" for j in range(90)] + phrase
        words[draw.randrange(80)] = f"e{k}"
        rows.append((k, " ".join(words)))
    classes = jc.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string"))
    links = components(jc.candidate_links(classes), "digest", "head")
    assert links.select("component").distinct().count() == 2
    assert (np.diff(jc.levels(np.array([0, 1, 127, 128, 200, 255, 600, 10**6])).astype(int)) > 0).all()


def test_components_of_links(spark):
    draw = random.Random(3)
    for n, m in ((1, 0), (60, 40), (200, 150), (40, 39)):
        links = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] if m != 39 else [(k, k + 1) for k in range(39)]
        frame = spark.createDataFrame(links + links[:3], "a int, b int")
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        want = {x: root(x) for a, b in links if a != b for x in (a, b)}
        assert {r["node"]: r["component"] for r in components(frame, "a", "b").collect()} == want


SIZES = {
    "one task": {},
    "many cells": {"least": 100, "most": 400},
    "regions": {"group_cells": 600, "pivots": 3, "task_cells": 600},
    "small regions": {"group_cells": 150, "pivots": 2, "task_cells": 150},
}


@pytest.mark.parametrize("sizes", SIZES)
def test_join_equals_brute_force(spark, sizes):
    rows = corpus(len(sizes), 150 if "regions" in sizes else 260)
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jc.join_documents(docs, **SIZES[sizes]).collect()}
    assert found == brute(rows)


def test_a_large_group_is_split_by_pivots(spark, monkeypatch):
    """Clouds of near copies that share a passage: one group, with the pivots and sizes of the query."""
    draw = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    heads = [[f"h{h}x{k}" for k in range(90)] for h in range(12)]
    rows = []
    for k in range(1200):
        words = passage + heads[min(draw.randrange(40), 11)]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice("abcdefgh")
        rows.append((k, " ".join(words)))
    levels = []
    split = jc.split_groups
    monkeypatch.setattr(jc, "split_groups", lambda large, level, *rest: (levels.append((level, large.count())), split(large, level, *rest))[1])
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jc.join_documents(docs).collect()}
    assert levels and levels[0][1] > 700
    assert found == brute(rows)


def test_repeated_ids_and_no_ids(spark):
    p = " ".join("abcdefghijklmn")
    rows = [(4, p), (4, p), (4, "other words here"), (None, p), (None, None), (None, "alone in the world today"), (2, p + " o")]
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jc.join_documents(docs).collect())
    assert found == sorted([("4", 10, "2"), ("4", 10, "2"), ("4", 1, "4"), ("None", 10, "2"), ("None", 0, "None"), ("None", 1, "None"), ("2", 11, "2")])
    assert jc.join_documents(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA)
    kept = jc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(rows).values()})


def test_repeated_rows_stay_once(spark):
    p, q = " ".join("abcdefghijklmn"), "some other words of this text"
    rows = [(1, p, "c", None), (1, p, "d", "y"), (1, q, "e", None), (2, p, None, None), (3, q, None, None), (None, "z z z", None, None), (None, "z z z", None, None)]
    out = jc.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("1", p), ("1", q), ("None", "z z z")]


def test_query_gives_the_rows_of_its_sql(spark, folder):
    query, sql = registry.queries()["op10_jaccard_join"], registry.oracle_sql()["op10_jaccard_join"]
    assert differences(query(spark, folder), connect(folder).sql(sql)) == []


def test_sets_are_dealt_once(spark, folder):
    out = jc.shingle_sets(spark.read.parquet(f"{folder}/documents.parquet"), least=cells.LEAST)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
