import hashlib
import math
import random

import numpy as np
import pytest

from payrisk.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label string, ints string, code string"


def brute(rows, entries=256, rounds=4, parts=4):
    """Plain Lloyd rounds with Python integers."""
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id is None, vec_id, [math.floor(1024 * x) for x in vector], label))
    kept.sort(key=lambda r: (r[0], r[1] or 0, np.array(r[2], "<i4").tobytes()))
    size = len(kept[0][2]) // parts
    pieces = [[r[2][p * size : (p + 1) * size] for p in range(parts)] for r in kept]
    books = [[list(pieces[k][p]) for k in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(row[p], books[p])[1] for row in pieces]
            for j in range(len(books[p])):
                own = [row[p] for row, k in zip(pieces, of) if k == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in pieces]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    codes = [(r[1], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), r[3]) for r, f in zip(kept, found)]
    return codes, hashlib.sha256(text.encode()).hexdigest()


def drawn(n, width=8, seed=3, centres=12):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(centres, width))
    vectors = heads[draw.integers(0, centres, n)] + 0.3 * draw.normal(size=(n, width))
    return [(int(k), [float(x) for x in v], random.Random(int(k)).choice(["a", "b", None]), "i", "c") for k, v in enumerate(vectors)]


@pytest.mark.parametrize(("n", "entries", "rounds"), [(300, 256, 4), (400, 20, 4), (90, 7, 6), (5, 256, 2), (40, 8, 0)])
def test_same_as_plain_rounds(spark, n, entries, rounds):
    rows = drawn(n)
    fitted = vc.fit_codes(spark.createDataFrame(rows, SCHEMA).repartition(7), entries=entries, rounds=rounds)
    codes, digest = brute(rows, entries, rounds)
    got = vc.with_label_error(fitted.codes).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label"] or "") for r in got) == sorted((*c[:3], c[3] or "") for c in codes)
    assert fitted.digest() == digest
    by_label = {}
    for _, _, error, label in codes:
        by_label[label] = by_label.get(label, 0) + error
    assert all(r["label_error"] == by_label[r["label"]] for r in got)


def test_hard_rows(spark):
    rows = drawn(60, seed=5)
    rows += rows[:9] + [(1000 + k, rows[3][1], "t", None, None) for k in range(30)]
    rows += [(None, rows[4][1], None, None, None), (None, None, "x", None, None), (-5, None, "x", None, None), (-4, [], "x", None, None)]
    rows += [(-3, [1.0, None] * 4, "x", None, None), (-2, [float("nan")] + [0.0] * 7, "x", None, None), (-1, [float("-inf")] * 8, None, None, None)]
    fitted = vc.fit_codes(spark.createDataFrame(rows, SCHEMA), entries=16)
    codes, digest = brute(rows, 16)
    got = fitted.codes.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=key) == sorted((c[:3] for c in codes), key=key)
    assert fitted.digest() == digest
    # Other lengths, and components whose distances no long holds.
    odd = rows[:60] + [(2000, [1.0] * 4, "x", None, None), (2001, [1e300] * 8, "x", None, None)]
    assert vc.fit_codes(spark.createDataFrame(odd, SCHEMA), entries=16).codes.count() == 60
    for none in ([], [(1, None, "a", "", "")], [(1, [1.0, 2.0, 3.0], "a", "", "")]):
        assert vc.with_label_error(vc.fit_codes(spark.createDataFrame(none, SCHEMA)).codes).count() == 0


def test_large_components_stay_exact():
    draw = np.random.default_rng(1)
    x, book = draw.integers(-(1 << 27), 1 << 27, (50, 4)), draw.integers(-(1 << 27), 1 << 27, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in book] for r in x]
    assert vc.squared(x, book).tolist() == want


def test_bounds_hold_and_spare_distances():
    """Every stored bound is one, in each round, and net displacements spare at least what accumulated ones do."""
    draw = np.random.default_rng(2)
    x = draw.integers(-300, 300, (500, 6)) + 400 * draw.integers(0, 3, (500, 6))
    measured = {}
    for accumulate in (False, True):
        books, known = vc.Codebooks([x[:40][None].copy()], accumulate=accumulate), None
        measured[accumulate] = []
        for t in range(8):
            known, best, n = vc.assign(x, known, books, 0, books.displacement())
            measured[accumulate].append(n)
            exact = vc.squared(x, books.now[0])
            assert (exact.argmin(1) == known.own).all() and (exact.min(1) == best).all()
            for g, members in enumerate(books.groups[0]):
                others = np.where(members[None] == known.own[:, None], np.inf, exact[:, members]).min(1)
                low = known.low[:, g] - books.displacement()[known.stamp[:, g], 0, g]
                assert (low <= np.sqrt(others)).all()
            known = vc.Known(known.own, known.low.astype(np.float32), known.stamp)
            sums = np.zeros((1, 40, 7), object)
            for row, j in zip(x, known.own):
                sums[0, j, :6] += row
                sums[0, j, 6] += 1
            books = vc.Codebooks([*books.rounds, vc.moved_entries(books.now, sums)], books.groups, accumulate)
    assert measured[False][0] == 500 * 40 and sum(measured[False]) <= sum(measured[True])
    assert measured[False][-1] < 500 * 40 / 4
