import random

import pytest

import __spark_entry__ as registry
from checks.compare import connect, differences
from payrisk.llm import decontaminate as dc

DOC_SCHEMA = "doc_id bigint, text string, n_chars bigint, text_ string, items string, doc string"


def brute(text, items, window):
    words = dc.words_of(text.encode() if text is not None else None)
    hit, found = set(), set()
    for name, item in items:
        own = dc.words_of(item.encode() if item is not None else None)
        m = min(len(own), window)
        wins = {tuple(own[p : p + m]) for p in range(len(own) - m + 1)} if own else set()
        for p in range(len(words) - m + 1):
            if tuple(words[p : p + m]) in wins:
                hit.update(range(p, p + m))
                found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_automaton_equals_brute_force(window):
    draw = random.Random(window)
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(150):
            items = [(str(k), " ".join(draw.choices(letters, k=draw.randint(0, 14)))) for k in range(draw.randint(0, 4))]
            text = " ".join(draw.choices(letters, k=draw.randint(0, 40)))
            automaton = dc.Automaton([(n, dc.words_of(t.encode())) for n, t in items], window)
            runs, found = automaton.hits(dc.words_of(text.encode()))
            assert all(a < b for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))
            n_words, n_hit, names = brute(text, items, window)
            assert (sum(b - a for a, b in runs), sorted(found)) == (n_hit, names)


ITEMS = [
    (10, "The quick brown fox jumps over the lazy dog and runs away"), (2, "short item"), (2, "another short item"),
    (7, None), (8, ""), (None, "no id at all"), (9, "Été ÉTÉ été"), (11, "one two three four five six seven eight nine ten"),
]
P = "quick brown fox jumps over the lazy dog and runs"
DOCS = [
    (1, f"Well, {P.upper()}! And so on and so forth, to the end of it all.", 5, "x", "y", None),
    (2, None, None, "x", "y", None), (3, "", 0, "x", None, None), (4, "a SHORT, item.", 14, None, "y", "z"),
    (5, "quick brown fox jumps over the lazy dog and walks", 50, "x", "y", "z"), (5, P, 48, "x", "y", "z"),
    (5, P, 48, "x", "y", "z"), (None, "Été ÉTÉ été", 1, "x", "y", "z"), (6, "filler " * 20000 + P + " filler", 2, "x", "y", "z"),
    (7, "no id at all", 3, "x", "y", "z"),
]


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 3])
def test_hits_in_hard_rows(spark, block_words):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = dc.find(docs, items, block_words=block_words).collect()
    named = [(str(n), t) for n, t in ITEMS if n is not None]
    got = sorted((repr(tuple(r["doc"])), r["n_words"], r["n_hit"], r["items"]) for r in found)
    assert got == sorted((repr(d), *brute(d[1], named, 10)) for d in DOCS)
    for r in found:
        raw = (r["text"] or "").encode()
        texts = [dc.words_of(raw[a:b]) for a, b in zip(r["spans"][::2], r["spans"][1::2])]
        assert [len(t) for t in texts] == [b - a for a, b in zip(r["runs"][::2], r["runs"][1::2])]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in dc.find(docs, no_items).collect()} == {0}
    assert dc.find(docs.limit(0), no_items).count() == 0


def test_clean_removes_long_runs_and_covered_documents(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = dc.clean(docs, items)
    assert out.dtypes == docs.dtypes
    rows = sorted(out.collect(), key=lambda r: repr(r["doc_id"]))
    # Rows of which more than half is hit are gone: the two copies of the passage, and short items alone.
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 5, 6, 7]
    first = next(r for r in rows if r["doc_id"] == 1)
    assert first["text"] == "Well, ! And so on and so forth, to the end of it all." and first["n_chars"] == len(first["text"])
    assert next(r for r in rows if r["doc_id"] == 2)["n_chars"] is None
    assert next(r for r in rows if r["doc_id"] == 7)["n_chars"] == 3


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 3])
@pytest.mark.parametrize("window", [10, 6])
def test_clean_removes_whole_short_items(spark, block_words, window):
    short = ["who wrote this", "one two three four", "the red fox ran off now", "is seven of nine words a short item here", "alone"]
    items = spark.createDataFrame(list(enumerate(short)), "item_id bigint, text string")
    rest = "and so the text goes on with many more words of its own"
    docs = spark.createDataFrame([(k, f"Before, {t.title()}! {rest}.", 1) for k, t in enumerate(short)] + [(9, rest, 1)], "doc_id bigint, text string, n_chars bigint")
    rows = {r["doc_id"]: r["text"] for r in dc.clean(docs, items, window, block_words=block_words).collect()}
    whole = [k for k, t in enumerate(short) if len(t.split()) < window]
    assert {k: rows[k] for k in whole} == {k: f"Before, ! {rest}." for k in whole} and rows[9] == rest
    if window == 10:
        assert set(whole) == set(range(5))


def test_query_gives_the_rows_of_its_sql(spark, folder):
    query, sql = registry.queries()["op3_decontamination"], registry.oracle_sql()["op3_decontamination"]
    assert differences(query(spark, folder), connect(folder).sql(sql)) == []


def test_blocks_meet_in_one_result(spark):
    """Several blocks give what one automaton gives, and the driver asks for one block at a time."""
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 14))) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(draw.choices(texts + vocabulary, k=6))) for k in range(80)], "doc_id bigint, text string")
    whole = {r["doc"]["doc_id"]: r[1:] for r in dc.find(docs, items).collect()}
    stored, n_blocks = dc.stored_items(items, 120)
    assert n_blocks >= 3 and sorted(t for b in range(n_blocks) for t in dc.item_block(stored, b)) == sorted((str(k), t.encode()) for k, t in enumerate(texts))
    assert max(len(dc.item_block(stored, b)) for b in range(n_blocks)) < len(texts)
    assert {r["doc"]["doc_id"]: r[1:] for r in dc.find(docs, items, block_words=120).collect()} == whole
