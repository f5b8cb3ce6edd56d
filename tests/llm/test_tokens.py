import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from payrisk.llm import binary_ids, common, packing
from payrisk.llm.common import CachedTokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n", "a  b", "a \n b", "it's  I'LL  x", "1 234,5 !?!", "café ÉTÉ ñ", "a b", "a  b", "a  b",
    "\n  b", "  x  ", "\x1c\x1d y", "<|endoftext|> <|startoftext|>", "　中文 日本", "Σσς ΟΣ", "\x00\x7f\t\x0b",
    " ́x", "\U0001f600‍  ​ z", "İı", "''s 's", "x" * 3000,
]
DOC_SCHEMA = "doc_id bigint, text string, source string, ids string"


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_equal_the_library(path):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    cached = CachedTokenizer(path)
    for text in ODD + [a + b for a in ODD for b in ODD]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.encode(text.encode()), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_chunk_is_learnt_when_it_is_looked_up(path, monkeypatch):
    """So a text is gone through once, and the chunks kept stay within their number inside one text, too."""
    library, cached = Tokenizer.from_file(path), CachedTokenizer(path)
    monkeypatch.setattr(common, "CACHED_CHUNKS", 20)
    text = " ".join(f"word{'abcdefghij'[k % 10] * (k // 10)}, 4x{k % 7} déjà. w" for k in range(200))
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(cached.encode(text.encode()), "<u4").tolist() == want
    assert 0 < len(cached.known) <= 24
    assert np.frombuffer(cached.known[b"unseen"], "<u4").tolist() == library.encode("unseen", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'st 1,\n\t  ́EÉ")), max_size=30))
def test_cached_ids_equal_the_library_for_any_text(text):
    for library, cached in LIBRARIES:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.encode(text.encode()), "<u4").tolist() == want


LIBRARIES = [(Tokenizer.from_file(p), CachedTokenizer(p)) for p in (WORD, BYTE)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    words = binary_ids.pack(np.array(values, np.uint64))
    assert binary_ids.unpack(words, len(values)).tolist() == values


def test_simple8b_counts_per_word():
    assert len(binary_ids.pack(np.ones(60))) == 1
    assert len(binary_ids.pack(np.full(3, 2**20 - 1))) == 1
    assert len(binary_ids.pack(np.full(3, 2**20))) == 2
    assert len(binary_ids.pack(np.array([2**60], np.uint64))) == 2
    assert len(binary_ids.pack(np.full(4, 2**15 - 1))) == 1


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


HARD = [
    (5, "one two three", "a", "x"), (2, None, "a", None), (9, "", None, "x"), (7, "long " * 5000, "b", "x"),
    (3, "one two three", "a", "x"), (3, "one two three", "a", "x"), (3, "other", "c", "x"), (None, "no id", "b", "x"),
    (None, None, None, None),
]


def encoded(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("block_ids", [1, 10, 1 << 16])
def test_written_ids_are_read_back(spark, block_ids):
    blocks = binary_ids.write_ids(docs(spark, HARD), BYTE, 2, block_ids=block_ids)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) for r in binary_ids.read_ids(blocks).collect())
    order = [f[1] for f in found]
    assert order == [None, None, 2, 3, 3, 3, 5, 7, 9]
    assert [f[0] for f in found] == np.cumsum([0] + [f[2] for f in found])[:-1].tolist()
    want = sorted((d, encoded(BYTE, t, 2)) for d, t, _, _ in HARD if d is not None)
    assert sorted((d, ids) for _, d, n, ids in found if d is not None) == want
    assert all(n == len(ids) for _, _, n, ids in found)


def test_no_documents(spark):
    empty = docs(spark, [])
    assert binary_ids.read_ids(binary_ids.write_ids(empty, BYTE, 2)).count() == 0
    assert packing.pack_documents(empty, WORD, 1).count() == 0


def windows_of(pieces, window):
    rows = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    stream = [(p["sequence_id"], p["offset"], p["length"]) for p in rows]
    at = 0
    for sequence, offset, length in stream:
        assert sequence * window + offset == at and 0 < length <= window - offset
        at += length
    return rows, at


def check_whole(rows, source_docs, path, end):
    by_doc = {}
    for p in rows:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        by_doc.setdefault((p["doc_id"], p["doc_tokens"], p["source"]), []).append((p["start"], ids))
    joined = sorted(
        (str(k[0]), sum((ids for _, ids in sorted(v)), [])) for k, v in by_doc.items()
    )
    want = sorted((str(d), encoded(path, t, end)) for d, t, *_ in source_docs)
    assert joined == want


def test_pieces_hold_every_id_once(spark):
    unique = [r for k, r in enumerate(HARD) if k not in (5, 8)]
    pieces = packing.pack_documents(docs(spark, unique), WORD, 1, window=64, grain=8).collect()
    rows, total = windows_of(pieces, 64)
    assert total == sum(len(encoded(WORD, t, 1)) for _, t, _, _ in unique)
    check_whole(rows, unique, WORD, 1)


def test_repeated_rows_are_packed_each(spark):
    pieces = packing.pack_documents(docs(spark, HARD), WORD, 1, window=64, grain=8).collect()
    _, total = windows_of(pieces, 64)
    assert total == sum(len(encoded(WORD, t, 1)) for _, t, _, _ in HARD)


def test_table_without_sources(spark):
    pieces = packing.pack_documents(docs(spark, HARD).drop("source"), WORD, 1).collect()
    assert {p["source"] for p in pieces} == {""}


def round_robin(totals, shares, window, grain):
    """The rounds one after another: the order in which queues serve their grains."""
    names = sorted(totals)
    left, deficit, served = dict(totals), dict.fromkeys(names, 0), []
    whole = sum(shares[n] for n in names)
    while any(left.values()):
        for n in names:
            deficit[n] += window * shares[n]  # in parts of a token: 1 / whole
            while left[n] and deficit[n] >= grain * whole:
                deficit[n] -= grain * whole
                take = min(grain, left[n])
                served.append((n, totals[n] - left[n], take))
                left[n] -= take
    return served


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.9, "b": 0.1}])
def test_stream_follows_the_rounds(targets):
    totals = {"a": 1000, "b": 333, "c": 2050}
    plan = packing.schedule(totals, targets, 64, 8)
    served = round_robin(totals, dict(zip(plan.names, plan.shares.tolist())), 64, 8)
    at = 0
    for name, place, take in served:
        queue = np.array([plan.names.index(name)])
        assert plan.stream_place(queue, np.array([place // 8])).tolist() == [at]
        at += take
    assert at == sum(totals.values())


def test_windows_meet_the_targets(spark):
    rows = [(k, "word " * 40, "abc"[k % 3], "") for k in range(300)]
    pieces = packing.pack_documents(docs(spark, rows), WORD, 1, {"a": 2, "b": 1, "c": 1}, window=128, grain=8).collect()
    first = [p for p in pieces if p["sequence_id"] < 40]
    for upto in range(1, 41):
        own = sum(p["length"] for p in first if p["source"] == "a" and p["sequence_id"] < upto)
        assert abs(own - 64 * upto) <= 2 * 8 + 1


def test_windows_are_assembled(spark):
    pieces = packing.pack_documents(docs(spark, HARD[:4]), WORD, 1, window=64, grain=8)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.assemble(pieces, 64, 7).collect()}
    assert all(len(ids) == 64 for ids in whole.values())
    for p in pieces.collect():
        own = whole[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert zlib.crc32(own.tobytes()) == zlib.crc32(p["ids"])


@pytest.mark.parametrize("targets", [None, {"s7": 1.0, "s31": 1.0}])
def test_sources_beyond_the_bound_share_a_queue(spark, targets):
    rows = [(k, "word " * (k % 11), f"s{k % 40}", "") for k in range(200)] + [(900, None, None, None)]
    pieces = packing.pack_documents(docs(spark, rows), WORD, 1, targets, window=64, grain=8, max_sources=5).collect()
    placed, total = windows_of(pieces, 64)
    assert total == sum(len(encoded(WORD, t, 1)) for _, t, *_ in rows)
    check_whole(pieces, [r[:2] for r in rows], WORD, 1)
    if targets:
        early = [p["source"] for p in placed if p["sequence_id"] < 2]
        assert {"s7", "s31"} <= set(early)


def test_places_of_many_queues_at_once():
    """Counters are worked out in parts of bounded size, whatever the number of queues."""
    totals = {str(k): 8 * (k % 7 + 1) for k in range(20_000)}
    plan = packing.schedule(totals, None, 64, 8, others=80)
    queue = np.repeat(np.arange(20_001), plan.totals // 8)
    grain = np.concatenate([np.arange(n // 8) for n in plan.totals])
    some = np.random.default_rng(1).choice(len(queue), 300, replace=False)
    one_by_one = [plan.stream_place(queue[[k]], grain[[k]])[0] for k in some[:40]]
    assert plan.stream_place(queue[some], grain[some]).tolist()[:40] == one_by_one
    assert len(set(plan.stream_place(queue[some], grain[some]).tolist())) == 300
