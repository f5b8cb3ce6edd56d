import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import zstandard
from payrisk.llm import fill_middle as fm

SCHEMA = "doc_id bigint, text string, n string, frames string, form string"


def expected(doc_id, text, cuts=None):
    """The contract, word by word, over a list of units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "é", "\n", "one two  three\n", "x" * 700, "ß" * 333 + "ab" * 200, "<P> in it", "a<", "<S", "<S>", "M><", "日本 語ab,c" * 90, "\x00\x00", "🎉" * 99, "plain words only " * 60]


@pytest.mark.parametrize("frame_bytes", [4, 64, fm.FRAME_BYTES])
def test_outputs_are_those_of_the_contract(spark, frame_bytes):
    rows = [(k if k % 17 else None, TEXTS[k % len(TEXTS)], "n", "f", "g") for k in range(170)]
    rows += rows[:20]
    frames = fm.store_frames(spark.createDataFrame(rows, SCHEMA), frame_bytes)
    found = fm.transform(frames).withColumn("text", fm.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], repr(r["prefix_chars"]), repr(r["middle_chars"]), r["output"]) for r in found)
    want = [(d, *expected(d, t)) for d, t, *_ in rows]
    assert got == sorted((repr(d), n, form, repr(p), repr(m), out) for d, n, form, p, m, out in want)
    assert sorted(r["text"] for r in found) == sorted(t or "" for _, t, *_ in rows)
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fm.transform(fm.store_frames(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ .<é日🎉\n\x00"), max_size=80), st.integers(4, 20))
def test_places_and_frames(text, size):
    raw = text.encode()
    n, chars, frames = fm.frames_of(raw, size, zstandard.ZstdCompressor())
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert (n, chars) == (len(units), len(text))
    seekable = fm.Seekable(n, chars, frames, zstandard.ZstdDecompressor())
    assert b"".join(map(seekable.read, range(len(frames)))) == raw
    for k in range(n + 1):
        seekable.opened = 0
        place = seekable.place(k)
        assert seekable.opened <= 1 and place.char == len("".join(units[:k]))
        start, end = fm.Place(0, 0, 0), fm.Place(len(frames), 0, chars)
        assert b"".join(seekable.stream(start, place)) == "".join(units[:k]).encode()
        assert b"".join(seekable.stream(place, end)) == "".join(units[k:]).encode()


def test_only_cut_frames_are_opened_for_the_selection():
    text = ("some words of a long text, " * 200_000).encode()
    n, chars, frames = fm.frames_of(text, fm.FRAME_BYTES, zstandard.ZstdCompressor())
    assert len(frames) == -(-len(text) // fm.FRAME_BYTES)
    seekable = fm.Seekable(n, chars, frames, zstandard.ZstdDecompressor())
    a, b = seekable.place(n // 3), seekable.place(n // 2)
    assert seekable.opened == 2 and a.char < b.char
    with pytest.raises(zstandard.ZstdError):
        seekable.frames[a.frame + 1]["data"] = b"no frame"
        b"".join(seekable.stream(a, b))
