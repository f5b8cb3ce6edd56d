"""Fill-in-the-middle forms of documents, cut out of seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut between code points. Each
frame has the units and the code points before it, so the two cut points of a document are found by bisection, and
only the frames that hold them are decompressed for the selection. The output is put together, and hashed, by
streaming the frames in the order in which its form wants them.

A unit is a run of ASCII letters or any other code point. A run that is longer than a frame goes on in the
next ones, and counts where it begins.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_bytes, over_batches, store

FRAME_BYTES = 1 << 15
LEVEL = 3
# Bytes of output that a task holds before it hands them on.
HELD_BYTES = 8 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

FRAME = pa.struct([("unit", pa.int64()), ("char", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())])
STORED_SCHEMA = (
    "doc_id bigint, n bigint, n_chars bigint, marked boolean, "
    "frames array<struct<unit: bigint, char: bigint, inside: boolean, data: binary>>"
)
STORED_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("n_chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(FRAME))]
)
OUTPUT_SCHEMA = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
)
OUTPUT_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64())]
    + [("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())]
)


def beginnings(raw: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte, whether a code point begins there and whether a unit does. ``inside``: the byte before is a letter."""
    b = np.frombuffer(raw, np.uint8)
    points = (b & 0xC0) != 0x80
    letters = ((b | 0x20) >= 97) & ((b | 0x20) <= 122)
    after = np.empty(len(b), bool)
    after[:1] = inside
    after[1:] = letters[:-1]
    return points, points & ~(letters & after)


def cut(raw: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes, at least 4, that end with a code point."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end]
        at = end


def frames_of(raw: bytes, size: int, press: zstandard.ZstdCompressor) -> tuple[int, int, list[dict]]:
    """Units and code points of a text, and its frames."""
    units = chars = 0
    inside, frames = False, []
    for piece in cut(raw, size):
        points, starts = beginnings(piece, inside)
        frames.append({"unit": units, "char": chars, "inside": inside, "data": press.compress(piece)})
        units, chars = units + int(starts.sum()), chars + int(points.sum())
        inside = piece[-1:].isalpha()
    return units, chars, frames


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES, label: str = "text-frames") -> DataFrame:
    """The texts of ``docs`` (doc_id, text; other columns are left out) as stored frames, one row per row of ``docs``.

    ``n`` and ``n_chars`` are the units and the code points of the text, ``marked`` says whether it holds one of the three
    marks. Null and empty texts have no frames; rows without doc_id and repeated rows stay; an empty table gives an
    empty one. A very long text becomes many frames, each compressed and read on its own.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def press(batches: Batches) -> Batches:
        to_frame = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for rows in slices_by_bytes(batch):
                raw = [t or b"" for t in as_bytes(rows.column(1))]
                found = [frames_of(t, frame_bytes, to_frame) for t in raw]
                columns = [rows.column(0), *([f[k] for f in found] for k in (0, 1))]
                columns += [[any(m in t for m in marks) for t in raw], [f[2] for f in found]]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, STORED_TYPES)],
                    schema=STORED_TYPES,
                )

    # The frames are compressed already.
    return store(over_batches(texts, press, STORED_SCHEMA), label, compression="none")


def slices_by_bytes(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of some ``HELD_BYTES``, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + HELD_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Place:
    """A cut point: the frame that holds it, its byte in there, and the code points before it."""

    frame: int
    byte: int
    char: int


class Seekable:
    """One stored text. ``opened`` counts the frames that were decompressed."""

    def __init__(self, n: int, n_chars: int, frames: list[dict], press: zstandard.ZstdDecompressor):
        self.n, self.n_chars, self.frames, self.press = n, n_chars, frames, press
        self.units = [f["unit"] for f in frames]
        self.opened = 0

    def read(self, k: int) -> bytes:
        self.opened += 1
        return self.press.decompress(self.frames[k]["data"])

    def place(self, unit: int) -> Place:
        """Where the unit of this number begins; the end of the text for the number behind the last."""
        if unit >= self.n:
            return Place(len(self.frames), 0, self.n_chars)
        # Of frames with the same count, the earlier ones hold no beginning.
        k = bisect_right(self.units, unit) - 1
        frame = self.frames[k]
        points, starts = beginnings(self.read(k), frame["inside"])
        byte = int(np.flatnonzero(starts)[unit - frame["unit"]])
        return Place(k, byte, frame["char"] + int(points[:byte].sum()))

    def stream(self, a: Place, b: Place) -> Iterator[bytes]:
        """The text between two cut points, frame by frame."""
        for k in range(a.frame, b.frame + (b.byte > 0)):
            raw = self.read(k)
            yield raw[a.byte if k == a.frame else 0 : b.byte if k == b.frame else len(raw)]

    def arranged(self, form: str, a: Place, b: Place) -> Iterator[bytes]:
        """The output of a form, in its order."""
        start, end = Place(0, 0, 0), Place(len(self.frames), 0, self.n_chars)
        parts = {PREFIX: (start, a), SUFFIX: (b, end), MIDDLE: (a, b)}
        if form == "plain":
            yield from self.stream(start, end)
            return
        for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
            yield mark.encode()
            yield from self.stream(*parts[mark])


def draws(doc_id: Column) -> list[Column]:
    """Four repeatable numbers of 32 bits; a row without doc_id has those of an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(frames: DataFrame) -> DataFrame:
    """Fill-in-the-middle outputs of stored frames (``store_frames``), one row per row.

    The first two draws cut the text at units; the others choose the form: ``plain`` (the text as it is: always for an empty
    text or one that holds a mark), ``psm`` or ``spm``. ``prefix_chars`` and ``middle_chars`` are code points, null if plain.
    ``output`` is the text in its form, ``output_sha256`` the digest of its stream. The text of one row at a time is held.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    size = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    planned = frames.select(
        "doc_id", "n", "n_chars", form.alias("form"), F.least(h1 % size, h2 % size).alias("a"),
        F.greatest(h1 % size, h2 % size).alias("b"), "frames",
    )

    def arrange(batches: Batches) -> Batches:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                text, digest, pieces = Seekable(r["n"], r["n_chars"], r["frames"], press), hashlib.sha256(), []
                plain = r["form"] == "plain"
                a, b = (Place(0, 0, 0),) * 2 if plain else (text.place(r["a"]), text.place(r["b"]))
                for piece in text.arranged(r["form"], a, b):
                    digest.update(piece)
                    pieces.append(piece)
                output = b"".join(pieces)
                lengths = (None, None) if plain else (a.char, b.char - a.char)
                rows.append((r["doc_id"], r["n"], r["form"], *lengths, output, digest.hexdigest()))
                held += len(output)
                if held >= HELD_BYTES:
                    yield outputs(rows)
                    rows, held = [], 0
            if rows:
                yield outputs(rows)

    return over_batches(planned, arrange, OUTPUT_SCHEMA)


def outputs(rows: list[tuple]) -> pa.RecordBatch:
    columns = []
    for values, field in zip(zip(*rows), OUTPUT_TYPES):
        if field.name == "output":
            columns.append(pa.array(values, pa.binary()).cast(pa.string()))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=OUTPUT_TYPES)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: marks cannot occur in it but where the form puts them."""
    # Behind the first mark, the other two part the text.
    psm = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{SUFFIX}|{MIDDLE}", 3)
    spm = F.split(F.substr(output, F.lit(len(SUFFIX) + 1)), f"{PREFIX}|{MIDDLE}", 3)
    return (
        F.when(form == "psm", F.concat(F.get(psm, F.lit(0)), F.get(psm, F.lit(2)), F.get(psm, F.lit(1))))
        .when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), F.get(spm, F.lit(0))))
        .otherwise(output)
    )
