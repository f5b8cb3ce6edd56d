"""Counting the hashes of all documents without a row for each.

Documents are dealt by a hash into segments. A segment's distinct hashes, sorted, are cut by
their leading bits into cells, one per bucket; a cell is one row, its hashes written as
differences. A bucket brings together the cells of all segments for its range
of hashes, and sends back one value per hash, in the order in which it came. So what
moves is some bytes per distinct hash of a segment, however often it occurs.

Segments and buckets hold a bounded number of hashes (a hash counts once in a segment), so
a hash that occurs everywhere weighs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import ready

# Hashes of a segment, and of a bucket: more as the data grow, so that cells stay large, within these bounds.
LEAST, MOST, CELL = 1 << 18, 1 << 23, 512
BYTES_PER_WORD = 6

# ASCII white space; the bits of the first 0 to 8 bytes; bytes of a word that are hashed in steps.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(b" \t\n\v\f\r")] = True
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CELL_SCHEMA = "bucket int, seg int, hashes binary, extra binary"
ANSWER_SCHEMA = "seg int, bucket int, answer binary"
CELL_TYPES = pa.schema([("bucket", pa.int32()), ("seg", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary())])
ANSWER_TYPES = pa.schema([("seg", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_ids_of_texts(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, and how many words each text has. Words are what ``split`` finds: runs of other
    characters than ASCII white space.

    All words are hashed together, eight bytes of each in a step, so no word becomes an object; only those of more than
    ``LONG_WORD`` bytes do. The hashes are others than those of ``word_ids``.
    """
    # A space before the first word, between texts and behind the last word, and bytes to read beyond it.
    joined = b"".join([b" ", b" ".join(texts), b" " * 9])
    space = IS_SPACE[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, left = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, begins)).tolist()

    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    ids = mixed(left.astype(np.uint64))
    long = np.flatnonzero(left > LONG_WORD)
    which = np.flatnonzero(left <= LONG_WORD)
    at, left = starts[which], left[which]
    while len(which):
        ids[which] = mixed(ids[which] ^ (eight[at] & FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        ids[k] = xxhash.xxh3_64_intdigest(joined[edges[2 * k] : edges[2 * k + 1]])
    return ids, counts


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``size`` ids, modulo 2^64: the sum of id * MULTIPLIER^place.

    A window is put together from those of half its size, so all windows cost a few
    multiplications of whole arrays; the result is the same as by rolling.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, at, power, width = np.zeros(n, np.uint64), 0, ids, 1
    with np.errstate(over="ignore"):
        while size:
            if size & 1:
                done = done * _power(width) + power[at : at + n]
                at += width
            size >>= 1
            if size:
                power = power[:-width] * _power(width) + power[width:]
                width *= 2
    return mixed(done)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), n, 1 << 64))


class Layout:
    """How many segments and buckets there are, for texts of so many bytes."""

    def __init__(self, n_bytes: int, least: int = LEAST, most: int = MOST):
        words = max(1, n_bytes // BYTES_PER_WORD)
        size = min(max(isqrt(CELL * words), least), most)
        self.n_segments = ceil(words / size)
        self.bits = (self.n_segments - 1).bit_length()

    def cuts(self, hashes: np.ndarray) -> np.ndarray:
        """Where in the sorted hashes each bucket begins, and the end."""
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else np.zeros(1, np.uint64)
        return np.append(np.searchsorted(hashes, edges), len(hashes))


def layout_of(texts: DataFrame, least: int = LEAST, most: int = MOST) -> Layout:
    return Layout(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, least, most)


def by_planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: those of the leading zeros take no room once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def cells_of(seg: int, hashes: np.ndarray, extra: np.ndarray, layout: Layout) -> pa.Table:
    """One row per bucket that has any of the sorted ``hashes``."""
    cuts, rows = layout.cuts(hashes), []
    for bucket in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[bucket], cuts[bucket + 1])
        steps = np.diff(hashes[part], prepend=np.uint64(0))
        rows.append({"bucket": int(bucket), "seg": seg, "hashes": by_planes(steps), "extra": by_planes(extra[part])})
    return pa.Table.from_pylist(rows, schema=CELL_TYPES)


def bucket_of(cells: pa.Table, extra_kind: type) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, sizes of their cells, and the cells joined: hashes, extras, place of the segment."""
    segments = cells.column("seg").to_pylist()
    parts = [np.cumsum(from_planes(h, np.uint64), dtype=np.uint64) for h in cells.column("hashes").to_pylist()]
    extras = [from_planes(e, extra_kind) for e in cells.column("extra").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    return segments, sizes, np.concatenate(parts), np.concatenate(extras), np.repeat(np.arange(len(parts)), sizes)


def answers_of(cells: pa.Table, segments: list[int], sizes: np.ndarray, values: np.ndarray, encode: Callable) -> pa.Table:
    ends = np.cumsum(sizes)
    bucket = cells.column("bucket")[0].as_py()
    rows = [
        {"seg": seg, "bucket": bucket, "answer": encode(values[end - n : end])}
        for seg, n, end in zip(segments, sizes, ends)
    ]
    return pa.Table.from_pylist(rows, schema=ANSWER_TYPES)


def read_answers(answers: pa.Table, cuts: np.ndarray, decode: Callable, kind: type) -> np.ndarray:
    """The values of a segment's hashes, from the answers of all buckets."""
    out = np.zeros(cuts[-1], kind)
    for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()):
        part = slice(cuts[bucket], cuts[bucket + 1])
        out[part] = decode(raw, part.stop - part.start)
    return out


def counted_by_segment(
    texts: DataFrame,
    layout: Layout,
    to_cells: Callable[[pa.Table], pa.Table],
    to_answers: Callable[[pa.Table], pa.Table],
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """``texts`` through cells, buckets and answers back to its segments.

    The segments are dealt out once: the plan has the same exchange below the cells and below the last step, and
    Spark runs it once. It depends on the rows' values alone, so a lost part is made anew as it was.
    """
    spark = texts.sparkSession
    ready(spark)
    n = max(layout.n_segments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seg = F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.n_segments)).cast("int")
    dealt = texts.withColumn("seg", seg).repartition(n, "seg")
    cells = dealt.groupBy("seg").applyInArrow(to_cells, CELL_SCHEMA)
    answers = cells.groupBy("bucket").applyInArrow(to_answers, ANSWER_SCHEMA)
    return dealt.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(finish, schema)
