"""Removing passages that occur earlier: every window of so many words is hashed and counted.

A word goes if it lies in a window whose words also start earlier, in a smaller doc_id or
earlier in the same text. Windows are compared by a 64-bit Rabin-Karp hash of
their words. Within a segment the first occurrence of a hash is known; a bucket finds for each hash
the segment that has it first of all. Windows that go are joined to maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm import cells
from payrisk.llm.common import as_bytes

WINDOW = 20
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, removed array<bigint>, text string, kept string"
TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.int64()))]
    + [("text", pa.string()), ("kept", pa.string())]
)
NO_ID = -(1 << 63)


class Segment:
    """Documents of a segment in order, with the hashes of all their windows."""

    def __init__(self, rows: pa.Table, window: int):
        ids, texts = rows.column("doc_id").to_pylist(), as_bytes(rows.column("text").combine_chunks())
        keys = [(NO_ID if d is None else d, t or b"") for d, t in zip(ids, texts)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.rows = [(ids[k], texts[k]) for k in order]
        self.doc_keys = np.array([keys[k][0] for k in order], np.int64)
        self.words = [(t or b"").split() for _, t in self.rows]
        own = [cells.window_hashes(cells.word_ids(w), window) for w in self.words]
        sizes = np.array([len(h) for h in own], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.repeat(np.arange(len(own)), sizes)
        found = np.concatenate(own) if own else np.zeros(0, np.uint64)
        self.hashes, self.first, self.place = np.unique(found, return_index=True, return_inverse=True)


def first_elsewhere(hashes: np.ndarray, docs: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which hashes another segment has earlier: in a smaller doc_id, or the same and a smaller segment."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    several = np.zeros(len(hashes), bool)
    several[order[1:]] |= same
    several[order[:-1]] |= same
    later = np.zeros(len(hashes), bool)
    among = np.flatnonzero(several)
    ranked = among[np.lexsort((segment[among], docs[among], hashes[among]))]
    later[ranked[1:]] = hashes[ranked][1:] == hashes[ranked][:-1]
    return later


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, least: int = cells.LEAST, most: int = cells.MOST
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are left out): words, words removed, the removed intervals (word numbers from,
    to, from, ...), the text, and the kept words with one space between.

    A null text has no words. Rows without doc_id come before all others; rows of one doc_id that share a segment
    are ordered by text, others by segment, and repeated rows count as earlier and later ones.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = cells.layout_of(texts, least, most)

    def to_cells(rows: pa.Table) -> pa.Table:
        own = Segment(rows, window)
        extra = own.doc_keys[own.owner[own.first]]
        return cells.cells_of(rows.column("seg")[0].as_py(), own.hashes, extra, layout)

    def to_answers(table: pa.Table) -> pa.Table:
        segments, sizes, hashes, owners, cell = cells.bucket_of(table, np.int64)
        later = first_elsewhere(hashes, owners, np.array(segments)[cell])
        return cells.answers_of(table, segments, sizes, later, lambda bits: np.packbits(bits).tobytes())

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return TYPES.empty_table()
        own = Segment(rows, window)
        later = cells.read_answers(
            answers,
            layout.cuts(own.hashes),
            lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool),
            bool,
        )
        gone = later[own.place] | (own.first[own.place] != np.arange(len(own.place)))
        out = []
        for k, ((doc_id, text), words) in enumerate(zip(own.rows, own.words)):
            starts = np.flatnonzero(gone[own.begins[k] : own.begins[k + 1]])
            if not len(starts):
                kept, intervals, n = words, [], 0
            else:
                hit = covered(len(words), starts, window)
                kept = [w for w, h in zip(words, hit.tolist()) if not h]
                intervals = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).tolist()
                n = int(hit.sum())
            out.append((doc_id, len(words), n, intervals, text, b" ".join(kept)))
        columns = [pa.array(c, pa.binary() if f.type == pa.string() else f.type).cast(f.type) for c, f in zip(zip(*out), TYPES)]
        return pa.Table.from_arrays(columns, schema=TYPES)

    return cells.counted_by_segment(texts, layout, to_cells, to_answers, finish, SCHEMA)
