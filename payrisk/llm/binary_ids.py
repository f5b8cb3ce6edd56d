"""Token ids in files of Simple-8b words.

A 64-bit word has a selector in its upper 4 bits and up to 60 payload bits. Selector
s from 1 to 14 packs ``COUNTS[s]`` values of ``60 // COUNTS[s]`` bits, lowest bits first.
Selector 15 is an escape: the next word is one raw value of more than 60 bits. Values
after the last are zero and are cut off by the count that the block stores.

A file is a Parquet part; a row is a block of whole documents, at least ``block_ids``
ids unless it is the last of its part. It has the words, and the end of every
document as an offset into the block, so any document is found without decoding others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_bytes, over_batches, store, tokenizer
from payrisk.operators.skew import broadcast_if_small

# Values a word holds, by selector. Fixed values of the format.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK_IDS = 65_536

BLOCK_SCHEMA = "part int, block int, first bigint, n_ids bigint, words binary, doc_ids array<bigint>, doc_ends array<bigint>"
DOC_SCHEMA = "part int, first bigint, doc_id bigint, n_tokens bigint, ids binary"


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned integer."""
    if len(values) and int(values.max()) >= 1 << 53:  # more than a double holds exactly
        high = values >> np.uint64(32)
        low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned integers; each word takes as many as fit."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    # Widest of the 1, 2, 4, ... values from each place on; two of these cover any other count.
    widest = [bit_widths(padded)]
    while 2 << len(widest) <= 2 * 60:
        last, reach = widest[-1], 1 << len(widest) - 1
        widest.append(np.append(np.maximum(last[:-reach], last[reach:]), last[-reach:]))
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        power = COUNTS[s].bit_length() - 1
        own, rest = widest[power], COUNTS[s] - (1 << power)
        selector[np.maximum(own[:n], own[rest : rest + n]) <= 60 // COUNTS[s]] = s
    step = np.array([*COUNTS, 1])[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    for s in np.unique(chosen):
        at = starts[chosen == s]
        if s == ESCAPE:
            words[place[chosen == s] + 1] = values[at]
            payload = np.zeros(len(at), np.uint64)
        else:
            bits = np.uint64(60 // COUNTS[s])
            payload = np.zeros(len(at), np.uint64)
            for k in range(COUNTS[s]):
                payload |= padded[at + k] << (np.uint64(k) * bits)
        words[place[chosen == s]] = (np.uint64(s) << np.uint64(60)) | payload
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of Simple-8b words; all words of one selector are decoded together."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    heads = np.ones(len(words), bool)
    maybe = np.flatnonzero(selector == ESCAPE)
    last = -2
    for at in maybe:  # a raw word may look like an escape itself
        if at != last + 1:
            heads[at + 1] = False
            last = at
    selector, at = selector[heads], np.flatnonzero(heads)
    sizes = np.array([*COUNTS, 1])[selector]
    place = np.cumsum(sizes) - sizes
    values = np.zeros(int(sizes.sum()), np.uint64)
    for s in np.unique(selector):
        own, to = words[at[selector == s]], place[selector == s]
        if s == ESCAPE:
            values[to] = words[at[selector == s] + 1]
            continue
        bits = np.uint64(60 // COUNTS[s])
        mask = np.uint64((1 << int(bits)) - 1)
        for k in range(COUNTS[s]):
            values[to + k] = (own >> (np.uint64(k) * bits)) & mask
    return values[:n]


def write_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, path_label: str = "token-ids", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; other columns are left out) and writes its blocks in ascending doc_id order.

    A null text is empty and still has the end id. Rows without doc_id come first.
    Rows of the same doc_id are documents of their own, ordered by a hash of the
    text. An empty table gives files without blocks. Returns the files as read back.
    """
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc())

    def encode(batches: Batches) -> Batches:
        encoder, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, ends, held = [], [], [], 0

        def row():
            values = np.frombuffer(b"".join(ids), "<u4")
            fields = [part, block, first, held, pack(values).astype("<u8").tobytes(), list(doc_ids), list(ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array([f], t) for f, t in zip(fields, BLOCK_TYPES)], names=[n for n, _ in BLOCK_FIELDS]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = encoder.encode(text) + end
                ids.append(own)
                held += len(own) // 4
                doc_ids.append(doc_id)
                ends.append(held)
                if held >= block_ids:
                    yield row()
                    block, first = block + 1, first + held
                    ids, doc_ids, ends, held = [], [], [], 0
        if held:
            yield row()

    return store(over_batches(ordered, encode, BLOCK_SCHEMA), path_label)


BLOCK_FIELDS = [
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
]
BLOCK_TYPES = [t for _, t in BLOCK_FIELDS]


def read_ids(blocks: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids as unsigned 32-bit."""

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["part"], np.int32)),
                        pa.array(starts + row["first"]),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - starts),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["part", "first", "doc_id", "n_tokens", "ids"],
                )

    # One row per file: the ids in all files before it.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_ids"), F.count(F.lit(1)).alias("_blocks"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    n_parts = blocks.select("part").distinct().count()
    found = over_batches(blocks, decode, DOC_SCHEMA).join(broadcast_if_small(parts, n_parts), "part")
    return found.select("doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids")
