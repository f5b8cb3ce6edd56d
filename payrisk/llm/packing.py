"""Packing documents into fixed windows, mixed from their sources by deficit round-robin.

Every source is a queue of tokens. In each round a queue's deficit counter grows by
its share of one window, and it serves whole grains while the counter covers them;
what is left of the counter goes on to the next round, and so into the next window
and the next partition. Queues are served in the order of their names. The served
grains make one stream, and windows are its consecutive pieces of ``window`` tokens,
so only the last window is short. An empty queue gives up its credit, which makes
later rounds shorter and keeps the proportions of the others.

The state of the counters needs no walk through earlier rounds: after round r queue
s has served floor(r * share_s * grains_per_window) grains, or all it has. So the
place of a grain in the stream follows from the queues' totals alone, and every
partition places its own documents. Shares are whole numbers, so this is exact.

A queue's order is that of the input partitions and the rows in them. Beyond ``MAX_SOURCES`` sources, those with the least tokens share the last
queue, one source after another; sources with a target share keep their own queues.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_bytes, chunks_of, over_batches, store, tokenizer
from payrisk.operators.running import prior_totals
from payrisk.operators.skew import broadcast_if_small

WINDOW, GRAIN = 2048, 128
# Shares are given in parts of this.
SHARE_UNIT = 65_536
# Sources with a queue of their own.
MAX_SOURCES = 10_000
# Counters of queues after rounds that are held at once.
COUNTERS = 1 << 20

TOKEN_SCHEMA = "part int, doc_id bigint, queue string, place bigint, n_tokens bigint, ids binary"
PIECE_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary()),
]
PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "source string, ids binary"
)


@dataclass(frozen=True)
class Schedule:
    """Names, token totals and whole-number shares of the queues, in serving order. A queue beyond the names is that of all other sources."""

    names: tuple[str, ...]
    totals: np.ndarray
    shares: np.ndarray
    window: int = WINDOW
    grain: int = GRAIN

    @property
    def per_round(self) -> int:
        return self.window // self.grain

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served after each of these rounds."""
        grains = rounds[:, None] * (self.per_round * self.shares) // self.shares.sum()
        return np.minimum(self.totals, grains * self.grain)

    def stream_place(self, queue: np.ndarray, grain: np.ndarray) -> np.ndarray:
        """Where in the stream the grains of these queues begin."""
        credit = self.per_round * self.shares[queue]
        rounds = -(-(grain + 1) * self.shares.sum() // credit)  # the first that covers the grain
        different, back = np.unique(rounds, return_inverse=True)
        order = np.argsort(back, kind="stable")
        step = max(1, COUNTERS // len(self.totals))
        edges = np.searchsorted(back[order], np.arange(0, len(different) + step, step))
        out = np.empty(len(grain), np.int64)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            own_rounds, some = different[k * step : (k + 1) * step], order[a:b]
            done = self.served(own_rounds - 1)
            own = self.served(own_rounds) - done
            begin = done.sum(axis=1)[:, None] + np.cumsum(own, axis=1) - own
            row = back[some] - k * step
            out[some] = begin[row, queue[some]] + grain[some] * self.grain - done[row, queue[some]]
        return out


def schedule(
    totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW, grain: int = GRAIN, others: int = 0
) -> Schedule:
    """Shares from target proportions; without targets, those of the tokens there are. At least one unit each.

    ``others`` are the tokens of all sources that have no queue of their own.
    """
    if window % grain:
        raise ValueError("a window must be a whole number of grains")
    names = tuple(sorted(totals))
    tokens = [totals[n] for n in names] + [others] * (others > 0)
    wanted = [targets.get(n, 0) for n in names] + [0] * (others > 0) if targets else tokens
    whole = sum(wanted) or 1
    shares = np.array([max(1, round(SHARE_UNIT * w / whole)) for w in wanted], np.int64)
    return Schedule(names, np.array(tokens, np.int64), shares, window, grain)


def queues_of(sums: DataFrame, targets: dict[str, float] | None, max_sources: int) -> tuple[dict[str, int], int, DataFrame | None]:
    """(tokens of the sources with queues of their own, tokens of all others, (queue, ahead) of the others).

    ``ahead`` are the tokens of other sources before this one in the queue that they share.
    """
    totals = store(sums.groupBy("queue").agg(F.sum("_tokens").alias("tokens")), "packing-totals")
    named = F.col("queue").isin(list(targets)) if targets else F.lit(False)
    # At most ``max_sources`` rows come to the driver.
    first = totals.orderBy(named.desc(), F.col("tokens").desc(), "queue").limit(max_sources).collect()
    own = {r["queue"]: r["tokens"] for r in first}
    n_others = totals.count() - len(own)
    if not n_others:
        return own, 0, None
    known = totals.sparkSession.createDataFrame([(n,) for n in own], "queue string")
    rest = totals.join(broadcast_if_small(known, len(own)), "queue", "left_anti").withColumn("one", F.lit(1))
    ahead = prior_totals(rest, ["one"], ["queue"], ["tokens"], n_others, 1)
    placed = store(ahead.select("queue", F.col("prior_tokens").cast("bigint").alias("ahead"), "tokens"), "packing-others")
    return own, placed.agg(F.sum("tokens")).first()[0], placed.select("queue", "ahead")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids per document, and its place in the queue of its source within the input partition."""
    source: Column = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(source, F.lit("")).alias("queue"),
        F.col("text").cast("string").alias("text"),
    )

    def encode(batches: Batches) -> Batches:
        encoder, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        narrow = max(encoder.library.get_vocab_size(), end_id) < 1 << 16
        part, queued = TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in chunks_of(batch.num_rows, 1024):
                rows = batch.slice(piece.start, piece.stop - piece.start)
                places, sizes, ids = [], [], []
                for queue, text in zip(rows.column(1).to_pylist(), as_bytes(rows.column(2))):
                    own = encoder.encode(text) + end
                    sizes.append(len(own) // 4)
                    places.append(queued.get(queue, 0))
                    queued[queue] = places[-1] + sizes[-1]
                    ids.append(np.frombuffer(own, "<u4").astype("<u2").tobytes() if narrow else own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), part, np.int32)), rows.column(0), rows.column(1),
                        pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["part", "doc_id", "queue", "place", "n_tokens", "ids"],
                )

    return over_batches(rows, encode, TOKEN_SCHEMA)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    grain: int = GRAIN,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, source) and their places: one row per run of ids within one window.

    ``ids`` holds them as little-endian unsigned 32-bit integers; ``assemble`` makes
    whole windows. A null text is empty and has the end id alone; a null source, or
    a table without that column, is the queue "". Rows of one doc_id are documents
    of their own. An empty table gives no pieces. A text of any length is cut into pieces. Other columns are left out.
    Sources beyond the ``max_sources`` that have targets or most tokens share one queue.
    """
    tokens = store(tokenize(docs, tokenizer_path, end_id), "packing-ids")
    sums = store(tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("_tokens")), "packing-sums")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("base"))
    totals, others, ahead = queues_of(sums, targets, max_sources)
    plan = schedule(totals, targets, window, grain, others)
    if ahead is not None:
        bases = bases.join(broadcast_if_small(ahead, ahead.count()), "queue", "left")
        bases = bases.select("part", "queue", (F.col("base") + F.coalesce("ahead", F.lit(0))).alias("base"))
    placed = tokens.join(broadcast_if_small(bases, sums.count()), ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("place")).alias("place"), "n_tokens", "ids")

    def cut(batches: Batches) -> Batches:
        index = {name: k for k, name in enumerate(plan.names)}
        for batch in batches:
            for rows in chunks_of(batch.num_rows, 512):
                yield _pieces(batch.slice(rows.start, rows.stop - rows.start), plan, index)

    return over_batches(placed, cut, PIECE_SCHEMA)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the row) for rows of these many entries."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(rows: pa.RecordBatch, plan: Schedule, index: dict[str, int]) -> pa.RecordBatch:
    names = rows.column(1).to_pylist()
    queue = np.array([index.get(n, len(index)) for n in names], np.int64)
    place, n_tokens = (rows.column(k).to_numpy() for k in (2, 3))
    ids, doc_ids = rows.column(4).to_pylist(), rows.column(0).to_pylist()

    # The document's parts in single grains of its queue.
    first = place // plan.grain
    doc, k = _spread((place + n_tokens - 1) // plan.grain - first + 1)
    grain = first[doc] + k
    begin = np.maximum(place[doc], grain * plan.grain)
    end = np.minimum((place + n_tokens)[doc], (grain + 1) * plan.grain)
    at = plan.stream_place(queue[doc], grain) + begin - grain * plan.grain

    # Neighbours in the stream join; then windows cut.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (end - begin)[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    doc, begin, at, end = doc[heads], begin[heads], at[heads], end[tails]
    last = at + end - begin - 1
    run, k = _spread(last // plan.window - at // plan.window + 1)
    left = np.maximum(at[run], (at[run] // plan.window + k) * plan.window)
    right = np.minimum(last[run] + 1, (at[run] // plan.window + k + 1) * plan.window)
    doc, start = doc[run], begin[run] + left - at[run] - place[doc[run]]
    length = right - left

    sources = [names[d] for d in doc]
    wide = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("<u4") for b, n in zip(ids, n_tokens)]
    cuts = [wide[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
    columns = [
        [doc_ids[d] for d in doc], start, length, n_tokens[doc], left // plan.window, left % plan.window, sources, cuts
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, PIECE_FIELDS)], names=[n for n, _ in PIECE_FIELDS]
    )


def assemble(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole windows: ids in order, filled up with ``pad_id``, and the documents in them. A window bounds its group."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))), lambda p: p["ids"])
    joined = pieces.groupBy("sequence_id").agg(own.alias("parts"), F.sum("length").alias("n_tokens"))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    # Arrays of bytes are joined as hexadecimal text, which Spark can concatenate.
    text = F.array_join(F.transform("parts", lambda p: F.hex(p)), "")
    filled = F.concat(text, F.repeat(F.hex(pad), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.unhex(filled).alias("ids"))
