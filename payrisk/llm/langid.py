"""Language identification by a small convolutional network over bytes.

A text is cut into windows of ``WIDTH`` bytes. Filters of several widths slide over the embedded bytes
of a window; the strongest answer of each filter goes through a softmax layer. The
probabilities of all windows of a text are averaged, weighted by their bytes.

The network is trained in numpy on the driver, on at most ``PER_LANGUAGE`` windows of each language. To apply it,
embedding and filters are multiplied out once into tables by pairs of bytes, so a
filter of up to four bytes needs two look-ups at each place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_bytes, as_records, over_batches, store, with_record
from payrisk.operators.skew import broadcast_if_small

WIDTH, PAD = 256, 256
EMBEDDING, FILTERS, WIDTHS = 8, 16, (2, 3, 4)
# Bounds of training: windows of each language, and of all together (more languages have fewer windows each, one at least).
PER_LANGUAGE, MAX_WINDOWS, PIECES = 800, 800_000, 4
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNKNOWN = "und"
HASH_PARTS = 1 << 20

SCHEMA = "lang_pred string, score double, n_windows bigint"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 257 bytes and padding, EMBEDDING
    filters: list[np.ndarray]  # of each width: width, EMBEDDING, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]


def windows_of(text: bytes) -> np.ndarray:
    """Bytes of the whole text in rows of WIDTH, the last one filled up with PAD."""
    n = max(1, -(-len(text) // WIDTH))
    rows = np.full(n * WIDTH, PAD, np.int16)
    rows[: len(text)] = np.frombuffer(text, np.uint8)
    return rows.reshape(n, WIDTH)


def new_network(languages: list[str], seed: int = 1) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0] * shape[1]), shape).astype(np.float32)
    embedding = draw.normal(0, 1, (PAD + 1, EMBEDDING)).astype(np.float32)
    embedding[PAD] = 0
    filters = [normal(w, EMBEDDING, FILTERS) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    return Network(
        languages, embedding, filters, np.zeros(n, np.float32), normal(n, len(languages)), np.zeros(len(languages), np.float32)
    )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _step(net: Network, rows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Gradients of the cross entropy, in the order of ``Network.parameters``."""
    n, f = len(rows), FILTERS
    embedded = net.embedding[rows]
    pooled, places, cut = [], [], []
    for kernel in net.filters:
        w = len(kernel)
        # n, places, w * EMBEDDING
        view = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2)
        answers = view.reshape(n, -1, w * EMBEDDING) @ kernel.reshape(-1, f)
        place = answers.argmax(axis=1)
        pooled.append(np.take_along_axis(answers, place[:, None, :], 1)[:, 0])
        places.append(place)
        cut.append(view)
    hidden = np.concatenate(pooled, axis=1) + net.bias
    active = np.maximum(hidden, 0)
    error = _softmax(active @ net.out + net.out_bias)
    error[np.arange(n), wanted] -= 1
    error /= n
    g_out, g_out_bias = active.T @ error, error.sum(axis=0)
    back = (error @ net.out.T) * (hidden > 0)
    g_embedding, g_filters = np.zeros_like(net.embedding), []
    for k, (kernel, place) in enumerate(zip(net.filters, places)):
        w, own = len(kernel), back[:, k * f : (k + 1) * f]
        chosen = cut[k][np.arange(n)[:, None], place]  # n, f, w, EMBEDDING
        g_filters.append(np.einsum("nf,nfwe->wef", own, chosen))
        into = np.einsum("nf,wef->nfwe", own, kernel)
        where = rows[np.arange(n)[:, None, None], place[:, :, None] + np.arange(w)]
        np.add.at(g_embedding, where, into)
    g_embedding[PAD] = 0
    return [g_embedding, *g_filters, back.sum(axis=0), g_out, g_out_bias]


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """A network for the languages of the samples; none without samples. Equal samples in equal order give the same."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rows = np.concatenate([windows_of(text[:WIDTH]) for text, _ in samples])
    wanted = np.array([languages.index(lang) for _, lang in samples])
    net, draw = new_network(languages, seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    t = 0
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            t += 1
            for p, g, m, v in zip(net.parameters(), _step(net, rows[own], wanted[own]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


class Reader:
    """A network with embedding and filters multiplied out into look-up tables."""

    def __init__(self, net: Network):
        self.net, n = net, PAD + 1
        self.tables: list[list[np.ndarray]] = []
        for kernel in net.filters:
            single = [net.embedding @ kernel[k] for k in range(len(kernel))]
            pairs = [
                (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(n * n, -1)
                for k in range(0, len(single) - 1, 2)
            ]
            self.tables.append(pairs + ([single[-1]] if len(single) % 2 else []))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int32) * (PAD + 1) + rows[:, 1:]
        pooled = []
        for kernel, tables in zip(self.net.filters, self.tables):
            w = len(kernel)
            places = rows.shape[1] - w + 1
            answers = np.zeros((len(rows), places, FILTERS), np.float32)
            for k, table in enumerate(tables):
                source = rows if len(table) == PAD + 1 else pairs
                answers += table[source[:, 2 * k : 2 * k + places]]
            pooled.append(answers.max(axis=1))
        active = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
        return _softmax(active @ self.net.out + self.net.out_bias)


ROWS_AT_ONCE = 256


def judge_texts(reader: Reader, texts: list[bytes]) -> list[tuple[str, float, int]]:
    """Language, its mean probability, and windows, of texts that have letters."""
    cut = [windows_of(t) for t in texts]
    sizes = np.array([len(c) for c in cut])
    rows = np.concatenate(cut)
    weight = (rows != PAD).sum(axis=1).astype(np.float64)
    mean = np.zeros((len(texts), len(reader.net.languages)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    for start in range(0, len(rows), ROWS_AT_ONCE):
        part = slice(start, start + ROWS_AT_ONCE)
        np.add.at(mean, owner[part], reader.probabilities(rows[part]) * weight[part, None])
    mean /= np.bincount(owner, weight)[:, None]
    best = mean.argmax(axis=1)
    return [
        (reader.net.languages[k], float(min(1.0, p[k])), int(n)) for k, p, n in zip(best, mean, sizes)
    ]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(
    docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE, max_windows: int = MAX_WINDOWS
) -> list[tuple[bytes, str]]:
    """At most ``per_language`` pieces of WIDTH bytes or so from texts of each language, chosen and placed by a hash.

    Rows without text or language are left out, copies of a text count once. A text gives up to PIECES pieces; where a language
    has no more than ``per_language`` of them all are taken. With many languages each has fewer, ``max_windows`` together.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    texts = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    counts = store(rows.groupBy("lang").agg(texts.alias("n_texts")), "langid-counts")
    n_languages = counts.count()
    if not n_languages:
        return []
    wanted = max(1, min(per_language, max_windows // n_languages))
    pieces = F.explode(F.array([F.lit(k) for k in range(PIECES)]))
    drawn = rows.select("text", "lang", pieces.alias("piece")).withColumn("hash", F.xxhash64("text", "piece"))
    drawn = drawn.join(broadcast_if_small(counts, n_languages), "lang")
    # All pieces of a language with few; of others twice the wanted number on average, so that the cut to the number is by the hash as well.
    share = F.when(F.col("n_texts") <= wanted, 1.0).otherwise(2 * wanted / (PIECES * F.col("n_texts")))
    drawn = drawn.where(F.pmod("hash", F.lit(HASH_PARTS)) < F.lit(HASH_PARTS) * share)
    start = F.pmod(F.col("hash"), F.greatest(F.length("text") - WIDTH, F.lit(1))).cast("int")
    found = drawn.select("lang", "hash", F.substring(F.col("text"), start + 1, F.lit(WIDTH)).alias("text"))
    # Pieces of a short text are all the same: its least hash counts.
    found = found.groupBy("lang", "text").agg(F.min("hash").alias("hash"))
    taken: dict[str, list[bytes]] = {}
    for name, _, text in sorted((r["lang"], r["hash"], r["text"]) for r in found.collect()):
        own = taken.setdefault(name, [])
        if len(own) < wanted and has_letter(text):
            own.append(text.encode()[:WIDTH])
    return [(text, name) for name in sorted(taken) for text in taken[name]]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with lang_pred and score for its whole text.

    A null text, one without any letter, or no network at all gives ``und`` and score 0. Only the text is looked at.
    Repeated rows are answered each, an empty table gives none. All windows of a very long text are judged, in one task.
    """

    def step(batches: Batches) -> Batches:
        reader = Reader(net) if net else None
        for whole in batches:
            start = 0
            while start < whole.num_rows or whole.num_rows == 0:
                batch = whole.slice(start, 256)
                start += 256
                texts = as_bytes(batch.column(1))
                read = [k for k, t in enumerate(texts) if reader and t and has_letter(t.decode())]
                out: list[tuple[str, float, int]] = [(UNKNOWN, 0.0, 0)] * len(texts)
                for k, found in zip(read, judge_texts(reader, [texts[k] for k in read]) if read else []):
                    out[k] = found
                columns = zip(*out) if out else [[], [], []]
                kinds = [pa.string(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                    names=["doc", "lang_pred", "score", "n_windows"],
                )
                if whole.num_rows == 0:
                    break

    return over_batches(as_records(docs), step, with_record(docs, SCHEMA))
