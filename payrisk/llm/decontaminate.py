"""Finding and removing passages of test items in training texts.

The items' word sequences go into one generalised suffix automaton. A training text
is streamed through it word by word, which gives at every word the length of the
longest passage ending there that occurs in any item. Passages of ``window`` words or
more are hits, and so is a whole item of fewer words.

Texts and items are lower-cased in A-Z; words are runs of letters, digits and all
characters beyond ASCII. An automaton holds at most ``block_words`` words of items, so that
it fits a worker; more items are taken in several blocks, each one pass over the
documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import (
    Batches,
    as_bytes,
    as_records,
    chunks_of,
    documents_from,
    over_batches,
    store,
    with_record,
)
from payrisk.session import scratch_path

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
BLOCK_WORDS = 200_000

# A hit run longer than this or with a whole item of less than the window, or a text of which more than this part is hit, is removed.
MAX_RUN, MAX_COVERAGE = 9, 0.5

HIT_SCHEMA = (
    "n_words bigint, n_hit bigint, longest bigint, items array<string>, runs array<bigint>, whole array<bigint>, spans array<bigint>, cut string"
)
FOUND_SCHEMA = "row bigint, items array<string>, runs array<bigint>, whole array<bigint>"
HIT_TYPES = [*[pa.int64()] * 3, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.string()]
HIT_NAMES = [f.split()[0] for f in HIT_SCHEMA.split(", ")]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items behind every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._name(items)

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _name(self, items: list[tuple[str, list[bytes]]]) -> None:
        """For every state the one that holds its last ``window`` words, and the whole short items that end it."""
        n, link, length, window = len(self.next), self.link, self.length, self.window
        order = sorted(range(1, n), key=length.__getitem__)
        self.at_window = [0] * n
        for v in order:
            if length[v] >= window:
                self.at_window[v] = v if length[link[v]] < window else self.at_window[link[v]]
        of_window: list[set[str]] = [set() for _ in range(n)]
        short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for name, words in items:
            v = 0
            for word in words:
                v = self.next[v][word]
                if length[v] >= window:  # one window of this item ends here
                    of_window[self.at_window[v]].add(name)
            if len(words) < window:
                short[v].append((len(words), name))
        self.of_window = [tuple(s) for s in of_window]
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in order:
            self.short[v] = (*short[v], *self.short[link[v]])

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit runs [from, to) of the words, and the names of the items found."""
        runs, found = self.marked(words)
        return [(a, b) for a, b, _ in runs], found

    def marked(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """``hits``, with 1 at each run that holds a whole short item, 0 at others."""
        runs: list[tuple[int, int, int]] = []
        found: set[str] = set()
        following, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        v = matched = 0
        for at, word in enumerate(words):
            step = following[v].get(word)
            if step is None:
                while step is None and v:
                    v = link[v]
                    step = following[v].get(word)
                if step is None:
                    matched = 0
                    continue
                matched = length[v]
            v = step
            matched += 1
            begin, whole = at + 1, 0
            if matched >= window:
                begin -= matched
                found.update(self.of_window[self.at_window[v]])
            if short[v]:
                for size, name in short[v]:
                    if size <= matched:
                        found.add(name)
                        begin, whole = min(begin, at + 1 - size), 1
            if begin <= at:
                while runs and runs[-1][1] >= begin:
                    earlier, _, held = runs.pop()
                    begin, whole = min(begin, earlier), max(whole, held)
                runs.append((begin, at + 1, whole))
        return runs, found


def stored_items(items: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """Distinct items (name, text) stored by the number of their block, and how many blocks of about ``block_words`` words there are."""
    rows = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    rows = rows.where("name is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))  # a word and its space are six characters or so
    blocked = rows.distinct().withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)).cast("int"))
    if n_blocks == 1:
        return blocked, 1
    path = scratch_path(items.sparkSession, "decontaminate-items")
    blocked.repartition("block").write.partitionBy("block").parquet(path)
    return items.sparkSession.read.schema(blocked.schema).parquet(path), n_blocks


def item_block(stored: DataFrame, block: int) -> list[tuple[str, bytes]]:
    """Items of one block, which goes to the workers with the pass that seeks it: the driver holds no more than one."""
    return [(r["name"], r["text"].encode()) for r in stored.where(F.col("block") == block).select("name", "text").collect()]


def find(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_run: int = MAX_RUN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with its text and the hits of ``items`` (item_id, text) in it.

    n_words, n_hit, longest (hit run), items (ids as sorted strings), runs (hit runs: words from, to, from, ...),
    whole (1 for each run that holds a whole item of less than ``window`` words, 0 for others), spans (the runs in bytes of the
    text), cut (the text without runs of more than ``max_run`` words and those with a whole item; null if it has none). A null text has no words. An item without id or words is left out; one id may have several
    texts. With no items nothing is hit. Every row is a document of its own, also if it repeats. A very long text is streamed
    whole through the automaton, in one task. An empty table gives none.
    """
    stored, n_blocks = stored_items(items, block_words)
    records, schema = as_records(docs), with_record(docs, f"text string, {HIT_SCHEMA}")
    if n_blocks == 1:
        return over_batches(records, _matching(item_block(stored, 0), window, max_run), schema)
    # Several passes must see the same rows, and their runs meet by row. A pass is over before the next block is fetched.
    keyed = store(records.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    rows, path = keyed.select("row", "text"), scratch_path(docs.sparkSession, "decontaminate-runs")
    for block in range(n_blocks):
        seen = over_batches(rows, _matching(item_block(stored, block), window, max_run), f"row bigint, text string, {HIT_SCHEMA}")
        seen.where("size(runs) > 0").select("row", "items", "runs", "whole").write.mode("append").parquet(path)
    found = docs.sparkSession.read.schema(FOUND_SCHEMA).parquet(path)
    merged = found.groupBy("row").agg(
        F.flatten(F.collect_list("items")).alias("items"), F.collect_list(F.struct("runs", "whole")).alias("parts")
    )
    # Runs and whole stay in the same order: both come from one list.
    parts = [F.flatten(F.col(f"parts.{name}")).alias(name) for name in ("runs", "whole")]
    hit = merged.select("row", "items", *parts)
    filled = [F.coalesce(name, F.array().cast(hit.schema[name].dataType)).alias(name) for name in ("items", "runs", "whole")]
    return over_batches(keyed.join(hit, "row", "left").select("doc", "text", *filled), _merging(max_run), schema)


def _described(
    text: bytes | None, words: list[bytes], runs: list[tuple[int, int, int]], items: set[str], max_run: int
) -> tuple:
    spans: list[int] = []
    cut = None
    if runs:
        places = [m.span() for m in WORD.finditer(text.lower())]
        pairs = [(places[a][0], places[b - 1][1]) for a, b, _ in runs]
        spans = [x for pair in pairs for x in pair]
        out = [pair for pair, (a, b, whole) in zip(pairs, runs) if whole or b - a > max_run]
        if out:
            begins, ends = [0, *[e for _, e in out]], [*[b for b, _ in out], len(text)]
            cut = b"".join(text[a:b] for a, b in zip(begins, ends)).decode()
    sizes = [b - a for a, b, _ in runs]
    flat, whole = [x for a, b, _ in runs for x in (a, b)], [w for _, _, w in runs]
    return len(words), sum(sizes), max(sizes, default=0), sorted(items), flat, whole, spans, cut


def _batch(leading: list[pa.Array], names: list[str], found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else [[] for _ in HIT_TYPES]
    arrays = [pa.array(c, t) for c, t in zip(columns, HIT_TYPES)]
    return pa.RecordBatch.from_arrays(leading + arrays, names=names + HIT_NAMES)


def _matching(block: list[tuple[str, bytes]], window: int, max_run: int) -> Callable[[Batches], Batches]:
    def match(batches: Batches) -> Batches:
        automaton = Automaton([(name, words_of(text)) for name, text in block], window)
        for whole in batches:
            for rows in chunks_of(whole.num_rows, 2048):
                batch = whole.slice(rows.start, rows.stop - rows.start)
                found = []
                for text in as_bytes(batch.column(1)):
                    words = words_of(text)
                    found.append(_described(text, words, *automaton.marked(words), max_run))
                yield _batch(batch.columns, batch.schema.names, found)

    return match


def _merging(max_run: int) -> Callable[[Batches], Batches]:
    def merge(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for text, names, flat, whole in zip(as_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4))):
                joined: list[tuple[int, int, int]] = []
                for a, b, w in sorted(zip(flat[::2], flat[1::2], whole)):
                    if joined and a <= joined[-1][1]:
                        joined[-1] = (joined[-1][0], max(b, joined[-1][1]), max(w, joined[-1][2]))
                    else:
                        joined.append((a, b, w))
                found.append(_described(text, words_of(text), joined, set(names), max_run))
            yield _batch(batch.columns[:2], ["doc", "text"], found)

    return merge


def clean(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_run: int = MAX_RUN,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without what they share with ``items``: columns as before.

    Hit runs of more than ``max_run`` words and those with a whole item of less than ``window`` go from the text; a document of which more than
    the part ``max_coverage`` of its words is hit goes altogether. A length column
    ``n_chars``, if there is one, follows the text. Null and empty texts stay as they are.
    """
    hits = find(docs, items, window, max_run, block_words)
    stays = hits.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    return documents_from(stays, docs.columns, F.col("cut"), F.col("cut").isNotNull())
