"""Conversations as formatted training windows of a token budget, with loss masks.

Prefix sums of turn tokens place every turn in its conversation. Windows are runs of whole
turns: the system turn that opens the conversation comes first in each of them, then as
much of the preceding turns as the history budget allows, then new turns up to
the budget. The loss mask covers the text of new assistant turns only, so a turn that is
repeated as history is no target twice. A turn that does not fit into the budget beside the system turn gets a window of its own with it;
turns are never cut and the system turn is never left out, so such a window is longer than the budget, and ``over_budget`` says so.

A long conversation is cut by its prefix sums into segments of ``SEGMENT_BUDGETS`` budgets.
Segments are formatted apart from each other, so no task holds a whole conversation; the
system turn and the history before a segment are copied to it.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every ``<``, any
backslashes, ``|`` gets one more backslash, which is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, over_batches, store, tokenizer
from payrisk.operators.running import prior_totals

BUDGET, HISTORY, SEGMENT_BUDGETS = 2048, 512, 64
START, END = "<|im_start|>", "<|im_end|>"
TURN_TOKENS = 4  # the marks and line breaks around role and text
ASSISTANT, SYSTEM = "assistant", "system"

CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)

WINDOW_SCHEMA = (
    "conv_id bigint, segment bigint, window bigint, formatted string, n_tokens bigint, n_turns bigint, "
    "n_repeated bigint, loss_spans array<bigint>, over_budget boolean"
)
DIGEST_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_windows bigint"
)


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def counted(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Turns without nulls in role and text, and the tokens of each; a null role or text is empty."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def count(batches: Batches) -> Batches:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            # What is counted is what will be written: escaped.
            sizes = [
                (len(encoder.encode(escape_role(role).encode())) + len(encoder.encode(escape(text).encode()))) // 4 + TURN_TOKENS
                for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64())], names=["conv_id", "turn", "role", "text", "n_tokens"]
            )

    return over_batches(rows, count, "conv_id bigint, turn bigint, role string, text string, n_tokens bigint")


def placed_turns(turns: DataFrame, tokenizer_path: str, rows_per_block: int | None = None) -> DataFrame:
    """Turns with the tokens (``before``) and the turns (``place``) before them in their conversation.

    The order is by turn, then role and text, so rows that share a turn have a fixed order.
    """
    rows = store(counted(turns, tokenizer_path), "chat-turns")
    keyed = rows.withColumn("one", F.lit(1).cast("bigint"))
    n_rows = rows.count()
    n_conversations = rows.agg(F.approx_count_distinct("conv_id")).first()[0]
    limit = {"rows_per_block": rows_per_block} if rows_per_block else {}
    order = ["turn", "role", "text"]
    totals = prior_totals(keyed, ["conv_id"], order, ["n_tokens", "one"], n_rows, 2 * n_conversations, **limit)
    return totals.select(
        "conv_id", "role", "text", "n_tokens",
        F.col("prior_n_tokens").cast("bigint").alias("before"), F.col("prior_one").cast("bigint").alias("place"),
    )


def segmented(turns: DataFrame, budget: int, history: int, segment_budgets: int) -> DataFrame:
    """Every turn in its segment, and copies of what later segments repeat: history, and the system turn."""
    size = budget * segment_budgets
    if history >= size:
        raise ValueError("the history must be shorter than a segment")
    own = turns.withColumns({"segment": F.floor(F.col("before") / size).cast("bigint"), "copied": F.lit(False)})
    next_segment = F.floor((F.col("before") + F.lit(history)) / size).cast("bigint")
    is_system = (F.col("place") == 0) & (F.col("role") == SYSTEM)
    recent = own.where((next_segment > F.col("segment")) & ~is_system).withColumns(
        {"segment": F.col("segment") + 1, "copied": F.lit(True)}
    )
    later = own.where("segment > 0").select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment")).distinct()
    systems = own.where(is_system).withColumn("copied", F.lit(True))
    systems = systems.join(later, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("segment", F.col("_segment"))
    return own.unionByName(recent).unionByName(systems.drop("_conv", "_segment"))


class Formatter:
    """Windows of one segment, from its turns in order."""

    def __init__(self, conv_id: int | None, segment: int, budget: int, history: int):
        self.conv_id, self.segment, self.budget, self.history_budget = conv_id, segment, budget, history
        self.window = 0
        self.system: tuple[str, str, int] | None = None
        self.past: deque[tuple[str, str, int]] = deque()  # turns a next window may repeat
        self.past_tokens = 0
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.held = 0

    def add(self, role: str, text: str, n_tokens: int, place: int, copied: bool) -> dict | None:
        """Takes a turn; gives the window that it does not fit into any more, if there is one."""
        turn, done = (role, text, n_tokens), None
        is_system = place == 0 and role == SYSTEM
        if not copied:
            if self.new and self.held + n_tokens > self.budget:
                done = self.close()
            if not self.new:
                self._open(n_tokens)
            self.new.append(turn)
            self.held += n_tokens
        if is_system:
            self.system = turn
        else:
            self.past.append(turn)
            self.past_tokens += n_tokens
            while self.past and self.past_tokens > self.history_budget:
                self.past_tokens -= self.past.popleft()[2]
        return done

    def _open(self, n_tokens: int) -> None:
        self.repeated = list(self.past)
        room = self.budget - n_tokens - (self.system[2] if self.system else 0)
        while self.repeated and sum(t[2] for t in self.repeated) > room:
            self.repeated.pop(0)
        if self.system:
            self.repeated.insert(0, self.system)
        self.held = sum(t[2] for t in self.repeated)

    def close(self) -> dict | None:
        if not self.new:
            return None
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate(self.repeated + self.new):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if k >= len(self.repeated) and role == ASSISTANT:
                spans += [at + len(head), at + len(head) + len(body)]
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
        row = {
            "conv_id": self.conv_id, "segment": self.segment, "window": self.window, "formatted": "".join(parts),
            "n_tokens": self.held, "n_turns": len(self.repeated) + len(self.new), "n_repeated": len(self.repeated),
            "loss_spans": spans, "over_budget": self.held > self.budget,
        }
        self.window, self.new, self.held = self.window + 1, [], 0
        return row


WINDOW_TYPES = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "segment", "window")] + [("formatted", pa.string())]
    + [(n, pa.int64()) for n in ("n_tokens", "n_turns", "n_repeated")] + [("loss_spans", pa.list_(pa.int64())), ("over_budget", pa.bool_())]
)
ROWS_OUT = 256


def format_windows(
    turns: DataFrame,
    tokenizer_path: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    segment_budgets: int = SEGMENT_BUDGETS,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Formatted windows of ``turns`` (conv_id, turn, role, text), other columns left out.

    Turns without conv_id are one conversation, a null turn comes last, repeated rows are turns of their own.
    An empty table has no windows, an empty text is a turn without text. A very long turn is written whole, in a window that is
    ``over_budget``; all others have at most ``budget`` tokens.
    """
    rows = segmented(placed_turns(turns, tokenizer_path, rows_per_block), budget, history, segment_budgets)
    # Copies come before a segment's own turns, because their places are lower.
    rows = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    rows = rows.select("conv_id", "segment", "place", "copied", "role", "text", "n_tokens")

    def build(batches: Batches) -> Batches:
        current, out = None, []
        for batch in batches:
            for conv_id, segment, place, copied, role, text, n_tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or (current.conv_id, current.segment) != (conv_id, segment):
                    out.append(current and current.close())
                    current = Formatter(conv_id, segment, budget, history)
                out.append(current.add(role, text, n_tokens, place, copied))
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist([r for r in out if r], schema=WINDOW_TYPES)
                    out = []
        out.append(current and current.close())
        yield pa.RecordBatch.from_pylist([r for r in out if r], schema=WINDOW_TYPES)

    return over_batches(rows, build, WINDOW_SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a window."""
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows say: digests of all new turns and of all text under the loss mask.

    The windows of a conversation go through one task, one after another: only digests are held.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    ordered = ordered.select("conv_id", "formatted", "n_repeated", "loss_spans")

    def digest(batches: Batches) -> Batches:
        key, state, out = None, None, []
        for batch in batches:
            for conv_id, formatted, n_repeated, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != conv_id:
                    if state:
                        out.append((key, state))
                    key, state = conv_id, {"n": 0, "chars": 0, "loss": 0, "windows": 0, "turns": hashlib.sha256(), "under": hashlib.sha256()}
                for role, text in parse(formatted)[n_repeated:]:
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                for a, b in zip(spans[::2], spans[1::2]):
                    text = unescape(formatted[a:b])
                    state["under"].update(text.encode())
                    state["loss"] += len(text)
                state["chars"] += len(formatted)
                state["windows"] += 1
            yield _digests(out)
            out = []
        yield _digests([(key, state)] if state else [])

    return over_batches(ordered, digest, DIGEST_SCHEMA)


def _digests(states: list[tuple[int | None, dict]]) -> pa.RecordBatch:
    rows = [
        (key, s["n"], s["turns"].hexdigest(), s["loss"], s["under"].hexdigest(), s["chars"], s["windows"])
        for key, s in states
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows) if rows else [[] for _ in kinds]
    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
