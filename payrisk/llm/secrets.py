"""Finding secrets in texts: patterns, and values of credentials that are costly to guess.

Three patterns are always reported: assignments of long values, access key ids and long
hexadecimal runs. Besides, a value given as a credential in any form is reported as
``guess`` if guessing it is costly: the cheapest way to spell it as words, dates,
repeats, keyboard walks and single characters, found by dynamic programming, still costs at
least ``MIN_BITS``. Words cost by their rank in a public vocabulary, an unlisted word what its letters do, each after the two before it
in those words. So ``password=changeme123`` is no secret by itself, and a short random value is one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import Batches, as_records, chunks_of, documents_from, over_batches, with_record
from payrisk.llm.letters import Letters, letters_of

ASSIGN = re.compile(
    r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18

# Other ways to name a credential and give its value. What stands before the name, as in db_pass, needs no look: a name begins
# where no letter or digit is before it, so a long run of hyphens or words is passed once.
CONTEXT = re.compile(
    r"""(?ia:(?<![a-z0-9])"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pw|pin|secret|token|api[_-]?key|auth|credentials?|(?:access|private)[_-]?key|login)"""
    r"""["']?\x20{0,3}(?:[:=]{1,2}|=>)\x20{0,3}["']?)([!#-&(-~]{6,})""",
    re.A,
)
# A value that code looks up: names joined by dots, or a call or an index behind a name.
REFERENCE = re.compile(r"""([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(\(|\[)?""", re.A)
REFERENCE_PART_BITS = 26.0
KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 34.0

# Words that passwords are made of, most usual first.
WORDS = tuple((
    "password the and you that with this from have love admin user test root secret login welcome letmein monkey "
    "dragon master shadow qwerty hello freedom whatever trust sunshine princess football baseball iloveyou change me "
    "guest default pass my key token api access account system server data base public private local host network "
    "summer winter spring autumn january february march april may june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday michael daniel jessica charlie thomas jordan "
    "hunter killer super star batman ninja access angel flower orange banana cookie cheese coffee pepper ginger "
    "red blue green black white gold silver king queen prince house home work office company google apple computer "
    "internet windows linux example sample demo temp new old one two three four five six seven eight nine ten zero "
    "here your name mail email address phone number value string text null none true false required optional "
    "insert enter type placeholder redacted hidden"
).split())
VOCABULARY = "word_bpe_49k.json"  # a public one, for all other words
# Characters often put for letters, and rows of a keyboard.
PLAIN = str.maketrans("@4301!$57", "aaeoiisst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

# No segment but single characters goes on beyond LONGEST, so every spelling passes one of any REACH neighbouring places.
LONGEST, REACH = 32, 36
KEPT_LENGTH = 64
NEW_SEGMENT = 1.0  # bits for where a segment ends
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)
DATE_BITS, YEAR_BITS = log2(365 * 120), log2(120)
# A run of letters that may be spelled as an unlisted word, letter after letter.
LETTERS = re.compile(r"[A-Za-z]?[a-z]{3,}|[A-Z]{4,}")
LEAST_RUN = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


PLACE = {key: (row, col) for row, keys in enumerate(ROWS) for col, key in enumerate(keys)}


@lru_cache(maxsize=1)
def neighbours() -> dict[str, frozenset[str]]:
    """Keys beside each key, in its row and the rows above and below."""
    return {
        a: frozenset(b for b, (s, d) in PLACE.items() if b != a and abs(r - s) <= 1 and abs(c - d) <= 1)
        for a, (r, c) in PLACE.items()
    }


def direction(a: str, b: str) -> tuple[int, int]:
    return PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]


def char_bits(char: str) -> float:
    if "0" <= char <= "9":
        return log2(10)
    if char.isascii() and char.isalpha():
        return log2(26)
    return log2(33)


def guess_bits(value: str, enough: float = MIN_BITS, vocabulary: str | None = None) -> float:
    """Cost of the cheapest spelling in bits; costs of short values are kept, since values repeat."""
    if len(value) <= KEPT_LENGTH:
        return _kept_bits(value, enough, vocabulary)
    return _guess_bits(value, enough, letters_of(vocabulary or default_vocabulary(), WORDS))


@lru_cache(maxsize=1 << 14)
def _kept_bits(value: str, enough: float, vocabulary: str | None) -> float:
    return _guess_bits(value, enough, letters_of(vocabulary or default_vocabulary(), WORDS))


def _guess_bits(value: str, enough: float, letters: Letters) -> float:
    """Cost of the cheapest spelling in bits; stops at a lower bound once that reaches ``enough``.

    ``best[i]`` is the least cost of the first i characters; ``single[i]`` the same
    if the last one is a guessed single character, which may go on without a new segment.
    """
    n, low = len(value), value.lower()
    plain, near = low.translate(PLAIN), neighbours()
    best, single = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
    for i in range(n):
        dates = []
        if value[i].isdigit():
            for pattern, bits in ((DATE, DATE_BITS), (YEAR, YEAR_BITS)):
                if m := pattern.match(value, i):
                    dates.append((m.end(), bits))
        # A letter of the other case than its neighbours costs a bit more.
        words, cased = [], 0.0
        if m := LETTERS.match(value, i, i + LONGEST):
            case = 0.0 if m.group().islower() else 1.0
            words += [(i + k, bits + case) for k, bits in enumerate(letters.costs(m.group().lower()), 1) if k >= LEAST_RUN]
        for j in range(i + 1, min(n, i + min(letters.longest, LONGEST)) + 1):
            cased += value[j - 1].isupper()
            for spelling, extra in ((low[i:j], 0.0), (plain[i:j], 2.0)):
                rank = letters.rank.get(spelling)
                if rank:
                    words.append((j, log2(rank + 1) + extra + (min(cased, j - i - cased) + 1 if cased else 0)))
                    break
        repeats = []
        for size in (1, 2, 3, 4):  # a repeated unit
            unit, j = value[i : i + size], i + size
            while len(unit) == size and j - i < LONGEST and value.startswith(unit, j):
                j += size
                repeats.append((j, sum(map(char_bits, unit)) + log2((j - i) // size)))
        walks, j, turns, last = [], i + 1, 0, None
        while j < n and j - i < LONGEST and low[j] in near.get(low[j - 1], ()):
            way = direction(low[j - 1], low[j])
            turns += way != last
            last, j = way, j + 1
            if j - i >= 3:  # where it starts, which way it goes at each turn, how long it is
                walks.append((j, log2(len(near)) + 3.0 * turns + log2(j - i)))
        here = best[i]
        go_on = min(here + NEW_SEGMENT, single[i]) + char_bits(value[i]) + (0.5 if value[i].isupper() else 0)
        if go_on < single[i + 1]:
            single[i + 1] = go_on
        for j, bits in dates + words + repeats + walks:
            best[j] = min(best[j], here + NEW_SEGMENT + bits)
        best[i + 1] = min(best[i + 1], single[i + 1])
        if i >= REACH and min(best[i + 2 - REACH : i + 2]) >= enough:
            return enough
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the three patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_reference(value: str, vocabulary: str | None = None) -> bool:
    """Whether a value is an expression that names where the secret is: a call or an index behind names without digits, closed again,
    or cheap words joined by dots."""
    m, plain = REFERENCE.match(value), value.rstrip(";,")
    if not m:
        return False
    if m.group(2):
        # A value ends before a quote, so behind the bracket there may be nothing.
        closed = len(value) == m.end() or plain.endswith(")" if m.group(2) == "(" else "]")
        return closed and not any(c.isdigit() for c in m.group(1))
    if "." not in m.group(1) or len(plain) != m.end():
        return False
    return all(guess_bits(p, REFERENCE_PART_BITS, vocabulary) < REFERENCE_PART_BITS for p in re.split(r"[._$]+", m.group(1)) if p)


def guess_spans(
    text: str, known: list[tuple[int, int, int]], min_bits: float = MIN_BITS, vocabulary: str | None = None
) -> list[tuple[int, int, int]]:
    """Costly values of credentials that no span in ``known`` (sorted) touches."""
    found = []
    starts, ends = [s for s, _, _ in known], list(accumulate((e for _, _, e in known), max))
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        before = bisect_left(starts, b)
        if before and ends[before - 1] > a:
            continue
        if guess_bits(m.group(1), min_bits, vocabulary) >= min_bits and not is_reference(m.group(1), vocabulary):
            found.append((a, 3, b))
    return found


def bits_of(text: str, spans: list[tuple[int, int, int]], min_bits: float = MIN_BITS, vocabulary: str | None = None) -> str:
    """kind:start:bits of every credential value among the spans: its guess cost, or ``min_bits`` where it is at least that."""
    shown = []
    for start, kind, end in spans:
        if kind in (0, 3):
            value = ASSIGN.match(text, start, end).group(2) if kind == 0 else text[start:end]
            shown.append(f"{KINDS[kind]}:{start}:{min(guess_bits(value, min_bits, vocabulary), min_bits):.1f}")
    return ",".join(shown)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by the kind that begins it."""
    parts, at, upto = [], 0, 0
    for start, kind, end in spans:
        if start >= upto:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        upto = max(upto, end)
        at = upto
    return "".join([*parts, text[at:]])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = (
    "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base string, spans string, bits string, redacted string"
)
TYPES = [*[pa.int64()] * 4, *[pa.string()] * 4]
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def scan(docs: DataFrame, min_bits: float = MIN_BITS, vocabulary: str | None = None) -> DataFrame:
    """Every row of ``docs`` as ``doc``, and the secrets in its text.

    ``base`` (the three patterns) and ``spans`` (all) list kind:start:end in code points, by start, then kind;
    ``bits`` has the guess cost of every credential value, those inside base spans too; ``redacted`` is the text without the secrets, null if
    there are none. A null text is empty. Every row is scanned, also if it repeats; an empty table gives no rows. Time grows
    with the length of a text, whatever runs it holds. ``vocabulary`` names a file of the tokenizers library that every executor can read
    (the public one by default): its words are cheap by their rank, and give letters their costs.
    """
    vocabulary = vocabulary or default_vocabulary()

    def step(batches: Batches) -> Batches:
        for whole in batches:
            for rows in chunks_of(whole.num_rows, 2048):
                batch = whole.slice(rows.start, rows.stop - rows.start)
                found = [_scanned(text or "", min_bits, vocabulary) for text in batch.column(1).to_pylist()]
                columns = zip(*found) if found else [[] for _ in TYPES]
                arrays = [pa.array(c, t) for c, t in zip(columns, TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc", *NAMES])

    return over_batches(as_records(docs), step, with_record(docs, SCHEMA))


def _scanned(text: str, min_bits: float, vocabulary: str | None = None) -> tuple:
    base = base_spans(text)
    spans = sorted(base + guess_spans(text, base, min_bits, vocabulary))
    counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
    return *counts, written(base), written(spans), bits_of(text, spans, min_bits, vocabulary), redact(text, spans) if spans else None


def mask(docs: DataFrame, min_bits: float = MIN_BITS, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind; ``n_chars``, if there is one, follows. Null and empty texts stay."""
    return documents_from(scan(docs, min_bits, vocabulary), docs.columns, F.col("redacted"), F.col("redacted").isNotNull())
