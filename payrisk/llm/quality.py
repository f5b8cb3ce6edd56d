"""Quality rules learned from labelled documents, as ordered conditions that Spark evaluates.

Documents are measured with built-in functions only. From the measures of labelled
documents a decision list is learned by sequential covering: a rule grows, threshold
by threshold, on one part of the rows until it covers no good document, loses
conditions again as long as that helps on the other part, and is added if it is
precise enough there; the rows that it covers are set aside and the next rule is learned.
A document is rejected by the first rule that covers it, and kept if none does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import as_records

# What separates words, and what counts as a symbol.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MARKS, DIGITS = "!?", "0123456789"

# At most so many labelled documents are learned from, those with the least hash of their id.
MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, MAX_CUTS = 24, 4, 64
MIN_PRECISION, MIN_COVERED = 0.95, 5

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "distinct_share", "repeat_share",
    "dup_line_share",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.cut if self.at_least else value < self.cut

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        value = rows[self.feature]
        return value >= self.cut if self.at_least else value < self.cut


Rule = tuple[Condition, ...]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count_in(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def measure(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with the measures of its text and the features of the rules.

    A null or empty text has no words, and 0 in everything. Words are compared as they are;
    the three-word windows of one text by a 64-bit hash.
    """
    text = F.col("text")
    rows = as_records(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("marked", F.regexp_replace(text, rf"[^{SYMBOLS}{MARKS}{DIGITS}\p{{Lu}}]+", ""))
    marked = F.col("marked")
    rows = rows.select(
        "doc",
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(SPACE)) != "").alias("lines"),
        _count_in(marked, SYMBOLS).cast("bigint").alias("n_symbols"),
        _count_in(marked, MARKS).alias("marks"),
        _count_in(marked, DIGITS).alias("digits"),
        F.length(_without(marked, SYMBOLS + MARKS + DIGITS)).alias("uppers"),
    )
    words, lines = F.col("words"), F.col("lines")
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    rows = rows.select(
        "doc", "n_symbols", "marks", "digits", "uppers",
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.size(words).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    hashes = F.col("hashes")
    # Only a text with equal windows needs their order.
    windows = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))),
    )
    rows = rows.withColumn("windows", windows).drop("hashes")
    windows = F.col("windows")
    # Equal windows are neighbours now.
    repeated = F.filter(
        windows,
        lambda w, i: (w["hash"] == F.get(windows, i - 1)["hash"]) | (w["hash"] == F.get(windows, i + 1)["hash"]),
    )
    rows = rows.withColumn("starts", F.sort_array(F.transform(repeated, lambda w: w["at"]))).drop("windows")
    starts = F.col("starts")
    # A repeated window covers its three words as far as the next one does not.
    covered = F.transform(starts, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    # A generator of one row: conditions on its columns are not pushed below it, where each would be evaluated
    # anew for every element of the arrays.
    return rows.select(
        "doc",
        F.inline_outer(
            F.array(
                F.struct(
                    *MEASURES,
                    F.col("n_words").cast("double").alias("words"),
                    share("word_chars", "n_words").alias("word_length"),
                    share("n_symbols", "word_chars").alias("symbol_share"),
                    share("marks", "word_chars").alias("mark_share"),
                    share("uppers", "word_chars").alias("upper_share"),
                    share("digits", "word_chars").alias("digit_share"),
                    share("distinct", "n_words").alias("distinct_share"),
                    share("n_repeat_words", "n_words").alias("repeat_share"),
                    share("n_dup_lines", "n_lines").alias("dup_line_share"),
                )
            )
        ),
    )


def base_failed() -> Column:
    too_repetitive = F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | too_repetitive


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, np.ndarray]:
    """Features of labelled documents that pass the base rules, whether they are bad, and a fold.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows without either are left out. At most ``max_labelled``
    labels are used: this bounds what is sent to the documents and what comes to the driver. Repeated rows count once.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).dropna()
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "_quality").limit(max_labelled)
    texts = docs.select(F.col("doc_id"), F.col("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    fold = F.pmod(F.xxhash64("doc.doc_id", F.lit("fold")), F.lit(3)).alias("fold")
    found = (
        measure(joined)
        .where(~base_failed())
        .select(*FEATURES, (F.col("doc._quality") == 0).alias("bad"), fold, F.col("doc.doc_id").alias("id"))
        .distinct()
        .collect()
    )
    found.sort(key=lambda r: tuple(map(str, r)))
    rows = {name: np.array([r[name] for r in found], float) for name in FEATURES}
    return rows | {name: np.array([r[name] for r in found], bool) for name in ("bad",)} | {
        "grow": np.array([r["fold"] != 0 for r in found], bool)
    }


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained about bad rows: those kept, times the bits saved on each."""
    before = log2(p0 / (p0 + n0))
    with np.errstate(divide="ignore", invalid="ignore"):
        after = np.log2(p / (p + n))
    return np.where(p > 0, p * (after - before), -np.inf)


def _best_condition(rows: dict[str, np.ndarray], bad: np.ndarray, covered: np.ndarray) -> Condition | None:
    p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
    best, found = 1e-9, None
    for feature in FEATURES:
        values, own = rows[feature][covered], bad[covered]
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, MAX_CUTS + 1)[1:], method="nearest"))
        middle = np.unique(values)
        place = np.searchsorted(middle, cuts)
        cuts = np.unique((middle[np.maximum(place - 1, 0)] + middle[place]) / 2)  # between two values that occur
        bad_below = np.searchsorted(np.sort(values[own]), cuts)
        good_below = np.searchsorted(np.sort(values[~own]), cuts)
        for at_least, p, n in ((True, p0 - bad_below, n0 - good_below), (False, bad_below, good_below)):
            gains = _gain(p, n, p0, n0)
            k = int(np.argmax(gains))
            if gains[k] > best:
                best, found = gains[k], Condition(feature, at_least, float(cuts[k]))
    return found


def _cover(rule: Rule, rows: dict[str, np.ndarray], among: np.ndarray) -> np.ndarray:
    return reduce(lambda mask, c: mask & c.covers(rows), rule, among)


def _worth(rule: Rule, rows: dict[str, np.ndarray], among: np.ndarray) -> float:
    covered = _cover(rule, rows, among)
    p = int((covered & rows["bad"]).sum())
    return (2 * p - int(covered.sum())) / max(1, int(covered.sum()))


def learn_list(rows: dict[str, np.ndarray], min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules for bad rows, in order. Without rows of both kinds there are none; ties go to the first feature and cut."""
    bad, left = rows["bad"], np.ones(len(rows["bad"]), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = left & rows["grow"], left & ~rows["grow"]
        covered, rule = grow, ()
        if not (covered & bad).any():
            break
        while len(rule) < MAX_CONDITIONS and (covered & ~bad).any():
            condition = _best_condition(rows, bad, covered)
            if condition is None:
                break
            rule += (condition,)
            covered = covered & condition.covers(rows)
        while len(rule) > 1 and _worth(rule[:-1], rows, prune) >= _worth(rule, rows, prune):
            rule = rule[:-1]
        covered = _cover(rule, rows, left)
        p, held = int((covered & bad).sum()), _cover(rule, rows, prune)
        precise = p >= min_precision * covered.sum() and (held & bad).sum() >= min_precision * held.sum()
        if not rule or p < MIN_COVERED or not precise:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    return learn_list(labelled_rows(docs, labels, max_labelled))


def rejecting_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a document, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    conditions = [reduce(Column.__and__, (c.column() for c in rule)) for rule in rules]
    chain = F.when(conditions[0], 1)
    for number, condition in enumerate(conditions[1:], 2):
        chain = chain.when(condition, number)
    return chain


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.at_least else '<'} {c.cut:g}" for c in rule) for rule in rules]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with measures, base_failed, the rejecting rule, and kept."""
    return measure(docs).withColumns(
        {"base_failed": base_failed(), "rule": rejecting_rule(rules)}
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and that no learned rule rejects, unchanged."""
    kept = judge(docs, rules).where("kept")
    return kept.select(*[F.col(f"doc.`{name}`") for name in docs.columns])
