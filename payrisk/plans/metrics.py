"""Exact evaluation of scored transactions (label 0/1, score, decision 0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.operators.running import prior_totals
from payrisk.operators.skew import MAX_GROUP_ROWS
from payrisk.session import store


def decide(scored: DataFrame, threshold: float = 0.5, score: str = "score", output: str = "predicted") -> DataFrame:
    """1 at or above the threshold."""
    return scored.withColumn(output, F.when(F.col(score) >= threshold, 1).otherwise(0))


def _cell(label: str, predicted: str, actual: int, decision: int) -> Column:
    return F.count_if((F.col(label) == actual) & (F.col(predicted) == decision))


def confusion_matrix(scored: DataFrame, label: str = "is_fraud", predicted: str = "predicted") -> DataFrame:
    """Four rows (actual, predicted, transactions); cells without rows count 0."""
    cells = [
        F.struct(
            F.lit(actual).alias("actual"),
            F.lit(decision).alias("predicted"),
            _cell(label, predicted, actual, decision).alias("transactions"),
        )
        for actual in (0, 1)
        for decision in (0, 1)
    ]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).orderBy("actual", "predicted")


def _share(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(
    scored: DataFrame, label: str = "is_fraud", predicted: str = "predicted", digits: int = 4
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both means."""
    cells = {f"n{a}{d}": _cell(label, predicted, a, d) for a in (0, 1) for d in (0, 1)}
    counted = scored.agg(*[cell.alias(name) for name, cell in cells.items()])
    n = {name: F.col(name) for name in cells}
    for k in (0, 1):
        right, claimed, actual = n[f"n{k}{k}"], n[f"n0{k}"] + n[f"n1{k}"], n[f"n{k}0"] + n[f"n{k}1"]
        counted = counted.withColumns({
            f"precision{k}": _share(right, claimed),
            f"recall{k}": _share(right, actual),
            f"f1_score{k}": _share(2 * right, claimed + actual),
            f"support{k}": actual,
        })
    support = F.col("support0") + F.col("support1")
    accuracy = _share(n["n00"] + n["n11"], support)
    scores = ("precision", "recall", "f1_score")

    def row(name: str, precision: Column, recall: Column, f1: Column, of: Column) -> Column:
        values = zip(scores, (precision, recall, f1))
        rounded = [F.round(value.cast("double"), digits).alias(score) for score, value in values]
        return F.struct(F.lit(name).alias("class"), *rounded, of.alias("support"))

    def mean(score: str, weighted: bool) -> Column:
        zero, one = F.col(f"{score}0"), F.col(f"{score}1")
        if weighted:
            return _share(zero * F.col("support0") + one * F.col("support1"), support)
        return (zero + one) / 2

    none = F.lit(None)
    report = [row(str(k), *[F.col(f"{s}{k}") for s in scores], F.col(f"support{k}")) for k in (0, 1)]
    report.append(row("accuracy", none, none, accuracy, support))
    report.append(row("macro avg", *[mean(s, False) for s in scores], support))
    report.append(row("weighted avg", *[mean(s, True) for s in scores], support))
    return counted.select(F.inline(F.array(*report)))


def ranking_scores(
    scored: DataFrame, label: str = "is_fraud", score: str = "score", *, max_block_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One row: average precision and area under the ROC curve, exactly.

    Equal scores are one step of the curve, so rows are first counted per score.
    The totals above each score then run over blocks of scores. Average precision
    is NULL without any row, 0 without positives; the area is NULL unless both
    classes occur.
    """
    steps = scored.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("bigint").alias("p")
    )
    n_steps = scored.count()
    if n_steps > max_block_rows:
        steps = store(steps, "scores")
        n_steps = steps.count()
    curve = prior_totals(
        steps, [], ["score"], ["n", "p"], n_steps, 1, descending=True, rows_per_block=max_block_rows
    ).select("n", "p", (F.col("prior_n") + F.col("n")).alias("above"), (F.col("prior_p") + F.col("p")).alias("hits"))

    p, n = F.col("p").cast("double"), F.col("n")
    positives, rows = F.sum("p"), F.sum("n")
    # Each negative at this score is beaten by all positives above it and ties with its own.
    beaten = F.sum((n - p) * (F.col("hits") - p / 2))
    return curve.agg(
        F.when(positives > 0, F.sum(p * F.col("hits") / F.col("above")) / positives)
        .when(rows > 0, F.lit(0.0))
        .alias("average_precision"),
        F.when(
            (positives > 0) & (rows > positives), beaten / (positives.cast("double") * (rows - positives))
        ).alias("roc_auc"),
    )
