"""Preparing the inputs, fitting the two classifiers, scoring and saving."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.functions import columns as c
from payrisk.operators.quantiles import DIRECT_VALUES, exact_quantiles
from payrisk.plans.metrics import decide, ranking_scores
from payrisk.schemas import MODEL_FEATURES
from payrisk.session import scratch_folder, store

# Settings of the two models.
SEED = 42
FRAUD_WEIGHT = 40.0
THRESHOLD = 0.50
LINEAR_PASSES = 1000
LINEAR_PENALTY = 1e-4
BOOST_RATE = 0.08
BOOST_ROUNDS = 200
BOOST_DEPTH = 5  # at most 32 leaves
BOOST_BINS = 255
MIN_LEAF_ROWS = 20
STOP_TOLERANCE = 1e-7


def column_medians(train: DataFrame, features: list[str] = MODEL_FEATURES, *, direct_values: int = DIRECT_VALUES):
    """One row with the exact median of each feature."""
    return exact_quantiles(train.select(*features), {f: (f, 0.5) for f in features}, direct_values=direct_values)


def fill_values(train: DataFrame, features: list[str] = MODEL_FEATURES) -> dict[str, float]:
    """Median per feature as plain numbers; a feature with no values at all gets 0."""
    row = column_medians(train, features).first()
    return {f: 0.0 if row[f] is None else row[f] for f in features}


def fill_missing(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in fills.items()})


@dataclass(frozen=True)
class Scaling:
    mean: float
    deviation: float


def scaling_values(filled: DataFrame, features: list[str] = MODEL_FEATURES) -> dict[str, Scaling]:
    """Mean and population deviation per feature, from one aggregate row."""
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
    deviations = [F.stddev_pop(f).alias(f"d{i}") for i, f in enumerate(features)]
    row = filled.agg(*means, *deviations).first()
    return {f: Scaling(row[f"m{i}"], row[f"d{i}"]) for i, f in enumerate(features)}


def scale(df: DataFrame, scaling: dict[str, Scaling]) -> DataFrame:
    """Centre and divide; a feature that never varies becomes 0."""
    return df.withColumns({
        f: (F.col(f) - s.mean) / s.deviation if s.deviation else F.lit(0.0) for f, s in scaling.items()
    })


def balanced_class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(label)).alias("classes")).first()
    share = F.lit(float(total["rows"])) / (F.lit(total["classes"]) * F.col("n"))
    return counts.select(label, share.alias("weight"))


def with_balanced_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Adds ``weight`` for a label of 0 and 1, from one row of counts; another label has none."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero")).first()
    classes = (n["one"] > 0) + (n["zero"] > 0)
    weight = {k: (n["one"] + n["zero"]) / (classes * c) if c else 0.0 for k, c in ((1, n["one"]), (0, n["zero"]))}
    return df.withColumn("weight", F.when(F.col(label) == 1, weight[1]).when(F.col(label) == 0, weight[0]))


def with_fraud_weight(df: DataFrame, label: str = "is_fraud", fraud_weight: float = FRAUD_WEIGHT) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, fraud_weight).otherwise(1.0))


def _prepare(fills: dict[str, float], scaling: dict[str, Scaling] | None = None) -> list:
    """Pipeline stages that hold the fill values, the scaling and the feature order."""

    def number(value: float) -> str:
        return f"double('{value!r}')"

    inputs = []
    for f, fill in fills.items():
        value = f"coalesce(double({f}), {number(fill)})"
        if scaling:
            s = scaling[f]
            value = f"({value} - {number(s.mean)}) / {number(s.deviation)}" if s.deviation else number(0.0)
        inputs.append(f"{value} AS in_{f}")
    statement = f"SELECT *, {', '.join(inputs)} FROM __THIS__"
    assembler = VectorAssembler(inputCols=[f"in_{f}" for f in fills], outputCol="features")
    return [SQLTransformer(statement=statement), assembler]


def fit_baseline(train: DataFrame, max_passes: int = LINEAR_PASSES) -> PipelineModel:
    """Filled, scaled, class-balanced logistic regression.

    The training rows are stored once; the solver reads them many times.
    """
    rows = with_balanced_weight(store(train, "baseline-train"))
    fills = fill_values(rows)
    stages = _prepare(fills, scaling_values(fill_missing(rows, fills)))
    classifier = LogisticRegression(
        labelCol="is_fraud", weightCol="weight", maxIter=max_passes, regParam=LINEAR_PENALTY,
        elasticNetParam=0.0, standardization=False,
    )
    return Pipeline(stages=[*stages, classifier]).fit(rows)


def fit_recent(
    train: DataFrame, rounds: int = BOOST_ROUNDS, *, held_out_percent: int = 0, tolerance: float = STOP_TOLERANCE
) -> PipelineModel:
    """Filled, fraud-weighted gradient-boosted trees.

    All rows are fitted in all rounds, however many rows there are. With ``held_out_percent`` that part of them, by a hash of
    the id, is kept from the fit and ends it at the first round that lowers its loss by less than ``tolerance``.
    """
    rows = with_fraud_weight(store(train, "recent-train"))
    scratch_folder(rows.sparkSession)  # the trees cut their lineage there
    classifier = GBTClassifier(
        labelCol="is_fraud", weightCol="weight", stepSize=BOOST_RATE, maxIter=rounds, maxDepth=BOOST_DEPTH,
        maxBins=BOOST_BINS, minInstancesPerNode=MIN_LEAF_ROWS, seed=SEED, checkpointInterval=10,
    )
    if held_out_percent:
        held_out = c.hash_bucket(F.concat(F.lit("stop"), F.col("transaction_id").cast("string"))) < held_out_percent
        rows = rows.withColumn("held_out", held_out)
        classifier = classifier.setParams(validationIndicatorCol="held_out", validationTol=tolerance)
    return Pipeline(stages=[*_prepare(fill_values(rows)), classifier]).fit(rows)


def score(model: PipelineModel, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(transaction_id, is_fraud, score, predicted) of each row."""
    fraud = vector_to_array("probability")[1].alias("score")
    return decide(model.transform(df).select("transaction_id", "is_fraud", fraud), threshold)


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: size of the scored set, outcome counts, and the exact ranking scores.

    The scores are stored first, so that the model is applied once.
    """
    kept = store(scored, "scored")
    fraud, flagged = F.col("is_fraud") == 1, F.col("predicted") == 1
    counts = kept.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(fraud).alias("fraud_transactions"),
        F.count_if(flagged).alias("flagged_transactions"),
        F.count_if(fraud & flagged).alias("fraud_caught"),
    ).first()
    shown = [F.lit(counts[name]).cast("bigint").alias(name) for name in counts.asDict()]
    ranked = ranking_scores(kept)
    return ranked.select(*shown, *[F.round(name, 4).alias(name) for name in ranked.columns])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
