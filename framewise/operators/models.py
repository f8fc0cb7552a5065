"""Scores from trained models, and their evaluation."""

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.points import over_threshold
from framewise.operators.bounce import FEATURES, SCORE_THRESHOLD, bounce_features, suppress_runs
from framewise.operators.chunks import CHUNK, KEYS, ORDER
from framewise.operators.folds import smooth_gaps
from framewise.operators.hits import lag_features
from framewise.sources.tables import stored

HIT_THRESHOLD = 0.8


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    """Each column twice, see `_known`. Every row gets its vector."""
    return VectorAssembler(inputCols=[n for c in cols for n in (f"_{c}", f"_{c}_known")], outputCol="features", handleInvalid="error")


def _known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For each column its value, 0 where it is missing, and whether it is there."""
    values = {f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    return df.withColumns(values | {f"_{c}_known": F.col(c).isNotNull().cast("double") for c in cols})


def _transform(model: PipelineModel, df: DataFrame, cols: Sequence[str], *result: str) -> DataFrame:
    """The rows of `df`, all of them, with columns of the model's result."""
    return model.transform(_known(df, cols)).select(*df.columns, *result)


def fit_bounce_model(
    features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, **params
) -> PipelineModel:
    """A boosted-tree regressor on the bounce features, from rows labelled 0 or 1."""
    settings = {"maxIter": 20, "maxDepth": 4, "seed": 7} | params
    gbt = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="score", **settings)
    return Pipeline(stages=[_assembler(FEATURES), gbt]).fit(_known(features.join(labels, [*keys, order]), FEATURES))


def score_features(features: DataFrame, scorer: PipelineModel | Column) -> DataFrame:
    """Add `score`, from a fitted model or from an expression on the features."""
    if isinstance(scorer, Column):
        return features.withColumn("score", scorer)
    return _transform(scorer, features, FEATURES, "score")


def score_frames(
    ball: DataFrame, scorer: PipelineModel | Column, smooth: bool = True, keys: Sequence[str] = KEYS, order: str = ORDER, size: int = CHUNK
) -> DataFrame:
    """(keys, order, _chunk, score) of every frame with bounce features, short gaps extrapolated first.

    Scores of a model are stored: what follows reads them several times, and each time all trees would be walked again.
    """
    track = smooth_gaps(ball, keys, order, size) if smooth else ball
    features = bounce_features(track, keys, order, size, keep_chunk=True)
    scored = score_features(features, scorer).select(*keys, order, "_chunk", "score")
    return scored if isinstance(scorer, Column) else stored(scored, "scores")


def predict_bounces(
    ball: DataFrame,
    scorer: PipelineModel | Column,
    smooth: bool = True,
    threshold: float = SCORE_THRESHOLD,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    size: int = CHUNK,
) -> DataFrame:
    """Bounce frames: extrapolate short gaps, build features, score, keep one frame per run.

    A row without a score is no candidate, but stays between its neighbours.
    """
    return suppress_runs(score_frames(ball, scorer, smooth, keys, order, size), threshold, keys=keys, order=order, size=size)


def hit_columns(reach: int = 3) -> list[str]:
    sides = [f"{c}_{side}_{n}" for c in "xy" for side in ("lag", "lead") for n in range(1, reach + 1)]
    return ["x", "y", *sides]


def fit_hit_model(
    ball: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, **params
) -> PipelineModel:
    """A boosted-tree classifier on the positions around a frame."""
    settings = {"maxIter": 20, "maxDepth": 4, "seed": 7} | params
    gbt = GBTClassifier(featuresCol="features", labelCol="label", **settings)
    rows = lag_features(ball, keys=keys, order=order).join(labels, [*keys, order])
    return Pipeline(stages=[_assembler(hit_columns()), gbt]).fit(_known(rows, hit_columns()))


def predict_hits(
    ball: DataFrame,
    model: PipelineModel,
    threshold: float | None = HIT_THRESHOLD,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    probability: str | None = None,
) -> DataFrame:
    """`hit` of every frame: 0 or 1 by the threshold on the class-1 probability, or the probability without one.

    With `probability` that one too, in a column of this name.
    """
    scored = _transform(model, lag_features(ball, keys=keys, order=order), hit_columns(), "probability")
    p = vector_to_array("probability")[1]
    return scored.select(*keys, order, *([p.alias(probability)] if probability else []), over_threshold(p, threshold).alias("hit"))


def confusion(predictions: DataFrame, labels: DataFrame, prediction: str, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Number of rows per label and prediction."""
    both = labels.join(predictions.select(*keys, order, prediction), [*keys, order], "left")
    guess = F.coalesce(F.col(prediction).cast("int"), F.lit(0)).alias("prediction")
    return both.groupBy("label", guess).agg(F.count(F.lit(1)).alias("n"))


def area_under_roc(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    """Exact: `numBins=0` keeps every distinct score; equal scores share their rank."""
    evaluator = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, numBins=0)
    return evaluator.evaluate(scored.withColumn(score, F.col(score).cast("double")))
