"""Boosted regression on a dataset: pipeline, early stopping on the validation split, grids and backtests.

The trees are Spark's own. A weight file of another library cannot be matched;
what is kept is the course: categories as strings with a value for missing,
early stopping, log-ratio targets, folds and blends.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.functions.money import from_log_ratio
from cubelark.operators import metrics as M
from cubelark.sources import sinks

MISSING = "__MISSING__"
DEFAULTS = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "seed": 42}


def prepared(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}, **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}})


def fit(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], split: str = "split", **params: float) -> PipelineModel:
    """ML-08: rows of the splits train and validation; iterations end when the validation error stops falling."""
    rows = prepared(df.where(F.col(split).isin("train", "validation") & F.col(target).isNotNull()), numeric, categorical).withColumn("_validation", F.col(split) == "validation").persist()  # the stages read it again and again
    indexers = [StringIndexer(inputCol=c, outputCol=f"_{c}_index", handleInvalid="keep") for c in categorical]
    assembler = VectorAssembler(inputCols=[*numeric, *[f"_{c}_index" for c in categorical]], outputCol="_features")
    trees = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="_prediction", validationIndicatorCol="_validation", maxBins=256, **(DEFAULTS | params))
    try:
        return Pipeline(stages=[*indexers, assembler, trees]).fit(rows)
    finally:
        rows.unpersist()


def predict(model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], baseline: str | None = None, name: str = "prediction") -> DataFrame:
    """ML-09: with a baseline the prediction is a log ratio to it."""
    keys = [c for c in df.columns if c not in numeric and c not in categorical]
    wide = df.withColumns({f"_keep_{c}": F.col(c) for c in [*numeric, *categorical]})
    out = model.transform(prepared(wide, numeric, categorical))
    value = F.col("_prediction") if baseline is None else from_log_ratio(F.col("_prediction"), F.col(f"_keep_{baseline}") if baseline in numeric else F.col(baseline))
    return out.select(*keys, *[F.col(f"_keep_{c}").alias(c) for c in [*numeric, *categorical]], value.alias(name))


def importances(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, float]]:
    """ML-13."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip([*numeric, *categorical], map(float, values), strict=True), key=lambda x: -x[1])


def grid_search(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], grid: dict[str, Iterable[float]]) -> list[dict]:
    """ML-10: candidates by the error on the validation split, best first, ties by the absolute error."""
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        found = predict(fit(df, target, numeric, categorical, **params), df.where("split = 'validation'"), numeric, categorical)
        score = M.evaluate(found, target, "prediction").first()
        out.append(params | {"mape": score["mape"], "mae": score["mae"]})
    return sorted(out, key=lambda r: (r["mape"], r["mae"]))


def fold_predictions(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], order: str, periods: Sequence[int], **params: float) -> DataFrame:
    """ML-12: a model for each fold; the test rows of all folds with their predictions."""
    parts = []
    for p in periods:
        rows = df.where(F.col(order) <= p).withColumn("split", F.when(F.col(order) == p, "test").when(F.col(order) == p - 1, "validation").otherwise("train"))
        parts.append(predict(fit(rows, target, numeric, categorical, **params), rows.where("split = 'test'"), numeric, categorical).withColumn("fold", F.lit(int(p))))


    return reduce(lambda a, b: a.unionByName(b), parts)


def backtest(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], order: str, periods: Sequence[int], **params: float) -> DataFrame:
    """ML-12: the folds' scorecards, in one job after the fits."""
    return M.evaluate(fold_predictions(df, target, numeric, categorical, order, periods, **params), target, "prediction", ["fold"])


def backtest_search(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], order: str, periods: Sequence[int], grid: dict[str, Iterable[float]], baseline: str) -> DataFrame:
    """ML-11: candidates by their folds: the smallest mean error first, then the smallest worst error, then the largest share of folds better than the baseline.

    A row for each candidate; the fits run one after another, the scorecards of a candidate in one job.
    """
    names, parts = list(grid), []
    for k, values in enumerate(product(*grid.values())):
        found = fold_predictions(df, target, numeric, categorical, order, periods, **dict(zip(names, values, strict=True)))
        scored = M.compare(found, target, "prediction", baseline, ["fold"])
        parts.append(M.fold_summary(scored.withColumnRenamed("model_mape", "mape").select(F.lit(k).alias("candidate"), "fold", "mape", "baseline_mape"), ["candidate"], "fold", baseline="baseline_mape").select(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)], "*"))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("mean_mape", "worst_mape", F.desc("better_share"), "candidate")


def save_artefacts(model: PipelineModel, spark: SparkSession, path: str, numeric: Sequence[str], categorical: Sequence[str], params: dict[str, float]) -> None:
    """SNK-06: the model, its parameters as a document and the importances as a table, under one folder."""
    model.write().overwrite().save(f"{path}/model")
    sinks.write_json(DEFAULTS | params | {"numeric": list(numeric), "categorical": list(categorical)}, f"{path}/params.json")
    sinks.write_metrics(spark.createDataFrame(importances(model, numeric, categorical), "feature string, importance double"), f"{path}/importances")


def time_series_splits(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """ML-14: folds of consecutive periods, each tested after all before it."""


    periods = df.select(order).distinct().withColumn("fold", F.ntile(n + 1).over(Window.orderBy(order)) - 1)  # the periods are few
    return df.join(F.broadcast(periods), order)


def setup(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, list[str]]:
    """ML-06: which of the features there are; metadata only."""
    have = set(df.columns)
    return {"numeric": [c for c in numeric if c in have], "categorical": [c for c in categorical if c in have], "missing": [c for c in [*numeric, *categorical] if c not in have]}
