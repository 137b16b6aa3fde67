"""Queries that SQL cannot express: models. Their tests are in ``tests/test_model.py``."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.operators import metrics as M
from cubelark.operators.encoding import ordered_target
from cubelark.plans import model
from cubelark.plans.forecasts import CATEGORIES, NUMERIC
from cubelark.plans.queries import Query, observed
from cubelark.session import scratch, stored
from cubelark.sources import readers

ROWS_ONLY: dict[str, Query] = {}


def query(f: Query) -> Query:
    ROWS_ONLY[f.__name__] = f
    return f


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a target, their split and their categories as ordered target statistics."""
    seen = stored(observed(spark, d).where("target is not null and median_salary_mid is not null"), "observed")  # a row for each segment and month
    return stored(ordered_target(M.time_split(seen, "month_idx"), CATEGORIES, "target", "month_idx", F.col("month_idx") + F.col("gap_to")), "training")


@query
def gbt_forecast(spark: SparkSession, d: str) -> DataFrame:
    """ML-08: the model's scorecard by split; categories are ordered target statistics, so they may have any number of values."""
    rows = training_rows(spark, d)
    fitted = model.fit(rows, "target", [*NUMERIC, *CATEGORIES], [], maxIter=10, maxDepth=4)
    return M.evaluate(model.predict(fitted, rows, [*NUMERIC, *CATEGORIES], []), "target", "prediction", ["split"])


@query
def model_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06, ML-13: a model, its parameters and its importances go out as files; the stored model's scorecard, with the importances as stored.

    A row for each feature, the most important first.
    """
    rows, features, to = training_rows(spark, d), [*NUMERIC, *CATEGORIES], scratch(spark, "model")
    params = {"maxIter": 5, "maxDepth": 4}
    model.save_artefacts(model.fit(rows, "target", features, [], **params), spark, to, features, [], params)
    scored = M.evaluate(model.predict(PipelineModel.load(f"{to}/model"), rows.where("split = 'test'"), features, []).withColumn("all", F.lit(True)), "target", "prediction", ["all"])
    kept = readers.read_json(spark, f"{to}/params.json")
    table = readers.read_metrics(spark, f"{to}/importances").withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row for each feature
    return table.crossJoin(F.broadcast(scored.select("valid_row_count", "mape"))).withColumn("depth", F.lit(kept["maxDepth"])).orderBy("place")
