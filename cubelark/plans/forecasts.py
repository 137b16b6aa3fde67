"""Training, backtests and searches: log-ratio residuals over seasonal baselines, strategies chosen on earlier folds, findings about a fold."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_mean, rounded
from cubelark.functions.money import from_log_ratio, log_ratio
from cubelark.operators import metrics as M
from cubelark.operators.encoding import ordered_target
from cubelark.plans import boosting as B
from cubelark.plans.queries import FOLDS, Query, observed, predicted
from cubelark.plans.star import SEGMENT, records
from cubelark.session import stored

FORECASTS: dict[str, Query] = {}
ROWS: dict[str, Query] = {}
NUMERIC = ("median_salary_mid", "mean_salary_mid", "vacancy_count", "salary_count", "remote_share", "full_time_share", "data_quality_score", "gap_to")
CATEGORIES = {"region_value": ["region"], "occupation_value": ["occupation_group"], "segment_value": list(SEGMENT)}
#: Names of the residual strategies.
STAGES = ("baseline", "seasonal", "residual")


def query(f: Query) -> Query:
    FORECASTS[f.__name__] = f
    return f


def rows_only(f: Query) -> Query:
    ROWS[f.__name__] = f
    return f


def with_seasonal_baseline(df: DataFrame, seasonal: Sequence[str], target: str, value: str, order: str, gap: str, weight: float = 5.0) -> DataFrame:
    """First stage of ML-09: ``log_delta`` (target over value), ``seasonal_delta`` (its mean over rows of the season whose targets are known by then) and ``seasonal`` (value moved by it).

    A row's target is known ``gap`` periods after its own, so no fold sees
    anything of its validation or test periods, without a fit for each.
    """
    rows = df.withColumn("log_delta", rounded(log_ratio(F.col(target), F.col(value)), 6))
    told = ordered_target(rows, {"seasonal_delta": seasonal}, "log_delta", order, F.col(order) + F.col(gap), weight)
    return told.withColumn("seasonal", rounded(from_log_ratio(F.coalesce("seasonal_delta", F.lit(0.0)), F.col(value)), 4))


def strategy_by_earlier_folds(folds: DataFrame, options: DataFrame, fold: str = "fold", metric: str = "mape") -> DataFrame:
    """For each of ``folds`` the strategy with the smallest mean metric over all earlier folds, ties by name, null where there is none; with its metric then and on the fold itself.

    ``options`` has a row for each fold and strategy, so both are few.
    """
    a, b = folds.select(fold).distinct().alias("a"), options.alias("b")
    earlier = a.join(b, F.col(f"b.{fold}") < F.col(f"a.{fold}"), "left").groupBy(F.col(f"a.{fold}").alias(fold), F.col("b.strategy").alias("strategy")).agg(rounded(exact_mean(F.col(f"b.{metric}")), 4).alias(f"earlier_{metric}"))
    first = F.row_number().over(Window.partitionBy(fold).orderBy(F.asc_nulls_last(f"earlier_{metric}"), "strategy"))
    chosen = earlier.withColumn("_k", first).where("_k = 1").drop("_k")
    return chosen.join(options.select(fold, "strategy", F.col(metric).alias(f"fold_{metric}")), [fold, "strategy"], "left")


def candidates(grid: dict[str, Iterable[float]]) -> list[B.Candidate]:
    """All combinations of depth, rate and l2."""
    return [B.Candidate(**dict(zip(grid, v, strict=True))) for v in product(*grid.values())]


def searched(scores: DataFrame, grid: dict[str, Iterable[float]]) -> DataFrame:
    """ML-11: stored scores (candidate, stage, fold, mape, baseline_mape) ranked: the smallest mean first, then the smallest worst fold, then the largest share of folds better than the baseline."""
    spark = scores.sparkSession
    named = spark.createDataFrame([(k, int(c.depth), float(c.rate), float(c.l2)) for k, c in enumerate(candidates(grid))], "candidate int, depth int, rate double, l2 double")
    summary = M.fold_summary(scores, ["candidate", "stage"], "fold", baseline="baseline_mape")
    return named.join(summary, "candidate").withColumnRenamed("stage", "iterations").orderBy("mean_mape", "worst_mape", F.desc("better_share"), "candidate", "iterations")


def backtest_scores(df: DataFrame, target: str, baseline: str, order: str, gap: str | None, folds: Sequence[int], grid: dict[str, Iterable[float]], stages: Sequence[int], residual: bool = False, numeric: Sequence[str] = NUMERIC, categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(candidate, stage, fold, trees, row_count, mape, baseline_mape, better_rows): all candidates and stages on all folds, from one matrix and ``max(stages) * max(depth)`` jobs of fits.

    With ``residual`` the trees learn the log ratio of the target to the baseline, else the target itself. A target is known ``gap`` periods after its row's own, without such a column one.
    """
    rows = df.withColumn("_target", rounded(log_ratio(F.col(target), F.col(baseline)), 6) if residual else F.col(target).cast("double")).where(F.col("_target").isNotNull())
    carry = ["_actual", "_baseline"]
    kept = rows.withColumns({"_actual": F.col(target).cast("double"), "_baseline": F.col(baseline).cast("double")})
    data = B.matrix(kept, "_target", numeric, CATEGORIES if categories is None else categories, order, min(folds), carry, F.col(order) + (F.col(gap) if gap else 1))
    fits = B.fit_many(data, folds, candidates(grid), max(stages))
    found = B.predict_many(data, fits, stages, carry)
    value = from_log_ratio(F.col("prediction"), F.col("_baseline")) if residual else F.col("prediction")
    scored = M.compare(found.withColumn("value", value), "_actual", "value", "_baseline", ["candidate", "stage", "fold", "trees"])
    return scored.withColumnRenamed("model_mape", "mape").drop("mape_delta")


def supervised(spark: SparkSession, d: str) -> DataFrame:
    return stored(observed(spark, d).where("target IS NOT NULL AND median_salary_mid IS NOT NULL"), "observed")


def seasonal_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(observed(spark, d).where("target IS NOT NULL AND median_salary_mid > 0"), "observed").withColumn("season", F.col("month_idx") % 12)
    return with_seasonal_baseline(rows, ["source_dataset", "season"], "target", "median_salary_mid", "month_idx", "gap_to")


@query
def ordered_targets(spark, d):
    """ML-08: categories as ordered target statistics."""
    rows = stored(observed(spark, d).where("target IS NOT NULL"), "observed")
    return ordered_target(rows, CATEGORIES, "target", "month_idx", F.col("month_idx") + F.col("gap_to")).select(*SEGMENT, "month_idx", *CATEGORIES)


@query
def seasonal_folds(spark, d):
    """ML-09, first stage: scorecards of the seasonal and the naive baseline by fold and role."""
    rows = M.expanding_folds(seasonal_rows(spark, d), "month_idx", FOLDS)
    return M.evaluate_strategies(rows, "target", {"baseline": F.col("median_salary_mid"), "seasonal": F.col("seasonal")}, ["fold", "role"])


@query
def strategy_choice(spark, d):
    """ML-09: blends of the seasonal and the naive baseline, chosen for each fold on the folds before it."""
    test = M.expanding_folds(seasonal_rows(spark, d), "month_idx", FOLDS).where("role = 'test'")
    scored = M.evaluate_strategies(test, "target", M.strategies(F.col("seasonal"), F.col("median_salary_mid")), ["fold"]).select("fold", "strategy", "mape")
    return strategy_by_earlier_folds(scored, scored)


@rows_only
def residual_backtest(spark, d):
    """ML-09: trees on what the seasonal baseline leaves of the log ratio, by fold: the three stages, their blends, and the blend chosen on earlier folds."""
    rows = seasonal_rows(spark, d).withColumns({"rest": rounded(F.col("log_delta") - F.coalesce("seasonal_delta", F.lit(0.0)), 6)})
    carry = ["target", "median_salary_mid", "seasonal"]
    data = B.matrix(rows, "rest", NUMERIC, CATEGORIES, "month_idx", min(FOLDS), carry, F.col("month_idx") + F.col("gap_to"))
    fits = B.fit_many(data, FOLDS, [B.Candidate(4, 0.1, 10.0)], 12)
    found = B.predict_many(data, fits, [12], carry).withColumn("residual", from_log_ratio(F.col("prediction"), F.col("seasonal")))
    options = M.strategies(F.col("residual"), F.col("median_salary_mid")) | {"seasonal": F.col("seasonal")}
    scored = M.evaluate_strategies(found, "target", options, ["fold"])
    chosen = strategy_by_earlier_folds(scored, scored).select("fold", F.col("strategy").alias("chosen_before"))
    return scored.join(chosen, "fold").withColumn("is_chosen", F.coalesce(F.col("strategy") == F.col("chosen_before"), F.lit(False))).drop("chosen_before")


#: The axes of the two searches; iterations are stages, a hundredth of the reference course's numbers.
BACKTEST_GRID, BACKTEST_STAGES = {"depth": (4, 6, 8), "rate": (0.3, 0.5), "l2": (10.0, 25.0, 50.0, 100.0)}, (5, 10)
VALIDATION_GRID, VALIDATION_STAGES = {"depth": (4, 6, 8), "rate": (0.1, 0.3, 0.5), "l2": (3.0, 10.0, 25.0, 50.0)}, (4, 8, 12)


@rows_only
def backtest_search(spark, d):
    """ML-11: 48 candidates on five folds, ranked by their folds."""
    scores = backtest_scores(supervised(spark, d), "target", "median_salary_mid", "month_idx", "gap_to", FOLDS, BACKTEST_GRID, BACKTEST_STAGES)
    return searched(scores, BACKTEST_GRID)


@rows_only
def grid_search(spark, d):
    """ML-10: 108 candidates on the validation period, which is a fold's test here; the one before it stops the fits early."""
    rows = M.time_split(supervised(spark, d), "month_idx").where("split <> 'test'")
    period = rows.agg(F.max("month_idx")).first()[0]
    if period is None:
        return searched(spark.createDataFrame([], "candidate int, stage int, fold long, mape double, baseline_mape double"), VALIDATION_GRID)
    scores = backtest_scores(rows, "target", "median_salary_mid", "month_idx", "gap_to", [period], VALIDATION_GRID, VALIDATION_STAGES)
    return searched(scores, VALIDATION_GRID)


FINDING_SETS = (("source_dataset",), ("region",), ("occupation_group",), SEGMENT, ("gap_to",))


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).where(F.col("month_idx") == FOLDS[-1])


@query
def fold_group_errors(spark, d):
    """EVAL-06 over grouping sets: where a fold's error comes from."""
    return M.group_error_sets(fold_rows(spark, d), "target", "model", "median_salary_mid", FINDING_SETS)


@query
def fold_findings(spark, d):
    """EVAL-10: the three findings about a fold, with their sentences."""
    rows = fold_rows(spark, d)
    return M.findings(rows, M.group_error_sets(rows, "target", "model", "median_salary_mid", FINDING_SETS), "target", "model", "median_salary_mid")


@query
def education_composition(spark, d):
    """H-02: the levels of each group with their shares within it."""
    g = records(spark, d).select(F.when(F.col("region").isin("ASIA", "EUROPE"), "A").otherwise("B").alias("grp"), F.col("experience_group").alias("level"))
    return M.composition(g, "grp", "level")


@query
def education_parts(spark, d):
    """H-02: how much of a difference in shares lies within the occupations and how much in their mix."""
    g = records(spark, d).select(F.when(F.col("region").isin("ASIA", "EUROPE"), "A").otherwise("B").alias("grp"), "occupation_group", (F.col("experience_group") == "1-URGENT").alias("high"))
    return M.difference_parts(g, "grp", "occupation_group", F.col("high"), "A", "B")
