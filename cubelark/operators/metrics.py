"""Scorecards, strategies, folds and error slices: each is one aggregation over whatever keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_mean, exact_sum, quantile, ratio, rounded, whole_quantiles

ALPHAS = tuple(i / 10 for i in range(11))
LARGE_LOG_DELTA = 0.35
QUANTILES = (0.5, 0.75, 0.9)


def errors(actual: Column, predicted: Column) -> tuple[Column, Column, Column, Column]:
    """(value, error, percentage error, symmetric percentage error) of rows with both values."""
    valid = actual.isNotNull() & predicted.isNotNull()
    a, p = F.when(valid, actual.cast("double")), F.when(valid, predicted.cast("double"))
    e = p - a
    return a, e, 100.0 * ratio(F.abs(e), F.abs(a)), 200.0 * ratio(F.abs(e), F.abs(a) + F.abs(p))


def scorecard(actual: Column, predicted: Column, digits: int = 4, found: dict[str, list[float | None]] | None = None) -> list[Column]:
    """EVAL-01: only rows with both values count; ratios by zero are left out. ``found`` has the quantiles, where they are known already."""
    a, e, ape, sape = errors(actual, predicted)
    r = lambda c, n: rounded(c, digits).alias(n)

    def at(x: Column, name: str, q: float) -> Column:
        return quantile(x, q) if found is None else rounded(F.lit(found[name][QUANTILES.index(q)]).cast("double"), 6)

    return [
        F.count(F.lit(1)).alias("row_count"), F.count(a).alias("valid_row_count"), r(exact_mean(F.abs(e)), "mae"), r(at(F.abs(e), "e", 0.5), "medae"), r(F.sqrt(F.avg(e * e)), "rmse"),
        r(exact_mean(ape), "mape"), r(exact_mean(sape), "smape"), r(100.0 * ratio(exact_sum(F.abs(e)), exact_sum(F.abs(a))), "wape"),
        r(at(ape, "ape", 0.5), "ape_p50"), r(at(ape, "ape", 0.75), "ape_p75"), r(at(ape, "ape", 0.9), "ape_p90"), r(exact_mean(e), "bias"),
    ]


def evaluate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """EVAL-01 by keys; without keys the quantiles come from rank selection over the whole table, whose jobs run here."""
    a, p = F.col(actual), F.col(predicted)
    if keys:
        return df.groupBy(*keys).agg(*scorecard(a, p))
    _, e, ape, _ = errors(a, p)
    return df.agg(*scorecard(a, p, found=whole_quantiles(df, {"e": F.abs(e), "ape": ape}, QUANTILES)))


def evaluate_sets(df: DataFrame, actual: str, predicted: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """SET-02: scorecards by several key sets in one scan; ``grouping`` names the set."""
    names = list(dict.fromkeys(k for s in sets for k in s))
    by = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in names])
    grouping = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in names])
    return by.agg(grouping.alias("grouping_set"), *scorecard(F.col(actual), F.col(predicted)))


def compare(df: DataFrame, actual: str, model: str, baseline: str, keys: Sequence[str], min_rows: int = 1) -> DataFrame:
    """EVAL-02: model against baseline by keys, with the share of rows that the model is nearer on."""
    a, m, b = F.col(actual), F.col(model), F.col(baseline)
    ape = lambda p: 100.0 * ratio(F.abs(p - a), F.abs(a))
    better = F.when(a.isNotNull() & m.isNotNull() & b.isNotNull(), (F.abs(m - a) < F.abs(b - a)).cast("int"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), rounded(exact_mean(ape(m)), 4).alias("model_mape"), rounded(exact_mean(ape(b)), 4).alias("baseline_mape"), F.sum(better).cast("bigint").alias("better_rows"))
    return out.where(F.col("row_count") >= min_rows).withColumn("mape_delta", rounded(F.col("model_mape") - F.col("baseline_mape"), 4))


def strategies(model: Column, baseline: Column, log_delta: Column | None = None, segment_bucket: Column | None = None, region_bucket: Column | None = None, alphas: Sequence[float] = ALPHAS) -> dict[str, Column]:
    """EVAL-03."""
    half = 0.5 * model + 0.5 * baseline
    # The names of the strategies.
    out = {"always_baseline": baseline, "always_catboost": model}
    out |= {f"blend_alpha_{a:.1f}": a * model + (1 - a) * baseline for a in alphas}
    if segment_bucket is not None:
        low = F.coalesce(segment_bucket.isin("very_low", "low"), F.lit(False))
        out |= {"choose_baseline_for_low_segment_support": F.when(low, baseline).otherwise(model), "blend_0_5_for_low_segment_support": F.when(low, half).otherwise(model)}
    if region_bucket is not None:
        out["choose_baseline_for_low_region_support"] = F.when(F.coalesce(region_bucket.isin("very_low", "low", "medium"), F.lit(False)), baseline).otherwise(model)
    if log_delta is not None:
        large = F.coalesce(F.abs(log_delta) > LARGE_LOG_DELTA, F.lit(False))
        out |= {"blend_0_5_for_large_log_delta": F.when(large, half).otherwise(model), "choose_baseline_for_large_log_delta": F.when(large, baseline).otherwise(model)}
    return out


def q4_strategies(model: Column, baseline: Column, is_q4_to_q1: Column, mean_ratio: Column | None = None, median_ratio: Column | None = None) -> dict[str, Column]:
    """EVAL-04: other predictions where a quarter four leads to a quarter one."""
    turn = F.coalesce(is_q4_to_q1 == 1, F.lit(False))
    at = lambda p, known=F.lit(True): F.when(turn & known, p).otherwise(model)  # noqa: E731, B008
    out = {  # fixed values: the names of the strategies and their rates
        "q4_to_q1_min_catboost_baseline": at(F.least(model, baseline)),
        "q4_to_q1_cap_growth_0pct": at(F.least(model, baseline)),
        "q4_to_q1_cap_growth_5pct": at(F.least(model, baseline * 1.05)),
        "q4_to_q1_baseline_minus_5pct": at(baseline * 0.95),
        "q4_to_q1_baseline_minus_10pct": at(baseline * 0.90),
    }
    if mean_ratio is not None:
        s = baseline * mean_ratio
        out |= {"q4_to_q1_historical_transition_mean": at(s, s.isNotNull()), "q4_to_q1_blend_catboost_historical_mean_0_5": at(0.5 * model + 0.5 * s, s.isNotNull())}
    if median_ratio is not None:
        s = baseline * median_ratio
        out["q4_to_q1_historical_transition_median"] = at(s, s.isNotNull())
    return out


def evaluate_strategies(df: DataFrame, actual: str, options: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Scorecards of all strategies from one scan."""
    each = df.select(*keys, F.col(actual).alias("_actual"), F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("_value")) for n, c in options.items()])))
    return each.groupBy(*keys, "strategy").agg(*scorecard(F.col("_actual"), F.col("_value")))


def fold_summary(folds: DataFrame, by: Sequence[str], label: str, metric: str = "mape", baseline: str | None = None) -> DataFrame:
    """EVAL-05 and SORT-06: mean, population deviation, worst value and its label, share of folds better than the baseline's metric."""
    worst = F.max(F.struct(F.col(metric), F.col(label)))
    better = [rounded(F.avg((F.col(metric) < F.col(baseline)).cast("double")), 4).alias("better_share")] if baseline else []
    return folds.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), rounded(exact_mean(F.col(metric)), 4).alias(f"mean_{metric}"), rounded(F.stddev_pop(metric), 3).alias(f"std_{metric}"), worst[metric].alias(f"worst_{metric}"), worst[label].alias("worst_fold"), *better)


def time_split(df: DataFrame, order: str) -> DataFrame:
    """ML-05: the last period is test, the one before validation, the rest train. The distinct periods are few."""
    periods = df.select(order).distinct().withColumn("_back", F.dense_rank().over(Window.orderBy(F.desc(order))))
    return df.join(F.broadcast(periods), order).withColumn("split", F.when(F.col("_back") == 1, "test").when(F.col("_back") == 2, "validation").otherwise("train")).drop("_back")


def expanding_folds(df: DataFrame, order: str, periods: Sequence[int]) -> DataFrame:
    """ML-12: each row once for every fold in which it is test, validation or train."""
    folds = F.array(*[F.lit(int(p)) for p in periods])
    role = F.when(F.col(order) == F.col("fold"), "test").when(F.col(order) == F.col("fold") - 1, "validation").when(F.col(order) < F.col("fold") - 1, "train")
    return df.withColumn("fold", F.explode(folds)).withColumn("role", role).where(F.col("role").isNotNull())


def group_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """EVAL-06: errors of groups and their share of all absolute error."""
    e = F.abs(F.col(predicted) - F.col(actual))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), exact_sum(e).alias("abs_error_sum"), quantile(e, 0.5).alias("abs_error_median"))
    total = g.agg(F.sum(F.col("abs_error_sum").cast("decimal(30,6)")).cast("double").alias("_total"))
    return g.crossJoin(F.broadcast(total)).withColumn("abs_error_share", rounded(ratio(F.col("abs_error_sum"), F.col("_total")), 6)).withColumn("abs_error_sum", rounded("abs_error_sum", 4)).drop("_total")


def slices(df: DataFrame, masks: dict[str, Column], actual: str, predicted: str) -> DataFrame:
    """EVAL-08: overlapping slices in one scan."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in masks.items()]))
    return df.withColumn("slice", F.explode(names)).groupBy("slice").agg(*scorecard(F.col(actual), F.col(predicted)))


def support_masks(actual: str, predicted: str) -> dict[str, Column]:
    a, p = F.col(actual), F.col(predicted)
    base = F.col("median_salary_mid")
    return {  # fixed values: the names of the slices and their bounds
        "salary_count_eq_1": F.col("salary_count") == 1, "salary_count_lte_2": F.col("salary_count") <= 2, "vacancy_count_lte_2": F.col("vacancy_count") <= 2,
        "data_quality_score_lt_0_5": F.col("data_quality_score") < 0.5, "abs_salary_change_pct_gt_50": F.abs(100.0 * ratio(a - base, base)) > 50, "catboost_ape_gt_50": 100.0 * ratio(F.abs(p - a), F.abs(a)) > 50,
    }


def largest_errors(df: DataFrame, actual: str, predicted: str, tie: Sequence[str], n: int = 25) -> DataFrame:
    """EVAL-09."""
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("abs_error", rounded(F.abs(F.col(predicted) - F.col(actual)), 6)).orderBy(F.desc("abs_error"), *[F.asc_nulls_last(t) for t in tie]).limit(n)


def period_profile(df: DataFrame, order: str, period: int, value: str) -> DataFrame:
    """EVAL-07: the period, the one before and the one after."""
    return df.where(F.col(order).between(period - 1, period + 1)).groupBy(order).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("vacancy_count"), F.lit(0)).cast("bigint").alias("vacancy_count"), quantile(F.col(value), 0.5).alias("median"), exact_mean(F.col(value)).alias("mean"))


def diagnostic_notes(rows: Sequence[dict]) -> list[str]:
    """EVAL-10: sentences for a few collected metric rows."""
    out = []
    for r in rows:
        better = "better" if (r.get("mape_delta") or 0) < 0 else "not better"
        out.append(f"{r.get('group', 'all')}: model MAPE {r.get('model_mape')} against {r.get('baseline_mape')}, {better} than the baseline")
    return out


def note(group: Column) -> Column:
    """EVAL-10: the sentence for a row of ``compare``, as a column."""
    better = F.when(F.coalesce(F.col("mape_delta"), F.lit(0.0)) < 0, "better").otherwise("not better")
    figure = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)), F.lit("none"))
    return F.concat(group, F.lit(": model MAPE "), figure("model_mape"), F.lit(" against "), figure("baseline_mape"), F.lit(", "), better, F.lit(" than the baseline"))


def size_hypothesis(df: DataFrame, size: str, small: Sequence[str], large: str, most_large: float = 15.0, least_small: float = 60.0) -> DataFrame:
    """H-01: rows and shares of the sizes, and whether the small ones and the large one are within bounds."""
    pct = lambda c: rounded(100.0 * F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 4)
    counts = df.where(F.col(size).isNotNull()).groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").cast("bigint").alias("rows"), pct(F.col(size).isin(*small)).alias("small_pct"), pct(F.col(size) == large).alias("large_pct"))
    return one.withColumn("holds", (F.col("small_pct") > least_small) & (F.col("large_pct") < most_large))


def share_difference(df: DataFrame, group: str, condition: Column, a: str, b: str, least: float) -> DataFrame:
    """H-02: the share of a condition in two groups, their difference in points and whether it is at least so much."""
    rate = lambda g: rounded(100.0 * F.sum(F.when(F.col(group) == g, F.coalesce(condition, F.lit(False)).cast("int"))) / F.nullif(F.sum((F.col(group) == g).cast("int")), F.lit(0)), 4)
    one = df.agg(rate(a).alias("a_pct"), rate(b).alias("b_pct"))
    return one.withColumn("difference", rounded(F.col("a_pct") - F.col("b_pct"), 4)).withColumn("holds", F.col("difference") >= least)


def forecast_decision(model: Column, baseline: Column, granularity: str, is_q4_to_q1: Column | None = None) -> Column:
    """EVAL-11: a blend for months; for quarters the lower value where quarter four leads to quarter one."""
    if granularity == "monthly":
        return 0.7 * model + 0.3 * baseline
    return F.when(F.coalesce(is_q4_to_q1 == 1, F.lit(False)), F.least(model, baseline)).otherwise(model)


def group_error_sets(df: DataFrame, actual: str, model: str, baseline: str, sets: Sequence[Sequence[str]], min_rows: int = 1) -> DataFrame:
    """EVAL-06 and EVAL-10: errors by several key sets from one scan: share of all absolute error, both MAPEs, share of rows that the model is nearer on.

    ``group_columns`` and ``group_value`` name a group; a null key is the value ``null``. Rows without a target or prediction count as rows only.
    """
    a, m, b = (F.col(c).cast("double") for c in (actual, model, baseline))
    valid = a.isNotNull() & m.isNotNull()
    error = F.when(valid, F.abs(m - a))
    ape = lambda p: 100.0 * ratio(F.abs(p - a), F.abs(a))
    nearer = F.when(valid & b.isNotNull(), (F.abs(m - a) < F.abs(b - a)).cast("double"))
    groups = F.array(*[F.struct(F.lit(" + ".join(s)).alias("c"), F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in s]).alias("v")) for s in sets])
    each = df.select(F.explode(groups).alias("g"), error.alias("e"), ape(m).alias("am"), ape(b).alias("ab"), nearer.alias("nearer"))
    g = each.groupBy(F.col("g.c").alias("group_columns"), F.col("g.v").alias("group_value")).agg(F.count(F.lit(1)).alias("row_count"), exact_sum(F.col("e")).alias("abs_error_sum"), rounded(exact_mean(F.col("am")), 4).alias("model_mape"), rounded(exact_mean(F.col("ab")), 4).alias("baseline_mape"), rounded(F.avg("nearer"), 6).alias("better_row_share"))
    total = df.agg(exact_sum(error).alias("_total"))  # one row
    out = g.crossJoin(F.broadcast(total)).where(F.col("row_count") >= min_rows)
    return out.withColumns({"mape_delta": rounded(F.col("model_mape") - F.col("baseline_mape"), 4), "abs_error_share": rounded(ratio(F.col("abs_error_sum"), F.col("_total")), 6), "abs_error_sum": rounded("abs_error_sum", 4)}).drop("_total")


def findings(df: DataFrame, groups: DataFrame, actual: str, model: str, baseline: str, high: float = 50.0) -> DataFrame:
    """EVAL-10: three rows (finding, place, value, note): the group with the largest share of the error, the share of rows that the model is nearer on, and that of rows with an error above ``high`` percent.

    Ties of the first go to the larger share's smaller names. Without rows the values are null.
    """
    a, m, b = (F.col(c).cast("double") for c in (actual, model, baseline))
    worst = groups.where("abs_error_share IS NOT NULL").orderBy(F.desc("abs_error_share"), "group_columns", "group_value").limit(1)
    first = worst.select(F.lit("largest_error_contribution").alias("finding"), F.concat("group_columns", F.lit("="), "group_value").alias("place"), F.col("abs_error_share").alias("value"))
    n = F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("double")
    shares = df.agg(rounded(count(F.abs(m - a) < F.abs(b - a)) / n, 6).alias("better"), rounded(count(100.0 * ratio(F.abs(m - a), F.abs(a)) > high) / n, 6).alias("above"))
    rest = shares.select(F.inline(F.array(*[F.struct(F.lit(f).alias("finding"), F.lit(None).cast("string").alias("place"), F.col(c).alias("value")) for f, c in (("model_nearer_than_baseline", "better"), ("errors_above_bound", "above"))])))
    pct = F.format_string("%.1f%%", rounded(100.0 * F.col("value"), 1))
    note = F.when(F.col("finding") == "largest_error_contribution", F.concat(F.lit("Most of the error of one group: "), "place", F.lit(" with "), pct)).when(F.col("finding") == "errors_above_bound", F.concat(F.lit(f"Rows off by more than {high:.0f}%: "), pct)).otherwise(F.concat(F.lit("Rows nearer than the baseline: "), pct))
    return first.unionByName(rest).withColumn("note", note)


def composition(df: DataFrame, group: str, level: str) -> DataFrame:
    """H-02: rows of each level in each group and their share of the group in percent; null is a level. The groups are aggregated before the window."""
    counts = df.groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("within_pct", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))


def difference_parts(df: DataFrame, group: str, stratum: str, condition: Column, a: str, b: str) -> DataFrame:
    """H-02: the difference of a condition's share between two groups as a sum over strata, in points.

    ``within_part`` is the difference of the shares inside a stratum at the
    mean of its two weights, ``mix_part`` that of its weights at the mean of the
    shares; together they make up the whole difference. A stratum that a group
    lacks has the other group's share there, so all of it is mix.
    """
    held = F.coalesce(condition, F.lit(False)).cast("int")
    of = lambda g, v: F.sum(F.when(F.col(group) == g, v).otherwise(0)).cast("double")
    by = df.where(F.col(group).isin(a, b)).groupBy(stratum).agg(of(a, F.lit(1)).alias("n_a"), of(b, F.lit(1)).alias("n_b"), of(a, held).alias("h_a"), of(b, held).alias("h_b"))
    total = by.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))  # one row
    p = by.crossJoin(F.broadcast(total)).withColumns({"w_a": ratio(F.col("n_a"), F.col("t_a")), "w_b": ratio(F.col("n_b"), F.col("t_b")), "s_a": ratio(F.col("h_a"), F.col("n_a")), "s_b": ratio(F.col("h_b"), F.col("n_b"))})
    s_a, s_b = F.coalesce("s_a", "s_b"), F.coalesce("s_b", "s_a")
    within = 100.0 * (s_a - s_b) * (F.col("w_a") + F.col("w_b")) / 2
    mix = 100.0 * (F.col("w_a") - F.col("w_b")) * (s_a + s_b) / 2
    return p.select(stratum, F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), rounded(100.0 * F.col("s_a"), 4).alias("a_pct"), rounded(100.0 * F.col("s_b"), 4).alias("b_pct"), rounded(within, 4).alias("within_part"), rounded(mix, 4).alias("mix_part"))
