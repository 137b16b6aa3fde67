"""Windows over periods: adjacent or observed neighbours, statistics of the past, seasonal transitions."""

from __future__ import annotations

from bisect import insort
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_mean, exact_sum, global_quantiles, pct_change, quantile, ratio, rounded
from cubelark.operators.cube import null_safe_join
from cubelark.session import ship_package

Keys = Sequence[str]


def along(keys: Keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def past(keys: Keys, order: str):
    """All earlier rows, without the current one."""
    return along(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def adjacent_target(df: DataFrame, keys: Keys, order: str, value: str, name: str) -> DataFrame:
    """WIN-01: the value of the next row, if it is the next period."""
    w = along(keys, order)
    return df.withColumn(name, F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(value).over(w)))


def adjacent_lags(df: DataFrame, keys: Keys, order: str, lags: Mapping[str, tuple[str, int]]) -> DataFrame:
    """WIN-02: the k-th row before, if it is k periods before. It counts rows: with the period before missing there is no second lag."""
    w = along(keys, order)
    return df.withColumns({n: F.when(F.lag(order, k).over(w) == F.col(order) - k, F.lag(v, k).over(w)) for n, (v, k) in lags.items()})


def observed(df: DataFrame, keys: Keys, order: str, value: str, target: str, gap_to: str, gap_from: str, lags: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """WIN-03: the next and earlier observed rows, and the periods between."""
    w = along(keys, order)
    columns = {target: F.lead(value).over(w), gap_to: F.lead(order).over(w) - F.col(order), gap_from: F.col(order) - F.lag(order).over(w)}
    return df.withColumns(columns | {n: F.lag(v, k).over(w) for n, (v, k) in (lags or {}).items()})


def expanding_median(df: DataFrame, keys: Keys, order: str, value: str, name: str, digits: int = 6) -> DataFrame:
    """WIN-06 and WIN-10: the median of all earlier rows of a group, null values left out.

    The rows of a group pass once, in order, through a sorted list that each
    value is inserted into; a frame that grows would be sorted again at every
    row. A group has a row for each period, so it fits a worker. Rows of one
    period keep the order of their values.
    """
    ship_package(df.sparkSession)
    kind = df.select("*", F.lit(None).cast("double").alias(name)).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending"), (value, "ascending")])
        seen: list[float] = []
        out: list[float | None] = []
        for x in group.column(value).to_pylist():
            n = len(seen)
            out.append(None if not n else seen[n // 2] if n % 2 else seen[n // 2 - 1] + (seen[n // 2] - seen[n // 2 - 1]) * 0.5)
            if x is not None:
                insort(seen, float(x))
        return group.append_column(name, pa.array(out, pa.float64()))

    return df.groupBy(*keys).applyInArrow(run, kind).withColumn(name, rounded(name, digits))


def past_statistics(df: DataFrame, keys: Keys, order: str, value: str, prefix: str = "segment_previous") -> DataFrame:
    """WIN-04 to WIN-07: number, mean, median and sample deviation of the earlier rows.

    """
    w, x = past(keys, order), F.col(value)
    df = expanding_median(df, keys, order, value, f"{prefix}_salary_median")
    return df.withColumns({f"{prefix}_observation_count": F.row_number().over(along(keys, order)) - 1, f"{prefix}_salary_mean": exact_mean(x, w), f"{prefix}_salary_std": rounded(F.stddev_samp(x).over(w), 4)})


def changes(df: DataFrame, keys: Keys, order: str, columns: Sequence[str]) -> DataFrame:
    """WIN-08: difference and relative change against the row before."""
    w, out = along(keys, order), {}
    for c in columns:
        before = F.lag(c).over(w)
        out |= {f"{c}_delta_lag_1": rounded(F.col(c) - before, 6), f"{c}_pct_change_lag_1": rounded(pct_change(F.col(c), before), 6)}
    return df.withColumns(out)


def lag_changes(df: DataFrame, keys: Keys, order: str, column: str) -> DataFrame:
    """WIN-08 between the two rows before."""
    w = along(keys, order)
    one, two = F.lag(column, 1).over(w), F.lag(column, 2).over(w)
    return df.withColumns({f"{column}_lag_1_to_lag_2_delta": rounded(one - two, 6), f"{column}_lag_1_to_lag_2_pct_change": rounded(pct_change(one, two), 6)})


def seasonal_history(df: DataFrame, transition: str, order: str, value: str, target: str) -> DataFrame:
    """WIN-09 and WIN-10: for each transition and period the mean, log mean and median of target over value in earlier periods."""
    valid = df.where((F.col(value) > 0) & (F.col(target) > 0) & F.col(transition).isNotNull())
    change = F.col(target) / F.col(value)
    by_period = valid.groupBy(transition, order).agg(F.count(F.lit(1)).alias("_n"), exact_sum(change).alias("_sum"), exact_sum(F.ln(change)).alias("_log"), quantile(change, 0.5).alias("_median"))
    by_period = expanding_median(by_period, [transition], order, "_median", "_past_median")
    w = past([transition], order)
    n = F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint")
    return by_period.select(transition, order, n.alias("seasonal_transition_previous_count"), rounded(ratio(exact_sum(F.col("_sum"), w), n), 6).alias("seasonal_transition_salary_ratio_mean"), F.col("_past_median").alias("seasonal_transition_salary_ratio_median"), rounded(ratio(exact_sum(F.col("_log"), w), n), 6).alias("seasonal_transition_log_delta_mean"))


def with_seasonal(df: DataFrame, transition: str, order: str, value: str, target: str) -> DataFrame:
    """JOIN-03: the history of (transition, period) at each row; a null transition gets none. The history has transitions times periods rows."""
    return df.join(seasonal_history(df, transition, order, value, target), [transition, order], "left")


def rolling(df: DataFrame, keys: Keys, order: str, column: str, width: int = 2) -> DataFrame:
    """WIN-12: mean and deviation of the last rows, null until there are enough."""
    w = along(keys, order).rowsBetween(-(width - 1), 0)
    full = F.count(column).over(w) == width
    return df.withColumns({f"{column}_rolling_mean_{width}": F.when(full, exact_mean(F.col(column), w)), f"{column}_rolling_std_{width}": F.when(full, rounded(F.stddev_samp(column).over(w), 4))})


def impute_by_group(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """NULL-03 and WIN-13: the group's median, else the global one, which is one row."""
    everything = global_quantiles(df, column, [0.5])[0]
    own = df.groupBy(*keys).agg(quantile(F.col(column), 0.5).alias("_own"))  # a row for each group, joined as Spark finds its size
    filled = F.coalesce(F.col(column), F.col("_own"), rounded(F.lit(everything).cast("double"), 6))
    return null_safe_join(df, own, keys, "left").withColumn(f"{column}_imputed", filled).drop("_own")


def last_rows(df: DataFrame, keys: Keys, order: str, n: int = 2) -> DataFrame:
    """WIN-15: the last rows of each group, numbered from the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("from_last", F.row_number().over(w)).where(F.col("from_last") <= n)


def last_deltas(df: DataFrame, order: str, columns: Sequence[str], n: int) -> DataFrame:
    """WIN-14: change against the period before, for the last n periods, the latest first. The table has a row for each period, so they are few."""
    few = df.orderBy(F.desc(order)).limit(n + 1)
    w = Window.orderBy(order)
    return few.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns}).orderBy(F.desc(order)).limit(n)


def observation_counts(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """AGG-21: numbers of rows by keys, at each row: counted before the shuffle and joined, so no task holds a key's rows."""
    out = df
    for n, keys in columns.items():
        out = null_safe_join(out, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)), keys)
    return out


def transition(quarter: Column, target_quarter: Column) -> Column:
    """STR-14: null without a target."""
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit("_to_Q"), target_quarter.cast("string"))
