"""Serving queries over a registered mart. Values are bound, never spliced; an endpoint is one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_mean, quantile, ratio, rounded

#: A source of the interface that stands for two of the data (fixed values).
SOURCE_GROUPS = {"hh": ("hh_github", "hh_kaggle")}
FILTERS = ("source_dataset", "region", "occupation_group")
Filters = Mapping[str, str | None]


def conjunction(filters: Filters, groups: Mapping[str, tuple[str, ...]] = SOURCE_GROUPS) -> Column:
    """FLT-01: the filters that have a value; a source may stand for several."""
    parts = []
    for name, value in filters.items():
        if name not in FILTERS:
            raise KeyError(name)
        if value is not None:
            parts.append(F.col(name).isin(*groups[value]) if name == "source_dataset" and value in groups else F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def exact_segment(source: str | None, region: str | None, occupation: str, groups: Mapping[str, tuple[str, ...]] = SOURCE_GROUPS) -> Column:
    """FLT-03: the combined source without a region means rows that have none."""
    where = conjunction({"source_dataset": source, "region": region, "occupation_group": occupation}, groups)
    return where & F.col("region").isNull() if source in groups and region is None else where


@dataclass(frozen=True)
class Mart:
    """A monthly or quarterly mart with its period column."""

    data: DataFrame
    period: str
    granularity: str
    groups: Mapping[str, tuple[str, ...]] = None  # type: ignore[assignment]

    def _where(self, filters: Filters) -> DataFrame:
        return self.data.where(conjunction(filters, self.groups or SOURCE_GROUPS))

    def _at(self, filters: Filters, period: str | None) -> DataFrame:
        """Rows of the period, by default the latest under the filters, by a scalar in the same job (AGG-17)."""
        rows = self._where(filters)
        if period is not None:
            return rows.where(F.col(self.period) == F.lit(period))
        return rows.join(F.broadcast(rows.agg(F.max(self.period).alias("_latest"))), F.col(self.period) == F.col("_latest")).drop("_latest")

    def overview(self, filters: Filters, period: str | None = None) -> DataFrame:
        """API-02, AGG-14; no row where nothing matches."""
        at = self._at(filters, period)
        return at.groupBy(F.lit(self.granularity).alias("granularity"), F.col(self.period).alias("period")).agg(F.count(F.lit(1)).alias("segment_count"), quantile(F.col("median_salary_mid"), 0.5, digits=4).alias("median_salary_mid"), F.sum("vacancy_count").cast("bigint").alias("vacancy_count"), rounded(ratio(F.sum("salary_count"), F.sum("vacancy_count")), 6).alias("salary_coverage"), rounded(exact_mean(F.col("data_quality_score")), 4).alias("data_quality_score"))

    def trend(self, filters: Filters) -> DataFrame:
        """API-03, AGG-15."""
        return self._where(filters).groupBy(F.col(self.period).alias("period")).agg(quantile(F.col("median_salary_mid"), 0.5, digits=4).alias("median_salary_mid"), F.sum("vacancy_count").cast("bigint").alias("vacancy_count"), rounded(ratio(F.sum("salary_count"), F.sum("vacancy_count")), 6).alias("salary_coverage")).orderBy("period")

    def segments(self, filters: Filters, period: str | None = None, limit: int = 50) -> DataFrame:
        """API-04, SORT-02: the largest segments; 1 to 500 rows; ties by the keys."""
        if not 1 <= limit <= 500:
            raise ValueError("limit is 1 to 500")
        at = self._at(filters, period)
        return at.select("source_dataset", "region", "occupation_group", F.col(self.period).alias("period"), "median_salary_mid", F.col("vacancy_count").cast("bigint").alias("vacancy_count"), F.col("salary_count").cast("bigint").alias("salary_count")).orderBy(F.desc("vacancy_count"), F.desc_nulls_last("median_salary_mid"), F.asc_nulls_last("source_dataset"), F.asc_nulls_last("region"), F.asc_nulls_last("occupation_group")).limit(limit)

    def history(self, source: str | None, region: str | None, occupation: str) -> DataFrame:
        """API-05, AGG-16."""
        rows = self.data.where(exact_segment(source, region, occupation, self.groups or SOURCE_GROUPS))
        medians = [quantile(F.col(c), 0.5, digits=4).alias(c) for c in ("median_salary_mid", "p25_salary_mid", "p75_salary_mid")]
        sums = [F.sum(c).cast("bigint").alias(c) for c in ("vacancy_count", "salary_count", "employer_count")]
        return rows.groupBy(F.col(self.period).alias("period")).agg(*medians, *sums).orderBy("period")

    def forecast_row(self, source: str | None, region: str | None, occupation: str, period: str | None = None) -> DataFrame:
        """API-06, SORT-03: the latest row of a segment."""
        rows = self.data.where(exact_segment(source, region, occupation, self.groups or SOURCE_GROUPS))
        rows = rows if period is None else rows.where(F.col(self.period) == F.lit(period))
        return rows.orderBy(F.desc(self.period), F.desc("vacancy_count"), F.asc_nulls_last("region")).limit(1)

    def filters(self, filters: Filters) -> DataFrame:
        """API-01: the values of each dimension under the other filters, and the periods under all, in one scan."""
        groups = self.groups or SOURCE_GROUPS
        source = F.col("source_dataset")
        for name, members in groups.items():
            source = F.when(F.col("source_dataset").isin(*members), F.lit(name)).otherwise(source)
        values = {"source_dataset": source, "region": F.col("region"), "occupation_group": F.col("occupation_group"), "period": F.col(self.period)}
        each = [F.when(conjunction({k: v for k, v in filters.items() if k != name}, groups), F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))) for name, value in values.items()]
        facets = self.data.select(F.explode(F.array_compact(F.array(*each))).alias("f"))
        return facets.select("f.facet", "f.value").where("value is not null").distinct()


    def health(self) -> DataFrame:
        """API-07 over the mart: its rows and latest period; the status is ok if there is a row."""
        return self.data.agg(F.count(F.lit(1)).alias("rows"), F.max(self.period).cast("string").alias("latest")).select(F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"), "rows", "latest")


def health() -> dict[str, str]:
    """API-07."""
    return {"status": "ok"}
