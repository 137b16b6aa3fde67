"""Profiles of any table: missing values, duplicates, outliers, correlations, roles of columns. One aggregation each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.functions.dates import parse_date
from cubelark.functions.exact import exact_mean, global_quantiles, quantile, rounded, whole_quantiles
from cubelark.functions.text import MISSING_PLACEHOLDERS, to_number
from cubelark.operators.cube import count_if
from cubelark.operators.distinct import exact_where, sketch


def _long(one: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row of ``column__field`` values to a row per column (RSH-02)."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").cast(t).alias(f) for f, t in fields.items()]) for c in columns])))


def missing_values(df: DataFrame, examples: int = 10) -> DataFrame:
    """DQ-01: nulls, empty strings and placeholders of each column, with the first few placeholders found."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in df.schema.fields:
        c, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.StringType)
        hit = F.lower(F.trim(c)).isin(*MISSING_PLACEHOLDERS) if text else F.lit(False)
        aggs += [count_if(c.isNull()).alias(f"{f.name}__nulls"), count_if(F.trim(c) == "" if text else F.lit(False)).alias(f"{f.name}__empty"), count_if(hit).alias(f"{f.name}__placeholders"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(hit, c.cast("string")))), 1, examples), "|").alias(f"{f.name}__examples")]  # at most a spelling of each placeholder
    return _long(df.agg(*aggs), df.columns, {"nulls": "bigint", "empty": "bigint", "placeholders": "bigint", "examples": "string"})


def null_percent(df: DataFrame, warning: float = 30.0, critical: float = 70.0) -> DataFrame:
    """DQ-12."""
    pct = {c: rounded(100.0 * count_if(F.col(f"`{c}`").isNull()).cast("double") / F.count(F.lit(1)).cast("double"), 4).alias(f"{c}__pct") for c in df.columns}
    return _long(df.agg(*pct.values()), df.columns, {"pct": "double"}).withColumn("level", F.when(F.col("pct") >= critical, "critical").when(F.col("pct") >= warning, "warning").otherwise("ok"))


def drop_sparse(df: DataFrame, most_null_percent: float = 68.0, also: Sequence[str] = ()) -> DataFrame:
    """FLT-08: one small row of statistics decides which columns go."""
    stats = df.agg(*[(count_if(F.col(f"`{c}`").isNull()) * 100.0 / F.count(F.lit(1))).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, p in stats.items() if (p or 0) > most_null_percent], *also)


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ-02: groups of equal rows and the rows in them; hashed down before the shuffle."""
    names = list(columns or df.columns)
    key = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), {"ignoreNullFields": "false"}), 256)
    sizes = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5, both: bool = True, floor: float | None = None) -> DataFrame:
    """AGG-20: rows outside the quartiles by a factor of their distance; upper side only with ``both`` off, never below ``floor``."""
    q1, q3 = (F.lit(q).cast("double") for q in global_quantiles(df, column, [0.25, 0.75]))
    low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    high = F.greatest(high, F.lit(floor)) if floor is not None else high
    x = F.col(column)
    return df.agg(F.count(x).alias("n"), rounded(q1, 6).alias("q1"), rounded(q3, 6).alias("q3"), count_if(x < low if both else F.lit(False)).alias("below"), count_if(x > high).alias("above"))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0, top: int = 30) -> DataFrame:
    """AGG-18: all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.col(f"r{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)])))
    return long.where(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def describe(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-19; without keys the median comes from rank selection over the whole table, whose jobs run here."""
    x = F.col(column)
    median = quantile(x, 0.5) if keys else rounded(F.lit(global_quantiles(df, column, [0.5])[0]).cast("double"), 6)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), rounded(exact_mean(x), 4).alias("mean"), median.alias("median"), rounded(F.stddev_samp(x), 3).alias("std"))


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """STR-12."""
    aggs = [a for c in columns for a in (rounded(exact_mean(F.char_length(c)), 4).alias(f"{c}__mean_length"), F.max(F.char_length(c)).alias(f"{c}__longest"))]
    return _long(df.agg(*aggs), columns, {"mean_length": "double", "longest": "bigint"})


def salary_summary(df: DataFrame, low: str, high: str, extreme: float = 1_000_000) -> DataFrame:
    """DQ-03: what is filled, zero, inverted and extreme, and the ends of either bound; one aggregation, one row."""
    a, b = F.col(low).cast("double"), F.col(high).cast("double")
    ends = [x for c, n in ((a, "low"), (b, "high")) for x in (count_if(c.isNotNull()).alias(f"{n}_filled"), F.min(c).alias(f"{n}_least"), F.max(c).alias(f"{n}_most"), rounded(exact_mean(c), 4).alias(f"{n}_mean"))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *ends, count_if((a <= 0) | (b <= 0)).alias("not_positive"), count_if(a > b).alias("inverted"), count_if((a > extreme) | (b > extreme)).alias("extreme"), count_if(a.isNull() & b.isNull()).alias("missing"))


def profile_all(frames: dict[str, DataFrame]) -> DataFrame:
    """DQ-04: rows, nulls, empty strings, distinct values and a warning level of every column of every source, in one table."""
    parts = []
    for name, df in frames.items():
        aggs = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            aggs += [F.max(F.lit(f.dataType.simpleString())).alias(f"{f.name}__type"), F.count(F.lit(1)).alias(f"{f.name}__rows"), count_if(c.isNull()).alias(f"{f.name}__nulls"), count_if(F.trim(c.cast("string")) == "").alias(f"{f.name}__empty"), F.count_distinct(c).alias(f"{f.name}__distinct")]
        parts.append(_long(df.agg(*aggs), df.columns, {"type": "string", "rows": "bigint", "nulls": "bigint", "empty": "bigint", "distinct": "bigint"}).select(F.lit(name).alias("source"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def sections(df: DataFrame, dates: Sequence[str], salaries: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """DQ-04: the date, salary and duplicate parts of a profile, a row for each column of each part.

    ``rows`` and ``filled`` count rows and those with a value. ``flagged`` counts
    dates that cannot be read, salaries that are not positive, and rows that
    share their value with another; ``groups`` counts the values that are shared, 0 elsewhere. ``low`` and
    ``high`` are the first and last date, or the ends of the salaries in whole
    units. Placeholders are no values of an identifier. Dates and salaries come
    from one scan; duplicates are counted by value before anything is shuffled,
    whole rows by their hash.
    """
    aggs, out = [F.count(F.lit(1)).alias("_rows")], []
    null = F.lit(None)
    counted = lambda c: F.coalesce(count_if(c), F.lit(0)).cast("bigint")  # noqa: E731  0 without rows
    for k, c in enumerate(dates):
        text = F.col(f"`{c}`").cast("string")
        when = parse_date(text)
        aggs += [F.count(text).alias(f"d{k}_filled"), counted(text.isNotNull() & when.isNull()).alias(f"d{k}_flagged"), F.date_format(F.min(when), "yyyy-MM-dd").alias(f"d{k}_low"), F.date_format(F.max(when), "yyyy-MM-dd").alias(f"d{k}_high")]
        out.append(F.struct(F.lit("dates").alias("section"), F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"d{k}_filled").alias("filled"), F.col(f"d{k}_flagged").alias("flagged"), F.lit(0).cast("bigint").alias("groups"), F.col(f"d{k}_low").alias("low"), F.col(f"d{k}_high").alias("high")))
    for k, c in enumerate(salaries):
        x = to_number(F.col(f"`{c}`").cast("string"))
        aggs += [F.count(x).alias(f"s{k}_filled"), counted(x <= 0).alias(f"s{k}_flagged"), F.floor(F.min(x)).cast("bigint").cast("string").alias(f"s{k}_low"), F.floor(F.max(x)).cast("bigint").cast("string").alias(f"s{k}_high")]
        out.append(F.struct(F.lit("salaries").alias("section"), F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"s{k}_filled").alias("filled"), F.col(f"s{k}_flagged").alias("flagged"), F.lit(0).cast("bigint").alias("groups"), F.col(f"s{k}_low").alias("low"), F.col(f"s{k}_high").alias("high")))
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [df.agg(*aggs).select(F.inline(F.array(*out)))] if out else []
    for name, key in [("full_row", whole), *[(c, F.when(~F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin(*MISSING_PLACEHOLDERS, ""), F.col(f"`{c}`").cast("string"))) for c in ids]]:
        sizes = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        twice = F.col("_k").isNotNull() & (F.col("n") > 1)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        parts.append(sizes.agg(total(F.col("n")).alias("rows"), total(F.when(F.col("_k").isNotNull(), F.col("n"))).alias("filled"), total(F.when(twice, F.col("n"))).alias("flagged"), counted(twice).alias("groups")).select(F.lit("duplicates").alias("section"), F.lit(name).alias("column"), "rows", "filled", "flagged", "groups", null.cast("string").alias("low"), null.cast("string").alias("high")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """RSH-03: n rows by a hash of key and seed: the same ones whatever the order and partitions."""
    return df.withColumn("_draw", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)).orderBy("_draw", key).limit(n).drop("_draw")


def against(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """H-06: per numeric column the share that is filled, the mean, and the correlation with the target; one aggregation."""
    aggs = [a for c in columns for a in (rounded(100.0 * F.count(c) / F.count(F.lit(1)), 4).alias(f"{c}__filled_pct"), rounded(exact_mean(F.col(c)), 4).alias(f"{c}__mean"), rounded(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 4).alias(f"{c}__r"))]
    return _long(df.agg(*aggs), columns, {"filled_pct": "double", "mean": "double", "r": "double"})


def prepared_against(df: DataFrame, target: str, columns: Sequence[str], low: float = 12_000.0, high: float = 800_000.0, most_null_percent: float = 68.0) -> DataFrame:
    """H-06 with its preparation: columns that are null too often go, rows count whose target is within bounds, then ``against`` for the columns that are left.

    How often a column is null is taken over all rows, before the bounds.
    """
    kept = drop_sparse(df.select(target, *[c for c in columns if c != target]), most_null_percent)
    left = [c for c in columns if c in kept.columns]
    return against(df.where(F.col(target).between(low, high)), target, left)


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    """DT-09: rows by year, with the ends of the range at each."""
    return df.groupBy(F.year(column).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min(column), "yyyy-MM-dd").alias("first"), F.date_format(F.max(column), "yyyy-MM-dd").alias("last"))


def roles(df: DataFrame, unique: float = 0.995, texts: float = 0.9, least: int = 1000) -> DataFrame:
    """CAT-11: the role of each column by its type, name, distinct values and length.

    One aggregation with a sketch for each column whose name and type leave its
    role open; columns near a threshold are counted exactly. Its row decides, so
    the result is a small local table. A table without rows has unknown shares,
    which are below any threshold.
    """
    aggs, open_columns = [F.count(F.lit(1)).alias("rows")], []
    is_date = lambda f: isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    named = lambda f: any(w in f.name.lower() for w in ("id", "uuid", "guid", "url", "link"))
    for i, f in enumerate(df.schema.fields):
        if is_date(f) or named(f):
            continue
        c = F.col(f"`{f.name}`").cast("string")
        open_columns.append(f.name)
        aggs.append(F.hll_sketch_estimate(sketch(c)).alias(f"{i}_distinct"))
        if not isinstance(f.dataType, T.NumericType):
            aggs += [F.avg(F.char_length(c)).alias(f"{i}_length"), F.avg(c.try_cast("timestamp").isNotNull().cast("double")).alias(f"{i}_dates")]
    one = df.agg(*aggs).first().asDict()
    rows, at = one["rows"], {f.name: i for i, f in enumerate(df.schema.fields)}
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    limits = {c: [t * rows for t in ([unique] if rows > least else []) + ([] if c in numeric else [texts])] for c in open_columns}
    counts = exact_where(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in open_columns]), {c: one[f"{at[c]}_distinct"] for c in open_columns}, limits if rows else {})

    def role(f: T.StructField) -> str:
        if is_date(f):
            return "datetime"
        if named(f) or (rows > least and counts[f.name] / rows > unique):
            return "id"
        if f.name in numeric:
            return "numeric"
        if (one[f"{at[f.name]}_dates"] or 0) >= 0.7:
            return "datetime"
        return "text" if (one[f"{at[f.name]}_length"] or 0) > 50 or (rows and counts[f.name] / rows > texts) else "categorical"

    return df.sparkSession.createDataFrame([(f.name, role(f)) for f in df.schema.fields], "column string, role string")


def guess_columns(df: DataFrame) -> dict[str, list[str]]:
    """CAT-13: columns of dates, salaries and identifiers by their names (fixed words)."""
    words = {"date": ("date", "time", "дата"), "salary": ("salary", "зарп", "з/п", "оклад"), "id": ("id", "uuid", "guid")}
    found = {k: [c for c in df.columns if any(w in c.lower() for w in ws)] for k, ws in words.items() if k != "id"}
    return found | {"id": [c for c in df.columns if c.lower() in words["id"] or c.lower().endswith("_id")]}


def issues(df: DataFrame, nearly_unique: float = 0.98) -> DataFrame:
    """DQ-13: constant, nearly unique and empty columns.

    One aggregation: a column is constant if its least value is its largest, and
    sketches tell the nearly unique ones; those near the threshold are counted
    exactly. Its row decides, so the result is a small local table.
    """
    aggs = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        aggs += [F.count(c).alias(f"f{i}"), F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}"), F.hll_sketch_estimate(sketch(c)).alias(f"d{i}")]
    one = df.agg(*aggs).first().asDict()
    varied = {c: i for i, c in enumerate(df.columns) if one[f"f{i}"] and not one[f"c{i}"]}
    counts = exact_where(df, {c: one[f"d{i}"] for c, i in varied.items()}, {c: [nearly_unique * one[f"f{i}"]] for c, i in varied.items()})
    found = [(c, "empty" if not one[f"f{i}"] else "constant" if c not in varied else "nearly_unique" if counts[c] > nearly_unique * one[f"f{i}"] else None) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame([f for f in found if f[1]], "column string, issue string")


def split_summary(df: DataFrame, condition: Column, value: str) -> DataFrame:
    """AGG-11: count and median on either side of a condition, in one row; the medians by rank selection, both sides in one pass."""
    found = whole_quantiles(df, {"yes": F.when(condition, F.col(value)), "no": F.when(~condition, F.col(value))}, [0.5])
    return df.agg(count_if(condition).alias("n_yes"), count_if(~condition).alias("n_no"), *[rounded(F.lit(m).cast("double"), 6).alias(f"median_{side}") for side, (m,) in found.items()])


def filled(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """CAT-13, ML-06: of each named group of columns their names, the rows of the table and the values that are there, in one scan; columns that the table lacks have none."""
    have = [c for c in dict.fromkeys(c for g in groups.values() for c in g) if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(have)])
    total = lambda g: sum((F.col(f"_{have.index(c)}") for c in g if c in have), F.lit(0).cast("bigint"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(",".join(g)).alias("columns"), F.col("_rows").alias("rows"), total(g).alias("filled")) for n, g in groups.items()])))
