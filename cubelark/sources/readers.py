"""Readers of the raw sources: every column is a string, schemas are given, nothing is inferred on large data."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.sources.quoted import read_quoted

# Names of the sources, separators tried by the sniffer, tokens that are null in exploratory reads.
SOURCES = ("trudvsem_latest", "hh_github", "hh_kaggle", "combined")
LABELS = {"trudvsem_latest": "Trudvsem latest snapshot", "hh_github": "HeadHunter GitHub SQLite", "hh_kaggle": "HeadHunter Kaggle CSV", "combined": "HH/Trudvsem/Mendeley combined CSV"}
SEPARATORS = (",", ";", "\t", "|")
NULL_TOKENS = ("", "NULL", "null", "None", "N/A", "не указано")
MERGED_COLUMN = "responsibilities"
SQLITE_TABLE = "vacancies"
SQLITE_COLUMNS = ("id", "name", "city", "salary_bottom", "salary_top", "currency", "published_at", "employer_name", "key_skills", "schedule", "professional_role", "experience")


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def require_path(spark: SparkSession, path: str, hint: str = "") -> str:
    """SRC-16: through the file system of the path, which may be one that only Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} is missing. {hint}".strip())
    return path


def header(spark: SparkSession, path: str, separator: str) -> list[str]:
    first = spark.read.text(path).limit(1).first()
    return [] if first is None else [c.strip("\ufeff \t\r") for c in next(csv.reader([first[0]], delimiter=separator), [])]


def read_ragged(spark: SparkSession, path: str, columns: Sequence[str] | None = None, separator: str = "|", merged: str = MERGED_COLUMN) -> DataFrame:
    """SRC-02, SRC-03: lines without quotes; surplus fields belong to ``merged``, joined again by the separator."""
    names = list(columns or header(spark, path, separator))
    at = names.index(merged) if merged in names else len(names) - 1
    fields = F.split(F.col("value"), F.lit(f"\\Q{separator}\\E"), -1)
    surplus = F.greatest(F.size("f") - len(names), F.lit(0))
    values = {n: F.get("f", F.lit(i)) for i, n in enumerate(names[:at])}
    values[names[at]] = F.when(F.size("f") > at, F.array_join(F.slice("f", F.lit(at + 1), surplus + 1), separator))
    values |= {n: F.get("f", F.lit(i) + surplus) for i, n in enumerate(names[at + 1 :], at + 1)}
    lines = spark.read.text(path).where((F.col("value") != separator.join(names)) & (F.trim("value") != "")).select(fields.alias("f"))
    return lines.select(*[v.alias(n) for n, v in values.items()])


def read_csv(spark: SparkSession, path: str, separator: str = ";", columns: Sequence[str] | None = None, whole: bool = False) -> DataFrame:
    """SRC-04: quoted, several lines a field allowed. Files are read in splits; ``whole`` reads each in one task, for files whose unquoted fields hold quotes."""
    if whole:
        reader = spark.read.option("sep", separator).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
        return reader.schema(strings(columns)).csv(path) if columns else reader.option("inferSchema", False).csv(path)
    names = list(columns or [c or f"_c{i}" for i, c in enumerate(header(spark, path, separator))])
    return read_quoted(spark, path, names, separator) if names else spark.createDataFrame([], strings(()))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """SRC-14: several null tokens, wrong values null, surplus fields dropped."""
    raw = read_csv(spark, path, separator, schema.fieldNames())
    clean = lambda c: F.when(~F.trim(c).isin(*tokens), c)
    return raw.select(*[clean(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_sqlite(spark: SparkSession, path: str, table: str | None = SQLITE_TABLE, limit: int | None = None, columns: Sequence[str] = SQLITE_COLUMNS) -> DataFrame:
    """SRC-05, SRC-13: by the Python data source ``sqlite``, in ranges of row ids."""
    from cubelark.session import ship_package
    from cubelark.sources.sqlite import SqliteSource

    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("cubelark_sqlite").option("path", path)
    reader = reader.option("table", table) if table else reader
    df = (reader.option("limit", str(limit)) if limit is not None else reader).load()
    missing = [c for c in columns if c not in df.columns]
    if table == SQLITE_TABLE and missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def sniff_separator(spark: SparkSession, path: str, lines: int = 20, default: str = ",") -> str:
    """SRC-12: the separator with the most fields in the first lines, weighted by how many lines agree with the first."""
    rows = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(lines).collect()]
    if not rows:
        return default

    def score(s: str) -> float:
        n = [r.count(s) for r in rows]
        return sum(n) / len(n) * sum(x == n[0] for x in n) / len(n)

    best = max(SEPARATORS, key=score)
    return best if score(best) > 0 else default


def read_any(spark: SparkSession, path: str, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-06, SRC-11, SRC-15: by the extension; columns are pruned and rows limited in the plan."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix in (".sqlite", ".db"):
        df = read_sqlite(spark, path, table=None, limit=limit)
    elif suffix == ".csv":
        df = read_csv(spark, path, sniff_separator(spark, path))
    else:
        raise ValueError(f"unknown format: {suffix}")
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def read_source(spark: SparkSession, source: str, path: str, limit: int | None = None) -> DataFrame:
    """SRC-01: one of the four sources."""
    readers = {"trudvsem_latest": lambda: read_ragged(spark, path), "hh_github": lambda: read_sqlite(spark, path, limit=limit), "hh_kaggle": lambda: read_csv(spark, path), "combined": lambda: read_csv(spark, path)}
    if source not in readers:
        raise ValueError(f"unsupported source {source!r}; one of {', '.join(SOURCES)}")
    df = readers[source]()
    return df if limit is None or source == "hh_github" else df.limit(limit)


def read_parquet(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """SRC-07, SRC-08: as a frame and, if named, a view for SQL with bound parameters."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: small tables of figures."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str) -> Any:
    """SRC-10: a small document."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
