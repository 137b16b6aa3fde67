"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: Sequence[str] = ()) -> None:
    """SNK-01, SNK-02: in as many files as there are partitions."""
    df.write.mode("overwrite").option("compression", compression).partitionBy(*partition_by).parquet(path)


def plain(value: Any) -> Any:
    if isinstance(value, Path):
        return str(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else str(value)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small document through the file system of its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(report: dict | DataFrame, path: str) -> None:
    """SNK-03: a report of one row, or a small dictionary."""
    found = report.first() if isinstance(report, DataFrame) else None
    data = found.asDict(recursive=True) if found is not None else ({} if isinstance(report, DataFrame) else report)
    put(SparkSession.active(), path, json.dumps(data, ensure_ascii=False, indent=2, default=plain))


def write_metrics(df: DataFrame, path: str, separator: str = ",") -> None:
    """SNK-04: a small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """A table of any size as quoted CSV, in as many files as there are partitions, each with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("escape", '"').csv(path)


def write_excel_csv(df: DataFrame, path: str, files: int | None = 1) -> None:
    """SNK-05: files for spreadsheets: semicolons and a byte order mark, all rows.

    One file by default; with ``files`` None each partition writes its own. A
    file that would have more rows than a sheet takes goes on in the next.
    """
    first, *rest = df.columns
    dealt = df.coalesce(files) if files else df
    dealt.toDF("\ufeff" + first, *rest).write.mode("overwrite").option("header", True).option("sep", ";").option("escape", '"').option("maxRecordsPerFile", SHEET_ROWS).csv(path)


def markdown(df: DataFrame, title: str, rows: int = 50) -> str:
    """SNK-07: the first rows as a table."""
    found = df.limit(rows).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in found]) + "\n"
