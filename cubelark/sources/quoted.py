"""Quoted CSV read in splits, although fields may hold line ends.

A line end belongs to a field where the quotes before it, from the start of the
file on, are odd in number; doubled quotes inside a field do not change that. So
one pass counts the quotes of each split (a row for each), a running sum over
the splits of a file tells which of them start inside a field, and a second pass
joins the lines of each split to records as they come, without a shuffle. Only
the ends of splits, two pieces of each at most, are shuffled by file and put
together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.session import ship_package

#: Of a row of ``pieces``: a whole record, the end of one or a part without either end, the start of one.
WHOLE, INNER, START = 0, 1, 2
FORM = "file string, block long, kind int, first boolean, value string"


class Joiner:
    """Joins the lines of splits to records; the lines of a split come one after another."""

    def __init__(self) -> None:
        self.at: tuple[str, int] | None = None
        self.inside = self.started = False  # inside a field; whether the present record starts in this split
        self.lines: list[str] = []
        self.seen = False  # whether a record of this split has been made
        self.rows: list[tuple[str, int, int, bool, str]] = []

    def emit(self, kind: int) -> None:
        self.rows.append((*self.at, kind, not self.seen and self.at[1] == 0, "\n".join(self.lines)))
        self.seen, self.lines, self.started = True, [], True

    def finish(self) -> None:
        if self.at is not None and self.lines:
            self.emit(START if self.started else INNER)

    def add(self, at: tuple[str, int], opened: bool, lines: pa.Array) -> None:
        if at != self.at:
            self.finish()
            self.at, self.inside, self.started, self.seen = at, opened, not opened, False
        after = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + self.inside) % 2 == 1
        start = 0
        for end in np.flatnonzero(~after) + 1:
            self.lines += lines[start:end].to_pylist()
            self.emit(WHOLE if self.started else INNER)
            start = end
        self.lines += lines[start:].to_pylist()
        self.inside = bool(after[-1])

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["file", "block", "kind", "first", "value"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``FORM`` from the lines (value, file, block, opened) of a task's splits."""
    joiner = Joiner()
    for b in batches:
        if not b.num_rows:
            continue
        blocks, files = b.column("block").to_numpy(), b.column("file")
        changes = np.flatnonzero((blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
        for start, end in zip([0, *changes], [*changes, b.num_rows], strict=True):
            joiner.add((files[int(start)].as_py(), int(blocks[start])), b.column("opened")[int(start)].as_py(), b.column("value").slice(start, end - start))
        yield joiner.taken()
    joiner.finish()
    yield joiner.taken()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value, first): the records of the files, ``first`` for each file's first one; blank ones are left out.

    The splits must be the same for both passes, so the sessions's settings of
    splits must not change between this call and the last use of its result;
    where they do, the read fails. A last field that is not closed ends with
    its file.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    marks = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    by_split = lines.groupBy("file", "block").agg(F.sum(marks).alias("marks"))
    before = F.sum("marks").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    opened = by_split.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("opened"))  # a row for each split
    known = F.coalesce("opened", F.raise_error(F.lit("the splits have changed between two passes")).cast("boolean"))
    joined = lines.join(F.broadcast(opened), ["file", "block"], "left").select("value", "file", "block", known.alias("opened")).mapInArrow(pieces, FORM)
    # Starts come after the pieces without one of the same split: each begins a record.
    ends = joined.where(F.col("kind") > WHOLE).withColumn("record", F.sum((F.col("kind") == START).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind")))
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "value")))
    stitched = ends.groupBy("file", "record").agg(F.array_join(F.transform(ordered, lambda p: p["value"]), "\n").alias("value"), F.max("first").alias("first"))
    every = joined.where(F.col("kind") == WHOLE).select("value", "first").unionByName(stitched.select("value", "first"))
    return every.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")


def read_quoted(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """Strings of the given columns; each file has a header, which is left out. Surplus fields are dropped, missing ones and empty ones null."""
    form = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = F.from_csv("value", form, {"sep": separator, "quote": '"', "escape": '"'})
    return records(spark, path).where(~F.col("first")).select(parsed.alias("r")).select("r.*")
