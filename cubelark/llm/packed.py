"""Rows that travel packed: Python workers make and read columns of numbers, Spark deals out blobs of many rows and never sees one.

A row that Spark takes apart costs more than all that numpy does with it. Values
are stored byte by byte (all lowest bytes, then all next ones), so that the
compression of files and shuffles finds the high bytes, which are alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def packed(columns: Sequence[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns))


def unpacked(blobs: Sequence, kinds: Sequence[type]) -> list[np.ndarray]:
    """The columns of all blobs, one after the other."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    counts = [len(b) // sum(sizes) for b in blobs]
    out, n = [np.empty(sum(counts), k) for k in kinds], 0
    for blob, count in zip(blobs, counts, strict=True):
        raw, at = np.frombuffer(blob, np.uint8), 0
        for column, size in zip(out, sizes, strict=True):
            column[n : n + count].view(np.uint8).reshape(count, size)[:] = raw[at : at + size * count].reshape(size, count).T
            at += size * count
        n += count
    return out


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of 32 bits of each row of whole numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out >> np.uint64(32)


def dealt(part: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, blob): the rows of each part, in their order."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), packed([c[a:b] for c in columns])


def places(spark: SparkSession, n: int) -> np.ndarray:
    """n whole numbers that ``repartition(n, ...)`` deals to n different partitions."""
    rows = spark.range(24 * n).select(F.col("id").cast("int").alias("place"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).collect()
    first: dict[int, int] = {}
    for r in rows:
        first.setdefault(r["to"], r["place"])
    return np.array([first.get(k, k) for k in range(n)], np.int32)
