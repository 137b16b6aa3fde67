"""Vector codes: product quantisation of integer vectors by active-entry Lloyd rounds.

Each part of a vector is assigned to the nearest of its position's codebook
entries; entries then move to the floor of the mean of their parts. All numbers
are integers, so results do not depend on how rows are dealt out.

A round knows which entries moved. A part whose entry stayed fixed compares the
moved entries alone with the exact distance that is stored with it: every other
entry was no nearer before and is where it was, with a higher index where it is
as near. Parts whose entry moved rescan all entries.

Codebooks are of fixed size (entries times components) and travel through the
driver; rows and their state stay in written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import discard, spread, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components stay below this, so that squared distances are exact in 64 bits. Products up to EXACT are exact as doubles.
LARGEST, EXACT = 1 << 25, 1 << 53
#: Groups up to so many are broadcast when their sums are joined back.
FEW_GROUPS = 100_000


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each entry, exact: by a product of doubles where that is exact, else in whole numbers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def rescanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the first of equals, and its distance, over all entries."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, code: np.ndarray, distance: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``rescanned``, from the assignment before the entries ``moved`` (a mask) moved."""
    code, distance = code.copy(), distance.copy()
    again = moved[code]
    if again.any():
        code[again], distance[again] = rescanned(x[again], entries)
    fixed, active = np.flatnonzero(~again), np.flatnonzero(moved)
    if len(fixed) and len(active):
        k, d = rescanned(x[fixed], entries[active])
        k = active[k]
        better = (d < distance[fixed]) | ((d == distance[fixed]) & (k < code[fixed]))
        code[fixed[better]], distance[fixed[better]] = k[better], d[better]
    return code, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


@dataclass
class Codes:
    """``rows``: id, the carried columns, code (binary, a byte for each part) and error. ``codebooks``: parts x entries x components; fewer entries where there are fewer rows, None for no rows."""

    rows: DataFrame
    codebooks: np.ndarray | None

    def decoded(self, code: bytes) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([self.codebooks[p, e] for p, e in enumerate(code)])


def integer_vectors(rows: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, carried columns, v): the components as ``floor(scale * x)``, of rows that are finite throughout and of the prevailing length."""
    v = F.col(f"`{vec_col}`")
    whole = rows.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], v.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return whole.where((F.size("v") > 0) & (F.size("v") % parts == 0)).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = ()) -> Codes:
    """Codes of all vectors and the codebooks they refer to.

    Vectors that are null or hold null or non-finite components are dropped,
    and so are those whose length is no multiple of ``parts`` or not the most
    frequent such length (the longest of equally frequent ones). Codebooks start
    at the vectors of the smallest ids; null ids come last, equal ids in the
    order of their vectors. Repeated rows are coded each; an empty table gives
    no rows and no codebooks. Carried columns may have any names but id, code
    and error; other columns are ignored. Components of 2 ** 25 or more after
    scaling are refused with an error: their distances do not fit 64 bits.
    """
    spark = rows.sparkSession
    whole = integer_vectors(spread(rows), parts, scale, id_col, vec_col, carry)
    common = whole.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    names = [f"c{k}" for k in range(len(carry))]
    if common is None:
        return Codes(whole.select("id", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None)
    size = common["n"]
    width = size // parts
    if (whole.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0) >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more after scaling")
    whole = whole.where(F.size("v") == size).withColumn("v", F.col("v").cast("array<int>"))
    first = [r["v"] for r in whole.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]  # as many as a codebook has entries
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    def starting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), size)
            found = [rescanned(v[:, p * width : (p + 1) * width], sent.value[0][p]) for p in range(parts)]
            yield with_state(b, found)

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, d = _matrix(b.column("v"), size), _matrix(b.column("distances"), parts)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            found = [reassigned(v[:, p * width : (p + 1) * width], code[:, p], d[:, p], sent.value[0][p], sent.value[1][p]) for p in range(parts)]
            yield with_state(b, found)

    def with_state(b: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        d = np.stack([x for _, x in found], axis=1)
        kept = [b.column(n) for n in ("id", *names, "v")]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * parts), pa.array(d.ravel()))
        return pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in code], pa.binary()), lists], names=["id", *names, "v", "code", "distances"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each entry of a partition's rows, the number of its parts and their sums: ENTRIES x components numbers at most."""
        count = np.zeros((parts, len(first)), np.int64)
        total = np.zeros((parts, len(first), width), np.int64)
        for b in batches:
            v = _matrix(b.column("v"), size)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=len(first))
                np.add.at(total[p], code[:, p], v[:, p * width : (p + 1) * width])
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], names=["p", "e", "n", "total"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select("id", *names, "v").schema)
    state_kind = f"{kinds}, code binary, distances array<long>"
    sent = spark.sparkContext.broadcast((books, np.ones((parts, len(first)), bool)))
    state = written(whole.select("id", *names, "v").mapInArrow(starting, state_kind), "codes")
    for _ in range(rounds):
        partial = state.select("v", "code").mapInArrow(sums, "p int, e int, n long, total array<long>")
        exact = F.sum(F.col("x").cast("decimal(20,0)"))
        new, moved = books.copy(), np.zeros((parts, len(first)), bool)
        for r in partial.select("p", "e", "n", F.posexplode("total").alias("at", "x")).groupBy("p", "e", "at").agg(F.sum("n").alias("n"), exact.alias("x")).collect():  # entries x components rows at most
            new[r["p"], r["e"], r["at"]] = int(r["x"]) // r["n"]
        moved = (new != books).any(axis=2)
        books = new
        sent = spark.sparkContext.broadcast((books, moved))
        after = written(state.mapInArrow(continued, state_kind), "codes")
        discard(state)
        state = after
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x)
    return Codes(state.select("id", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "code", error.alias("error")), books)


def group_sums(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over the rows of equal ``by``, nulls together. Sums of many groups are joined as Spark finds it, which splits hot groups; few are broadcast."""
    totals = written(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(F.col(value).cast("decimal(20,0)")).cast("long").alias(name)), "group-sums")
    side = F.broadcast(totals) if totals.count() <= FEW_GROUPS else totals
    return rows.join(side, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
