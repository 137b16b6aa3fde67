"""Boosted trees for many models at once: all candidates and folds share one binned matrix and its scans.

Trees are symmetric: a level splits all leaves at one feature and bound. A level
of all models is one job: every partition sums its rows' gradients by model,
leaf, feature and bin, the sums meet by model, and the best split of each model
comes back. So a search runs iterations times depth jobs, however many
candidates and folds it has. Candidates that differ in the number of iterations
alone are stages of one fit.

Scores and gradients are whole numbers in units of the target's deviation, so
sums do not depend on the order of rows and a lost task repeats exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.operators.encoding import ordered_target
from cubelark.session import scratch, ship_package

#: Bins of a feature, the first for missing values; units of a deviation; trees that are applied on the fly before scores are stored.
BINS, UNIT, REFRESH = 33, 1 << 20, 8


@dataclass(frozen=True)
class Candidate:
    depth: int = 6
    rate: float = 0.1
    l2: float = 3.0


@dataclass
class Tree:
    features: list[int]
    bounds: list[int]
    values: np.ndarray  # of each leaf, in units


@dataclass
class Fit:
    """A model: the trees of a candidate on a fold, and the validation error before and after each of them."""

    candidate: int
    fold: int
    depth: int
    rate: float
    l2: float
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def best(self, iterations: int) -> int:
        """Trees up to ``iterations`` with the smallest validation error, the fewest of equals."""
        return int(np.argmin(self.errors[: iterations + 1]))


@dataclass
class Matrix:
    """``rows``: carried columns, ``_x`` (bins), ``_y`` (target in units, null where there is none), ``_order``."""

    rows: DataFrame
    features: list[str]
    mean: float
    unit: float


def matrix(df: DataFrame, target: str, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]], order: str, learned_before: int, carry: Sequence[str] = (), known: Column | None = None) -> Matrix:
    """The binned matrix, stored once.

    Bounds and the target's scale are taken from periods before ``learned_before``.
    Categories (name: key columns) are ordered target statistics, so they may
    have any number of values. Missing numbers have a bin of their own.
    """
    spark = df.sparkSession
    features = [*numeric, *categorical]
    whole = ordered_target(df, categorical, target, order, known).select(*dict.fromkeys([*carry, *features, target, order]))
    stored = scratch(spark, "encoded")  # the bounds and the bins read it
    whole.write.parquet(stored)
    encoded = spark.read.schema(whole.schema).parquet(stored)
    past = encoded.where(F.col(order) < learned_before).withColumns({f: F.col(f).cast("double") for f in features})
    shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
    bounds = [sorted(set(b)) for b in past.approxQuantile(features, shares, 0.001)]
    of_target = past.agg(F.avg(F.col(target).cast("double")).alias("m"), F.stddev_pop(F.col(target).cast("double")).alias("s")).first()
    mean, unit = float(of_target["m"] or 0.0), float(of_target["s"] or 1.0) / UNIT or 1.0 / UNIT

    def place(f: str, b: list[float]) -> Column:
        v = F.col(f).cast("double")
        over = F.size(F.filter(F.array(*map(F.lit, b)), lambda x: x < v)) + 1 if b else F.lit(1)
        return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(over).cast("int")

    y = F.round((F.col(target).cast("double") - F.lit(mean)) / F.lit(unit)).cast("long")
    out = encoded.select(*carry, F.array(*[place(f, b) for f, b in zip(features, bounds, strict=True)]).alias("_x"), y.alias("_y"), F.col(order).cast("long").alias("_order"))
    to = scratch(spark, "matrix")
    out.write.parquet(to)
    return Matrix(spark.read.schema(out.schema).parquet(to), features, mean, unit)


def _leaves(x: np.ndarray, features: Sequence[int], bounds: Sequence[int]) -> np.ndarray:
    leaf = np.zeros(len(x), np.int64)
    for k, (f, b) in enumerate(zip(features, bounds, strict=True)):
        leaf |= (x[:, f] > b).astype(np.int64) << k
    return leaf


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best_split(g: np.ndarray, n: np.ndarray, l2: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(feature, bound, gradient sums of the children, their numbers): g and n by leaf, feature and bin. Ties go to the first feature and bound."""
    below_g, below_n = g.cumsum(axis=2), n.cumsum(axis=2)
    above_g, above_n = below_g[:, :, -1:] - below_g, below_n[:, :, -1:] - below_n
    gain = (below_g.astype(float) ** 2 / (below_n + l2) + above_g.astype(float) ** 2 / (above_n + l2)).sum(axis=0)
    f, b = np.unravel_index(int(gain[:, :-1].argmax()), gain[:, :-1].shape)
    return int(f), int(b), np.concatenate((below_g[:, f, b], above_g[:, f, b])), np.concatenate((below_n[:, f, b], above_n[:, f, b]))


def fit_many(data: Matrix, folds: Sequence[int], candidates: Sequence[Candidate], iterations: int) -> list[Fit]:
    """A fit of each candidate on each fold: rows before the validation period train, the period before the fold's validates. Folds without either are left out."""
    spark, width = data.rows.sparkSession, len(data.features)
    ship_package(spark)
    there = {r["_order"]: r["n"] for r in data.rows.where("_y IS NOT NULL").groupBy("_order").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each period
    whole = [p for p in folds if p in there and p - 1 in there and any(t < p - 1 for t in there)]
    fits = [Fit(k, p, c.depth, c.rate, c.l2) for k, c in enumerate(candidates) for p in whole]
    if not fits:
        return []
    state = data.rows.where(F.col("_y").isNotNull() & (F.col("_order") < max(whole))).select("_x", "_y", "_order", F.lit(None).cast("binary").alias("_scores")).persist()
    stored = 0
    for done in range(iterations + 1):
        partial = [([], []) for _ in fits]
        for level in range(max(c.depth for c in candidates) if done < iterations else 1):
            sent = spark.sparkContext.broadcast([(m.fold, m.depth, m.trees[stored:], *partial[k]) for k, m in enumerate(fits)])
            l2 = [m.l2 for m in fits]
            found = _level(state, sent, level, width, l2)
            for k, r in found.items():
                if level == 0:
                    fits[k].errors.append(float(np.sqrt(r["error"] / max(1, r["checked"]))) * data.unit)
                if done == iterations or level >= fits[k].depth:
                    continue
                partial[k][0].append(r["feature"])
                partial[k][1].append(r["bound"])
                if level == fits[k].depth - 1:
                    g, n = np.array(r["g"], float), np.array(r["n"], float)
                    fits[k].trees.append(Tree(*partial[k], np.rint(fits[k].rate * g / (n + fits[k].l2)).astype(np.int64)))
            sent.unpersist()
        if done + 1 - stored >= REFRESH and done < iterations:
            before, state = state, _scored(state, [m.trees[stored:] for m in fits], width)
            before.unpersist()
            stored = done + 1
    state.unpersist()
    return fits


def _scores(b: pa.RecordBatch, models: int) -> np.ndarray:
    raw = b.column("_scores").to_pylist()
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, models).copy() if raw and raw[0] is not None else np.zeros((len(raw), models), np.int64)


def _scored(state: DataFrame, trees: list[list[Tree]], width: int) -> DataFrame:
    """The state with the trees applied, stored."""
    spark = state.sparkSession
    sent = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, scores = _bins(b.column("_x"), width), _scores(b, len(sent.value))
            for m, some in enumerate(sent.value):
                for t in some:
                    scores[:, m] += t.values[_leaves(x, t.features, t.bounds)]
            yield pa.RecordBatch.from_arrays([b.column("_x"), b.column("_y"), b.column("_order"), pa.array([s.tobytes() for s in scores], pa.binary())], names=["_x", "_y", "_order", "_scores"])

    to = scratch(spark, "scores")
    state.mapInArrow(run, state.schema).write.parquet(to)
    return spark.read.schema(state.schema).parquet(to).persist()


def _level(state: DataFrame, sent, level: int, width: int, l2: list[float]) -> dict[int, dict]:
    """One level of all models: by model the split with its children's sums, at level 0 the validation error too."""
    cells = (1 << level) * width * BINS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        g, n = [None] * len(models), [None] * len(models)
        errors, checked = [0] * len(models), [0] * len(models)
        for b in batches:
            x, y, order = _bins(b.column("_x"), width), b.column("_y").to_numpy(), b.column("_order").to_numpy()
            scores = _scores(b, len(models))
            for m, (fold, depth, trees, features, bounds) in enumerate(models):
                if level >= depth:
                    continue
                rest = y - scores[:, m]
                for t in trees:
                    rest -= t.values[_leaves(x, t.features, t.bounds)]
                if level == 0:
                    seen = order == fold - 1
                    errors[m] += sum(int(v) * int(v) for v in rest[seen])
                    checked[m] += int(seen.sum())
                own = order < fold - 1
                if not own.any():
                    continue
                at = ((_leaves(x[own], features, bounds)[:, None] * width + np.arange(width)) * BINS + x[own]).ravel()
                if g[m] is None:
                    g[m], n[m] = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
                np.add.at(g[m], at, np.repeat(rest[own], width))
                n[m] += np.bincount(at, minlength=cells)
        rows = []
        for m in range(len(models)):
            some = np.flatnonzero(n[m]) if n[m] is not None else np.empty(0, np.int64)
            if len(some) or checked[m]:
                rows.append((m, some, g[m][some] if len(some) else some, n[m][some] if len(some) else some, str(errors[m]), checked[m]))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["model", "cell", "g", "n", "error", "checked"])

    def split(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        g, n = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for r in parts.itertuples():
            np.add.at(g, np.asarray(r.cell, np.int64), np.asarray(r.g, np.int64))
            np.add.at(n, np.asarray(r.cell, np.int64), np.asarray(r.n, np.int64))
        f, b, child_g, child_n = _best_split(g.reshape(-1, width, BINS), n.reshape(-1, width, BINS), l2[key[0]])
        return pd.DataFrame({"model": [key[0]], "feature": [f], "bound": [b], "g": [child_g], "n": [child_n], "error": [float(sum(map(int, parts["error"])))], "checked": [int(parts["checked"].sum())]})

    by_model = state.mapInArrow(sums, "model int, cell array<long>, g array<long>, n array<long>, error string, checked long").groupBy("model")
    found = by_model.applyInPandas(split, "model int, feature int, bound int, g array<long>, n array<long>, error double, checked long")
    return {r["model"]: r.asDict() for r in found.collect()}  # a row for each model


def predict_many(data: Matrix, fits: Sequence[Fit], stages: Sequence[int], carry: Sequence[str]) -> DataFrame:
    """(carried columns, candidate, fold, stage, trees, prediction): the test rows of each fold, predicted by each of its candidates with the best number of trees up to each stage."""
    spark, width = data.rows.sparkSession, len(data.features)
    plan = [(m.candidate, m.fold, [(s, m.best(s)) for s in stages], m.trees) for m in fits]
    sent = spark.sparkContext.broadcast(plan)
    rows = data.rows.where(F.col("_order").isin(sorted({m.fold for m in fits}) or [-1]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, order = _bins(b.column("_x"), width), b.column("_order").to_numpy()
            for candidate, fold, wanted, trees in sent.value:
                own = np.flatnonzero(order == fold)
                if not len(own):
                    continue
                score = np.zeros((len(trees) + 1, len(own)), np.int64)
                for k, t in enumerate(trees):
                    score[k + 1] = score[k] + t.values[_leaves(x[own], t.features, t.bounds)]
                kept = [b.column(c).take(pa.array(own)) for c in carry]
                for s, k in wanted:
                    same = lambda v, t: pa.array(np.full(len(own), v), t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([*kept, same(candidate, pa.int32()), same(fold, pa.int64()), same(s, pa.int32()), same(k, pa.int32()), pa.array(data.mean + score[k] * data.unit)], names=[*carry, "candidate", "fold", "stage", "trees", "prediction"])

    data = Matrix(None, data.features, data.mean, data.unit)  # what the tasks need of it
    return rows.mapInArrow(run, f"{kinds}, candidate int, fold long, stage int, trees int, prediction double")
