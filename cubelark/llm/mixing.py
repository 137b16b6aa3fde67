"""Mixing sources to target weights by iterative proportional fitting.

The tokens to keep of the cells (source, language, topic) are raked: dimension
by dimension they are scaled to the target marginals of the wanted number of
tokens, none above the tokens that the cell has, until the largest relative
error of a marginal or the change of a round is small. A cell's raked tokens
over its tokens are the probability with which its documents are kept, by a hash
of the identifier; as no cell goes beyond its own tokens, the probabilities meet
the marginals wherever the corpus can. A value without enough tokens is kept
whole, and its shortfall is reported and not made up for by others; or the
budget is scaled down to one at which no value falls short (``meet``).

Cells are aggregated by Spark. Up to ``MOST_CELLS`` of them are raked as one
small array; beyond that the same steps run as DataFrame aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.llm.common import cut

#: Rounds of raking at most, relative error or change at which it ends, cells that are raked on the driver.
ROUNDS, CLOSE, MOST_CELLS = 200, 1e-9, 50_000
NONE = "(none)"
#: A value falls short if it misses more than this share of its goal; budgets that are tried for one at which none does.
SHORT, BUDGETS = 1e-4, 20
#: Columns of the result beside those of the dimensions.
OUT = ("row", "tokens", "weight", "probability", "kept", "shortfall")
Targets = Mapping[str, Mapping[str, float] | None]


def tokens_of(text: Column) -> Column:
    """A cheap count of tokens: words and marks of punctuation are about four characters each."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by what the text holds, the first that applies: tables, license terms, contacts, listings of short lines, prose."""
    t = F.coalesce(text, F.lit(""))
    lines = F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.instr(t, " | ") > 0, "table").when(F.lower(t).rlike("licen[sc]e|copyright"), "legal").when(t.rlike("@[A-Za-z0-9-]+[.]|[+][0-9]{2}"), "contact").when(lines * 60 > F.char_length(t) + 60, "listing").otherwise("prose")


def rake(cells: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], budget: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Tokens to keep of the cells, none above ``cells``: their sums over each dimension are ``budget`` in the shares ``wanted``, where the cells allow it.

    A value without tokens cannot get any; its share is spread over the others.
    """
    total = cells.sum()
    w = cells * (min(1.0, budget / total) if total > 0 else 0.0)
    for _ in range(rounds):
        before, worst = w, 0.0
        for code, want in zip(codes, wanted, strict=True):
            have = np.bincount(code, w, minlength=len(want))
            goal = np.where(have > 0, want, 0)
            if goal.sum() <= 0:
                continue
            goal = goal / goal.sum() * budget
            factor = np.divide(goal, have, out=np.zeros_like(have), where=have > 0)
            worst = max(worst, float(np.abs(factor[(have > 0) & (goal > 0)] - 1).max(initial=0)))
            w = np.minimum(cells, w * factor[code])
        if worst <= close or np.abs(w - before).max(initial=0) <= close * max(budget, 1e-300):
            break
    return w


def shortfalls(cells: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], w: np.ndarray, budget: float) -> list[np.ndarray]:
    """By dimension the share of each value's goal that the raked tokens ``w`` miss. Values without tokens have no goal and miss nothing."""
    out = []
    for code, want in zip(codes, wanted, strict=True):
        goal = np.where(np.bincount(code, cells, minlength=len(want)) > 0, want, 0)
        goal = goal / (goal.sum() or 1.0) * budget
        out.append(np.maximum(0.0, 1 - np.divide(np.bincount(code, w, minlength=len(want)), goal, out=np.ones_like(goal), where=goal > 0)))
    return out


def meeting(rake_at: Callable[[float], tuple[object, float]], budget: float) -> tuple[object, float]:
    """The raked tokens at the first budget, from ``budget`` down, at which no value falls short, and that budget.

    ``rake_at`` gives raked tokens and the largest shortfall. A budget goes down
    by what the worst value misses, so that this value's goal becomes what it
    got. Marginals that contradict each other fall short at any budget: the
    search ends when a smaller budget leaves the shortfall as it was, with the
    budget before.
    """
    found, short = rake_at(budget)
    for _ in range(BUDGETS):
        if short <= SHORT:
            break
        smaller = budget * (1 - short) * (1 - SHORT / 2)
        again, left = rake_at(smaller)
        if left > SHORT and left >= short * (1 - 1e-3):
            break
        found, short, budget = again, left, smaller
    return found, budget


def _tempered(sums: dict[str, float], power: float) -> dict[str, float]:
    """Shares that a value's tokens to a power give: between those of the input (1) and equal ones (0)."""
    raised = {k: v**power if v > 0 else 0.0 for k, v in sums.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def mix(docs: DataFrame, dimensions: Mapping[str, Column], tokens: Column, targets: Targets | None = None, keep_share: float = 0.5, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", most_cells: int = MOST_CELLS, meet: bool = False) -> DataFrame:
    """Every row as ``row`` with its cell (one string column per dimension), tokens, weight (its chance over the share that is kept), probability, kept and shortfall.

    ``targets`` gives a dimension the shares its values should have; a dimension
    without any gets the shares of its token sums to the power ``power``. A
    value without a target gets none of the tokens. ``keep_share`` of all tokens
    are wanted; with ``meet`` fewer, if some value has too few for its share of
    those, so that all shares are met. ``shortfall`` has a field for each
    dimension: the share of its value's goal that the corpus cannot give.

    Null values are the value ``(none)``; documents without tokens have their
    cell's probability. The draw is a hash of the identifier, so repeated rows
    are kept or left together; a null id is hashed as such. An empty table gives
    an empty result. Columns of ``docs`` may have any names, dimensions may not
    be named like a column of the result.
    """
    if clash := set(OUT).intersection(dimensions):
        raise ValueError(f"names of the result: {', '.join(sorted(clash))}")
    names = [f"_d{i}" for i in range(len(dimensions))]  # so that no name clashes
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("_id"), F.greatest(F.coalesce(tokens, F.lit(0)).cast("long"), F.lit(0)).alias("_tokens"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, dimensions.values(), strict=True)])
    cells = cut(rows.groupBy(*names).agg(F.sum("_tokens").alias("_sum")))
    given = {n: (targets or {}).get(d) for n, d in zip(names, dimensions, strict=True)}
    few = cells.count() <= most_cells
    factors = (_raked_here if few else _raked_by_spark)(cells, names, given, keep_share, power, meet)
    drawn = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    joined = rows.join(F.broadcast(factors) if few else factors, names, "left")
    short = F.struct(*[F.col(f"_s{n}").alias(d) for n, d in zip(names, dimensions, strict=True)])
    return joined.select("row", *[F.col(n).alias(d) for n, d in zip(names, dimensions, strict=True)], F.col("_tokens").alias("tokens"), "weight", "probability", (drawn < F.col("probability")).alias("kept"), short.alias("shortfall"))


def _raked_here(cells: DataFrame, names: list[str], given: Targets, keep_share: float, power: float, meet: bool) -> DataFrame:
    spark = cells.sparkSession
    found = sorted(tuple(r) for r in cells.select(*names, "_sum").collect())
    sums = np.array([r[-1] or 0 for r in found], float)
    codes, wanted = [], []
    for i, n in enumerate(names):
        values = sorted({r[i] for r in found})
        place = {v: k for k, v in enumerate(values)}
        codes.append(np.array([place[r[i]] for r in found], int))
        own = np.bincount(codes[-1], sums, minlength=len(values))
        shares = _tempered(dict(zip(values, own.tolist(), strict=True)), power) if given[n] is None else given[n]
        wanted.append(np.array([float(shares.get(v, 0.0)) for v in values], float))

    def rake_at(budget: float) -> tuple[np.ndarray, float]:
        w = rake(sums, codes, wanted, budget)
        return w, max((float(s.max(initial=0)) for s in shortfalls(sums, codes, wanted, w, budget)), default=0.0)

    budget = keep_share * float(sums.sum())
    raked, budget = meeting(rake_at, budget) if meet else (rake(sums, codes, wanted, budget), budget)
    missed = shortfalls(sums, codes, wanted, raked, budget)
    chance = np.divide(raked, sums, out=np.zeros_like(sums), where=sums > 0)
    share = budget / sums.sum() if sums.sum() else 0.0
    fields = [T.StructField(c, T.DoubleType()) for c in ("weight", "probability", *[f"_s{n}" for n in names])]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], *fields])
    return spark.createDataFrame([(*r[:-1], float(c / share if share else 0.0), float(c), *[float(m[code[k]]) for m, code in zip(missed, codes, strict=True)]) for k, (r, c) in enumerate(zip(found, chance, strict=True))], schema)


def _raked_by_spark(cells: DataFrame, names: list[str], given: Targets, keep_share: float, power: float, meet: bool) -> DataFrame:
    """The same for very many cells: a round is an aggregation and a join a dimension, one job for its end and one for its error. Only sums of the whole table reach the driver."""
    spark = cells.sparkSession
    tokens = float(cells.agg(F.sum("_sum")).first()[0] or 0)
    goals = {}
    for n in names:
        own = cells.groupBy(n).agg(F.sum("_sum").cast("double").alias("s"))
        if given[n] is None:
            goal = own.select(n, F.when(F.col("s") > 0, F.pow(F.col("s"), F.lit(power))).otherwise(0.0).alias("goal"))
        else:
            targets = spark.createDataFrame([(k, float(v)) for k, v in given[n].items()], f"`{n}` string, goal double")
            goal = own.join(targets, n, "left").select(n, F.when(F.col("s") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0).alias("goal"))
        goals[n] = cut(goal)
    sums = {n: float(g.agg(F.sum("goal")).first()[0] or 0) for n, g in goals.items()}

    def compared(at: DataFrame, n: str, budget: float) -> DataFrame:
        """(value, tokens it has in ``w``, its goal) of a dimension; the goals of values with tokens add up to the budget."""
        have = at.groupBy(n).agg(F.sum("w").alias("have")).join(goals[n], n).select(n, "have", F.when(F.col("have") > 0, F.col("goal")).otherwise(0.0).alias("goal"))
        full = have.agg(F.sum("goal").alias("full"))  # one row
        return have.crossJoin(F.broadcast(full)).select(n, "have", "full", (F.col("goal") / F.nullif(F.col("full"), F.lit(0.0)) * F.lit(budget)).alias("goal"))

    def rake_at(budget: float) -> tuple[DataFrame, float]:
        at = cells.withColumn("w", F.col("_sum") * F.lit(min(1.0, budget / tokens) if tokens else 0.0))
        for _ in range(ROUNDS):
            at = cut(at.withColumn("_before", F.col("w")))
            for n in names:
                factor = compared(at, n, budget).select(n, F.when(F.col("full") <= 0, 1.0).when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
                at = at.join(factor, n).withColumn("w", F.least(F.col("_sum").cast("double"), F.col("w") * F.col("f"))).withColumn(f"_e{n}", F.when(F.col("f") > 0, F.abs(F.col("f") - 1)).otherwise(0.0)).drop("f")
            at = cut(at)
            error, change = at.agg(F.max(F.greatest(*[F.col(f"_e{n}") for n in names], F.lit(0.0))), F.max(F.abs(F.col("w") - F.col("_before")))).first()
            at = at.select(*names, "_sum", "w")
            if (error or 0) <= CLOSE or (change or 0) <= CLOSE * max(budget, 1e-300):
                break
        for n in names:
            got = at.groupBy(n).agg(F.sum("w").alias("have")).join(goals[n], n)
            goal = F.col("goal") * F.lit(budget / sums[n] if sums[n] else 0.0)
            at = at.join(got.select(n, F.when(goal > 0, F.greatest(F.lit(0.0), 1 - F.col("have") / goal)).otherwise(0.0).alias(f"_s{n}")), n)
        at = cut(at)
        return at, at.agg(F.max(F.greatest(*[F.col(f"_s{n}") for n in names], F.lit(0.0)))).first()[0] or 0.0

    budget = keep_share * tokens
    at, budget = meeting(rake_at, budget) if meet else (rake_at(budget)[0], budget)
    share = budget / tokens if tokens else 0.0
    chance = F.when(F.col("_sum") > 0, F.col("w") / F.col("_sum")).otherwise(0.0)
    return at.select(*names, (chance / F.lit(share) if share else F.lit(0.0)).alias("weight"), chance.alias("probability"), *[f"_s{n}" for n in names])
