"""Toxicity by compression distance.

zstandard trains two dictionaries: one on ordinary text, one on the windows of
toxic texts that set them apart, as those texts have and repeat them. Both hold
the same ordinary background, so that a window's compressed lengths differ only
by what the toxic windows add. A window is a few whole words, by default one:
it is compressed between two fixed phrases that both dictionaries hold, since
zstandard stores very short input raw and starts no match near its end. A
window's advantage, the bytes by which the toxic dictionary is ahead, depends on
its words alone and is kept.

Features of a text are the numbers and shares of its windows whose advantage
reaches each of a few thresholds, over the whole text; their weights are
calibrated by a logistic curve on labelled texts that no dictionary has seen,
which gives the score.

This departs from plain compression distance: which windows make up the toxic
dictionary is chosen by how much more often toxic texts have them. Without that
choice half as many toxic texts are found (README).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import held_out, spread

#: Labelled rows of either class that are learned from at most, their characters in all, and those of one row.
TRAINED, TRAINED_CHARS, LONGEST = 4_000, 8_000_000, 200_000
#: Least bytes of a window; bytes of the dictionaries' background and of their own parts; segment and hash lengths of the training of the latter, times that it sees its samples.
WINDOW, BACKGROUND, OWN, SEGMENT, HASHED, SEEN = 1, 16_384, 4_096, 16, 6, 8
#: Toxic texts that a window must be in, and how much likelier there than in ordinary ones, to enter the toxic dictionary.
LEAST_TEXTS, LEAST_ODDS = 3, 25
#: Bytes by which the toxic dictionary must be ahead, and the share of the window's bytes, for each feature.
AHEAD, AHEAD_SHARE = (1, 2, 3, 4, 6), (0.25, 0.35, 0.45, 0.55)
#: Fixed phrases around a window, in capitals, which no lower-cased text has.
BEFORE, AFTER = b" THE QUICK ONYX GOBLIN JUMPS OVER A LAZY DWARF ", b" PACK MY BOX WITH FIVE DOZEN LIQUOR JUGS "
#: Windows whose advantage a task keeps before it starts anew, and bytes of the longest that it keeps.
MOST_WINDOWS, KEPT_BYTES = 400_000, 64
PARAMETERS = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 5, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY, "write_checksum": 0, "write_content_size": 0, "write_dict_id": 0}


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The words of a text, lower-cased, in windows of whole words of at least ``size`` bytes, but for the last."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if size <= 1:
        return words
    out, part, n = [], [], 0
    for w in words:
        part.append(w)
        n += len(w) + 1
        if n > size:
            out.append(b" ".join(part))
            part, n = [], 0
    return [*out, b" ".join(part)] if part else out


class Distance:
    """Advantages of windows under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.kept: dict[bytes, int] = {}
        self.lengths = [self._lengths(d) for d in (toxic, ordinary)]

    @staticmethod
    def _lengths(data: bytes):
        params = zstandard.ZstdCompressionParameters(**PARAMETERS)
        dictionary = zstandard.ZstdCompressionDict(AFTER + data + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress

    def __call__(self, window: bytes) -> int:
        toxic, ordinary = self.lengths
        framed = b"".join((BEFORE, b" ", window, b" ", AFTER))
        ahead = len(ordinary(framed)) - len(toxic(framed))
        if len(window) <= KEPT_BYTES:
            self.kept[window] = ahead
        return ahead

    def features(self, text: str | None) -> np.ndarray:
        kept = self.kept
        if len(kept) > MOST_WINDOWS:
            kept.clear()
        some = windows(text)
        bytes_ = np.array([self(w) if (a := kept.get(w)) is None else a for w in some] or [0], np.float64)
        shares = bytes_ / np.array([len(w) + 1 for w in some] or [1])
        n = np.array([(bytes_ >= k).sum() for k in AHEAD] + [(shares >= k).sum() for k in AHEAD_SHARE])
        return np.array([1.0, *np.log1p(n), *(n / len(bytes_)), min(float(bytes_.max()), 40.0) / 10, float(shares.max()), bytes_.mean()])


@lru_cache(maxsize=4)
def distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


@dataclass(frozen=True)
class Model:
    """Dictionaries, weights of the features, and the score of a text without windows."""

    toxic: bytes
    ordinary: bytes
    prior: float
    weights: tuple[float, ...] = field(default=())

    def score(self, text: str | None) -> float:
        if not (text or "").split():
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(distance(self.toxic, self.ordinary).features(text) @ np.array(self.weights), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the first weight."""
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _background(texts: list[str]) -> bytes:
    samples = [w for t in texts for w in windows(t, 200)]
    try:
        return zstandard.train_dictionary(BACKGROUND, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary themselves
        return b" ".join(samples)[-BACKGROUND:] or b" "


def _own(chosen: list[bytes], texts: list[str]) -> bytes:
    """The dictionary that is trained on the chosen windows as the texts have them, in their order."""
    apart = set(chosen)
    samples = [b" ".join([b"", *found, b""]) for t in texts if (found := [w for w in windows(t) if w in apart])]
    if sum(len(w) + 1 for t in texts for w in apart.intersection(windows(t))) <= OWN:  # all that they have fits
        return b" ".join([b"", *chosen, b""])
    try:
        return zstandard.train_dictionary(OWN, samples * SEEN, k=SEGMENT, d=HASHED).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b" ".join([b"", *chosen, b""])[-OWN:]


def fit(texts: list[str], labels: list[int]) -> Model:
    """The dictionaries learn from every other text, the curve from the rest, whose features are those of unseen texts."""
    toxic, ordinary = ([t for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
    prior = (len(toxic) + 1) / (len(texts) + 2)
    blank = [y for t, y in zip(texts, labels, strict=True) if not (t or "").split()]
    empty = (sum(blank) + prior) / (len(blank) + 1)
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b" ", b" ", empty, (float(np.log(prior / (1 - prior))), *[0.0] * (2 * (len(AHEAD) + len(AHEAD_SHARE)) + 3)))
    counts = [Counter(w for t in some for w in set(windows(t))) for some in (toxic[::2], ordinary[::2])]
    in_toxic, in_ordinary = counts
    least = min(LEAST_TEXTS, -(-len(toxic) // 20))
    odds = {w: (n / len(toxic[::2])) / ((in_ordinary[w] + 0.5) / (len(ordinary[::2]) + 1)) for w, n in in_toxic.items() if n >= least}
    chosen = sorted((w for w, o in odds.items() if o >= min(LEAST_ODDS, len(ordinary) / 4)), key=lambda w: (in_toxic[w], w))
    own = _own(chosen, toxic[::2])
    background = _background(ordinary[1::2])
    both = background + own, (background * (1 + len(own) // len(background)))[: len(own)] + background
    prepared = distance(*both)
    rest = toxic[1::2] + ordinary[1::2]
    weights = logistic(np.array([prepared.features(t) for t in rest]), np.array([1.0] * len(toxic[1::2]) + [0.0] * len(ordinary[1::2])))
    return Model(*both, empty, tuple(map(float, weights)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = TRAINED, most_chars: int = TRAINED_CHARS, longest: int = LONGEST) -> Model:
    """Fit on whole labelled texts outside the held-out fold: of either class the first ``most`` rows by a hash of the id, with ``most_chars`` characters in all.

    Rows with a null id, label or text are not learned from, nor are texts of
    over ``longest`` characters; of repeated labels the largest counts, of
    repeated ids one row.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(1 << 30))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    limit = F.when(F.col("y") == 1, F.lit(most / max(1, sizes.get(1, 0)))).otherwise(F.lit(most / max(1, sizes.get(0, 0))))
    chosen = F.broadcast(known.where(draw / F.lit(float(1 << 30)) < limit))  # about two times ``most`` ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= longest)).join(chosen, "id")
    first = Window.partitionBy("y").orderBy(draw, "id", "text")  # over about two times ``most`` rows
    bounded = rows.withColumn("n", F.sum(F.char_length("text")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("n") <= most_chars)
    found = sorted({r["id"]: r for r in bounded.select("id", "text", "y").collect()}.values(), key=lambda r: r["id"])
    model = fit([r["text"] for r in found], [r["y"] for r in found])
    distance.cache_clear()  # the driver scores nothing after this
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score, predicted) of each row's whole text and, with ``carry``, the whole input row as ``row``.

    Null, empty and blank texts get the share of toxic labels among such texts,
    drawn towards the share among all. Every row gives one row, repeated and
    null ids included; other columns are ignored unless carried inside ``row``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        try:
            for texts in batches:
                yield pd.Series([own.score(t) for t in texts], dtype="float64")
        finally:
            distance.cache_clear()  # the worker goes on to other steps, and what a task keeps would stay with it

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    columns = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *([row] if carry else [])]
    scored = spread(docs.select(*columns)).withColumn("score", score("_text"))
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row"] if carry else []))
