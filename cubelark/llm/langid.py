"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. The vector of a trigram
binds (multiplies) its letters' vectors, permuted (rotated) by their place; the
vector of a text bundles (adds) those of its trigrams. A language's prototype
is the bundle of its training texts. Texts are compared with the prototypes by
cosine.

Vectors of trigrams are made from the letters' where they are first needed. A
batch of texts is a matrix of trigram counts, so that bundling is one matrix
product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.llm.common import held_out, spread

#: Dimensions; letter classes (0: no letter, 1-26: a-z, the rest by a hash of the letter); texts of a matrix product.
DIMENSIONS, CLASSES, TOGETHER = 512, 40, 128
#: Labelled rows of a language that are learned from at most, about; how sharply cosines become a score.
TRAINED, SHARPNESS = 5_000, 30.0
UNKNOWN = "und"
GRAMS = CLASSES**3


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.flatnonzero(is_letter)
    out[codes] = 27 + (codes * 2654435761 % (1 << 32) >> 7) % (CLASSES - 27)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = i + 1
    return out


@lru_cache(maxsize=1)
def gram_vectors() -> np.ndarray:
    """Bound vectors of all trigrams, +1 and -1."""
    base = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return (first[:, None, None, :] * second[None, :, None, :] * base[None, None, :, :]).reshape(GRAMS, DIMENSIONS)


def grams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a text, white space and other non-letters as one class, runs of it as one, with one at either end; none for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters()[codes].astype(np.int32)
    if not own.any():
        return np.empty(0, np.int32)
    own = np.concatenate(([0], own, [0]))
    own = own[np.concatenate(([True], (own[1:] != 0) | (own[:-1] != 0)))]
    return (own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether there was a letter) of the texts."""
    out, some = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    table = gram_vectors()
    for i in range(0, len(texts), TOGETHER):
        own = [grams(t) for t in texts[i : i + TOGETHER]]
        used = np.zeros(GRAMS, bool)
        for g in own:
            used[g] = True
        columns = np.flatnonzero(used)
        if not len(columns):
            continue
        place = np.zeros(GRAMS, np.int32)
        place[columns] = np.arange(len(columns))
        counts = np.zeros((len(own), len(columns)), np.float32)
        for k, g in enumerate(own):
            counts[k] = np.bincount(place[g], minlength=len(columns))
            some[i + k] = len(g) > 0
            if not len(g):
                counts[k] = 0
        out[i : i + len(own)] = counts @ table[columns].astype(np.float32)
    return out, some


@dataclass(frozen=True)
class Prototypes:
    languages: tuple[str, ...]
    vectors: np.ndarray  # of length one

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        vectors, some = bundles(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cosine = vectors @ self.vectors.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(axis=1)
        e = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
        score = 1.0 / e.sum(axis=1)
        return [self.languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, some, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAINED) -> Prototypes:
    """Prototypes from about ``most`` rows of each language at most, chosen by a hash of the id, outside the held-out fold, with non-null language and text.

    The bundle of a language is a sum, made in the tasks and then by Spark over (language, dimension); only the prototypes reach the driver.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out("id"), F.lit(False)))
    sizes = known.groupBy("lang").agg((F.lit(float(most)) / F.count(F.lit(1))).alias("share"))  # a row for each language, as are the prototypes
    known = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)).drop("share")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            vectors, _ = bundles(list(b["text"]))
            for lang in b["lang"].unique():
                v = vectors[(b["lang"] == lang).to_numpy()]
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)  # each text counts the same
                total[lang] = total.get(lang, 0) + v.sum(axis=0, dtype=np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [np.round(v * 1e6).astype(np.int64).tolist() for v in total.values()]})  # whole numbers: the sum does not depend on its order

    sums = spread(known).select("lang", "text").mapInPandas(summed, T.StructType([T.StructField("lang", T.StringType()), T.StructField("v", T.ArrayType(T.LongType()))]))
    rows = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    return Prototypes(tuple(r["lang"] for r in rows), (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def identify(docs: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row's whole text.

    Null texts and texts without a letter get ``und`` and score 0. Every row
    gives one row, repeated and null ids included; other columns are ignored;
    without prototypes all is ``und``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages times DIMENSIONS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = sent.value.predict(list(b["text"]))
            yield pd.DataFrame({"id": b["id"], "lang_pred": langs, "score": scores})

    out = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score")
