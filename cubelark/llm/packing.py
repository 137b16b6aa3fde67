"""Packing token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. What is left of a document
after its full windows goes to the open window that it fits most tightly. If it
fits none and no more may be opened, the fullest is emitted: filled up with the
head of the piece, or padded where the gap is too small to be worth a cut.
Windows still open at the end of a partition are merged over groups of
partitions by the same rule; what then remains is chained, cut into full
windows, and the tail into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.llm.common import spread, written

#: Open windows of a partition; the smallest gap that is filled by a cut; partitions whose open windows are merged together.
OPEN_WINDOWS, LEAST_CUT, MERGED_PARTITIONS = 32, 16, 64
#: Words whose ids a worker keeps before it starts anew, and characters of the longest that it keeps; rows of a batch that a worker returns.
MOST_WORDS, KEPT_CHARS, ROWS = 400_000, 48, 1_000
WIDTH = 4  # bytes of an id, little-endian
COUNTER_BITS, MERGED = 33, 1 << 29


#: A run of Latin letters, then a run of ASCII punctuation that is in no contraction and no special token: the pre-tokenizer always parts these two.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]*)")
#: Bytes that the byte-level alphabet spells by other characters: in order, from 256 on.
SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


class WordEncoder:
    """Ids of whole texts, as little-endian bytes, for byte-level tokenizers that lower-case, drop white space and never merge across it.

    Each word is encoded by the library once and kept, unless it is long. A
    simple word goes to the library's merges as letters and punctuation, which
    are kept apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        found = b"".join([t.id.to_bytes(WIDTH, "little") for t in self.merges(part.encode().decode("latin-1").translate(SPELT))])
        if len(part) <= KEPT_CHARS:
            self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if simple := SIMPLE.fullmatch(word):
            parts = self.parts
            letters, rest = simple[1].lower(), simple[2]
            a, b = parts.get(letters), parts.get(rest)
            return (self._part(letters) if a is None else a) + (self._part(rest) if b is None else b)
        return b"".join([i.to_bytes(WIDTH, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def batch(self, texts: list[str], end: bytes) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = self.words
        for kept in (words, self.parts):
            if len(kept) > MOST_WORDS:
                kept.clear()
                kept[""] = b""
        long = {}
        for w in {w for s in split for w in s}.difference(words):
            (words if len(w) <= KEPT_CHARS else long)[w] = self._word(w)
        if long:
            return [b"".join([long[w] if len(w) > KEPT_CHARS else words[w] for w in s]) + end for s in split]
        return [b"".join(map(words.__getitem__, s)) + end for s in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class OpenWindows:
    """At most ``most`` open windows of ``size`` ids. A piece is (document, start, length, ids, tokens of the document)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []  # [fill, pieces]

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place a piece; yields the windows that are closed by it."""
        doc, start, length, ids, total = piece

        def part(a: int, n: int) -> tuple:
            return doc, start + a, n, ids[a * WIDTH : (a + n) * WIDTH], total

        done = 0
        while length - done >= self.size:
            yield [part(done, self.size)]
            done += self.size
        rest = length - done
        if not rest:
            return
        fits = [w for w in self.open if self.size - w[0] >= rest]
        if fits:
            best = max(fits, key=lambda w: w[0])
            best[1].append(part(done, rest))
            best[0] += rest
            if best[0] == self.size:
                self.open.remove(best)
                yield best[1]
            return
        if len(self.open) == self.most:
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = self.size - fullest[0]
            if gap >= LEAST_CUT:
                fullest[1].append(part(done, gap))
                done += gap
            yield fullest[1]
        self.open.append([length - done, [part(done, length - done)]])


def chained(pieces: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """The pieces one after another, cut into full windows and a tail of powers of two."""
    pieces = list(pieces)
    left = sum(p[2] for p in pieces)
    queue = iter(pieces)
    piece, used = None, 0
    while left:
        want = size if left >= size else 1 << (left.bit_length() - 1)
        left -= want
        window: list[tuple] = []
        while want:
            if piece is None or used == piece[2]:
                piece, used = next(queue), 0
            n = min(want, piece[2] - used)
            window.append((piece[0], piece[1] + used, n, piece[3][used * WIDTH : (used + n) * WIDTH], piece[4]))
            used += n
            want -= n
        yield window


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset.

    Null text counts as empty: such a document is its end id alone. Every row is
    packed, repeated and null ids included; an empty table gives no piece; other
    columns are ignored. ``size`` must be a power of two.
    """
    kind = docs.schema[id_col].dataType
    fields = [("id", kind), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    plain = T.StructType([T.StructField(n, t) for n, t in fields])
    placed_schema = T.StructType([*plain.fields, T.StructField("group", T.LongType())])
    names = [n for n, _ in fields]
    end = end_id.to_bytes(WIDTH, "little")

    def rows_of(window: list[tuple], sequence: int | None) -> Iterator[tuple]:
        at = 0
        for p in window:
            yield (*p, sequence, at)
            at += p[2]

    def frame(rows: list[tuple], group: int | None = None, extra: bool = True) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        if extra:
            out["group"] = pd.array([group] * len(rows), dtype="Int64")
        out["sequence_id"] = out["sequence_id"].astype("Int64")
        return out

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        windows, n, rows = OpenWindows(size, open_windows), 0, []
        code = encoder(tokenizer_path)
        for b in batches:
            for i in range(0, len(b), ROWS):
                ids, texts = b["id"].iloc[i : i + ROWS], [t or "" for t in b["text"].iloc[i : i + ROWS]]
                for doc, x in zip(ids, code.batch(texts, end), strict=True):
                    length = len(x) // WIDTH
                    for window in windows.add((None if pd.isna(doc) else doc, 0, length, x, length)):
                        rows += rows_of(window, (pid << COUNTER_BITS) + n)
                        n += 1
                yield frame(rows)
                rows = []
        yield frame([r for _, w in windows.open for r in rows_of(w, None)], pid // MERGED_PARTITIONS)

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        windows, n, rows, base = OpenWindows(size, open_windows), 0, [], MERGED + int(key[0])
        left = left.sort_values(["length", "id", "start"], ascending=[False, True, True], kind="stable")
        for p in left[names[:5]].itertuples(index=False, name=None):
            for window in windows.add(p):
                rows += rows_of(window, (base << COUNTER_BITS) + n)
                n += 1
        for window in chained((p for _, w in windows.open for p in w), size):
            rows += rows_of(window, (base << COUNTER_BITS) + n)
            n += 1
        return frame(rows, extra=False)

    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    placed = written(texts.mapInPandas(place, placed_schema), "packed")  # tokenized once; both branches below read it
    closed = placed.where(F.col("group").isNull()).select(*names)
    merged = placed.where(F.col("group").isNotNull()).groupBy("group").applyInPandas(merge, plain)
    return closed.unionByName(merged).withColumnRenamed("id", id_col)
