"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary with scores is compiled, on demand, to a deterministic
transducer over characters whose transitions carry the change in the number of
emitted tokens. It rests on the incremental form of byte-pair encoding: the
tokens of a prefix ``p`` are those of ``p`` without its last token, then that
token; and the last token is the one suffix of ``p`` whose pair with the token
before it is stable under the merges. What the future needs of ``p`` is then
only, for each suffix of ``p`` that begins some piece, the last token before
that suffix and the count there: finitely many situations, which are the
states.

Characters outside the vocabulary fall back to their bytes; they and the start
of a run of word marks end every piece, so the state after them is known
whatever came before. A chunk of text is a map from entry states to exit states
and counts: run its head from the entry state, then add what follows, which is
the same for every entry. The head ends where every piece does or, in a chunk
without such a place, where the state has had time to forget its entry; a map
says which state that must be, and keeps the chunk for entries that lead to
another. Maps compose associatively: a text's chunks are summarised apart, those
of a very long text in tasks of their own, and composed pairwise in a tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import partitions, spread

MARK = "▁"
RUN_START = re.compile(f"(?<!{MARK}){MARK}")
#: Characters of a chunk, of a head in a chunk where no place ends every piece, and of a text beyond which its chunks are rows of their own.
CHUNK, HEAD, LONG = 1 << 16, 512, 1 << 20
#: States, words and pairs that a worker keeps before it starts its tables anew; characters of the longest word that it keeps.
MOST_STATES, MOST_WORDS, MOST_PAIRS, KEPT_CHARS = 300_000, 400_000, 800_000, 48


class ChunkMap(NamedTuple):
    """Run ``head`` from the entry state; if that leads to ``meets`` (or to any state, where that is -1), ``count`` more tokens lead to ``leaves``. Else go through ``whole``, texts and maps."""

    head: str
    meets: int
    count: int
    leaves: int
    whole: tuple


class CountTransducer:
    """Counts the pieces of a scored byte-pair vocabulary with byte fallback, identity normalisation and a leading word mark."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.alphabet = frozenset(p for p in scores if len(p) == 1)
        self.starts = frozenset(p[:i] for p in scores for i in range(1, len(p) + 1))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spelt: dict[str, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state is (text of the longest suffix that begins a piece, for each suffix that does: (its length, last token before it, count before it less the count now)).
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.step: list[dict[str, tuple[int, int]]] = []
        self.words: dict[str, int] = {}
        self.start = self._id(("", ((0, "", 0),)))

    def _id(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        return found

    def _merge(self, symbols: list[str]) -> list[str]:
        """The vocabulary's own merges, best score first, leftmost of equals."""
        while len(symbols) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _whole(self, piece: str) -> bool:
        found = self.spelt.get(piece)
        if found is None:
            found = self.spelt[piece] = len(self._merge(list(piece))) == 1
        return found

    def _stable(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self._merge(list(left + right)) == [left, right]
        return found

    def _grow(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a character of the alphabet: (next state, change in the count)."""
        text, before = self.keys[state]
        now = text + char
        for length, last, count in before:  # longest suffix first
            piece = now[len(now) - length - 1 :]
            if piece in self.scores and self._whole(piece) and (not last or self._stable(last, piece)):
                break
        else:
            raise AssertionError("a character of the alphabet is a piece")
        change = count + 1
        kept = [(n + 1, a, c - change) for n, a, c in before if now[len(now) - n - 1 :] in self.starts] + [(0, piece, 0)]
        out = self.step[state][char] = self._id((now[len(now) - kept[0][0] :] if kept[0][0] else "", tuple(kept))), change
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """From ``state`` over ``text``: (exit state, tokens added)."""
        total, step = 0, self.step
        for char in text:
            move = step[state].get(char)
            if move is None:
                if char not in self.alphabet:
                    move = step[state][char] = self.start, len(char.encode("utf-8", "surrogatepass"))
                else:
                    move = self._grow(state, char)
            state = move[0]
            total += move[1]
        return state, total

    def word(self, word: str) -> int:
        """Tokens of a word after its mark, from the start state; a word is a chunk whose map is kept by its content."""
        found = self.run(self.start, MARK + word)[1]
        if len(word) <= KEPT_CHARS:
            self.words[word] = found
        return found

    def chunk(self, text: str) -> ChunkMap:
        """The map of a chunk."""
        first = RUN_START.search(text, 1)
        if first is None:  # no place that ends every piece
            head, rest = text[:HEAD], text[HEAD:]
            meets, _ = self.run(self.start, head)
            leaves, count = self.run(meets, rest)
            return ChunkMap(head, meets, count, leaves, (text,))
        cut = first.start()
        words = self.words
        inner = text[cut:]
        total = 0
        at = inner.rfind(MARK)
        while at > 0 and inner[at - 1] == MARK:
            at -= 1
        body, tail = inner[:at], inner[at:]
        for w in (body[1:].split(MARK) if MARK + MARK not in body else ()) if body else ():
            n = words.get(w)
            total += self.word(w) if n is None else n
        if MARK + MARK in body:
            for run in re.findall(f"{MARK}+[^{MARK}]*", body):
                n = words.get(run[1:])
                total += self.word(run[1:]) if n is None else n
        state, n = self.run(self.start, tail)
        return ChunkMap(text[:cut], -1, total + n, state, ())

    def apply(self, state: int, chunk: ChunkMap) -> tuple[int, int]:
        """(exit state, tokens) of a map from an entry state."""
        met, n = self.run(state, chunk.head)
        if chunk.meets in (-1, met):
            return chunk.leaves, n + chunk.count
        total = 0
        for part in chunk.whole:
            state, n = self.run(state, part) if isinstance(part, str) else self.apply(state, part)
            total += n
        return state, total

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks after each other; associative."""
        leaves, n = self.apply(a.leaves, b)
        return ChunkMap(a.head, a.meets, a.count + n, leaves, (*a.whole, b) if a.meets >= 0 else ())

    def composed(self, maps: list[ChunkMap]) -> ChunkMap:
        """Neighbours are composed, then their maps, as a prefix scan does."""
        while len(maps) > 1:
            maps = [self.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def fresh(self) -> None:
        """Start tables anew that have grown large; ids of states are void then."""
        if len(self.keys) > MOST_STATES:
            self._reset()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
            self.spelt.clear()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        self.fresh()
        marked = MARK + text.replace(" ", MARK)
        return self.apply(self.start, self.composed([self.chunk(marked[i : i + CHUNK]) for i in range(0, len(marked), CHUNK)]))[1]

    def told(self, state: int) -> str:
        """A state for other workers, whose ids differ."""
        return json.dumps(self.keys[state], ensure_ascii=False) if state >= 0 else ""

    def heard(self, told: str) -> int:
        if not told:
            return -1
        text, before = json.loads(told)
        return self._id((text, tuple(map(tuple, before))))


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    """Compiled once in each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return CountTransducer({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))})


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row's whole text.

    Null text counts as empty: no bytes and no tokens. Every input row gives one
    row, repeated and null ids included; other columns are ignored, an empty
    table gives an empty result. The chunks of a text of over ``long``
    characters are dealt out, and their maps composed. ``model_path`` must exist
    on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.char_length("text") > long, F.lit(False))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [machine.count(t) for t in texts]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, row, t in zip(b["id"], b["row"], b["text"], strict=True):
                for k in range(0, len(t), CHUNK):
                    yield pd.DataFrame({"id": pd.Series([i], dtype=b["id"].dtype), "row": [row], "k": [k], "text": [t[k : k + CHUNK]]})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for b in batches:
            machine.fresh()
            maps = [machine.chunk((MARK if k == 0 else "") + t.replace(" ", MARK)) for k, t in zip(b["k"], b["text"], strict=True)]
            yield b[["id", "row", "k"]].assign(n_bytes=[len(t.encode("utf-8", "surrogatepass")) for t in b["text"]], head=[m.head for m in maps], meets=[machine.told(m.meets) for m in maps], count=[m.count for m in maps], leaves=[machine.told(m.leaves) for m in maps], whole=["".join(m.whole) for m in maps])

    def composed(p: pd.DataFrame) -> pd.DataFrame:
        machine = transducer(model_path)
        machine.fresh()
        p = p.sort_values("k")
        maps = [ChunkMap(h, machine.heard(m), int(c), machine.heard(x), (w,) if w else ()) for h, m, c, x, w in zip(p["head"], p["meets"], p["count"], p["leaves"], p["whole"], strict=True)]
        return p[["id"]].head(1).assign(n_bytes=int(p["n_bytes"].sum()), n_tokens=machine.apply(machine.start, machine.composed(maps))[1])

    counts = f"id {kind}, n_bytes long, n_tokens long"
    short = spread(rows.where(~is_long)).mapInPandas(counted, counts)
    cut = rows.where(is_long).withColumn("row", F.monotonically_increasing_id()).mapInPandas(chunks, f"id {kind}, row long, k long, text string")
    dealt = cut.repartition(partitions(docs.sparkSession), "row", "k").mapInPandas(mapped, f"id {kind}, row long, k long, n_bytes long, head string, meets string, count long, leaves string, whole string")
    out = short.unionByName(dealt.groupBy("row").applyInPandas(composed, counts))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
