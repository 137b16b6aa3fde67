"""Repeated passages by compact windows.

A text is the sequence of its word shingles' hashes. For a hash function, the
Cartesian tree over the hashes groups all subsequences of at least ``length``
words by their smallest element: a compact window (left, centre, right) stands
for all that begin at or after left, end at or before right, and hold the
centre. Two passages with many shingles in common share their smallest hash,
under each of several functions with a chance of their Jaccard similarity; equal
passages always do. Equal texts are taken together first: a copy is one passage.

Windows with the same smallest hash under the same function are joined where
their intervals, laid over each other at the centres, have a passage's length in
common. They are joined with the first of them, not with each other: a passage
that many documents share costs a link for each. The first of three or more may
have the centre but not the passage; so such windows meet twice more, where no passage
found by then accounts for them. Under one
function, which is enough for equal passages, each is taken apart into the exact
runs of a passage's length that it stands for, every one of which is equal to
the first with its key: no equal passage hides behind another. For changed ones
they meet by the smallest hashes, under two further functions, of the shingles
beside the centre, and are joined with the first that shares those too; and with
the first window of their key whose centre is in a passage found by then, which
the first of all may not be.

Links of two documents that enough functions agree on are verified together on
their whole sequences of words: equal stretches at the same distance are
measured, and around a link that no such stretch holds the best stretch of a
passage's length or more is searched, as far as it reaches in either text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.llm.common import batches_of, cut, discard, partitions, spread, written
from cubelark.llm.packed import dealt, mixed, places, unpacked

#: Words of a shingle, hash functions (16 at most), words of a passage at least, Jaccard similarity.
SHINGLE, FUNCTIONS, LENGTH, SIMILARITY = 5, 8, 50, 0.8
#: Functions that must agree on a link; further functions for what is beside a centre, and shingles there.
ENOUGH, FURTHER, BESIDE = 2, 2, 18
#: The number that stands for exact runs among the functions of a key; identifiers that are broadcast at most.
EXACT, FEW = 15, 1_000_000
#: Rows with whole sequences that a worker takes at once; turns in which pairs are verified, and in which windows meet, so that less of them lies on disk at a time.
BATCH, TURNS, MEETINGS = 1_000, 4, 4
#: Columns of packed rows: windows (key, id, at, left, right), the same with flags, links (id, first id, at, shift, function).
WINDOW = (np.uint64, np.int64, np.int32, np.int32, np.int32)
FLAGGED = (*WINDOW, np.uint8)
LINK = (np.int64, np.int64, np.int32, np.int32, np.uint8)
#: Flags of a window: it reaches out of what is found, its exact runs do, it lies in a found passage; all of its key are laid out as exact runs.
CHANGED, OPEN, PLACED, LAID = 1, 2, 4, 8
#: The code of a word that is not in the vocabulary; texts, and characters of each, that the vocabulary is taken from. It makes sequences shorter, whatever is in it.
UNKNOWN, VOCABULARY_TEXTS, VOCABULARY_CHARS = 65_535, 2_000, 20_000
#: Bytes of text that are worked on at once.
SLICE = 400_000
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"window %d" % i) | 1 for i in range(FUNCTIONS + FURTHER)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UP = _DOWN = np.ones(1, np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, parted by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Of each byte: its lower-case form plus one, or zero for ASCII white space.
_BYTES = np.array([0 if b in b" \t\n\x0b\x0c\r" else b + 1 + 32 * (65 <= b <= 90) for b in range(256)], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text: a polynomial of its bytes, from prefix sums over the whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return hashes_of(data, np.array([0, len(data)]))[0]


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts that lie one after the other, and the number of words of each."""
    values = _BYTES[data]
    inside = np.zeros(len(values) + 2, bool)
    inside[1:-1] = values > 0
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[first], ends[last] = inside[first + 1], inside[last + 1]  # no word goes on in the next text
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(len(values))
    sums = np.concatenate((np.zeros(1, np.uint64), (values * up).cumsum(dtype=np.uint64)))
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)), np.diff(np.searchsorted(starts, offsets))


def sliced(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of words of each row) of a column of texts, some rows at a time."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, *hashes_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes: differences of prefix sums, which are polynomials in an odd base, brought to the same power."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), (hashes * up).cumsum(dtype=np.uint64)))
    out = (sums[k:] - sums[:-k]) * down[:n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << int(n).bit_length()
        _UP, _DOWN = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _UP[:n], _DOWN[:n]


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, centre, right), ends inclusive, of the nodes of the Cartesian tree that span ``least`` elements or more; of equal values the first is the smaller."""
    out, stack = [], [(0, len(values))]
    while stack:
        a, b = stack.pop()
        if b - a < least:
            continue
        c = a + int(values[a:b].argmin())
        out.append((a, c, b - 1))
        stack += ((a, c), (c + 1, b))
    return out


def centres(values: np.ndarray, least: int) -> np.ndarray:
    """The centres of ``compact_windows``, ascending: the first smallest elements of all stretches of ``least`` elements."""
    n = len(values) - least + 1
    if n < 1:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    low = ((values >> bits) << bits) | np.arange(len(values), dtype=np.uint64)  # the place breaks ties and comes out with the minimum
    width = 1
    while width < least:
        step = min(width, least - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # never falls from one stretch to the next
    return place[np.concatenate(([True], place[1:] != place[:-1]))]


def windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) as arrays, by centre: what ``compact_windows`` finds, with a loop over the centres alone.

    The next smaller element on either side of a centre is a centre itself, and the tree over them is built as usual, with a stack.
    """
    c = centres(values, least)
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    low = (((values[c] >> bits) << bits) | c.astype(np.uint64)).tolist()
    at, right = c.tolist(), [len(values) - 1] * len(c)
    left, stack = [], []
    for k, v in enumerate(low):
        while stack and low[stack[-1]] > v:
            right[stack.pop()] = at[k] - 1
        left.append(at[stack[-1]] + 1 if stack else 0)
        stack.append(k)
    return np.array(left, np.int64), c, np.array(right, np.int64)


def smaller_beside(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest places before and after it with one that is not larger. The first and the last value, and each zero, have none: their entries mean nothing."""
    out = []
    for step in (-1, 1):
        place = np.arange(len(values)) + step
        at = np.flatnonzero(values[1:-1]) + 1
        while len(at):  # all between a value and its place are larger, so the place of the place is the next to look at
            at = at[values[place[at]] > values[at]]
            place[at] = place[place[at]]
        out.append(place)
    return out[0], out[1]


def all_windows(hashes: np.ndarray, counts: np.ndarray, length: int, shingle: int) -> list[np.ndarray]:
    """(key, text, at, left, right): ``windows`` of all texts under all functions at once, from their word hashes one after the other."""
    least, n = length - shingle + 1, len(hashes)
    ends = counts.cumsum()
    held = np.flatnonzero(counts >= length)
    if not len(held):
        return [np.empty(0, k) for k in WINDOW]
    base = runs(hashes, shingle)  # those over the end of a text are not looked at
    bits = np.uint64(n.bit_length())
    mask, place = (np.uint64(1) << bits) - np.uint64(1), np.arange(len(base), dtype=np.uint64)
    first, after = (ends - counts)[held], ends[held] - shingle + 1  # of the shingles of a text
    usable = np.zeros(len(base) + 1, np.int8)
    np.add.at(usable, first, 1)
    np.add.at(usable, after - least + 1, -1)
    usable = np.flatnonzero(usable.cumsum(dtype=np.int8)[: len(base) - least + 1])
    out = []
    for j in range(FUNCTIONS):  # a key's last four bits are its function
        values = base * _MULTIPLIERS[j]
        values ^= values >> np.uint64(31)
        low = ((values >> bits) << bits) | place  # the place breaks ties and comes out with the minimum
        width = 1
        while width < least:
            step = min(width, least - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        low = low[usable]
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        c = (low & mask).astype(np.int64)
        text = np.searchsorted(ends, c, "right")
        new = np.concatenate(([True], text[1:] != text[:-1]))
        own = np.arange(len(c)) + new.cumsum()  # a zero before each text and after the last
        tree = np.zeros(len(c) + int(new.sum()) + 1, np.uint64)
        tree[own] = low
        before, behind = smaller_beside(tree)
        to_left, to_right = np.empty(len(tree), np.int64), np.empty(len(tree), np.int64)
        zeros = np.append(own[new] - 1, len(tree) - 1)
        to_left[zeros[:-1]], to_right[zeros[1:]] = first - 1, after
        to_left[own] = to_right[own] = c
        start = (ends - counts)[text]
        key = (values[c] * _MULTIPLIERS[j] & ~np.uint64(15)) | np.uint64(j)
        out.append((key, text, c - start, to_left[before[own]] + 1 - start, to_right[behind[own]] - 1 - start))
    return [np.concatenate([o[k] for o in out]).astype(t) for k, t in enumerate(WINDOW)]


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Of each value whether it is among the sorted ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def coded(hashes: np.ndarray, vocabulary: np.ndarray) -> bytes:
    """Words as two bytes each, their places in the vocabulary, and after them those that are not in it; before them their number."""
    known = among(hashes, vocabulary)
    codes = np.where(known, np.searchsorted(vocabulary, hashes), UNKNOWN).astype("<u2")
    return np.array([len(hashes)], "<u4").tobytes() + codes.tobytes() + hashes[~known].astype("<u4").tobytes()


def decoded(blob: pa.Buffer, vocabulary: np.ndarray) -> np.ndarray:
    """``vocabulary`` with UNKNOWN + 1 entries, the last ones of which mean nothing."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    codes, rest = np.frombuffer(blob, "<u2", n, 4), np.frombuffer(memoryview(blob)[4 + 2 * n :], "<u4")
    out = vocabulary[codes]
    out[codes == UNKNOWN] = rest
    return out


def grouped(*columns: np.ndarray) -> np.ndarray:
    """Of rows in order of these columns, where each group of equal ones begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def met(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The windows of keys that several have, by key and place; of each the first of its key, and how many its key has."""
    order = np.argsort(columns[0])
    key = columns[0][order]
    starts = grouped(key)
    some = order[np.repeat(np.diff(starts, append=len(key)) > 1, np.diff(starts, append=len(key)))]
    columns = [c[some] for c in columns]
    order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    starts = grouped(columns[0])
    number = np.diff(starts, append=len(order))
    return columns, np.repeat(starts, number), np.repeat(number, number)


def links_between(columns: list[np.ndarray], first: list[np.ndarray], common_least: int) -> list[np.ndarray]:
    """The interval join: windows with the first ones beside them, where what both span at one distance is as long as a passage with changes."""
    (key, i, at, left, right), (first_id, first_at, first_left, first_right) = columns[:5], first[1:5]
    shift = at - first_at
    common = np.minimum(right, first_right + shift) - np.maximum(left, first_left + shift) + 1
    some = ((i != first_id) | (at != first_at)) & (common >= common_least)
    return [i[some], first_id[some], at[some], shift[some], (key[some] & np.uint64(15)).astype(np.uint8)]


def pairs_of(links: list[np.ndarray], anchors: list[np.ndarray], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(id, first id, low, high, shift, functions as bits), where each pair begins. Of links of two documents at one distance, the first and the last of each part of ``least`` positions are on all passages that reach into it.

    ``anchors`` are such rows of links known before; pairs without other links are left out, unless there are only such.
    """
    i, first_id, at, shift, function = links
    columns = [np.concatenate(c) for c in zip((i, first_id, at, at, shift, np.left_shift(1, function.astype(np.int32), dtype=np.int32)), anchors, strict=True)]
    new = np.arange(len(columns[0])) < len(i)
    part = columns[2] // least
    order = np.lexsort((part, columns[4], columns[1], columns[0]))
    columns, part, new = [c[order] for c in columns], part[order], new[order]
    starts = grouped(columns[0], columns[1], columns[4], part)
    if not len(starts):
        return columns, starts
    i, first_id, shift = (columns[k][starts] for k in (0, 1, 4))
    columns = [i, first_id, np.minimum.reduceat(columns[2], starts), np.maximum.reduceat(columns[3], starts), shift, np.bitwise_or.reduceat(columns[5], starts)]
    new, pairs = np.logical_or.reduceat(new, starts), grouped(i, first_id)
    wanted = np.repeat(np.logical_or.reduceat(new, pairs), np.diff(pairs, append=len(i)))
    columns = [c[wanted] for c in columns]
    return columns, grouped(columns[0], columns[1])


class Ranges:
    """Ranges [start, end) of texts, to be asked whether one of them holds another range."""

    def __init__(self, i: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.texts = distinct(i)
        text = np.searchsorted(self.texts, i) << 32
        order = np.argsort(text | start)
        self.starts, self.ends = (text | start)[order], np.maximum.accumulate((text | end)[order])

    def inside(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not len(self.texts):
            return np.zeros(len(i), bool)
        text = np.searchsorted(self.texts, i)
        known = among(i, self.texts)
        at = np.searchsorted(self.starts, (text << 32) | low, "right") - 1
        end = self.ends[np.maximum(at, 0)]
        return known & (at >= 0) & (end >> 32 == text) & (end & 0xFFFFFFFF >= high)


def flagged(columns: list[np.ndarray], found: Ranges, length: int, shingle: int) -> list[np.ndarray]:
    """Windows with what the found passages say of them, without those of which nothing follows."""
    key, i, at, left, right = columns
    at, left, right, least, one = at.astype(np.int64), left.astype(np.int64), right.astype(np.int64), length - shingle + 1, key & np.uint64(15) == 0
    flags = ~found.inside(i, np.maximum(left, at - length), np.minimum(right, at + length) + shingle) * np.uint8(CHANGED)
    flags |= (one & ~found.inside(i, np.maximum(left, at - least + 1), np.minimum(at, right - least + 1) + length)) * np.uint8(OPEN)
    flags |= found.inside(i, at, at + shingle) * np.uint8(PLACED)
    some = one | (flags > 0)
    return [c[some] for c in (*columns, flags)]


def laid_out(columns: list[np.ndarray], common_least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of flagged windows of whole keys: links of the changed ones with the first of their key in a found passage, and those that meet others once more.

    Exact runs are laid out for all windows of a key where any of them has a run that is not inside.
    """
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    key, flags = columns[0], columns[5]
    if not len(key):
        return [np.empty(0, k) for k in LINK], columns
    starts = grouped(key)
    number = np.diff(starts, append=len(key))
    is_open = np.repeat(np.bitwise_or.reduceat(flags, starts) & OPEN > 0, number)
    place = np.repeat(np.minimum.reduceat(np.where(flags & PLACED > 0, np.arange(len(key)), len(key)), starts), number)
    some = (flags & CHANGED > 0) & (place < len(key))
    links = links_between([c[some] for c in columns], [c[place[some]] for c in columns], common_least)
    flags = (flags & CHANGED) | (is_open * np.uint8(LAID))
    return links, [c[flags > 0] for c in (*columns[:5], flags)]


def beside(columns: list[np.ndarray], texts: np.ndarray, hashes: np.ndarray, counts: np.ndarray, length: int, shingle: int) -> list[np.ndarray]:
    """The changed windows of texts once more, with the smallest hashes on either side in their keys; those to be laid out as the exact runs of a passage's length that they stand for. ``texts`` has the row of each window's text."""
    key, i, at, left, right, flags = columns
    least, start, found = length - shingle + 1, (counts.cumsum() - counts)[texts], []
    c, base = at.astype(np.int64), runs(hashes, shingle)
    laid = np.flatnonzero(flags & LAID)
    if len(laid):
        low, high = np.maximum(left[laid], c[laid] - least + 1).astype(np.int64), np.minimum(c[laid], right[laid] - least + 1)
        number = high - low + 1
        starts = np.repeat(low - (number.cumsum() - number), number) + np.arange(number.sum())
        exact = runs(hashes, length)[starts + np.repeat(start[laid], number)]
        found.append(((exact & ~np.uint64(15)) | np.uint64(EXACT), np.repeat(i[laid], number), starts, starts, starts + least - 1))
    some = np.flatnonzero(flags & CHANGED)
    if len(some):
        key, i, c, left, right, start, last = key[some], i[some], c[some], left[some], right[some], start[some], (counts[texts[some]] - shingle + 1) - BESIDE
        for j in range(FUNCTIONS, FUNCTIONS + FURTHER):
            low = base * _MULTIPLIERS[j]
            low ^= low >> np.uint64(29)
            width = 1
            while width < BESIDE:
                step = min(width, BESIDE - width)
                low = np.minimum(low[: len(low) - step], low[step:])
                width += step
            for side, where in ((1, c - BESIDE), (2, c + 1)):
                fits = np.flatnonzero((where >= 0) & (where <= last))
                both = (key[fits] ^ (low[(where + start)[fits]] * np.uint64(2 * j + side))) * _MULTIPLIERS[j]
                both ^= both >> np.uint64(32)
                found.append((((both * _MULTIPLIERS[0]) & ~np.uint64(15)) | (key[fits] & np.uint64(15)), i[fits], c[fits], left[fits], right[fits]))
    return [np.concatenate([np.empty(0, t), *(f[k].astype(t) for f in found)]).astype(t) for k, t in enumerate(WINDOW)]


class Membership:
    """For the shingles of a text, whether another text has them: prefix sums of 1 for those it has and -cost for the others."""

    def __init__(self, own: np.ndarray, other: np.ndarray, cost: float):
        self.own = own
        sums = self.sums = np.concatenate(([0.0], np.where(among(own, np.sort(other)), 1.0, -cost).cumsum()))
        place = np.arange(len(sums))
        lowest, highest = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
        self.lowest = np.maximum.accumulate(np.where(np.concatenate(([True], sums[1:] < lowest[:-1])), place, 0))  # first place of the smallest sum up to each place
        self.highest = np.minimum.accumulate(np.where(np.concatenate((sums[:-1] > highest[1:], [True])), place, len(sums))[::-1])[::-1]  # last place of the largest from each place

    def stretches(self, centres: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretches [a, b) around ``centres`` with the largest sum; where that is short of ``least``, the one with the largest sum of those that are not, or [0, 0) if that sum is negative."""
        sums, n = self.sums, len(self.sums) - 1
        a, b = self.lowest[centres], self.highest[centres]
        if n < least:
            return a, b
        short = np.flatnonzero(b - a < least)
        for k in range(0, len(short), 4096):
            some = short[k : k + 4096]
            c = centres[some][:, None]
            low, starts = np.maximum(0, c - least), c - least + np.arange(least + 1)
            fits = (starts >= low) & (starts <= np.minimum(c, n - least))
            starts = np.clip(starts, 0, n - least)
            begins = np.where(starts == low, self.lowest[starts], starts)  # of all that begin further to the left
            ends = self.highest[np.maximum(c, starts + least)]
            gain = np.where(fits, sums[ends] - sums[begins], -np.inf)
            best = gain.argmax(1)
            rows, good = np.arange(len(some)), gain.max(1) >= 0
            a[some], b[some] = np.where(good, begins[rows, best], 0), np.where(good, ends[rows, best], 0)
        return a, b


def equal_stretches(own: list[np.ndarray], other: list[np.ndarray], pair: np.ndarray, shift: np.ndarray, length: int) -> list[np.ndarray]:
    """(row, start, end): stretches of ``length`` equal words or more in two texts of a pair that lie ``shift`` apart, as word ranges in the first; rows are those of ``pair`` and ``shift``, ascending."""
    out, a = [], 0
    starts = np.maximum(0, shift)
    sizes = np.array([min(len(own[p]) - s, len(other[p]) - s + d) for p, d, s in zip(pair.tolist(), shift.tolist(), starts.tolist(), strict=True)], np.int64)
    before = np.concatenate(([0], (sizes + 1).cumsum()))
    while a < len(pair):
        b = max(a + 1, int(np.searchsorted(before, before[a] + 10 * SLICE, "right")) - 1)
        at = before[a : b + 1] - before[a] + 1
        flat = np.zeros(int(at[-1]) + 1, bool)  # parted by one word that is not equal
        for p, d, s, n, k in zip(pair[a:b].tolist(), shift[a:b].tolist(), starts[a:b].tolist(), sizes[a:b].tolist(), at.tolist()):
            np.equal(own[p][s : s + n], other[p][s - d : s - d + n], out=flat[k : k + n])
        edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
        edges = edges.reshape(-1, 2)[np.diff(edges)[::2] >= length]
        row = np.searchsorted(at, edges[:, 0], "right") - 1
        out.append((a + row, *(edges - (at[row] - starts[a + row])[:, None]).T))
        a = b
    return [np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in range(3)]


def verified(own: list[np.ndarray], other: list[np.ndarray], links: list[np.ndarray], same: list[bool], shingle: int, length: int, similarity: float) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of pairs of texts, as words, the word ranges in both of their common passages at the links: rows (low, high, shift, functions as bits) of each pair."""
    number = np.array([len(r) for r in links], np.int64)
    low, high, shift, functions = (c.astype(np.int64) for c in np.concatenate([np.empty((0, 4), np.int32), *links]).T)
    pair, at = np.tile(np.repeat(np.arange(len(links)), number), 2), np.concatenate((low, high))
    shift, functions = np.tile(shift, 2), np.tile(functions, 2)
    order = np.lexsort((shift, pair))
    new = grouped(pair[order], shift[order])
    row = np.empty(len(order), np.int64)
    row[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(order)))
    shifts = shift[order][new]
    of, start, end = equal_stretches(own, other, pair[order][new], shifts, length)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for p, a, b, d in zip(pair[order][new][of].tolist(), start.tolist(), end.tolist(), shifts[of].tolist(), strict=True):
        found.setdefault(p, []).append((a, b, a - d, b - d))
    order = np.lexsort((functions, at - shift, at, pair))
    pair, at, shift, functions, row = (c[order] for c in (pair, at, shift, functions, row))
    rest = ~Ranges(of, start, end).inside(row, at, at + 1)
    to, bits, step = at - shift, functions.copy(), 1
    k = np.arange(len(at))
    while len(k := k[k + step < len(at)]):  # functions of the links nearby
        k = k[(pair[k + step] == pair[k]) & (at[k + step] - at[k] <= length)]
        near = k[np.abs(to[k + step] - to[k]) <= length]
        bits[near] |= functions[near + step]
        bits[near + step] |= functions[near]
        step += 1
    some = np.flatnonzero(rest & (np.bitwise_count(bits) >= ENOUGH))
    least, edges = length - shingle + 1, [*grouped(pair[some]).tolist(), len(some)]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        p = int(pair[some[first]])
        anchors = [t for t in dict.fromkeys(zip(at[some[first:last]].tolist(), to[some[first:last]].tolist(), strict=True)) if not any(a <= t[0] < b and c <= t[1] < d for a, b, c, d in found.get(p, ()))]
        if anchors:
            changed = changed_passages(own[p].astype(np.uint64), other[p].astype(np.uint64), anchors, shingle, least, similarity, same[p])
            if changed:
                found.setdefault(p, []).extend(changed)
    return found


def changed_passages(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]], shingle: int, least: int, similarity: float, same: bool) -> list[tuple[int, int, int, int]]:
    """Word ranges in x and y around the anchors (shingle position in x, in y) with enough shingles in common."""
    u, v, cost = runs(x, shingle), runs(y, shingle), similarity / max(1e-9, 1 - similarity)
    of_x, of_y = Membership(u, v, cost), Membership(v, u, cost)
    found: list[tuple[int, int, int, int]] = []
    tried = set()
    at, to = np.array(anchors, np.int64).T
    starts, ends = of_x.stretches(at, least)
    k = np.flatnonzero(ends - starts >= least)
    first_starts, first_ends = of_y.stretches(to[k], least)
    some = first_ends - first_starts >= least
    k = k[some]
    for a, b, a0, a1, b0, b1 in zip(*(c.tolist() for c in (at[k], to[k], starts[k], ends[k], first_starts[some], first_ends[some])), strict=True):
        if (a0, a1, b0, b1) in tried or any(p <= a < q and r <= b < t for p, q, r, t in found) or (same and a0 < b1 + shingle and b0 < a1 + shingle):
            continue
        tried.add((a0, a1, b0, b1))
        p, q = distinct(u[a0:a1]), distinct(v[b0:b1])
        both = int(among(p, q).sum())
        if both and both >= similarity * (len(p) + len(q) - both) - 1e-9:
            found.append((a0, a1 + shingle - 1, b0, b1 + shingle - 1))
    return found


def joined(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, place): ranges that touch become one, with the smallest place."""
    out: list[tuple[int, int, int]] = []
    for a, b, place in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), min(place, out[-1][2]))
        else:
            out.append((a, b, place))
    return out


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: Spark removes them when the driver collects its garbage, which may be never in a short job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_passages(docs: DataFrame, length: int = LENGTH, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, first_id, first_start, is_first): passages of at least ``length`` words that another place has too, as word ranges [start, end).

    ``first_id`` and ``first_start`` are the place that the passage is linked
    to, the smallest (id, position) of those that share a window with it; each
    such place is itself given once with ``is_first``. Ranges that touch and
    have the same first document are one. Passages that repeat inside one
    document count as well. A document whose words equal another's throughout is
    one passage of its whole length, linked to the one with the smallest id, and
    has no other row. Null and short texts have none. Ids must be long
    and not null; repeated rows of an id count as one text, other columns are
    ignored, an empty table gives an empty result.
    """
    least = length - shingle + 1
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    spark = docs.sparkSession
    parts = partitions(spark)
    place = places(spark, parts)
    common_least = int(least * similarity)
    by_key = lambda key: place[(key >> np.uint64(32)) % np.uint64(parts)]
    by_id = lambda i: place[mixed(i) % np.uint64(parts)]
    by_pair = lambda i, first: place[mixed(i, first) % np.uint64(parts)]

    some_texts = [r["text"] for r in texts.select(F.substring("text", 1, VOCABULARY_CHARS).alias("text")).limit(VOCABULARY_TEXTS).collect()]
    seen_words = [(hashes >> np.uint64(32)).astype("<u4") for _, hashes, _ in sliced(pa.array(some_texts, pa.string()))]
    values, number = np.unique(np.concatenate([np.empty(0, "<u4"), *seen_words]), return_counts=True)
    vocabulary = np.sort(values[np.argsort(-number, kind="stable")[:UNKNOWN]])
    padded = np.append(vocabulary, np.zeros(UNKNOWN + 1 - len(vocabulary), "<u4"))

    def blobs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Buffer]:
        return (b.as_buffer() for batch in batches for b in batch.column(name) if b.is_valid)

    def rows_of(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def dealt_rows(schema: pa.Schema, name: str, part: np.ndarray, columns: list[np.ndarray], **others: object) -> Iterator[pa.RecordBatch]:
        """The rows packed, a blob for each part."""
        found = [*dealt(part, columns)]
        for k in range(0, len(found), 1000):
            to, blob = zip(*found[k : k + 1000], strict=True)
            yield rows_of(schema, **{f.name: [others.get(f.name)] * len(to) for f in schema} | {"to": list(to), name: list(blob)})

    turns = [f"turn{k}" for k in range(MEETINGS)]
    of_nodes = pa.schema([("to", pa.int32()), *((t, pa.binary()) for t in turns)])
    of_windows = pa.schema([("key", pa.int32()), ("to", pa.int32()), ("links", pa.binary()), ("windows", pa.binary())])
    of_blobs = pa.schema([("to", pa.int32()), ("links", pa.binary()), ("windows", pa.binary())])
    of_pairs = pa.schema([("to", pa.int32()), ("id", pa.int64()), ("first_id", pa.int64()), ("anchors", pa.binary())])
    of_texts = pa.schema([("to", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows, a row for each part of the keys, a column for each turn."""
        for whole in batches:
            ids, found = whole.column(0).to_numpy(), []
            for k, hashes, counts in sliced(whole.column(1)):
                key, text, *ends = all_windows(hashes, counts, length, shingle)
                found.append((key, ids[k + text], *ends))
            if not found:
                continue
            columns = [np.concatenate([f[k] for f in found]) for k in range(len(WINDOW))]
            order = np.lexsort((columns[2], columns[1]))  # rows of a text side by side pack better
            columns = [c[order] for c in columns]
            rows: dict[int, list] = {}
            turn = (columns[0] >> np.uint64(4)) % np.uint64(MEETINGS)
            part = ((columns[0] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            for code, blob in dealt((part * MEETINGS + turn.astype(np.int64)).astype(np.uint16 if parts * MEETINGS < 1 << 16 else np.int64), columns):
                rows.setdefault(code // MEETINGS, [None] * MEETINGS)[code % MEETINGS] = blob
            yield rows_of(of_nodes, to=[int(place[p]) for p in rows], **{t: [r[k] for r in rows.values()] for k, t in enumerate(turns)})

    def meet(turn: int | None):
        """Windows of a part of the keys: links with the first of each key, and those whose key has three or more."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [*batches]
            columns, first, number = met(unpacked([*blobs(batches, "windows")], WINDOW))
            if not len(first):
                return
            links = links_between(columns, [c[first] for c in columns], common_least)
            own = None if turn is None else MEETINGS * int(next(b.column(0)[0] for b in batches if b.num_rows).as_py()) + turn
            schema = of_blobs if turn is None else of_windows
            yield from dealt_rows(schema, "links", by_pair(links[0], links[1]), links, key=own)
            if turn is not None:
                doubtful = [c[number > 2] for c in columns]
                yield from dealt_rows(schema, "windows", by_id(doubtful[1]), doubtful, key=own)

        return run

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [*batches]
        known = [(*r, a.as_buffer()) for b in batches for *r, a in zip(b.column("id").to_pylist(), b.column("first_id").to_pylist(), b.column("anchors"), strict=True) if a.is_valid]
        number = np.array([len(a) // 16 for _, _, a in known], np.int64)
        rows = np.frombuffer(b"".join(a for _, _, a in known), np.int32).reshape(-1, 4)
        ids = [np.repeat(np.array([r[k] for r in known], np.int64), number) for k in (0, 1)]
        columns, starts = pairs_of(unpacked([*blobs(batches, "links")], LINK), [*ids, *rows.T], least)
        anchors, ends = np.stack(columns[2:], 1), np.append(starts[1:], len(columns[0]))
        i, first = columns[0][starts], columns[1][starts]
        to = by_pair(i, first)
        for k in range(0, len(starts), 10_000):
            some = slice(k, k + 10_000)
            yield rows_of(of_pairs, to=to[some], id=i[some], first_id=first[some], anchors=[anchors[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Doubtful windows of some texts, beside the passages found in them."""
        batches = [*batches]
        known = [b.filter(b.column("id").is_valid()) for b in batches]
        found = Ranges(*(np.concatenate([np.empty(0, np.int64), *(b.column(c).to_numpy() for b in known)]).astype(np.int64) for c in ("id", "start", "end")))
        columns = flagged(unpacked([*blobs(batches, "windows")], WINDOW), found, length, shingle)
        yield from dealt_rows(of_blobs, "windows", by_key(columns[0]), columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(by_id(b.column(0).to_numpy())), pa.nulls(b.num_rows, pa.binary()), *b.columns], names=["to", "windows", "id", "start", "end"])

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, columns = laid_out(unpacked([*blobs(batches, "windows")], FLAGGED), common_least)
        yield from dealt_rows(of_blobs, "links", by_pair(links[0], links[1]), links)
        yield from dealt_rows(of_blobs, "windows", by_id(columns[1]), columns)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Left over windows of some texts, with the texts."""
        batches = [*batches]
        columns = unpacked([*blobs(batches, "windows")], FLAGGED)
        order = np.argsort(columns[1], kind="stable")
        columns = [c[order] for c in columns]
        some = distinct(columns[1])
        wanted = set(some.tolist())
        sequences = {i: decoded(w.as_buffer(), padded) for b in batches for i, w in zip(b.column("id").to_pylist(), b.column("words"), strict=True) if i in wanted}
        sizes, a = np.array([len(sequences[i]) for i in some.tolist()], np.int64), 0
        before = np.concatenate(([0], sizes.cumsum()))
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(before, before[a] + SLICE, "right")) - 1)
            low, high = np.searchsorted(columns[1], some[a]), np.searchsorted(columns[1], some[b - 1], "right")
            own = [c[low:high] for c in columns]
            hashes = np.concatenate([sequences[i] for i in some[a:b].tolist()]).astype(np.uint64)
            found = beside(own, np.searchsorted(some[a:b], own[1]), hashes, sizes[a:b], length, shingle)
            yield from dealt_rows(of_blobs, "windows", by_key(found[0]), found)
            a = b

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own = [words(t.as_py()) for t in whole.column(1)]
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in own], pa.binary()), pa.array([len(w) for w in own], pa.int32())], names=["id", "same", "n"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column(0).to_numpy()
            for k, hashes, counts in sliced(whole.column(1)):
                short, ends = (hashes >> np.uint64(32)).astype("<u4"), counts.cumsum()
                held = np.flatnonzero(counts >= length)
                i = ids[k + held]
                yield rows_of(of_texts, to=by_id(i), id=i, n=counts[held].astype(np.int32), words=[coded(short[e - n : e], vocabulary) for e, n in zip(ends[held].tolist(), counts[held].tolist(), strict=True)])

    with batches_of(spark, BATCH):
        known = written(spread(texts).mapInArrow(digests, "id long, same binary, n int").where(F.col("n") >= length), "digests")
    classes = cut(known.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("same", "rep"))
    copies = written(known.join(classes, "same").where("id <> rep").select("id", "rep", "n").distinct(), "copies")
    discard(known, classes)
    gone = copies.select("id")
    texts = texts.join(F.broadcast(gone) if copies.count() <= FEW else gone, "id", "left_anti")
    released(spark)
    with batches_of(spark, BATCH):
        every = written(spread(texts).mapInArrow(nodes, "to int, " + ", ".join(f"{t} binary" for t in turns)), "nodes")
    met_turns = []
    for turn in range(MEETINGS):
        some = every.select("to", F.col(turns[turn]).alias("windows")).where("windows IS NOT NULL")
        met_turns.append(written(some.repartition(parts, "to").mapInArrow(meet(turn), "key int, to int, links binary, windows binary"), "windows"))
        released(spark)
    discard(every)
    keyed = reduce(DataFrame.unionByName, met_turns)
    nothing = lambda kind: F.lit(None).cast(kind)
    links = written(keyed.select("to", "links").where("links IS NOT NULL").withColumns({"id": nothing("long"), "first_id": nothing("long"), "anchors": nothing("binary")}).repartition(parts, "to").mapInArrow(paired, "to int, id long, first_id long, anchors binary"), "links")
    with batches_of(spark, BATCH):
        held = written(spread(texts).mapInArrow(sequences, "to int, id long, n int, words binary"), "sequences")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs, and each sequence that any of them needs, once."""
        pairs, sequence = [], {}
        for b in batches:
            for i, first, links, words in zip(b.column("id").to_pylist(), b.column("first_id").to_pylist(), b.column("anchors"), b.column("words"), strict=True):
                if first is None:
                    sequence[i] = decoded(words.as_buffer(), padded)
                else:
                    pairs.append((i, first, np.frombuffer(links.as_buffer(), np.int32).reshape(-1, 4).copy()))
        for k in range(0, len(pairs), BATCH):
            ids, firsts, links = zip(*pairs[k : k + BATCH], strict=True)
            found = verified([sequence[i] for i in ids], [sequence[i] for i in firsts], list(links), [i == first for i, first in zip(ids, firsts, strict=True)], shingle, length, similarity)
            rows = []
            for p, pair in found.items():
                rows += [(ids[p], a, b, firsts[p], at, False) for a, b, at in joined([(p, q, u) for p, q, u, _ in pair])]
                rows += [(firsts[p], a, b, firsts[p], a, True) for a, b, _ in joined([(u, v, u) for _, _, u, v in pair])]
            if rows:
                yield rows_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    schema = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first_id", pa.int64()), ("first_start", pa.int32()), ("is_first", pa.bool_())])

    def passages_of(links: DataFrame) -> DataFrame:
        sizes = held.select("id", "n")
        turned = F.col("n") > F.col("first_n")  # the shorter sequence travels to the longer one
        pairs = cut(links.join(sizes, "id").join(sizes.select(F.col("id").alias("first_id"), F.col("n").alias("first_n")), "first_id").select("id", "first_id", "anchors", F.when(turned, F.col("first_id")).otherwise(F.col("id")).alias("short"), F.when(turned, F.col("id")).otherwise(F.col("first_id")).alias("long")))
        released(spark)
        # Pairs of a text that has very many are dealt out in parts, by the other text.
        many = pairs.groupBy("long").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64("long", F.pmod(F.xxhash64("short"), F.coalesce("parts", F.lit(1)))), F.lit(parts)) + 1
        spread_out = cut(pairs.join(many, "long", "left").select("id", "first_id", "anchors", "short", "long", F.element_at(F.lit(place.tolist()), part.cast("int")).alias("to"), F.pmod(F.xxhash64("long", F.lit(1)), F.lit(TURNS)).cast("int").alias("turn")))
        found = None
        for turn in range(TURNS):  # not all pairs at once
            mine = spread_out.where(F.col("turn") == turn)
            needed = mine.select("to", F.col("short").alias("id")).union(mine.select("to", "long")).distinct()
            travel = held.select("id", "words").join(needed.hint("shuffle_hash"), "id").select("to", "id", nothing("long").alias("first_id"), nothing("binary").alias("anchors"), "words")
            both = mine.select("to", "id", "first_id", "anchors", nothing("binary").alias("words")).unionByName(travel).repartition(parts, "to")
            with batches_of(spark, BATCH):
                some = cut(both.mapInArrow(verify, "id long, start int, end int, first_id long, first_start int, is_first boolean").distinct())
            found = some if found is None else found.unionByName(some)
            del mine, needed, travel, both
            released(spark)
        discard(spread_out)
        discard(pairs)
        return found

    released(spark)
    found = passages_of(links)
    released(spark)
    # Doubtful windows that what is found so far does not account for. One that reaches out of it meets others once more.
    ranges = found.select("id", "start", "end").distinct().mapInArrow(placed, "to int, windows binary, id long, start int, end int")
    doubtful = keyed.select("to", "windows").where("windows IS NOT NULL").withColumns({c: nothing(kind) for c, kind in (("id", "long"), ("start", "int"), ("end", "int"))}).unionByName(ranges)
    beyond = doubtful.repartition(parts, "to").mapInArrow(seen, "to int, links binary, windows binary").repartition(parts, "to").mapInArrow(left_over, "to int, links binary, windows binary")
    beyond = written(beyond, "doubtful")
    discard(*met_turns)
    released(spark)
    both = beyond.select("to", "windows").where("windows IS NOT NULL").withColumns({"id": nothing("long"), "words": nothing("binary")}).unionByName(held.select("to", nothing("binary").alias("windows"), "id", "words"))
    with batches_of(spark, BATCH):
        further = written(both.repartition(parts, "to").mapInArrow(again, "to int, links binary, windows binary").repartition(parts, "to").mapInArrow(meet(None), "to int, links binary, windows binary"), "beside")
    further = beyond.select("to", "links").where("links IS NOT NULL").unionByName(further.select("to", "links")).withColumns({"id": nothing("long"), "first_id": nothing("long"), "anchors": nothing("binary")})
    more = written(further.unionByName(links.select("to", nothing("binary").alias("links"), "id", "first_id", "anchors")).repartition(parts, "to").mapInArrow(paired, "to int, id long, first_id long, anchors binary"), "links")
    released(spark)
    found = found.unionByName(passages_of(more)).distinct()
    discard(links, more, beyond, held)
    whole_text = lambda c, is_first: copies.select(F.col(c).alias("id"), F.lit(0).alias("start"), F.col("n").alias("end"), F.col("rep").alias("first_id"), F.lit(0).alias("first_start"), F.lit(is_first).alias("is_first"))
    found = found.unionByName(whole_text("id", False)).unionByName(whole_text("rep", True).distinct())
    return merged(found).withColumnRenamed("id", id_col)


def merged(found: DataFrame) -> DataFrame:
    """Ranges of a document that have the same first document become one where they touch, with the smallest first place. First places are found from many others, so they are aggregated before."""
    rows = found.groupBy("id", "first_id", "is_first", "start").agg(F.max("end").alias("end"), F.min("first_start").alias("first_start"))  # no more than the words of a text
    own = Window.partitionBy("id", "first_id", "is_first").orderBy("start", "end")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(own))
    return rows.groupBy("id", "first_id", "is_first", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_start").alias("first_start")).select("id", "start", "end", "first_id", "first_start", "is_first")
