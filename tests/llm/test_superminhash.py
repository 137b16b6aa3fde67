import re

import numpy as np
import pytest

from cubelark.llm import queries
from cubelark.llm import superminhash as S
from tests.llm.conftest import least_reachable


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))


def brute(rows):
    """(id, n, component, kept) over all pairs of different texts' sets."""
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = least_reachable(range(len(rows)), pairs)
    low = {}
    for k, (i, _) in enumerate(rows):
        known = [x for x in (low.get(label[k]), i) if x is not None]
        low[label[k]] = min(known, default=None)
    return [(i, len(s), i if not s else low[label[k]], None if i is None or (s and low[label[k]] is None) else not s or i == low[label[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, key int, node int, same string").write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op11_superminhash(spark, str(tmp_path)).collect()]


def near_copies(n, seed, words=400):
    """Texts with changes of any number of words, so similarities lie on both sides of the bound, in chains and groups."""
    rng = np.random.default_rng(seed)
    rows, bases = [], [rng.integers(0, words, rng.integers(2, 120)) for _ in range(n // 12 + 1)]
    for k in range(n):
        base = bases[rng.integers(len(bases))].copy()
        for p in rng.integers(0, len(base), rng.integers(0, max(2, len(base) // 5))):
            base[p] = rng.integers(0, words)
        rows.append((int(k * 31 % 10007), " ".join(f"W{w}" if w % 9 == 0 else f"w{w}" for w in base)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_brute_force(spark, tmp_path, seed):
    rows = near_copies(500, seed)
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_groups_of_a_shared_frame(spark, tmp_path):
    """All texts have most of their words in common, at similarities around the bound: buckets full of strangers."""
    rng = np.random.default_rng(3)
    frame = [f"f{k}" for k in range(60)]
    rows = [(k, " ".join(frame + [f"x{w}" for w in rng.integers(0, 10_000, rng.integers(5, 14))])) for k in range(150)]
    rows += [(1000 + k, t + " tail") for k, (_, t) in enumerate(rows[:40])]
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one two one two"), (8, "two one two"), (8, "two one two"), (9, "ÄB c"), (10, "äB c"), (11, "ÄB C"), (None, "one two"), (None, "alone here"), (None, None), (12, "word " * 200_000), (13, "x\x0by\x1cz"), (14, "x y\x1cz"), (12, "shared id other text")]
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def plain(elements, m):
    """The signature element by element, with all steps: what early stopping must not change."""
    out = [1 << 64] * m
    for x in elements.tolist():
        p = list(range(m))
        for j in range(m):
            draw = int(S.mixed(np.array([x + int(S._STEP) * (j + 1) & (1 << 64) - 1], np.uint64))[0])
            k = j + ((draw & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], (j << 32) | (draw >> 32))
    return out


def test_early_stopping_changes_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300)]
    expected = [plain(s, 32) for s in sets]
    assert S.signatures(sets, 32).tolist() == expected
    monkeypatch.setattr(S, "TOGETHER", 50)
    assert S.signatures(sets, 32).tolist() == expected


def test_values_agree_as_often_as_sets_are_similar():
    """Unbiased, and of lower variance than independent hashes have."""
    rng = np.random.default_rng(6)
    agree = []
    for _ in range(300):
        u = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = S.signatures([np.sort(u[:50]), np.sort(u[10:])])
        agree.append((a == b).mean())
    j = 40 / 60
    assert abs(np.mean(agree) - j) < 0.01 and np.var(agree) < 0.8 * j * (1 - j) / S.VALUES


def test_prefixes_meet():
    """Any two sets at the similarity show each other an element, at a position from which the rest can still reach it."""
    rng = np.random.default_rng(7)
    edges = S.size_edges(1 << 20)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        a = rng.permutation(200)[:n]
        b = np.unique(np.concatenate((a[rng.random(n) < 0.93], rng.integers(200, 400, rng.integers(0, n // 6 + 2)))))
        a, b = sorted(a.tolist()), sorted(b.tolist())
        both = len(set(a) & set(b))
        if not b or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        x, y = sorted((a, b), key=len)
        shows = lambda s, long: {(k, e, s.index(e)) for longer, k, length in S.prefixes(len(s), 80, edges) if longer == long for e in s[:length]}
        assert any(k == q and e == f and min(len(x) - i, len(y) - j) * 180 >= 80 * (len(x) + len(y)) for k, e, i in shows(x, False) for q, f, j in shows(y, True))
        met += 1
    assert met > 500
