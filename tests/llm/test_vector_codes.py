import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubelark.llm import queries, vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, c0 int, code int, _by int"


def brute(rows):
    """Plain Lloyd rounds in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // 16
    cut = [[v[p * w : (p + 1) * w] for p in range(16)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:64]] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(2):
        got = assign()
        for p in range(16):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in g), e, by[label], sha) for (i, _, label), g, e in zip(kept, got, errors, strict=True)]


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in queries.op12_vector_codes(spark, str(tmp_path)).collect()]


def vectors(n, seed, coarse=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 32)) * 0.3
    return (np.round(v * 2) / 2 if coarse else v).astype(np.float32).tolist()


@pytest.mark.parametrize("n, coarse", [(40, False), (300, False), (300, True)])
def test_codes_brute_force(spark, tmp_path, n, coarse):
    """Coarse vectors have ties at every entry."""
    rows = [(7 * k % 997, v, None if k % 5 == 0 else k % 3) for k, v in enumerate(vectors(n, n, coarse))]
    rows[3] = (rows[3][0], None, 1)
    rows[4] = (rows[4][0], [float("nan")] * 32, 1)
    rows[5] = (rows[5][0], [None] + [0.0] * 31, 1)
    rows[6] = (rows[6][0], [float("inf")] + [0.0] * 31, 1)
    rows += [rows[8]] * 3 + [(None, rows[9][1], 2)]
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_codes_of_nothing_and_of_other_lengths(spark, tmp_path):
    assert found(spark, [(1, None, 1), (2, [], 1)], tmp_path / "a") == []
    rows = [(k, v, 1) for k, v in enumerate(vectors(20, 1))]
    odd = [(90, [0.5] * 16, 1), (91, [0.5] * 5, 1), (92, [], 1)]
    assert sorted(found(spark, rows + odd, tmp_path / "b")) == sorted(brute(rows))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 12), st.integers(1, 4), st.integers(1, 5))
def test_active_entries_agree_with_a_rescan(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (50, width))
    before = rng.integers(-spread, spread + 1, (k, width))
    moved = rng.random(k) < 0.4
    after = np.where(moved[:, None], rng.integers(-spread, spread + 1, (k, width)), before)
    moved = (after != before).any(axis=1)
    code, d = V.rescanned(x, before)
    a, b = V.rescanned(x, after), V.reassigned(x, code, d, after, moved)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_distances_are_exact_for_large_components():
    x, e = np.array([[V.LARGEST - 1, -V.LARGEST + 1]]), np.array([[-V.LARGEST + 1, V.LARGEST - 1], [V.LARGEST - 2, -V.LARGEST + 1]])
    assert V.distances(x, e).tolist() == [[2 * (2 * V.LARGEST - 2) ** 2, 1]]


def test_large_components_are_refused(spark):
    with pytest.raises(ValueError, match="components"):
        V.vector_codes(spark.createDataFrame([(1, [1e9] * 16)], "vec_id long, embedding array<float>"))
