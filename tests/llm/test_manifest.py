import hashlib
import zlib

import pytest

from cubelark.llm import merkle, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(nodes):
    """All levels of a tree, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, H(*map(value, r))))
    trees = {}
    for s, some in by_source.items():
        some.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = up([leaf for _, leaf in some])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = up([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (r, leaf) in enumerate(by_source[s]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded, path = H(*map(value, (*r[:4], text))), siblings(trees[s], at) + siblings(top, place)
            for a, b in path:
                folded = H(*a, folded, *b)
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, H(*[x for a, b in path for x in (*a, *b)]), folded, folded == root))
    return out


def found(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        df = df.selectExpr("*", "1 AS tree", "2 AS place", "'x' AS leaf", "3 AS rank", "4 AS part", "5 AS id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 700])
def test_manifest_brute_force(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 100)
    rows = [(k * 7 % 1009, [None, "a", "b", "é", "Z", "one"][min(k % 11, 5)] if k % 97 else f"s{k}", "en" if k % 3 else None, k, f"Text {k} Ünï AB" if k % 5 else None) for k in range(n)]
    assert sorted(found(spark, rows, tmp_path, extra=True), key=str) == sorted(brute(rows), key=str)


def test_manifest_repeats_and_nulls(spark, tmp_path):
    rows = [(1, "a", "en", 3, "ABC")] * 20 + [(1, "a", "en", 3, "abd"), (None, "a", None, None, None), (None, None, None, None, None), (10, "", "", 0, "")] + [(5, "a", "x", 1, "Q")] * 2
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_manifest_long_text(spark, tmp_path):
    rows = [(k, "a", "en", 3, "Word " * 400_000) for k in range(3)]
    assert sorted(found(spark, rows, tmp_path), key=str) == sorted(brute(rows), key=str)


def test_missing_is_the_minimal_union():
    import numpy as np

    assert [m.tolist() for m in merkle.missing(np.arange(16), 16)] == [[]]
    assert [m.tolist() for m in merkle.missing(np.array([0, 17]), 40)] == [[*range(1, 16), 16, *range(18, 32)], [2]]


def test_proofs_of_chosen_leaves(spark):
    docs = spark.createDataFrame([(k, "s%d" % (k % 3), None, k, f"t{k}") for k in range(500)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(docs)
    some = merkle.proofs(made, made.leaves.where("id % 50 = 7")).collect()
    assert len(some) == 10
    for r in some:
        subroot = merkle.fold(r["leaf"], r["place"], r["proof"])
        assert subroot == r["subroot"] and merkle.fold(subroot, r["source_place"], r["source_proof"]) == r["root"] == made.root
