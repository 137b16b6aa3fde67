"""Exact dedup, SimHash components, near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import xxhash

from cubelark.llm import exact_dedup as E
from cubelark.llm import simhash as S
from cubelark.llm.components import components
from cubelark.llm.passages import compact_windows, centres, repeated_passages, windows
from tests.llm.conftest import SMALL, least_reachable


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    least = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    return sorted(((i, least[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True)), key=str)


def exact_checked(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == exact_brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_edges(docs, empty):
    exact_checked(E.exact_dedup(docs), pairs_of(docs))
    assert E.exact_dedup(empty).count() == 0
    carried = E.exact_dedup(docs, carry=True).select("row.*")
    assert carried.columns == docs.columns and carried.count() == docs.count()


def test_exact_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    exact_checked(E.exact_dedup(docs), pairs_of(docs))


def test_exact_hot_text(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAST_HOT", 8)
    rows = [(1000 - i, "the same\ttext") for i in range(300)] + [(i, f"text {i % 17}") for i in range(40)] + [(None, "the same text")]
    exact_checked(E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    rows = [(None, "the same text")] * 200 + [(7, "other text")] * 200 + [(8, "other text")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.kept for r in got].count(True) == 2 and {(r.keep_id, r.group_size) for r in got} == {(None, 200), (7, 201)}


def fingerprint_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_small_tables(spark, docs, empty):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    both = table.unionByName(docs.where("doc_id is not null").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = pairs_of(both)
    prints = {i: fingerprint_brute(t) for i, t in rows}
    ids = sorted(prints)
    want = least_reachable(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = S.simhash_components(both).collect()
    assert len(got) == len(rows)
    assert all(r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got)
    assert S.simhash_components(empty).count() == 0
    nulls = [r for r in S.simhash_components(docs).collect() if r.doc_id is None]
    assert sorted((r.component_id for r in nulls), key=str) == [1, None]  # one shares its text with 1, one is alone


def test_links_of_large_buckets(spark):
    """Members of buckets beyond the pairing bound are linked by exactly the same components."""
    draw = random.Random(3)
    prints = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(30):
            x = base
            for b in draw.sample(range(64), draw.randrange(5)):
                x ^= 1 << b
            prints.add(S.signed(x))
    prints = sorted(prints)
    for bits in (1, 2):
        want = least_reachable(prints, [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= bits])
        found = components(S.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits, paired=4)).collect()
        label = {r.node: r.label for r in found}
        first = {}
        for p in prints:
            first.setdefault(label.get(p, p), p)
        assert {p: first[label.get(p, p)] for p in prints} == want


def shingles(text, k=5):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_brute(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)

    def linked(a, b):
        return a == b if not a or not b else len(a & b) >= similarity * len(a | b)

    return least_reachable(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(sets[a], sets[b])])


def test_near_duplicates(spark, empty):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = draw.choices(words, k=draw.randrange(60, 200))
        for edits in (0, 0, 1, 2, 4, 9):
            own = list(base)
            for at in draw.sample(range(len(own)), edits):
                own[at] = draw.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, " "), (n + 2, "one two"), (n + 3, "One  two")]
    want = near_brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(frame).collect()} == want
    assert S.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_template(spark):
    """A bucket of hundreds of documents, most of a template, whose similar pairs are not similar to the first."""
    draw = random.Random(29)
    words = [f"t{i}" for i in range(30_000)]
    template, rows = draw.choices(words, k=180), []
    for k in range(300):
        own = draw.choices(words, k=60)
        other = list(own)
        for at in (10, 30):
            other[at] = draw.choice(words)
        edited = list(template)
        edited[90] = draw.choice(words)
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(edited + other))]
    want = near_brute(rows)
    assert sum(a != b for a, b in want.items()) == 300
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_with_repeats(spark):
    """Equal bodies but for an edit, one with a word many times over: the sets are similar, whatever the counts."""
    draw = random.Random(11)
    words = [f"r{i}" for i in range(5000)]
    rows = []
    for k in range(12):
        body, line = draw.choices(words, k=200), [f"again{k}"]
        edited = [*body[:100], "edit", *body[101:]]
        rows += [(2 * k, " ".join(body + line * 5)), (2 * k + 1, " ".join(edited + line * 400))]
    want = near_brute(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(12))
    assert {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_compact_windows_are_the_minima_of_stretches():
    import numpy as np

    draw = np.random.default_rng(1)
    for n in (0, 1, 9, 10, 200):
        values = draw.integers(0, 1 << 62, n, dtype=np.uint64)
        tree = sorted(compact_windows(values, 10), key=lambda t: t[1])
        assert [c for _, c, _ in tree] == centres(values, 10).tolist()
        left, centre, right = windows(values, 10)
        assert tree == [*zip(left.tolist(), centre.tolist(), right.tolist(), strict=True)]


def test_passages(spark, named, empty):
    draw = random.Random(9)
    words = [f"v{i}" for i in range(20_000)]
    text = lambda k: draw.choices(words, k=k)
    passage, other = text(60), text(55)
    changed = [*passage[:58], "changed", passage[59]]
    places, rows = {}, []
    for i in range(40):
        own, inner = text(draw.randrange(80, 300)), passage if i % 4 == 0 else other if i % 4 == 1 else None
        if inner:
            at = draw.randrange(len(own))
            places[i] = at, at + len(inner)
            own[at:at] = inner
        rows.append((i, " ".join(own)))
    rows += [(40, " ".join(text(30) + changed + text(30))), (41, " ".join(other + text(200) + other)), (42, " ".join(passage[:49]))]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    for i, (a, b) in places.items():
        assert any(s <= a and e >= b for s, e in got[i])
    assert any(s <= 30 and e >= 88 for s, e in got[40]) and len(got[41]) >= 2
    assert set(got) == {*places, 40, 41}  # texts without a repeat, and those too short for one, have none
    assert repeated_passages(empty).count() == 0
    assert {r.doc_id for r in repeated_passages(named).collect()} <= {7}  # only the long text repeats itself


def test_passages_behind_a_first_place_without_them(spark):
    """Two documents share a line and the words after it; a document with a smaller id has the line only."""
    draw = random.Random(17)
    words = [f"u{i}" for i in range(20_000)]
    text = lambda k: draw.choices(words, k=k)
    rows, want = [], {}
    for k in range(30):
        line, after = text(38 + k % 7), text(12)
        for i in range(5):
            rows.append((k * 10 + i, " ".join(text(40) + line + text(60))))
        for i in (5, 6):
            rows.append((k * 10 + i, " ".join(text(40) + line + after + text(40))))
            want[k * 10 + i] = 40, 40 + len(line) + len(after)
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {i for i, (a, b) in want.items() if any(s <= a and e >= b for s, e in got.get(i, ()))} == set(want)
    assert set(got) == set(want)  # the line alone is under 0.8 of any 50 words


def test_changed_passages_recall(spark):
    """Planted pairs of passages with changes anywhere, at a similarity of 0.8 to 0.9 by brute force over their shingles, of 50 to 1,500 words."""
    draw = random.Random(23)
    words = [f"c{i}" for i in range(30_000)]
    text = lambda k: draw.choices(words, k=k)
    rows, kinds = [], []
    for size, number in ((50, 60), (60, 60), (80, 60), (100, 60), (400, 40), (1500, 20)):
        n = 0
        while n < number:
            passage = text(size)
            changed = list(passage)
            for at in draw.sample(range(size), max(1, size // 45)):
                changed[at] = draw.choice(words)
            a, b = shingles(" ".join(passage)), shingles(" ".join(changed))
            if 0.8 <= len(a & b) / len(a | b) <= 0.9:
                k = len(kinds)
                rows += [(2 * k, " ".join(text(60) + passage + text(60))), (2 * k + 1, " ".join(text(60) + changed + text(60)))]
                kinds.append(size)
                n += 1
    found, covered = {}, {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if not r.is_first:
            found.setdefault(r.doc_id, set()).add(r.first_id)
            covered[r.doc_id] = covered.get(r.doc_id, 0) + max(0, min(r.end, 60 + kinds[r.doc_id // 2]) - max(r.start, 60))
    for size in dict.fromkeys(kinds):
        own = [k for k, n in enumerate(kinds) if n == size]
        recall = sum(2 * k in found.get(2 * k + 1, ()) for k in own) / len(own)
        cover = sum(covered.get(2 * k + 1, 0) for k in own) / (size * len(own))
        print(size, "recall", recall, "covered", round(cover, 3))
        assert recall >= 0.9 and cover >= 0.8
