"""Exact copies of passages are never lost, whatever lines smaller identifiers hold of them; changed ones are found at 0.9 at least."""

import numpy as np
import pytest

from cubelark.llm.passages import repeated_passages


def texts(seed, pairs, length, held, holders):
    """Pairs of documents that share a passage, and documents of smaller ids that hold a line of it each."""
    rng = np.random.default_rng(seed)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    rows, planted, low, high = [], [], 0, 10**6
    for p in range(pairs):
        passage = [f"p{p}w{k}" for k in range(length)]
        for _ in range(holders):
            at = int(rng.integers(0, length - held + 1))
            rows.append((low, " ".join(filler(int(rng.integers(5, 40))) + passage[at : at + held] + filler(int(rng.integers(5, 40))))))
            low += 1
        for _ in range(2):
            before = filler(int(rng.integers(5, 60)))
            rows.append((high, " ".join(before + passage + filler(int(rng.integers(5, 60))))))
            planted.append((high, len(before), len(before) + length))
            high += 1
    return rows, planted


@pytest.mark.parametrize("length, held, holders", [(50, 44, 6), (50, 43, 24), (60, 44, 24), (80, 44, 30), (50, 49, 10)])
def test_no_exact_copy_hides_behind_partial_holders(spark, length, held, holders):
    rows, planted = texts(length + held, 40, length, held, holders)
    by = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by.setdefault(r.doc_id, []).append((r.start, r.end))
    assert all(any(a <= low and high <= b for a, b in by.get(i, [])) for i, low, high in planted)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_exact_repeats_brute_force(spark, seed):
    """Small corpora of nested lines: every word of every run of 50 words that occurs at another place is covered."""
    rng = np.random.default_rng(seed)
    line = [f"l{x}" for x in range(400)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            words += [f"x{x}" for x in rng.integers(0, 10**9, rng.integers(0, 30))]
            at = int(rng.integers(0, 300))
            words += line[at : at + int(rng.integers(30, 100))]
        rows.append((int(i), " ".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (502, rows[4][1] + " more")]
    places = {}
    for i, t in rows:
        w = t.lower().split()
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    needed = {(i, k + j) for found in places.values() if len(found) > 1 for i, k in found for j in range(50)}
    covered = {(r.doc_id, k) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() for k in range(r.start, r.end)}
    assert len(needed) > 1000 and needed <= covered


def test_copies_of_a_text_are_one_passage(spark):
    t = " ".join(f"w{k}" for k in range(80))
    rows = [(5, t), (3, t.upper()), (9, t.replace(" ", "\n")), (7, "short text"), (8, "short text"), (None, t)]
    got = sorted((r.doc_id, r.start, r.end, r.first_id, r.is_first) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 0, 80, 3, True), (5, 0, 80, 3, False), (9, 0, 80, 3, False)]


def test_changed_passages_with_holders(spark):
    """Passages with a tenth of their words changed in places, behind holders of a line of them."""
    rng = np.random.default_rng(9)
    rows, planted = texts(7, 80, 100, 44, 6)
    changed = []
    for i, t in rows:
        w = t.split()
        if i >= 10**6 and i % 2:
            start = next(k for k, x in enumerate(w) if x.startswith("p"))
            for k in rng.choice(100, 2, replace=False):
                w[start + int(k)] = f"c{rng.integers(10**9)}"
        changed.append((i, " ".join(w)))
    by = {}
    for r in repeated_passages(spark.createDataFrame(changed, "doc_id long, text string")).collect():
        by.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    found = [len(by.get(i, set()) & set(range(a, b))) >= 0.8 * (b - a) for i, a, b in planted]
    assert np.mean(found) >= 0.9


def test_changed_passage_of_places_that_are_accounted_for(spark):
    """Two places with 80 equal words find each other; a third has 52 of them with one changed, all of it behind two holders of 44 words and smaller ids."""
    rng = np.random.default_rng(5)
    filler = lambda: [f"f{x}" for x in rng.integers(0, 10**9, 30)]
    rows = []
    for p in range(100):
        passage = [f"p{p}w{k}" for k in range(80)]
        changed = passage[10:57] + [f"c{p}"] + passage[58:62]
        for i, middle in ((p, passage[10:54]), (1000 + p, passage[13:57]), (2000 + p, passage), (3000 + p, passage), (4000 + p, changed)):
            rows.append((i, " ".join(filler() + middle + filler())))
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2000 + p in found and 3000 + p in found for p in range(100))
    assert np.mean([4000 + p in found for p in range(100)]) >= 0.9


def test_windows_meet_in_turns(spark, monkeypatch):
    """No key is met in two turns, and no turn holds all keys: so much less of them lies on disk at a time."""
    from cubelark.llm import passages as P

    seen, plain = [], P.written

    def spied(df, name="cut"):
        out = plain(df, name)
        if name == "windows":
            seen.append({r.key for r in out.select("key").collect()})
        return out

    monkeypatch.setattr(P, "written", spied)
    t = [f"w{k}" for k in range(400)]
    found = repeated_passages(spark.createDataFrame([(1, " ".join(t)), (2, " ".join([*t, "more"]))], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in found} == {(1, 0, 400), (2, 0, 400)}
    assert len(seen) == P.MEETINGS > 1 and all(seen) and sum(map(len, seen)) == len(set.union(*seen))


def test_the_shorter_sequence_travels(spark, monkeypatch):
    """A long text that shares a passage with each of many short ones is not dealt with every pair, whichever of them has the smaller id."""
    from cubelark.llm import passages as P

    seen, plain = [], P.cut

    def spied(df):
        out = plain(df)
        if "anchors" in out.columns:
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(P, "cut", spied)
    long = [f"w{k}" for k in range(3000)]
    short = {i: [f"x{i}"] * 5 + long[60 * i : 60 * i + 60 + i % 7] + [f"y{i}"] * 5 for i in range(1, 41)}
    for own in (0, 99):
        seen.clear()
        size = {own: len(long)} | {i: len(w) for i, w in short.items()}
        found = repeated_passages(spark.createDataFrame([(own, " ".join(long)), *((i, " ".join(w)) for i, w in short.items())], "doc_id long, text string")).collect()
        assert {(r.doc_id, r.start, r.end) for r in found if r.doc_id != own} >= {(i, 5, size[i] - 5) for i in short}
        assert len(seen) >= 40 and all(size[r.short] <= size[r.long] and {r.short, r.long} == {r.id, r.first_id} for r in seen)


def test_windows_travel_packed(spark, monkeypatch):
    """Spark deals blobs of windows and links, not a row for each."""
    from cubelark.llm import passages as P

    rows, plain = {}, P.written

    def spied(df, name="cut"):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(P, "written", spied)
    t = [f"w{k}" for k in range(3000)]
    repeated_passages(spark.createDataFrame([(1, " ".join(t)), (2, " ".join([*t, "more"]))], "doc_id long, text string").coalesce(1)).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(P.all_windows(P.word_hashes(" ".join(t)), np.array([3000]), 50, 5)[0]) > 500
    assert rows["nodes"] <= 2 * parts and rows["links"] <= 2 and rows["windows"] <= 2 * P.MEETINGS * parts


def test_all_windows_at_once():
    """The windows of many texts at once are those of each text alone; words are told apart at the ends of texts."""
    import pyarrow as pa
    from cubelark.llm import passages as P

    rng = np.random.default_rng(4)
    texts = [None, "", " a", "b ", *(" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (49, 50, 51, 400, 3)), "c", "d"]
    for first, hashes, counts in P.sliced(pa.array(["skipped", *texts])[1:]):
        assert first == 0 and counts.tolist() == [len(P.words(t)) for t in texts]
        key, text, at, left, right = P.all_windows(hashes, counts, 50, 5)
        for k, t in enumerate(texts):
            own = P.word_hashes(t)
            assert (hashes[counts[:k].sum() : counts[: k + 1].sum()] == own).all()
            for j in range(P.FUNCTIONS):
                values = P.runs(own, 5) * P._MULTIPLIERS[j]
                values ^= values >> np.uint64(31)
                mine = (text == k) & (key & np.uint64(15) == j)
                assert all((a == b[mine]).all() and len(a) == mine.sum() for a, b in zip(P.windows(values, 46), (left, at, right), strict=True))


def test_sequences_are_coded_without_loss():
    import pyarrow as pa
    from cubelark.llm import passages as P

    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 32, 70_000).astype("<u4")
    for vocabulary in (np.empty(0, "<u4"), np.unique(words[:300]), np.unique(words)[: P.UNKNOWN]):
        padded = np.append(vocabulary, np.zeros(P.UNKNOWN + 1 - len(vocabulary), "<u4"))
        for some in (words[:0], words[:1], words[250:400], words):
            assert (P.decoded(pa.py_buffer(P.coded(some, vocabulary)), padded) == some).all()
