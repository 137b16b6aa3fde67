"""Nearest neighbours by recall; language, toxicity and personal data by held-out accuracy and brute force; mixing by its marginals."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubelark.llm import langid, mixing, pii, queries, toxicity
from cubelark.llm.ann import nearest
from tests.llm.conftest import LARGE, MEDIUM


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim int")


def test_nearest_recall(spark):
    draw = np.random.default_rng(2)
    centre = draw.normal(size=(20, 16))
    x = (centre[draw.integers(0, 20, 2000)] + 0.3 * draw.normal(size=(2000, 16))).astype(np.float32)
    x[1990:] = x[0]  # equal vectors: ties go to the smaller id
    frame = vectors(spark, [(i, v.tolist(), 0, 1) for i, v in enumerate(x)])
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, k=10, shard_rows=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 2000, 20))
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        assert np.allclose([s for _, _, s in found], d[[i for _, i, _ in found]], rtol=0, atol=1e-12)
        want = sorted((d[i], i) for i in range(2000) if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits / (10 * len(got)) >= 0.95
    assert [i for _, i, _ in got[0]] == list(range(1990, 2000))


def test_nearest_on_the_table_over_shards(spark):
    """Every query of ``embeddings`` against brute force, with the table over several shards."""
    table = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in nearest(table, F.pmod("vec_id", F.lit(100)) == 0, k=10, shard_rows=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries_ = [k for k, i in enumerate(ids) if i % 100 == 0]
    hits = 0
    for k in queries_:
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        hits += len({int(ids[j]) for j in np.lexsort((ids, d))[:10]} & got[int(ids[k])])
    print("recall", hits / (10 * len(queries_)))
    assert hits / (10 * len(queries_)) >= 0.95


def test_nearest_of_large_components(spark):
    """Doubles beyond the range of singles are ranked by their own distances."""
    rows = [(0, [1e200, 0.0]), (1, [1.5e200, 0.0]), (2, [3e200, 0.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(frame, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, 0), (100, [0.0, 0.0], 0, 0), (200, None, 0, 0), (300, [nan, 1.0], 0, 0), (400, [inf, 1.0], 0, 0), (500, [None, 1.0], 0, 0), (1, [2.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0), (600, [], 0, 0), (None, [1.0, 0.0], 0, 0)]
    query = F.pmod("vec_id", F.lit(100)) == 0
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(vectors(spark, rows), query).collect()]
    assert sorted(got) == [(0, 1, 2, 0.0), (0, 2, 1, 1.0)]
    assert nearest(vectors(spark, rows).limit(0), query).count() == 0


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_accuracy(spark, docs, empty):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = queries.op5_langid(spark, MEDIUM).collect()
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(judged) / len(judged) >= 0.95
    model = langid.train(table)
    edge = langid.identify(docs, model).collect()
    assert len(edge) == docs.count() and {r.lang_pred for r in edge if r.doc_id in (3, 4, 9)} == {"und"}
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}


def test_toxicity_accuracy(spark, docs, empty):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = queries.op8_toxicity(spark, MEDIUM).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    of = {k: [r.predicted for r in got if r.held_out and labels.get(r.doc_id) == k] for k in (0, 1)}
    score = {k: np.array([r.score for r in got if r.held_out and labels.get(r.doc_id) == k]) for k in (0, 1)}
    above = score[1][:, None] - score[0]
    assert (above > 0).mean() + (above == 0).mean() / 2 >= 0.85  # measured 0.87, with 37 toxic texts to learn from
    assert np.mean(of[1]) >= 0.6 and np.mean(of[0]) <= 0.05
    known = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    edge = toxicity.toxicity(docs, model, carry=True)
    assert edge.count() == docs.count() and edge.select("row.*").columns == docs.columns and edge.where("score is null").isEmpty()
    assert toxicity.toxicity(empty, toxicity.train(empty, known.limit(0))).count() == 0


def test_toxicity_leaves_no_windows_in_the_workers(spark):
    """Workers go on to other steps: what a task keeps must not stay with them."""

    def kept(batches):
        import pandas as pd

        from cubelark.llm import toxicity as own

        for _ in batches:
            yield pd.DataFrame({"n": [own.distance.cache_info().currsize]})

    model = toxicity.Model(b"bad words", b"good words", 0.1, (0.0,) * 22)
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    assert toxicity.toxicity(texts, model).where("score = 0.5").count() == 40
    left = spark.range(40).repartition(4).mapInPandas(kept, "n long").agg(F.max("n")).first()[0]
    assert left == 0


def spans_brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"]
        doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "+", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 11", " ", "(", ")", "x@y.z", "+49 30 1234567", "10.0.0.1", "é", "٣", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == spans_brute(text)


def test_personal_data(spark, docs, empty):
    table = duckdb.sql(f"select doc_id, text from '{MEDIUM}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op4_pii(spark, MEDIUM).collect()}
    assert len(got) == len(table)
    for i, t in table:
        base = spans_brute(t or "")
        assert got[i].base_sha256 == pii.digest(base) and got[i].n_email == sum(k == "email" for k, _, _ in base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i].spans.split(","))
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(empty).count() == 0
    spelt = spark.createDataFrame([(i, f"mail: john{i} [at] example [dot] com") for i in range(30)], "doc_id long, text string")
    assert {s.kind for r in pii.personal_data(spelt).collect() for s in r.added} == {"email_spelt"}


def sources(spark, n=3000):
    """A hot source, a null one and a rare one."""
    rows = [(i, ("web" if i % 3 else "code" if i % 2 else None), ("en" if i % 5 else "de"), "w " * (10 + i % 40)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def test_raking_meets_marginals():
    cells = np.array([5.0, 1, 2, 7, 3, 3])
    codes, wanted = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])], [np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    w = mixing.rake(cells, codes, wanted, 10.0)
    for code, want in zip(codes, wanted, strict=True):
        assert np.allclose(np.bincount(code, w) / w.sum(), want, atol=1e-8)


def test_raking_keeps_within_the_cells():
    """Against brute force: no cell above its tokens, and all marginals met that the cells allow."""
    cells = np.array([1.0, 9, 2, 8, 30, 30])
    codes, wanted = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])], [np.array([0.25, 0.25, 0.5]), np.array([0.4, 0.6])]
    w = mixing.rake(cells, codes, wanted, 40.0)
    assert (w <= cells + 1e-12).all() and w.sum() == pytest.approx(40.0, rel=1e-6)
    for code, want in zip(codes, wanted, strict=True):
        assert np.allclose(np.bincount(code, w), 40 * want, rtol=1e-4)
    short = mixing.rake(cells, codes, [np.array([0.8, 0.1, 0.1]), np.array([0.5, 0.5])], 40.0)
    assert np.allclose(short[:2], cells[:2]) and (short <= cells + 1e-12).all()  # more is asked of the first value than it has


def test_mixing(spark, docs, empty):
    table = sources(spark)
    dims, tokens = {"source": F.col("source"), "lang": F.col("lang")}, mixing.tokens_of(F.col("text"))
    targets = {"source": {"web": 0.4, "code": 0.3, "(none)": 0.3}, "lang": {"en": 0.7, "de": 0.3}}
    mixed = mixing.mix(table, dims, tokens, targets, keep_share=0.3)
    rows = mixed.collect()
    assert len(rows) == table.count()
    expected = {}
    for r in rows:
        expected[r.source] = expected.get(r.source, 0) + r.tokens * r.probability
    total = sum(expected.values())
    assert total == pytest.approx(0.3 * sum(r.tokens for r in rows), rel=1e-4)
    assert {k: v / total for k, v in expected.items()} == pytest.approx(targets["source"], abs=1e-4)
    assert sum(r.tokens for r in rows if r.kept) == pytest.approx(total, rel=0.1)
    by_spark = mixing.mix(table, dims, tokens, targets, keep_share=0.3, most_cells=0)
    small = {(r.source, r.lang): r.probability for r in rows}
    large = {(r.source, r.lang): r.probability for r in by_spark.select("source", "lang", "probability").distinct().collect()}
    assert large == pytest.approx(small, rel=1e-4)
    assert max(max(r.shortfall) for r in rows) <= mixing.SHORT
    with pytest.raises(ValueError):
        mixing.mix(table, {"kept": F.col("source")}, tokens)
    edge = mixing.mix(docs, dims, tokens)
    assert edge.count() == docs.count() and edge.select("row.*").columns == docs.columns
    assert mixing.mix(empty, dims, tokens).count() == 0


def test_mixing_meets_its_targets_within_what_there_is(spark):
    """More is asked of ``code`` than it has: its shortfall is reported, or the budget goes down until nothing falls short, and not further."""
    table = sources(spark)
    dims, tokens = {"source": F.col("source"), "lang": F.col("lang")}, mixing.tokens_of(F.col("text"))
    targets = {"source": {"web": 0.1, "code": 0.8, "(none)": 0.1}, "lang": {"en": 0.7, "de": 0.3}}

    def reached(rows):
        got = [{}, {}]
        for r in rows:
            for sums, v in zip(got, (r.source, r.lang), strict=True):
                sums[v] = sums.get(v, 0) + r.tokens * r.probability
        return got

    rows = mixing.mix(table, dims, tokens, targets, keep_share=0.9).collect()
    total = sum(r.tokens for r in rows)
    for sums, (d, wanted) in zip(reached(rows), targets.items(), strict=True):
        for v, share in wanted.items():
            missed = {r.shortfall[d] for r in rows if r[d] == v}
            assert len(missed) == 1 and missed.pop() == pytest.approx(max(0.0, 1 - sums[v] / (share * 0.9 * total)), abs=1e-9)
    assert max(r.shortfall["source"] for r in rows if r.source == "code") > 0.1
    met = mixing.mix(table, dims, tokens, targets, keep_share=0.9, meet=True).collect()
    assert all(0 <= r.probability <= 1 + 1e-12 and max(r.shortfall) <= mixing.SHORT for r in met)
    by_source, by_lang = reached(met)
    kept = sum(by_source.values())
    for sums, wanted in ((by_source, targets["source"]), (by_lang, targets["lang"])):
        assert {v: n / kept for v, n in sums.items()} == pytest.approx(wanted, rel=5e-4)
    assert sum(r.weight * r.tokens for r in met) == pytest.approx(total, rel=1e-3)
    more = mixing.mix(table, dims, tokens, targets, keep_share=kept / total * 1.01).collect()
    assert max(max(r.shortfall) for r in more) > mixing.SHORT
    one = {"source": F.col("source")}  # the form for very many cells, with few rounds
    here, spread = ({(r.source, r.probability, r.shortfall["source"]) for r in mixing.mix(table, one, tokens, targets, keep_share=0.9, meet=True, most_cells=most).collect()} for most in (50_000, 0))
    for (s, p, m), (t, q, o) in zip(sorted(here), sorted(spread), strict=True):
        assert s == t and p == pytest.approx(q, rel=1e-6) and m == pytest.approx(o, abs=1e-6)


def test_contradictory_marginals_keep_the_budget():
    """The first value of either dimension is the same cell, of which one wants 0.9 and the other 0.1: no budget meets both."""
    cells, codes, wanted = np.array([50.0, 50.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.9, 0.1]), np.array([0.1, 0.9])]

    def rake_at(budget):
        w = mixing.rake(cells, codes, wanted, budget)
        return w, max(float(s.max()) for s in mixing.shortfalls(cells, codes, wanted, w, budget))

    w, budget = mixing.meeting(rake_at, 20.0)
    assert budget > 1 and rake_at(budget)[1] > mixing.SHORT and w.sum() <= budget * (1 + 1e-9)


@pytest.mark.parametrize("where", [MEDIUM])
def test_mixing_query_meets_its_targets(spark, where):
    rows = queries.op6_mixing(spark, where).collect()
    kept = sum(r.tokens * r.probability for r in rows)
    for d in ("source", "lang", "topic"):
        sums, got = {}, {}
        for r in rows:
            sums[r[d]] = sums.get(r[d], 0) + r.tokens
            got[r[d]] = got.get(r[d], 0) + r.tokens * r.probability
        wanted = {v: n**0.5 for v, n in sums.items()}
        assert {v: n / kept for v, n in got.items()} == pytest.approx({v: n / sum(wanted.values()) for v, n in wanted.items()}, rel=1e-3)
        assert max(r[f"{d}_shortfall"] for r in rows) <= mixing.SHORT
