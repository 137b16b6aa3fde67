"""Readers and sinks over small files, and the streaming cube."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.sources import readers, sinks
from cubelark.streaming import event_stream, run_to_table, windowed_cube


def test_ragged(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿id|resp|z\n1|a|b\n3|b|y|q|z\n4|only\n", encoding="utf-8")
    got = [tuple(r) for r in readers.read_ragged(spark, str(p), ["id", "resp", "z"], merged="resp").orderBy("id").collect()]
    assert got == [("1", "a", "b"), ("3", "b|y|q", "z"), ("4", "only", None)]


def test_sniff_and_any(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a;b;c\n1;"x;y";3\n', encoding="utf-8")
    assert readers.sniff_separator(spark, str(p)) == ";"
    assert tuple(readers.read_any(spark, str(p)).first()) == ("1", "x;y", "3")
    (tmp_path / "e.csv").write_text("")
    assert readers.sniff_separator(spark, str(tmp_path / "e.csv")) == ","


def test_typed(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,N/A\nbad,2.5\n", encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    assert sorted(map(tuple, readers.read_csv_typed(spark, str(p), schema).collect()), key=str) == [(1, None), (None, 2.5)]


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "x.sqlite")
    with sqlite3.connect(p) as c:
        c.execute("create table vacancies (" + ", ".join(readers.SQLITE_COLUMNS) + ")")
        c.executemany(f"insert into vacancies values ({', '.join('?' * 12)})", [(i, *["x"] * 11) for i in range(10)])
    assert readers.read_source(spark, "hh_github", p).count() == 10
    assert readers.read_source(spark, "hh_github", p, limit=3).count() == 3
    with pytest.raises(ValueError):
        readers.read_source(spark, "other", p)


def test_required_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.require_path(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "n int, s string")
    sinks.write_parquet(df, str(tmp_path / "p"), "zstd", ["n"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.write_json(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "s": "a|b"}
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert readers.read_metrics(spark, str(tmp_path / "m")).first()["n"] == 1
    sinks.write_excel_csv(df, str(tmp_path / "x.csv"))
    sheet = next((tmp_path / "x.csv").glob("part-*")).read_bytes()
    assert sheet.startswith(b"\xef\xbb\xbf") and sheet.decode("utf-8-sig") == "n;s\n1;a|b\n"
    assert "a\\|b" in sinks.markdown(df, "t")


def test_stream(spark, tmp_path):
    events = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    run_to_table(windowed_cube(event_stream(spark, str(tmp_path / "events.parquet"))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 9 and got.agg(F.max("n")).first()[0] == 60


def quoted_text(rng, rows):
    """A file of fields that hold line ends, quotes and separators, and its rows as an independent reader has them."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator="\n")
    w.writerow(["id", "text", "end"])
    for i in range(rows):
        w.writerow([i, "".join(rng.choice(list("ab ;\"\n")) for _ in range(rng.randrange(60))) + "z", rng.choice(["", "x", 'y"'])])
    return out.getvalue(), [[v or None for v in r] for r in csv.reader(io.StringIO(out.getvalue()), delimiter=";")][1:]


def test_quoted_in_splits(spark, tmp_path):
    """Splits of a few bytes start in the middle of fields, and some fields span several of them."""
    import random

    rng = random.Random(4)
    (tmp_path / "q").mkdir()
    want = []
    for k in range(3):
        text, rows = quoted_text(rng, 40)
        (tmp_path / "q" / f"{k}.csv").write_text(text, encoding="utf-8")
        want += rows
    (tmp_path / "q" / "empty.csv").write_text("")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for size in (23, 200, 1 << 20):
        before = [spark.conf.get(n) for n in names]
        for n in names:
            spark.conf.set(n, str(size))
        try:
            got = [list(r) for r in readers.read_csv(spark, str(tmp_path / "q"), columns=["id", "text", "end"]).collect()]
        finally:
            for n, v in zip(names, before, strict=True):
                spark.conf.set(n, v)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_quoted_edges(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('\ufeffa;b\r\n1;"x\r\ny"\r\n\r\n2;z;surplus\r\n3\r\n4;"open\nto the end', encoding="utf-8", newline="")
    got = sorted(map(tuple, readers.read_csv(spark, str(p)).collect()))
    assert got[:3] == [("1", "x\r\ny"), ("2", "z"), ("3", None)] and got[3][0] == "4" and len(got) == 4
    q = tmp_path / "y.csv"
    q.write_text('a;b\n1;5" disk\n2;x\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(q), whole=True).collect())) == [("1", '5" disk'), ("2", "x")]


def test_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 10)
    sinks.write_excel_csv(spark.range(25).repartition(2), str(tmp_path / "s"), files=None)
    files = list((tmp_path / "s").glob("*.csv"))
    assert len(files) >= 4 and all(f.read_bytes().startswith(b"\xef\xbb\xbfid") for f in files)
