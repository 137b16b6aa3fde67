"""Late events, restarts and replays of the streaming mart."""

from datetime import datetime

from pyspark.sql import functions as F

from cubelark import streaming as ST

KEYS = ("window_start", "event_type")
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(hour, minute):
    return datetime(2024, 1, 1, hour, minute)


def add(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, to):
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    ST.upsert_table(ST.windowed_cube(events, late="2 hours"), KEYS, to, f"{to}-checkpoint")
    return {(r["window_start"].hour, r["event_type"]): (r["n"], r["value_sum"]) for r in ST.latest(spark, KEYS, to).collect()}


def test_late_windows_replace_what_was_stored(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "mart")
    add(spark, [(1, at(9, 5), 1, "a", 1.0), (2, at(9, 50), 1, "a", 2.0), (3, at(10, 5), 1, "b", 4.0)], folder, "one")
    assert run(spark, folder, to) == {(9, "a"): (2, 3.0), (10, "b"): (1, 4.0)}
    assert run(spark, folder, to) == {(9, "a"): (2, 3.0), (10, "b"): (1, 4.0)}  # a restart without new files changes nothing
    add(spark, [(4, at(9, 55), 2, "a", 8.0), (5, at(11, 0), 2, "b", 16.0)], folder, "two")  # late, but within the watermark
    grown = {(9, "a"): (3, 11.0), (10, "b"): (1, 4.0), (11, "b"): (1, 16.0)}
    assert run(spark, folder, to) == grown
    batches = sorted(p.name for p in (tmp_path / "mart").iterdir() if p.name.startswith("batch="))
    assert len(batches) >= 2
    last = max(batches)
    again = spark.read.parquet(f"{to}/{last}").collect()
    spark.createDataFrame(again, spark.read.parquet(f"{to}/{last}").schema).write.mode("overwrite").parquet(f"{to}/{last}")  # a batch that is run again
    assert {(r["window_start"].hour, r["event_type"]): (r["n"], r["value_sum"]) for r in ST.latest(spark, KEYS, to).collect()} == grown
    ST.compact(spark, KEYS, to, f"{to}-small")
    assert {(r["window_start"].hour, r["event_type"]): (r["n"], r["value_sum"]) for r in ST.latest(spark, KEYS, f"{to}-small").collect()} == grown


def test_sessions_close_after_the_gap(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, [(1, at(9, 0), 1, "a", 1.0), (2, at(9, 29), 1, "a", 1.0), (3, at(10, 30), 1, "a", 1.0), (4, at(9, 10), 2, "a", 1.0)], folder, "one")
    add(spark, [(5, at(12, 0), 3, "a", 1.0)], folder, "two")
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    ST.run_to_table(ST.sessions(events), to, f"{to}-checkpoint")
    got = {(r["user_id"], r["session_start"].hour, r["session_start"].minute, r["n"]) for r in spark.read.parquet(to).withColumn("x", F.lit(1)).collect()}
    assert got == {(1, 9, 0, 2), (1, 10, 30, 1), (2, 9, 10, 1)}
