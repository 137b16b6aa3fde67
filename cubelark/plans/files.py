"""Sources, sinks and streams as queries: tables go out in a format and come back, and their SQL reads the table itself."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.plans.oracles import MONTHLY, STAR
from cubelark.plans.queries import Query, monthly
from cubelark.plans.star import records, table
from cubelark.session import scratch
from cubelark.sources import readers, sinks
from cubelark import streaming as ST
from cubelark.streaming import event_stream, run_to_table, windowed_cube

FILES: dict[str, Query] = {}
#: Rows of a limited read.
LIMITED = 150


def query(f: Query) -> Query:
    FILES[f.__name__] = f
    return f


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit('a "b"; '), "p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, "N/A").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise("many").alias("size"))


@query
def stream_cube(spark, d):
    """Hourly windows of the event stream, in append mode: those that the watermark has passed."""
    to = scratch(spark, "stream")
    run_to_table(windowed_cube(event_stream(spark, f"{d}/events.parquet")), f"{to}/out", f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/out").withColumn("window_start", F.unix_timestamp("window_start"))


@query
def sqlite_scan(spark, d):
    """SRC-05, SRC-13 over a database that is made of the nations; its file is in the shared folder."""
    to = scratch(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    os.makedirs(to)
    with sqlite3.connect(path := f"{to}/nations.sqlite") as c:
        c.execute("create table nation (n_nationkey, n_name, n_regionkey)")
        c.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])  # 25 rows
    return readers.read_sqlite(spark, path, table=None, columns=())


@query
def ragged_csv(spark, d):
    """SRC-02, SRC-03: lines with surplus separators, made of parts' names."""
    to = scratch(spark, "ragged")
    lines = table(spark, d, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("|")), F.col("p_brand")).alias("value"))
    lines.write.text(to)
    return readers.read_ragged(spark, to, ["id", "resp", "brand"], merged="resp")


@query
def quoted_csv(spark, d):
    """SRC-01, SRC-04, SRC-16, SNK-05: separators and quotes inside fields."""
    to = scratch(spark, "quoted")
    part(spark, d).write.option("sep", ";").option("header", True).option("escape", '"').csv(to)
    return readers.read_source(spark, "hh_kaggle", readers.require_path(spark, to))


@query
def lines_csv(spark, d):
    """SRC-04: fields of several lines, with quotes and separators, in files that are read in splits."""
    to = scratch(spark, "lines")
    sinks.write_csv(part(spark, d).select("id", F.concat("title", F.lit("\n\n;"), "size", F.lit('"')).alias("title"), "size"), to, ";")
    return readers.read_csv(spark, to)


@query
def limited_read(spark, d):
    """SRC-06: the first rows of a source; how many, and how many of them the table has."""
    to = f"{scratch(spark, 'limited')}.csv"
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_brand")
    sinks.write_csv(rows, to)
    some = readers.read_any(spark, to, limit=LIMITED)
    return some.join(rows.withColumn("there", F.lit(1)), ["id", "p_brand"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("found"))


@query
def typed_csv(spark, d):
    """SRC-14: null tokens, and values of the wrong type as null."""
    to = scratch(spark, "typed")
    sinks.write_csv(part(spark, d), to)
    return readers.read_csv_typed(spark, to, T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("size", T.IntegerType())])).select("id", "size")


@query
def sniffed_csv(spark, d):
    """SRC-11, SRC-12, SRC-15: separator by the first lines, columns pruned in the plan."""
    to = f"{scratch(spark, 'sniffed')}.csv"
    table(spark, d, "part").select("p_partkey", "p_brand", "p_size").write.option("sep", "|").option("header", True).csv(to)
    return readers.read_any(spark, to, columns=["p_partkey", "p_size"])


@query
def spreadsheet(spark, d):
    """SNK-05: the file for spreadsheets, read again by name of its marked header."""
    to = scratch(spark, "sheet")
    sinks.write_excel_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), to)
    return spark.read.option("sep", ";").option("header", True).schema("n_nationkey int, n_name string").csv(to)


@query
def parquet_sinks(spark, d):
    """SNK-01, SNK-02, SRC-08: a partitioned table, read by SQL with a bound parameter."""
    to = scratch(spark, "table")
    sinks.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), to, compression="zstd", partition_by=["o_orderstatus"])
    readers.read_parquet(spark, to, view="cubelark_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM cubelark_orders WHERE o_orderstatus = :status", args={"status": "F"})


@query
def metrics_csv(spark, d):
    """SNK-04, SRC-09: a table of figures with its types."""
    to = scratch(spark, "metrics")
    sinks.write_metrics(records(spark, d).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.max("salary_from").alias("most")), to)
    return readers.read_metrics(spark, to).select("source_dataset", F.col("n").cast("bigint").alias("n"), "most")


@query
def json_report(spark, d):
    """SNK-03, SRC-10: a report of one row as a document."""
    to = f"{scratch(spark, 'report')}.json"
    sinks.write_json(monthly(spark, d).agg(F.sum("vacancy_count").alias("vacancies"), F.count(F.lit(1)).alias("segments")), to)
    return spark.createDataFrame([tuple(readers.read_json(spark, to)[k] for k in ("vacancies", "segments"))], "vacancies long, segments long")


@query
def markdown_report(spark, d):
    """SNK-07: the first rows as a table for reading."""
    text = sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "regions")
    return spark.createDataFrame([(text,)], "text string")


@query
def event_sessions(spark, d):
    """Sessions of users: events at most half an hour apart."""
    s = ST.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select(F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "user_id", "n")


@query
def stream_sessions(spark, d):
    """The same as a stream: sessions that the watermark has closed."""
    to = scratch(spark, "sessions")
    ST.run_to_table(ST.sessions(ST.event_stream(spark, f"{d}/events.parquet")), to, f"{to}-checkpoint")
    return spark.read.parquet(to).select(F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "user_id", "n")


@query
def stream_upsert(spark, d):
    """The windowed cube kept by upserts: each window as of the last batch that touched it."""
    to, keys = scratch(spark, "upsert"), ("window_start", "event_type")
    ST.upsert_table(ST.windowed_cube(ST.event_stream(spark, f"{d}/events.parquet")), keys, to, f"{to}-checkpoint")
    return ST.latest(spark, keys, to).withColumn("window_start", F.unix_seconds("window_start"))


STREAMED = "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, value FROM events)"
SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '30 minutes' AS b, count(*) AS n FROM s GROUP BY user_id, k) SELECT epoch_us(a) AS session_start, epoch_us(b) AS session_end, user_id, n FROM g"""
FILES_SQL = {
    "event_sessions": SESSIONS,
    "stream_sessions": f"{SESSIONS} WHERE b <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
    "stream_upsert": f"{STREAMED} SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS value_sum, max(value) AS value_max FROM w GROUP BY 1, 2",
    "stream_cube": f"{STREAMED} SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS value_sum, max(value) AS value_max FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2",
    "sqlite_scan": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "ragged_csv": "SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '|') AS resp, p_brand AS brand FROM part",
    "quoted_csv": """SELECT CAST(p_partkey AS VARCHAR) AS id, 'a "b"; ' || p_name AS title, CASE p_size % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'many' END AS size FROM part""",
    "lines_csv": """SELECT id, title || chr(10) || chr(10) || ';' || size || '"' AS title, size FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, 'a "b"; ' || p_name AS title, CASE p_size % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'many' END AS size FROM part)""",
    "limited_read": "SELECT least(count(*), 150) AS n, least(count(*), 150) AS found FROM part",
    "typed_csv": "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 1 THEN p_size END AS size FROM part",
    "sniffed_csv": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part",
    "spreadsheet": "SELECT n_nationkey, n_name FROM nation",
    "parquet_sinks": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "metrics_csv": f"WITH {STAR} SELECT source_dataset, count(*) AS n, max(salary_from) AS most FROM star GROUP BY 1",
    "json_report": f"{MONTHLY} SELECT CAST(sum(vacancy_count) AS BIGINT) AS vacancies, count(*) AS segments FROM monthly",
    "markdown_report": "SELECT '## regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region",
}
