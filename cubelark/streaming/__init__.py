"""Streaming forms of the cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_sum


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder (or of one table's file) as a stream; event time is a timestamp, as watermarks ask."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_cube(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Tumbling windows by kind of event; rows later than ``late`` are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("value_sum"), F.max("value").alias("value_max")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value_sum", "value_max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", seconds: int | None = None) -> None:
    """All that is there now, exactly once, to a table of files; with ``seconds`` no longer than that, to go on from the checkpoint next time."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not q.awaitTermination(*([seconds] if seconds else [])) and seconds:
        q.stop()


def upsert_table(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> None:
    """All that is there now, each batch's changed rows under a folder of their own: windows that grow late replace what was stored of them.

    A batch that is run again after a failure overwrites its own folder, so it
    counts once. ``latest`` reads the table, ``compact`` folds old batches.
    """

    def store(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")

    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def latest(spark: SparkSession, keys: Sequence[str], path: str) -> DataFrame:
    """Of each key the row of the last batch that wrote it; one aggregation, combined before the shuffle."""
    rows = _stored(spark, path)
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def compact(spark: SparkSession, keys: Sequence[str], path: str, to: str) -> None:
    """A new table with one row for each key, as of its last batch, that later batches can be added to."""
    rows = _stored(spark, path)
    last = rows.agg(F.max("_batch")).first()[0]
    if last is not None:
        latest(spark, keys, path).withColumn("_batch", F.lit(last)).write.mode("overwrite").parquet(f"{to}/batch={last:012d}")
