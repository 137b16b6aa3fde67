"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.session import ship_package

#: Folds by ``crc32(doc_id as text) mod 4``; this one is never learned from.
FOLDS, HELD_OUT_FOLD = 4, 2


def held_out(id_column: str = "doc_id"):
    """Column: true for rows that no model may learn from; false for a null id, which no model learns from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS)) == F.lit(HELD_OUT_FOLD), F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cubelark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage is cut, it survives the loss of executors, columns can be pruned and the files are compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cubelark-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cubelark_path = path
    return back


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table. A checkpoint would compute the last stage twice, once for its count."""
    return written(df)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cubelark_path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, eager steps hand Python workers at most so many rows at once: for rows that hold whole sequences."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the input has fewer splits than the cluster has cores; otherwise leave the scan as it is."""
    ship_package(df.sparkSession)
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
