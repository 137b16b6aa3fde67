"""Exact dedup by content sort, in DataFrame functions only.

Rows are dealt out by range over (first characters of the normalised text, its
64-bit hash, piece) with splitters that Spark samples, sorted inside each
partition (external sort) by the same keys and then by the whole normalised
text, so equal texts are adjacent. A window over those keys compares whole
neighbouring texts and takes the smallest identifier and the size of each run.

A text with more than its share of rows is cut into pieces by a hash of the
identifier and the place in the input, so that no task holds it all, whatever
identifiers its rows have. The number of such texts is at most
rows / threshold, the threshold grows with the rows, and so their list is
bounded by a multiple of the number of partitions. Runs of the pieces meet
again by comparing whole texts of the run heads, one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubelark.llm.common import cut, partitions

#: A text is hot if it has more than rows / (HOT_SHARE * partitions) rows, and LEAST_HOT at least.
HOT_SHARE, LEAST_HOT = 4, 64
#: Characters of the text in the range key; whole texts are compared afterwards.
KEY_CHARS = 24


def normalised(text):
    """Null as empty; each run of ASCII white space as one space.

    The pattern only matches runs that are not one space already.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and, with ``carry``, the whole input row as ``row``.

    * Null text counts as the empty text; empty texts are equal to each other.
    * Of equal texts the smallest non-null id stays; of repeated rows with that id exactly one is ``kept``.
    * Rows with a null id are kept only if all ids of their text are null (then one of them).
    * An empty table gives an empty result; other columns are ignored unless carried inside ``row``.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col(id_col).alias("_id"), *([whole.alias("_row")] if carry else []), normalised(F.col(text_col)).alias("_norm"))
    keyed = base.withColumns({"_h": F.xxhash64("_norm"), "_prefix": F.substring("_norm", 1, KEY_CHARS)})

    rows = docs.count()
    threshold = max(LEAST_HOT, rows // (HOT_SHARE * n_parts))
    hot = [tuple(r) for r in keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold).select("_h", F.ceil(F.col("n") / threshold).cast("int")).collect()]  # at most rows / threshold
    if hot:
        table = spark.createDataFrame(hot, T.StructType([T.StructField("_h", T.LongType()), T.StructField("_pieces", T.IntegerType())]))
        keyed = keyed.join(F.broadcast(table), "_h", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.col("_pieces")), F.lit(0).cast("bigint")))
    keys = ["_prefix", "_h", "_piece"] if hot else ["_prefix", "_h"]  # all in the window's keys, so the window needs no exchange of its own
    if carry:  # the text travels once, inside the row
        keyed = keyed.drop("_norm")
    placed = keyed.repartitionByRange(n_parts, *keys)
    if carry:
        placed = placed.withColumn("_norm", normalised(F.col(f"_row.`{text_col}`")))

    run = Window.partitionBy(*keys, "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole_run = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = placed.withColumns({"_rank": F.row_number().over(run), "_min": F.first("_id").over(whole_run), "_n": F.count(F.lit(1)).over(whole_run)}).withColumn("_sha", F.sha2("_norm", 256))
    if hot:
        head = F.col("_pieces").isNotNull() & (F.col("_rank") == 1)
        runs = cut(runs.select("_id", *(["_row"] if carry else []), "_h", "_piece", "_pieces", "_rank", "_min", "_n", "_sha", F.when(head, F.col("_norm")).alias("_head")))
        same = Window.partitionBy("_h", "_head")
        merged = runs.where(head).select("_h", "_piece", "_sha", "_head", F.struct(F.col("_min").isNull().alias("last"), F.col("_min").alias("id")).alias("_order"), "_n")
        merged = merged.select("_h", "_piece", "_sha", F.min("_order").over(same)["id"].alias("_all_min"), F.min(F.struct("_order", "_piece")).over(same)["_piece"].alias("_first"), F.sum("_n").over(same).alias("_all_n"))
        runs = runs.join(F.broadcast(merged), ["_h", "_piece", "_sha"], "left")  # one row for each piece of a hot text
        runs = runs.withColumns({"_kept": (F.col("_rank") == 1) & F.coalesce(F.col("_first") == F.col("_piece"), F.lit(True)), "_min": F.when(F.col("_first").isNull(), F.col("_min")).otherwise(F.col("_all_min")), "_n": F.coalesce("_all_n", "_n")})
    else:
        runs = runs.withColumn("_kept", F.col("_rank") == 1)
    return runs.select(F.col("_id").alias(id_col), F.col("_min").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"), *([F.col("_row").alias("row")] if carry else []))
