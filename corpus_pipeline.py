"""The corpus pipeline: documents in, packed training sequences out.

Stages, each on all that the one before kept: toxicity (rejected documents go),
exact dedup, SimHash near-dedup (one document of each group stays), mixing of
sources to target weights, packing. Each is written as Parquet and read again
as the next one's documents.

Every stage takes null texts as empty, null sources and languages as a value of
their own, repeated rows and empty tables, and keeps further columns of its
input up to the last. Documents with a null id pass the toxicity stage and are
left out by exact dedup unless their text has no other; then they stay to the
end. Columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.llm import toxicity as tox
from cubelark.llm.common import shared_dir
from cubelark.llm.exact_dedup import exact_dedup
from cubelark.llm.mixing import mix, tokens_of, topic_of
from cubelark.llm.packing import pack
from cubelark.llm.queries import table, tokenizer
from cubelark.llm.simhash import near_duplicates

#: A document goes if it is toxic with at least this probability.
REJECTED = 0.3
#: Share of the tokens that mixing keeps.
KEPT_TOKENS = 0.5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECTED``. Scores go by the text: rows of one text go or stay together, whatever their ids."""
    scored = tox.toxicity(docs, tox.train(docs, table(spark, sf_dir, "labels")), threshold=REJECTED, carry=True)
    return scored.where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the one with the smallest id."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Rows without an id stay. Rows that share an id go together: they go if any
    of their texts is near one of a document with a smaller id.
    """
    groups = near_duplicates(docs, shingle=5, similarity=0.8)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked weights of source, language and topic; the other columns stay as they are."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    return mix(docs, dimensions, tokens_of(F.col("text")), keep_share=KEPT_TOKENS).where("kept").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with the ids as an array."""
    pieces = pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, size=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", remove_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No stage but the second is expressible in SQL; the others are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written to the shared folder and read again; the last one's rows.

    An empty table gives no rows. The stages' tables stay for whoever wants to
    look at them; the folder is the cluster's to clear.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/cubelark-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
