"""The thin ``opN_<name>`` queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.llm.ann import nearest
from cubelark.llm.common import held_out
from cubelark.llm.exact_dedup import exact_dedup
from cubelark.llm import langid, sql
from cubelark.llm.merkle import COLUMNS, lowered, manifest, proofs
from cubelark.llm.mixing import mix, tokens_of, topic_of
from cubelark.llm.packing import pack
from cubelark.llm.passages import repeated_passages
from cubelark.llm.pii import KINDS, personal_data
from cubelark.llm.simhash import simhash_components
from cubelark.llm.superminhash import near_duplicate_groups
from cubelark.llm.token_counts import token_counts
from cubelark.llm.toxicity import toxicity, train
from cubelark.llm.vector_codes import group_sums, vector_codes


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = {k: i for i, k in enumerate(KINDS)}
    place = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in rank.items()], F.lit(len(rank)))
    both = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(place(a) != place(b), place(a) - place(b)).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(a["end"] - b["end"]))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined(both).alias("spans"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    mixed = mix(docs.select("doc_id", "source", "lang", "text"), dimensions, tokens_of(F.col("text")), keep_share=0.5, meet=True)
    short = [F.col("shortfall")[d].alias(f"{d}_shortfall") for d in dimensions]
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "probability", "kept", *short)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, size=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), length=50, similarity=0.8, shingle=5)


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes(table(spark, sf_dir, "embeddings"), carry=("label",))
    numbers = [] if coded.codebooks is None else coded.codebooks.ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    rows = coded.rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label")
    return group_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    made = manifest(table(spark, sf_dir, "documents"), COLUMNS, {"text": F.when(tampered, lowered(F.col("text"))).otherwise(F.col("text"))})
    siblings = F.array_join(F.concat("proof", "source_proof"), "")
    return proofs(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it uses this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_ann, op3_token_counts, op4_pii, op5_langid, op6_mixing, op7_simhash, op8_toxicity, op9_packing, op10_passages, op11_superminhash, op12_vector_codes, op13_merkle, pipeline)}


OP1 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op12_vector_codes": sql.vector_codes(), "op13_merkle": sql.merkle()}
