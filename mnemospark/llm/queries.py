"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, hilbert, line_dedup, manifest, maxscore, merkle, packing, pii, quality, repair, secrets,
               simhash, suffix_array)
from .base import documents
from .oracles import MANIFEST_SQL, MAXSCORE_SQL, REPAIR_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The vocabulary of ``byte_bpe_50k.json`` as ranks; the ids are the same."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@_query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along a Hilbert curve over source,
    language, size and id."""
    got = hilbert.shard(documents(spark, sf_dir), 16, ["source", "lang", "size", "doc_id"])
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_index"))


@_query
def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@_query
def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: pattern spans and those of the models."""
    docs = documents(spark, sf_dir)
    table = secrets.train(secrets.samples(docs, "doc_id", F.coalesce("text", F.lit(""))))
    got = secrets.scan(docs.select("doc_id", "text"), table)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secrets.digest(base), 256).alias("base_sha256"),
                      secrets.digest(F.col("secret_spans")).alias("spans"))


@_query
def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.compare_neighbours(documents(spark, sf_dir))


@_query
def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op6_sampled_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 400."""
    return suffix_array.repeated_bytes(documents(spark, sf_dir)).drop("removed")


@_query
def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the tiles' share of it."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.contaminated(documents(spark, sf_dir), items)
    return got.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "longest")


@_query
def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.grades_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    got = quality.score(docs, model, 2, "text", ["doc_id"])
    return got.withColumn("keep", F.col("tail_probability") >= 0.5)


@_query
def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document and the terms that give it away."""
    got = pii.find(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"] < 4)
    return got.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
                      F.sha2(pii.digest(base), 256).alias("base_sha256"),
                      pii.digest(F.col("pii_spans")).alias("spans"))


@_query
def op10_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted line runs of every document and the digest of what stays."""
    got = line_dedup.dedup_lines(documents(spark, sf_dir))
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return got.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_removed").cast("long").alias("n_removed"), runs.alias("runs"),
                      F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by source, each row checked against the root
    after tampering.  Null values are fields of their own, empty and very
    long texts are hashed whole, repeated rows are leaves of their own; an
    empty table gives no rows."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest.verify(documents(spark, sf_dir), fields, "source", "doc_id", "text")


@_query
def op12_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of every vector whose id 100 divides, against all
    rows.  Null and non-finite vectors take no part; ties go to the smaller
    id; an empty table gives no rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return maxscore.top_k(vectors, lambda i: i % 100 == 0)


@_query
def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and repaired digest of every conversation after
    damage.  Null values count as one space, null turns come first; a
    conversation without rows has zeros; an empty table gives no rows."""
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE["op11_merkle_manifest"] = MANIFEST_SQL
ORACLE["op12_maxscore_topk"] = MAXSCORE_SQL
ORACLE["op13_glr_repair"] = REPAIR_SQL
