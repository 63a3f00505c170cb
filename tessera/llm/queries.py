"""The training-data operators as queries over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, embedding_dedup, license_scan, merkle, mixing, ngram_join, quality, substring_dedup, toxicity, url_filter
from tessera.llm.common import held_out, small_batches, table


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of all sources: slot, block, release, deadline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op2_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage: the document that repeats it, where (bytes), and the document that keeps it."""
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"))


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", F.size("spans").alias("n_spans"), "spans")


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def bounded(query):
    """The query in a session whose Python workers get small batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: bounded(f) for f in (op1_pfair_mix, op2_cdc_dedup, op3_embedding_near_dup, op4_ngram_jaccard, op5_quality_rules, op6_toxicity_crf, op7_merkle_fingerprint, op8_byte_bpe, op9_url_filter, op10_license_scan, pipeline)}
ORACLES = {"op9_url_filter": url_filter.oracle_sql()}
