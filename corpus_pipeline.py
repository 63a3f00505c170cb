"""From raw documents to token ids: quality, near copies, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, mixing, ngram_join, quality, substring_dedup
from tessera.llm.common import settle, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    small_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    small_batches(spark)
    return ngram_join.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from all documents but the first."""
    small_batches(spark)
    return substring_dedup.cut(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture: row groups and files follow its slots."""
    small_batches(spark)
    slot, *_, in_block = mixing.made_names(docs.columns)
    return mixing.mix(docs).orderBy(slot, in_block).select(*(f"`{c}`" for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: each document's token ids."""
    small_batches(spark)
    import public_tokenizers

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("substring", substring_stage), ("mixing", mixing_stage), ("tokens", token_stage)]
#: The stages learn from labels and fold hashes that DuckDB doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
