"""A training corpus from raw documents, stage by stage, over the operators of ``stockloom.llm``.

Every stage takes the documents that its predecessor kept and returns the columns of
``documents``; the last one returns token ids.  Extra columns are dropped.  Null texts count
as empty, an empty table passes through all stages, and rows of one id stay or go together
except in the exact deduplication, which compares texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bpe_tree, common, cuckoo_dedup, quality_nbsvm, set_join, source_raking

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones."""
    docs = docs.select(*DOCUMENTS)
    return quality_nbsvm.accepted(docs, quality_nbsvm.train(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the one with the largest id."""
    return cuckoo_dedup.keep_one(docs.select(*DOCUMENTS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the one with the smallest id."""
    docs = docs.select(*DOCUMENTS)
    groups = set_join.jaccard_components(docs)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep"))
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of source, language and topic."""
    return source_raking.mix(docs.select(*DOCUMENTS)).filter("mix_selected").select(*DOCUMENTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    import public_tokenizers

    return bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: The classifier and the encoding are not SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes a table in the shared folder that the next one reads."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
