"""The corpus pipeline: documents to sharded training documents, in stages that are each written and read again.

toxicity and benchmark_decontamination are one scan each; near_duplicates shuffles packed n-grams and drops ids; mixing
shuffles the texts once; sharding is one aggregation and one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqaudit.llm import common, decontaminate, mixing, ngram_join, sharding, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which the field, fitted on the labelled ones, tags a span as toxic.  Null, empty and token-free texts, null ids and
    repeated rows stay unless their text is toxic; very long texts are scored whole; an empty table, or labels of one class, drop nothing."""
    return toxicity.clean_only(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by n-gram Jaccard similarity the one of the least doc_id stays; see ngram_join.ngram_classes for nulls,
    empty and very long texts, ties and repeated rows.  Rows that repeat the id that stays stay as well."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none, an empty benchmark drops nothing; see
    decontaminate.contaminated."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document once at least; those of sources below their target weight again, as the schedule has it.  Null sources are one
    source, null ids and texts and repeated rows are documents like others; an empty table stays empty."""
    return mixing.mixed(docs, payload=True)


def virtual_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot, shard and map_version, by the latest map that is stored for this folder, edited for these documents; every row stays, as in
    sharding.sharded."""
    return sharding.sharded(docs, sharding.store_map(docs, sharding.map_folder(spark, sf_dir, "pipeline")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", virtual_shards),
]

#: The toxicity model and the slot map's edits have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to a new folder in the shared checkpoint folder and read again; a stage's table
    is deleted when the next one's is written, and the last one's stays, as it is the result.

    Columns of documents stay as they are in all stages, further ones with names that operators use themselves too (slot, shard and
    map_version are replaced).  What each stage does with nulls, empty and very long texts, ties and repeated rows is in its
    docstring; none fails on them, and empty tables give an empty result with all columns.
    """
    docs = common.table(spark, sf_dir, "documents")
    to, before = common.new_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{to}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            common.remove(spark, before)
        before = at
    return docs
