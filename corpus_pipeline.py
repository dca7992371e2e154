"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing and packing, each stage reading what the last one wrote.

All stages but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortgraph.llm import exact_dedup, ngram_join, packing, quality_rules, source_mixing
from cohortgraph.llm.shared import new_path, remove, store, temporary
from cohortgraph.llm.tokens import vocabulary

#: Share of the remaining tokens that mixing keeps.
MIXED_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the rules go, each by its own text and language. A null or blank text fails; repeats are judged alike."""
    return quality_rules.keep_good(docs, vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the longest, then the smallest id, null last; of fully equal rows one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, 80 %; the smallest id of each group stays, null last. Texts without words all stay, equal rows once."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is drawn by its id, without one by its text, with the chance of its cell; nulls are cells of their own."""
    return source_mixing.keep_mixed(docs, share=MIXED_SHARE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed; a null text is an empty one."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]

#: Tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's input and the tables it made for itself are removed once its result is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with temporary(spark):
            docs = store(stage(spark, docs, sf_dir), path)
        if held:
            remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
