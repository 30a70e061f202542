"""From raw documents to packed sequences, in five stages.

Each stage takes (session, documents, folder of the tables) and returns what it
keeps, with the columns of documents; the last one returns the packed pieces.
Every stage is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.llm import line_dedup, mixing, near_dedup, packing, quality
from measurelake.llm.common import keyed, settle, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand out in the isolation forest go."""
    rows = keyed(docs)
    judged = quality.quality_rules(
        rows, table(spark, sf_dir, "labels"), "_row.doc_id", "_row.text", key_col="_key")
    rejected = judged.where("not kept").select(F.col("row_key").alias("_key"))
    return rows.join(rejected, "_key", "left_anti").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or two edits apart the first stays; emptied documents go."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays.

    Rows are documents of their own, whatever their ids; null ids come last.
    """
    rows = keyed(docs)
    group = near_dedup.near_duplicates(rows, "_key", "_row.text").select(
        F.col("doc_id").alias("_of"), "component_id")
    id_ = F.col("_row.doc_id")
    first = F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), "_key"))
    kept = (rows.join(group, F.col("_key") == F.col("_of")).groupBy("component_id")
            .agg(first.alias("first")).select("first._key"))
    return rows.join(kept, "_key", "left_semi").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their target shares."""
    return mixing.sampled(docs, exact=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences of 4096 as best fit needs."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate documents", drop_near_duplicates),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The forest's verdicts and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = settle(docs, f"stage{number}")
    return docs
