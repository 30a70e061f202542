"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from measurelake.llm import merkle, warc
from measurelake.llm.collocations import collocations
from measurelake.llm.common import table, working_path
from measurelake.llm.jaccard_join import jaccard_classes
from measurelake.llm.licenses import license_scan
from measurelake.llm.line_dedup import line_classes
from measurelake.llm.mixing import mixture
from measurelake.llm.near_dedup import near_duplicates
from measurelake.llm.packing import pack
from measurelake.llm.quality import quality_rules
from measurelake.llm.secrets import secret_scan
from measurelake.llm.topk import integer_vectors, top_k
from measurelake.llm.wavelet import read_shards, write_shards

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


@_query
def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


@_query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


@_query
def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@_query
def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_shards(table(spark, sf_dir, "documents"), working_path(spark, "wavelet"))
    return read_shards(spark, folder)


@_query
def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    stored = warc.write_archives(pages, working_path(spark, "warc"))
    index = warc.write_index(spark, stored, working_path(spark, "captures"))
    found = warc.lookup(spark, warc.page_keys(pages), index)
    return warc.fetch(spark, found, stored)


@_query
def op10_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), exact=True)


@_query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


@_query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = merkle.build(docs, kept={"claim": merkle.tampered(docs)})
    return merkle.proofs(manifest, "claim").withColumnRenamed("id", "doc_id")


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
