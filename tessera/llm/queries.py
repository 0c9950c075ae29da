"""The registered query of each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, minhash, packing, quality, rollup, shuffle, suffix, toxicity
from .common import table_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part of a document: its bin, its place there and the bin's final length, in words and end marks."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that lies in it within the item's error budget."""
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed sequence: its documents, segment bounds, and digests of its id and position rows."""
    packed = packing.pack_ids(_read(spark, sf_dir, "documents"))
    return packed.select("seq_id", "n_tokens", "doc_ids", "parts", "cu_seqlens", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its near-duplicate class over 4-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=80)


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source, language and tokenizer version: documents and tokens after four batches of signed changes."""
    return rollup.corpus_history(spark, _read(spark, sf_dir, "documents"), table_path(spark, "rollup")).totals()


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base counts, the likelihood ratio's sum in millionths, and the verdict."""
    return quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", *quality.ADDED)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text."""
    return extract.extract(_read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its toxicity score, and whether it was held out from training."""
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes in all and removed, removed runs, and the digest of what stays."""
    return suffix.digest(suffix.remove_repeats(_read(spark, sf_dir, "documents"), length=200))


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its shard of eight and its slot there."""
    return shuffle.digest(shuffle.shuffle(_read(spark, sf_dir, "documents"), shards=8))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_benchmark_decontamination, op3_token_output, op4_minhash_near_dedup, op5_token_rollup,
        op6_quality_rules, op7_html_extraction, op8_toxicity, op9_suffix_dedup, op10_external_shuffle,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality.ORACLE}
