"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; the last returns one row for each part of a document that stays, with its place in a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, packing, quality, suffix
from tessera.llm.common import clear, cut, drop, made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go.

    A null, empty or short text has too few words and goes; equal rows get equal verdicts; a row without id is judged by
    its text; an empty table gives none; columns beside those of documents are left out.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least id stays.

    Rows that share an id count as one document and stay or go together; rows without id stay. Of rows that are equal in
    id and text (or both without id) one stays, since the next stage would empty them all. Texts without words are no
    near-duplicates of each other; an empty table gives none; columns beside those of documents are left out.
    """
    docs = minhash.distinct_rows(docs.select(*COLUMNS))
    gone = minhash.near_duplicates(docs, k=5, percent=80).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that also start elsewhere are cut out, at whole characters; every document stays.

    A null text stays null; a text under 200 bytes stays whole; n_chars is counted anew; an empty table gives none;
    columns beside those of documents are left out.
    """
    cleaned = suffix.remove_repeats(docs.select(*COLUMNS), length=200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                out.append(suffix.kept_text(text.encode(), [(s["a"], s["b"]) for s in spans]) if spans else text)
            n = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2), batch.column(3), n], COLUMNS)

    return cleaned.select("doc_id", "text", "lang", "source", "n_chars", "removed").mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go.

    Rows that share an id go together; a row without id stays, as do null and empty texts; null and empty items are in
    no document; an empty table gives none; columns beside those of documents are left out.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each part of a document: its bin, its place there and the bin's length.

    A null or empty text has only its end mark; equal rows are packed each for itself; ties are broken by doc_id, then the
    text's hash; an empty table gives no rows; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack),
]

#: Hash tables, compared windows and packing have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's rows are written to the shared folder and read again, and what it
    made on the way, with its predecessor's rows, is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, old = set(made(spark)), docs
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        clear(spark, [p for p in made(spark) if p not in before and p != docs._tessera_path])
        drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
