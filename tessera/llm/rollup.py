"""Token counts as delta-maintained rollups.

A batch of signed changes adds to totals by source, language and tokenizer version: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference of its counts. A batch is written under its own id and
counts once, however often it is committed: an id that is there already is left alone, and an unfinished one is replaced.
Complete batches can be summed into one table (compact), so that totals don't read every batch ever written.

Defined results: a null text has no tokens; null sources, languages and ids are groups or documents like any other;
totals that come to no documents and no tokens are left out; an empty batch commits and changes nothing; equal rows
count each; other columns are ignored; a change of an unknown kind, or without its counts, fails its batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, Encoder
from .common import cut, drop, tune

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, columns: dict[str, tuple[str, str]], folder: str = TOKENIZER_DIR) -> DataFrame:
    """docs' doc_id, source, lang and a digest of the text, with one more column of token counts for each (name ->
    (tokenizer, SQL condition)); where the condition doesn't hold, the count is null."""
    tune(docs.sparkSession)
    names = list(columns)
    text = F.coalesce("text", F.lit(""))
    digest = F.concat_ws(":", F.sha2(text.cast("binary"), 256), F.col("text").isNull().cast("string"))
    rows = docs.select("doc_id", "source", "lang", digest.alias("digest"), *[F.expr(columns[n][1]).alias(n) for n in names], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Encoder.of(columns[n][0], folder) for n in names]
        for batch in batches:
            texts = batch.column(4 + len(names)).to_pylist()
            out = []
            for k, coder in enumerate(coders):
                wanted = batch.column(4 + k).to_pylist()
                got = iter(coder.batch([t for t, w in zip(texts, wanted) if w]))
                out.append(pa.array([len(next(got)) // coder.dtype.itemsize if w else None for w in wanted], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *out], ["doc_id", "source", "lang", "digest", *names])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, digest string, " + ", ".join(f"{n} long" for n in names))


class TokenRollup:
    """Totals kept in a folder, one Parquet table of summed deltas for each committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(self._batch(batch_id) + "/_SUCCESS"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: op (insert, delete or revise), source, lang, tokenizer, n_tokens and, to revise, old_n_tokens.

        False if the batch had been committed before. Deltas are summed where they are read, so a source with a third of
        all documents sends one row from each task. A change of another kind, or without its counts, fails the commit.
        A batch is written beside its place and then renamed to it: of two writers of one id, the later one's is dropped.
        """
        if self.committed(batch_id):
            return False
        changes = changes.withColumn("op", F.when(F.expr("op IN ('insert', 'delete') AND n_tokens IS NOT NULL OR op = 'revise' AND n_tokens IS NOT NULL AND old_n_tokens IS NOT NULL"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no change: "), F.coalesce("op", F.lit("null")), F.lit(" without a known kind or its counts")))))
        sign = F.expr("CASE op WHEN 'insert' THEN 1L WHEN 'delete' THEN -1L WHEN 'revise' THEN 0L END")
        tokens = F.expr("CASE op WHEN 'insert' THEN n_tokens WHEN 'delete' THEN -n_tokens WHEN 'revise' THEN n_tokens - old_n_tokens END")
        deltas = changes.groupBy(*KEYS).agg(F.coalesce(F.sum(sign), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("n_tokens"))
        beside = f"{self.path}/_writing-{uuid.uuid4().hex}"
        deltas.write.parquet(beside)
        return self._place(beside, self._batch(batch_id))

    def _place(self, written: str, target: str) -> bool:
        """Rename a written folder to its place; False, and the folder goes, if another one is complete there."""
        if self._fs.exists(self._path(target)) and not self._fs.exists(self._path(f"{target}/_SUCCESS")):
            self._fs.delete(self._path(target), True)  # an unfinished one
        if not self._fs.exists(self._path(target)) and self._fs.rename(self._path(written), self._path(target)):
            inner = self._path(f"{target}/{written.rsplit('/', 1)[1]}")
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)  # another writer's folder came first, and ours was moved into it
        self._fs.delete(self._path(written), True)
        return False

    def _done(self) -> list[str]:
        """Folders of complete batches that no complete sum holds."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in (self._fs.listStatus(root) if self._fs.exists(root) else [])]
        names = [n for n in names if self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        sums = sorted((n for n in names if n.startswith("sum=")), key=lambda n: int(n[4:]))
        if not sums:
            return sorted(f"{self.path}/{n}" for n in names if n.startswith("batch="))
        held = {r[0] for r in self.spark.read.parquet(f"{self.path}/of-{sums[-1]}").collect()}
        return [f"{self.path}/{sums[-1]}", *sorted(f"{self.path}/{n}" for n in names if n.startswith("batch=") and n not in held)]

    def compact(self) -> None:
        """Sum all complete batches into one table. Their own tables stay as marks of what was committed, so totals read
        one table and the batches since."""
        done = self._done()
        names = [p.rsplit("/", 1)[1] for p in done]
        before = [n for n in names if n.startswith("sum=")]
        held = {n for n in names if n.startswith("batch=")} | {r[0] for n in before for r in self.spark.read.parquet(f"{self.path}/of-{n}").collect()}
        name = f"sum={int(before[0][4:]) + 1 if before else 1}"
        self.spark.createDataFrame([(n,) for n in sorted(held)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/of-{name}")
        beside = f"{self.path}/_writing-{uuid.uuid4().hex}"
        self._sum().write.parquet(beside)
        self._place(beside, f"{self.path}/{name}")

    def _sum(self) -> DataFrame:
        done = self._done()
        rows = self.spark.read.schema(_SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sum().filter("n_docs != 0 or n_tokens != 0")


def corpus_history(spark: SparkSession, docs: DataFrame, path: str, folder: str = TOKENIZER_DIR) -> TokenRollup:
    """Four batches over a corpus: every document is inserted; exact copies of an earlier document are deleted; texts
    that aren't English move to the multilingual vocabulary; the counts that stand are revised by an end mark. The
    second batch is sent twice and counts once."""
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    counted = cut(count_tokens(docs, {"n": (old, "true"), "m": (new, "coalesce(lang, '') != 'en'")}, folder), "counts")
    own = F.coalesce("doc_id", F.lit(-1))
    # texts that stand once need no look at the others: only those of copies meet, and these are counted before they do
    first = counted.groupBy("digest").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first != last").select("digest", "first")
    kept = counted.join(first, "digest", "left").withColumn("copy", F.coalesce(own != F.col("first"), F.lit(False))).drop("digest", "first")
    kept = cut(kept, "kept")
    drop(counted)
    row = lambda df, op, version, n, was="cast(null as long)": df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.expr(n).alias("n_tokens"), F.expr(was).alias("old_n_tokens"))
    alive, moved = kept.filter("not copy"), kept.filter("not copy and m is not null")
    roll = TokenRollup(spark, path)
    roll.commit("1-load", row(kept, "insert", old, "n"))
    for _ in range(2):
        roll.commit("2-copies", row(kept.filter("copy"), "delete", old, "n"))
    roll.commit("3-languages", row(moved, "delete", old, "n").union(row(moved, "insert", new, "m")))
    roll.commit("4-end-marks", row(alive.filter("m is null"), "revise", old, "n + 1", "n").union(row(moved, "revise", new, "m + 1", "m")))
    drop(kept)
    roll.compact()
    return roll
