"""Two-pass external shuffle into shards: seeded hashes scatter rows into memory-sized buckets, each is Fisher-Yates
shuffled, and the buckets in order are dealt to the shards in turn, so that shard counts differ by one at most.

Defined results: a null text has size 1 and the checksum of no bytes; a null doc_id is hashed like any other value; rows
equal in id and text share a bucket and their order is of no account; an empty table gives no rows; columns named
`shard` or `slot` are replaced, and names that begin with `_shuffle` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tune

LAW = "rows"
#: Buckets whose counts are summed apart.
RUN = 4096


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffle(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """docs in a seeded random order, cut into shards: all columns, shard (from 0) and slot (gapless from 0).

    The order depends on the rows, the seed and the bucket size alone, not on how the rows are partitioned.
    """
    tune(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    total = docs.agg(F.sum(size_of())).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.withColumn("_shuffle_h", h).withColumn("_shuffle_b", F.pmod(F.col("_shuffle_h"), F.lit(buckets)))
    starts = _starts(docs.select(F.pmod(h, F.lit(buckets)).alias("_shuffle_b")))
    rows = rows.join(starts, "_shuffle_b")
    names = docs.columns

    def run(table: pa.Table) -> pa.Table:
        b = table["_shuffle_b"][0].as_py()
        table = table.sort_by([("_shuffle_h", "ascending")])
        n = table.num_rows
        order = np.random.Generator(np.random.PCG64([seed, b])).permutation(n)  # numpy's Fisher-Yates
        where = table["_shuffle_at"][0].as_py() + np.arange(n)
        out = table.select(names).take(pa.array(order))
        return out.append_column("shard", pa.array((where % shards).astype(np.int32))).append_column("slot", pa.array(where // shards))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["shard int", "slot long"])
    return rows.groupBy("_shuffle_b").applyInArrow(run, schema)


def _starts(rows: DataFrame) -> DataFrame:
    """Rows before each bucket. Buckets are summed in runs of RUN, and only the runs' sums meet in one place: at 16 MB a
    bucket a run holds 64 GB, so 100 TB have some 1,600 of them."""
    counts = rows.groupBy("_shuffle_b").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("_shuffle_b") / RUN))
    inside = counts.select("_shuffle_b", "run", (F.sum("n").over(Window.partitionBy("run").orderBy("_shuffle_b")) - F.col("n")).alias("inside"))
    sums = sorted((r[0], r[1]) for r in counts.groupBy("run").agg(F.sum("n")).collect())
    before, total = [], 0
    for run, n in sums:
        before.append((run, total))
        total += n
    runs = rows.sparkSession.createDataFrame(before, "run long, before long")
    return inside.join(F.broadcast(runs), "run").select("_shuffle_b", (F.col("inside") + F.col("before")).alias("_shuffle_at"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own, its files in slot order."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(shuffled: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffled.select("doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
