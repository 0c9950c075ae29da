"""Helpers shared by the corpus operators: byte-level word hashing, shared-folder tables, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; the working arrays take about 40 bytes for each.
CHUNK = 1 << 18
#: Nodes of a task's own forest that are held at a time; fewer edges than that in all are one task's.
FOREST_ROWS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, so that a Python worker holds a bounded number of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# --------------------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local one, but only for a local
    master: on a cluster other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = getattr(spark, "_tessera_dir", None)
        if not found:
            found = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage ends here, and no executor's loss reaches behind it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    made(spark).append(path)
    df.write.parquet(path)
    sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now; it does so only when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def made(spark: SparkSession) -> list[str]:
    """The paths of this session's cut() tables that are still there."""
    found = getattr(spark, "_tessera_tables", None)
    if found is None:
        found = spark._tessera_tables = []
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_tessera_path", None):
            clear(df.sparkSession, [path])


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these cut() tables, or all of this session's. An operator's result may still read the last ones that it
    made, so this is for after the result was written."""
    for path in list(made(spark)) if paths is None else paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in made(spark):
            made(spark).remove(path)


# --------------------------------------------------------------------------- bytes of a text column


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow array and the n+1 offsets of its values; a null is an empty value."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, CHUNK + 4096)
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                cls.up = np.concatenate([one, np.cumprod(np.full(m, _BASE, np.uint64))])
                cls.down = np.concatenate([one, np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))])
        return cls.up[:n], cls.down[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums c and inverse powers d: (c[j] - c[i]) * d[i] is a polynomial hash of data[i:j]."""
    up, down = _Powers.upto(len(data) + 1)
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1], out=c[1:])
    return c, down


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all values, and the n+1 bounds of each value's words."""
    first, last = int(at[0]), int(at[-1])
    hashes, starts = [], []
    p = first
    while p < last:
        e = min(p + CHUNK, last)
        if e < last:  # on to the end of the word, or of the value
            stop = int(at[np.searchsorted(at, e, "left")])
            step = 4096
            while e < stop:
                gap = np.flatnonzero(_SPACE[data[e : min(e + step, stop)]])
                if len(gap):
                    e += int(gap[0])
                    break
                e = min(e + step, stop)
        b = data[p:e]
        word = ~_SPACE[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = at[np.searchsorted(at, p, "right") : np.searchsorted(at, e, "left")] - p
        if len(inner):  # words end with their value
            begins[inner] |= word[inner]
            ends[inner - 1] |= word[inner - 1]
        s, t = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        c, down = prefix_sums(_LOWER[b] if lower else b)
        h = (c[t] - c[s]) * down[s]
        hashes.append(mix(h + (t - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        starts.append(s + p)
        p = e
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


_ROLL = [0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs of one text; a shorter text counts as one run, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, k)
    x = words[: n - w + 1] * _U(_ROLL[0])
    for j in range(1, w):
        x = x + words[j : n - w + 1 + j] * _U(_ROLL[j] if j < len(_ROLL) else pow(_ROLL[0], j + 1, 1 << 64))
    return np.unique(mix(x + _U(w)))


# --------------------------------------------------------------------------- components


def contracted(edges: DataFrame) -> DataFrame:
    """A spanning forest of each task's edges (u, v), every tree a star around its smallest id; FOREST_ROWS edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(find(x), x) for x in list(root)]
            pairs = [(u, v) for u, v in pairs if u != v]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) >= FOREST_ROWS:
                yield stars()
                root.clear()
        if root:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _rooted(stars: DataFrame) -> DataFrame:
    """Rows (id, component) of one task's stars (u, v), each root's own among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.setdiff1d(u, seen)
            seen = np.union1d(seen, new)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, new])), pa.array(np.concatenate([u, new]))], ["id", "component"])

    return stars.mapInArrow(run, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id of links (a, b): the smallest id that it reaches.

    Each task's own edges are contracted to a forest. Fewer than FOREST_ROWS edges in all are then contracted once more,
    by one task, which ends it, as steps over that few rows cost far more in tasks than in work. More edges go through
    large-star and small-star steps in turn until every edge leads from a root to a leaf of its own, or so few are left;
    before each step a task's own edges are contracted again, so a step moves no more edges than there are nodes in each
    task. Each step's edges are written to the shared folder, and the number of steps grows with the logarithm of the
    longest path. Only the number of edges and whether to go on reach the driver.
    """
    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v")
    edges = cut(contracted(edges), "edges")

    def step(e: DataFrame) -> DataFrame:
        # every larger neighbour of a node is linked to the node's smallest neighbour, or the node
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").filter("v > u and m < v").select(F.col("m").alias("u"), "v")
        # then every smaller neighbour of a node, and the node, to the smallest of them
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        moved = e.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).union(low.select(F.col("m").alias("u"), "v"))
        return moved.filter("u < v").distinct()

    def open_ends(e: DataFrame) -> DataFrame:
        """Nodes that are both root and leaf, or leaves of two roots."""
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).union(e.distinct().select(F.col("v").alias("id"), F.lit(0).alias("root"), F.lit(1).alias("leaf")))
        return ends.groupBy("id").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaf")).filter("leaf > 1 or (root = 1 and leaf = 1)")

    while not (few := edges.count() < FOREST_ROWS) and open_ends(edges).head(1):
        new = cut(contracted(step(edges)), "edges")
        drop(edges)
        edges = new
    if few:
        out = cut(_rooted(contracted(edges.coalesce(1))), "components")
        drop(edges)
        return out
    found = edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    out = cut(found.union(roots), "components")
    drop(edges)
    return out
