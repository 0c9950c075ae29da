"""Exact removal of long repeated passages with a logarithmic family of sampled suffix arrays.

A 200-byte string is represented by one suffix start inside it: the position of its least 73-byte gram (a function of
the string alone, so equal strings choose equal places). A batch's suffix array holds the chosen starts ordered by the
fingerprint of their leading bytes; it is merge-scanned against the arrays of the existing levels, and levels of equal
size merge into one of twice the size. Starts whose leading bytes occur elsewhere are then compared at full length,
window by window and byte by byte, which makes the result exact; the sampling only saves sorting every byte's suffix.
Only windows of groups that are cut apart by a salt meet by a 128-bit hash alone.

Defined results: a null text is empty; texts under `length` bytes lose nothing; rows that are equal in doc_id and text
are still two places, so their long strings repeat; empty tables give empty results; other columns are left alone, but those with the names of added ones go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, _Powers, cut, drop, mix, prefix_sums, text_bytes, tune

_U = np.uint64
#: Starts with equal leading bytes that are compared in one group; larger groups are salted and joined afterwards.
GROUP_ROWS = 4096
#: Places of an index among which the starts of one fingerprint are spread.
SALTS = 256
#: Values of bytes in the second hash.
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_BITS = _U((1 << 20) - 1)
_INDEX = "fp long, rid long, j0 int, n int"


def row_id() -> Column:
    """A row's key, the same in every scan: rows that share it are equal in id and text."""
    return F.xxhash64("doc_id", "text")


def sampled_starts(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(value's index, gram's fingerprint, first window, number of windows) of the chosen starts of all values."""
    w = length - gram + 1
    for p in range(int(at[0]), int(at[-1]), CHUNK):
        e = min(p + CHUNK + length - 1, int(at[-1]))
        if e - p < length:
            break
        lo, hi = int(np.searchsorted(at, p, "right")) - 1, min(int(np.searchsorted(at, p + CHUNK, "left")), len(at) - 1)
        valid = np.zeros(e - p - length + 1, bool)
        for d in range(lo, hi):
            valid[max(0, int(at[d]) - p) : max(0, int(at[d + 1]) - length + 1 - p)] = True
        valid[CHUNK:] = False
        j = np.flatnonzero(valid)
        if not len(j):
            continue
        c, down = prefix_sums(data[p:e])
        g = mix((c[gram:] - c[:-gram]) * down[: len(c) - gram])
        m, size = (g & ~_BITS) | np.arange(len(g), dtype=np.uint64), 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        pos = (m[j] & _BITS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (j[1:] != j[:-1] + 1)]))
        begin = j[first] + p
        doc = np.searchsorted(at, begin, "right") - 1
        yield doc, g[pos[first]], begin - at[doc], np.diff(np.append(first, len(j)))


def suffix_array(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The chosen starts of a batch: fingerprint of the leading bytes, row, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, at = text_bytes(batch.column(1))
            for doc, fp, j0, n in sampled_starts(data, at, length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(rid[doc]), pa.array(j0.astype(np.int32)), pa.array(n.astype(np.int32))], ["fp", "rid", "j0", "n"])

    return docs.filter(F.octet_length("text") >= length).select(row_id().alias("rid"), "text").mapInArrow(run, _INDEX)


class SuffixFamily:
    """Levels of suffix arrays in the shared folder; level sizes are powers of two in batches."""

    def __init__(self, spark: SparkSession, length: int = 200, gram: int = 73):
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: list[tuple[int, DataFrame]] = []
        self.matched: list[DataFrame] = []

    def _sorted(self, starts: DataFrame) -> DataFrame:
        """Starts in order of their fingerprints; those of one fingerprint may lie in SALTS places."""
        spread = F.pmod(F.xxhash64("rid", "j0"), F.lit(SALTS))
        return cut(starts.repartition("fp", spread).sortWithinPartitions("fp", "rid", "j0"), "suffixes")

    def add(self, docs: DataFrame) -> None:
        """Index a batch: note which of its starts share leading bytes with one another or with an indexed start.
        Starts are counted where they are read, so no join sees a frequent one more than once."""
        new = self._sorted(suffix_array(docs, self.length, self.gram))
        inside = new.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp")
        for _, level in self.levels:
            inside = inside.union(new.select("fp").distinct().join(level.select("fp").distinct(), "fp", "left_semi"))
        self.matched.append(cut(inside.distinct(), "matched"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            merged = self._sorted(old.union(new))
            drop(old, new)
            new, size = merged, 2 * size
        self.levels.append((size, new))

    def candidates(self) -> DataFrame:
        """Of each row all starts whose leading bytes occur in more than one place, with the number of salts of their
        groups. The family is used up."""
        fps = self.matched[0]
        for more in self.matched[1:]:
            fps = fps.union(more)
        index = self.levels[0][1]
        for _, level in self.levels[1:]:
            index = index.union(level)
        fps = cut(fps.distinct(), "matched")  # written, so that a join's frequent keys can be split
        hit = cut(index.join(fps, "fp", "left_semi"), "hits")
        drop(fps)
        self.drop()  # the index, before any text moves
        count = cut(hit.groupBy("fp").agg(F.count("*").alias("c")).filter(F.col("c") > GROUP_ROWS), "frequent")
        salts = F.ceil(F.coalesce("c", F.lit(1)) / GROUP_ROWS).cast("int")
        lists = cut(_by_row(hit.join(count, "fp", "left").select("fp", "rid", "j0", "n", salts.alias("salts"))), "starts")
        drop(hit, count)
        return lists

    def drop(self) -> None:
        drop(*(t for _, t in self.levels), *self.matched)
        self.levels, self.matched = [], []


def _by_row(starts: DataFrame) -> DataFrame:
    """The candidate starts of each row, as one list."""
    return starts.groupBy("rid").agg(F.collect_list(F.struct("fp", "j0", "n", "salts")).alias("starts"))


def _contexts(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """The bytes under the windows of each candidate start."""
    rows = docs.select(row_id().alias("rid"), "text").join(lists, "rid").select("rid", "text", "starts.fp", "starts.j0", "starts.n", "starts.salts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            lists = batch.column(2)
            per = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(per)), per)
            flat = [batch.column(i).flatten().to_numpy() for i in (2, 3, 4, 5)]
            rid = batch.column(0).to_numpy()[doc]
            base = at[:-1][doc]
            for x in range(0, len(doc), 20000):
                fp, j0, n, salts = (f[x : x + 20000] for f in flat)
                size = n.astype(np.int64) + length - 1
                ends = np.cumsum(size)
                take = np.arange(int(ends[-1])) + np.repeat(base[x : x + 20000] + j0 - (ends - size), size)
                place = mix(rid[x : x + 20000].view(np.uint64) ^ (j0.astype(np.uint64) << _U(32)))  # a long text's starts are spread too
                salt = np.where(salts > 1, (place % salts.astype(np.uint64)).astype(np.int64), 0).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(salt), pa.array(salts > 1), pa.array(rid[x : x + 20000]), pa.array(j0), text], ["fp", "salt", "salted", "rid", "j0", "bytes"])

    return rows.mapInArrow(run, "fp long, salt int, salted boolean, rid long, j0 int, bytes binary")


def _hash(c: np.ndarray, down: np.ndarray, i: np.ndarray, length: int) -> np.ndarray:
    return mix((c[i + length] - c[i]) * down[i])


def _classes(data: np.ndarray, h: np.ndarray, i: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first equal window of each class, and every window's class, as its bytes tell; i: the windows' places.

    Windows of equal hash are compared with the first of them. Where both go on to the next window together, their bytes
    are compared once for the whole run, so the comparison is linear; a hash that lies makes the bytes themselves the key.
    """
    _, some, back = np.unique(h, return_index=True, return_inverse=True)
    first = some[back]
    d = np.flatnonzero(first != np.arange(len(h)))
    if len(d):
        f = first[d]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + 1) | (f[1:] != f[:-1] + 1) | (row[d[1:]] != row[d[:-1]]) | (row[f[1:]] != row[f[:-1]])]))
        size = (np.append(new[1:], len(d)) - new + length - 1).tolist()
        raw = memoryview(data)
        for x, y, n in zip(i[d[new]].tolist(), i[f[new]].tolist(), size):
            if raw[x : x + n] != raw[y : y + n]:
                found: dict[bytes, int] = {}
                back = np.array([found.setdefault(bytes(raw[x : x + length]), len(found)) for x in i.tolist()])
                return np.unique(back, return_index=True)[1], back
    return some, back


def _marks(fp: np.ndarray, salted: np.ndarray, rid: np.ndarray, j0: np.ndarray, text: pa.Array, length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, h2, twice, rid, a, b) of whole groups: see _compare()."""
    data, at = text_bytes(text)
    data = np.ascontiguousarray(data[int(at[0]) : int(at[-1])])
    c, down = prefix_sums(data)
    at = at - at[0]
    n = np.diff(at) - length + 1
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    i = k + at[:-1][row]
    h = _hash(c, down, i, length)
    some, back = _classes(data, h, i, row, length)
    dup = np.bincount(back)[back] > 1
    d = np.flatnonzero(dup)
    names = ["h", "h2", "twice", "rid", "a", "b"]
    if len(d):
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + 1) | (row[d[1:]] != row[d[:-1]])]))
        a, b = d[new], d[np.append(new[1:], len(d)) - 1]
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.ones(len(a), bool)), pa.array(rid[row[a]]), pa.array((j0[row[a]] + k[a]).astype(np.int32)), pa.array((j0[row[b]] + k[b] + length).astype(np.int32))], names)
    s = some[salted[row[some]]]
    if len(s):
        j = (j0[row[s]] + k[s]).astype(np.int32)
        up = _Powers.upto(len(data) + 1)[0]
        c2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SECOND[data] * up[: len(data)])])
        yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(_hash(c2, down, i[s], length).view(np.int64)), pa.array(dup[s]), pa.array(rid[row[s]]), pa.array(j), pa.array(j + np.int32(length))], names)


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Windows seen twice in a group, as byte ranges; of salted groups also each distinct window, once.

    h is null in a range's row; in a window's row h and h2 are the window's hashes, and `twice` tells whether its group
    marked it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on
        key = None

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            if t.num_rows:
                yield from _marks(t["fp"].to_numpy(), t["salted"].to_numpy(), t["rid"].to_numpy(), t["j0"].to_numpy(), t["bytes"], length)

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and key != (fp[0], salt[0]):
                yield from done(held)
                held = []
            change = np.flatnonzero((fp[1:] != fp[:-1]) | (salt[1:] != salt[:-1]))
            if len(change):
                at = int(change[-1]) + 1
                yield from done([*held, batch.slice(0, at)])
                held = []
                batch = batch.slice(at)
            held.append(batch)
            key = fp[-1], salt[-1]
        if held:
            yield from done(held)

    return contexts.repartition("fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(run, "h long, h2 long, twice boolean, rid long, a int, b int")


def repeated_ranges(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """Rows (rid, a, b): byte ranges of a row that are covered by strings of `length` bytes that start elsewhere too."""
    spark = docs.sparkSession
    tune(spark)
    family = SuffixFamily(spark, length, max(1, length - 127))
    for b in range(batches):
        family.add(docs.filter(F.pmod(row_id(), F.lit(batches)) == b))
    lists = family.candidates()
    contexts = cut(_contexts(docs, lists, length), "contexts")  # written, so that the texts' shuffle files can go
    drop(lists)
    found = cut(_compare(contexts, length), "ranges")
    drop(contexts)
    windows = found.filter("h is not null")
    across = windows.groupBy("h", "h2").agg(F.count("*").alias("c")).filter("c > 1")
    late = windows.filter("not twice").join(across, ["h", "h2"], "left_semi").select("rid", "a", "b")
    return found.filter("h is null").select("rid", "a", "b").union(late)


def remove_repeats(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """docs with three more columns: `removed`, the covered byte runs [a, b) in order; `kept`, the bytes that stay;
    and `n_bytes`. Strings are judged on the input, not on what is left."""
    docs = docs.select(*[c for c in docs.columns if c not in ("removed", "kept", "n_bytes", "_key", "_rid", "_ranges")])
    ranges = repeated_ranges(docs, length, batches).groupBy(F.col("rid").alias("_rid")).agg(F.collect_set(F.struct("a", "b")).alias("_ranges"))
    rows = docs.withColumn("_key", row_id()).join(ranges, F.col("_key") == F.col("_rid"), "left").drop("_key", "_rid")
    names = [c for c in rows.columns if c != "_ranges"]
    kinds = {f.name: f for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(names.index("text")))
            lists = batch.column(len(names)).to_pylist()
            spans, kept = [], []
            for i, ranges in enumerate(lists):
                own = data[at[i] : at[i + 1]]
                runs: list[tuple[int, int]] = []
                for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1] = runs[-1][0], max(runs[-1][1], r[1])
                    else:
                        runs.append(r)
                stay, p = [], 0
                for a, b in runs:
                    stay.append(own[p:a].tobytes())
                    p = b
                kept.append(b"".join([*stay, own[p:].tobytes()]))
                spans.append([{"a": a, "b": b} for a, b in runs])
            pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(spans, pair), pa.array(kept, pa.binary()), pa.array(np.diff(at))], [*names, "removed", "kept", "n_bytes"])

    return rows.select(*names, "_ranges").mapInArrow(run, f"{schema}, removed array<struct<a: int, b: int>>, kept binary, n_bytes long")


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats()'s rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def kept_text(row_text: bytes, removed: list[tuple[int, int]]) -> str:
    """What stays of a text as a string: a character is removed only if all its bytes are."""
    out, p = [], 0
    for a, b in removed:
        while a < len(row_text) and row_text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(row_text) and row_text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(row_text[p:a])
            p = b
    out.append(row_text[p:])
    return b"".join(out).decode("utf-8")


