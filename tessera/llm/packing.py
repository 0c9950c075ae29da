"""Best-fit packing into sequences: of several permitted lengths (lengths only), or of one length with token ids.

Rows are dealt to independent packing groups by a hash of their id and text, so a group is bounded however large the
corpus, and only its last bins are less than full for want of documents.

Defined results: a null or empty text has only its end mark; ties are broken by doc_id, then the text's hash; equal rows
are packed each for itself; an empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, Encoder
from .common import text_bytes, tune

#: Permitted sequence lengths of the production query.
SIZES = (512, 1024, 2048, 4096, 8192)


def bin_cost(size: int) -> float:
    """What a bin of this length costs: a fixed part, its slots, and attention, which grows with the square."""
    return 64 + size + size * size / 16384


def n_words(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def split_length(length: int, most: int) -> list[int]:
    """Parts of at most `most`, without loss: full ones, then the rest."""
    full, rest = divmod(length, most)
    return [most] * full + [rest] * (rest > 0)


def variable_best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length, in order, and the capacity of each bin.

    Lengths are taken in decreasing order. Each goes to the open bin that it fills best, of whatever size. Where none has
    room, a bin of the least cost for each slot that it can fill is opened: the volume still to come and the length
    itself decide what a size can fill. At last each bin shrinks to the least permitted length that holds its contents.
    """
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), []
    capacity: list[int] = []
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / min(s, max(n, left)), s))
            b = len(used)
            used.append(0)
            capacity.append(free)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [min(s for s in sizes if s >= u) for u in used]


class RoomTree:
    """Open bins by free capacity; a segment tree finds the least free capacity that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, b: int) -> None:
        self.bins[free].append(b)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of the fullest bin with room for `need`."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right neighbour has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        b = self.bins[free].pop()
        self._add(free, -1)
        return free, b


def best_fit_decreasing(lengths: Sequence[int], most: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each length, in order, and the number of bins of capacity `most`."""
    tree = RoomTree(most)
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.take(n)
        if found is None:
            free, b = most, len(used)
            used.append(0)
        else:
            free, b = found
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            tree.put(free - n, b)
    return bins, offsets, len(used)


def _groups(docs: DataFrame, per_group: int) -> int:
    return max(1, -(-docs.count() // per_group))


def _token_lengths(rows: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """(doc_id, n, h) of rows (doc_id, text, h): n is the text's token ids and the end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer, folder)
        for batch in batches:
            n = [len(x) // coder.dtype.itemsize + 1 for x in coder.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["doc_id", "n", "h"])

    return rows.mapInArrow(run, "doc_id long, n long, h long")


def pack(docs: DataFrame, length: Column | None = None, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost, per_group: int = 20_000, seed: int = 1, tokenizer: str | None = None, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row for each part of a document: doc_id, part, n_tokens, bin_id, bin_offset, capacity.

    tokenizer: the vocabulary that counts a document's tokens; an end mark is added. Without one, length: a document's
    tokens; by default its words and an end mark. Only lengths are shuffled, no texts.
    """
    if tokenizer is not None and length is not None:
        raise ValueError("length and tokenizer exclude each other")
    groups, most = _groups(docs, per_group), max(sizes)
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    if tokenizer is not None:
        tune(docs.sparkSession)
        rows = _token_lengths(docs.select(F.col("doc_id").cast("long"), "text", h.alias("h")), tokenizer, folder)
    else:
        length = length if length is not None else n_words() + 1
        rows = docs.select(F.col("doc_id").cast("long"), length.cast("long").alias("n"), h.alias("h"))
    rows = rows.withColumn("g", F.pmod("h", F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:  # Arrow: pandas would round the ids beside a null
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("h", "ascending"), ("n", "ascending")])
        docs_, parts, sizes_ = [], [], []
        for d, n in zip(table["doc_id"].to_pylist(), table["n"].to_pylist()):
            for p, m in enumerate(split_length(n, most)):
                docs_.append(d)
                parts.append(p)
                sizes_.append(m)
        bins, offsets, capacity = variable_best_fit(sizes_, sizes, cost)
        first = table["g"][0].as_py() << 32
        small = [pa.array(x, pa.int32()) for x in (parts, sizes_, offsets, [capacity[b] for b in bins])]
        return pa.table({"doc_id": pa.array(docs_, pa.int64()), "part": small[0], "n_tokens": small[1], "bin_id": pa.array([first + b for b in bins], pa.int64()), "bin_offset": small[2], "capacity": small[3]})

    return rows.groupBy("g").applyInArrow(run, "doc_id long, part int, n_tokens int, bin_id long, bin_offset int, capacity int")


def pack_ids(docs: DataFrame, capacity: int = 4096, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, group_bytes: int = 12 << 20, seed: int = 1) -> DataFrame:
    """One row for each packed sequence: seq_id, n_tokens, doc_ids, parts, cu_seqlens, and as little-endian binary rows of
    `capacity` entries input_ids (padded with the end mark) and position_ids (from 0 in each segment and in the padding).

    Each document's ids are followed by the end mark; documents over the capacity are split without loss.
    """
    tune(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long"), h.alias("h"), F.pmod(h, F.lit(groups)).cast("int").alias("g"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer, folder)
        mark = np.array([coder.end], coder.dtype).tobytes()
        for batch in batches:
            ids = coder.batch(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x + mark for x in ids], pa.binary())], ["doc_id", "h", "g", "ids"])

    def run(table: pa.Table) -> pa.Table:
        coder = Encoder.of(tokenizer, folder)
        w = coder.dtype.itemsize
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("h", "ascending")])
        docs_ = table["doc_id"].to_pylist()
        data, at = text_bytes(table["ids"])
        seg = [(i, p, int(at[i]) + p * capacity * w, n) for i in range(len(docs_)) for p, n in enumerate(split_length(int(at[i + 1] - at[i]) // w, capacity))]
        bins, offsets, n_bins = best_fit_decreasing([s[3] for s in seg], capacity)
        inside: list[list[int]] = [[] for _ in range(n_bins)]
        for s, b in enumerate(bins):
            inside[b].append(s)
        small = np.dtype("<u2") if capacity <= 1 << 16 else np.dtype("<u4")
        ids, pos, cu, ds, ps, used = [], [], [], [], [], []
        for own in inside:
            own.sort(key=offsets.__getitem__)
            row, where, ends = np.full(capacity, coder.end, coder.dtype), np.arange(capacity, dtype=small), [0]
            for s in own:
                _, _, a, n = seg[s]
                o = offsets[s]
                row[o : o + n] = data[a : a + n * w].view(coder.dtype) if a % w == 0 else np.frombuffer(data[a : a + n * w].tobytes(), coder.dtype)
                where[o : o + n] = np.arange(n)
                ends.append(o + n)
            where[ends[-1] :] = np.arange(capacity - ends[-1])
            ids.append(row.tobytes())
            pos.append(where.tobytes())
            cu.append(ends)
            used.append(ends[-1])
            ds.append([docs_[seg[s][0]] for s in own])
            ps.append([seg[s][1] for s in own])
        first = table["g"][0].as_py() << 32
        return pa.table(
            {
                "seq_id": pa.array(range(first, first + n_bins), pa.int64()), "n_tokens": pa.array(used, pa.int32()), "doc_ids": pa.array(ds, pa.list_(pa.int64())), "parts": pa.array(ps, pa.list_(pa.int32())),
                "cu_seqlens": pa.array(cu, pa.list_(pa.int32())), "input_ids": pa.array(ids, pa.binary()), "position_ids": pa.array(pos, pa.binary()),
            }
        )

    coded = rows.mapInArrow(encode, "doc_id long, h long, g int, ids binary")
    return coded.groupBy("g").applyInArrow(run, "seq_id long, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, one row of the id matrix to a row, ordered by seq_id within each file."""
    packed.sortWithinPartitions("seq_id").write.mode("errorifexists").parquet(path)
