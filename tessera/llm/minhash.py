"""MinHash near-duplicate groups with tensored banding.

Each document has two collections of `halves` half-keys, each half-key made of two minhashes; a table key pairs a
half-key of the first collection with one of the second, so `halves**2` tables cost only `4 * halves` minhashes. Two
documents of similarity 0.8 share at least one of 100 tables with probability 0.9999. Every candidate pair is confirmed
on the full shingle sets.

Defined results: a null or wordless text has no shingles and links with nothing; equal sets are one class before any
table is formed; rows that share a doc_id are one document, whose links are those of all its texts; a row whose doc_id
is null is kept and has no component; ties between pivots go to the larger node; an empty table gives no rows; other
columns play no part and are returned by near_duplicates() untouched only through the caller's join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, mix, shingle_set, text_bytes, tune, word_hashes

_U = np.uint64
#: Members that are verified against one copy of their pivot's set.
SALT_ROWS = 2000
#: Members of a group of candidates that one task holds, and their shingles in all.
BLOCK_ROWS = 500
BLOCK_SHINGLES = 2_000_000


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def half_keys(sets: list[np.ndarray], halves: int) -> np.ndarray:
    """A row of 2 * halves half-keys for each set, each made of two minhashes; an empty set has zeros."""
    a = _seeds(4 * halves)
    low = np.zeros((len(sets), 4 * halves), np.uint64)
    for i, s in enumerate(sets):
        for x in range(0, len(s), 8192):
            part = (s[x : x + 8192, None] * a).min(axis=0)
            low[i] = np.minimum(low[i], part) if x else part
    low = mix(low)
    return mix(low[:, 0::2] * _U(3) + low[:, 1::2]).view(np.int64)


def _sets(batch_text: pa.Array, k: int) -> list[np.ndarray]:
    data, at = text_bytes(batch_text)
    words, bounds = word_hashes(data, at)
    return [shingle_set(words[bounds[i] : bounds[i + 1]], k) for i in range(len(at) - 1)]


def signatures(docs: DataFrame, k: int, halves: int) -> DataFrame:
    """doc_id, the row's hash, n_shingles, the set's 128-bit digest, and the two collections of half-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(2), k)
            n = len(sets)
            sizes, digest = np.array([len(x) for x in sets], np.int64), np.zeros((n, 2), np.uint64)
            for i, x in enumerate(sets):
                digest[i] = x.sum(), mix(x ^ _U(0xA5A5A5A55A5A5A5A)).sum()
            half = half_keys(sets, halves)
            pick = lambda x: pa.ListArray.from_arrays(np.arange(0, n * halves + 1, halves, dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(digest[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(digest[:, 1]).view(np.int64)), pick(half[:, :halves]), pick(half[:, halves:])],
                ["doc_id", "row", "n_shingles", "d1", "d2", "left", "right"],
            )

    return docs.select(F.col("doc_id").cast("long"), _row(), "text").mapInArrow(run, "doc_id long, row long, n_shingles long, d1 long, d2 long, left array<long>, right array<long>")


def _row() -> Column:
    """Tells rows of one doc_id apart; rows that agree in both are equal in text."""
    return F.xxhash64("text").alias("row")


def _members(keys: DataFrame) -> DataFrame:
    """(key, id) of the keys that two or more ids have; the sorted rows are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, id, already given)
        for batch in batches:
            k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                k, i = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], i])
            same = k[1:] == k[:-1]
            keep = np.zeros(len(k), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last[2]:
                keep[0] = False
            given = bool(keep[-1]) or (len(k) == 1 and last is not None and last[2])
            last = (k[-1], i[-1], given)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(i[keep])], ["key", "id"])

    return keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: id, text.

    The texts are dealt once by id; each pair then carries its second text to its first, whose text goes there once for
    every SALT_ROWS pairs, so no task gathers a hot document's pairs.
    """
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(count, "a").select(
        "a", "b", F.when(F.col("n") > SALT_ROWS, F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SALT_ROWS).cast("long"))).otherwise(F.lit(0).cast("long")).alias("salt")
    )
    own = salted.select("a", F.col("a").alias("b"), "salt").distinct()
    need = salted.union(own)
    rows = need.join(texts.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "salt", (F.col("a") != F.col("b")).alias("other"), "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own_set = None, None
        for batch in batches:
            a, b, other = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            out = []
            for i, s in enumerate(_sets(batch.column(4), k)):
                if not other[i]:
                    now, own_set = a[i], s
                elif now == a[i] and similar(s, own_set, percent):
                    out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(run, "a long, b long")


def _shape(rows: DataFrame) -> DataFrame:
    """Of each group of (kind, grp, id, c, size) with members in several components: the largest component, into how
    many blocks its members and, apart, those outside that component are cut, and how many texts that moves."""
    parts = rows.groupBy("kind", "grp", "cluster", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    g = parts.groupBy("kind", "grp", "cluster").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "size", "c")).alias("most")).filter("parts > 1")
    cut_in = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    odd, odd_size = F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")
    g = g.select("kind", "grp", "cluster", F.col("most.c").alias("main"), "n", odd.alias("odd"), cut_in(F.col("n"), F.col("size")).alias("blocks"), cut_in(odd, odd_size).alias("tiles"))
    return g.withColumn("moved", F.col("n") * F.col("tiles") + F.col("odd") * F.col("blocks"))


def links_across(texts: DataFrame, members: DataFrame, of: DataFrame, k: int, percent: int, halves: int) -> DataFrame:
    """Links (a, b) between different components c of one cluster, of pairs that share a table.

    of: id, cluster, c, size of the ids in clusters with several components. A cluster is compared either as one group
    or table by table, whichever moves fewer texts: the first is less for a family whose members share most tables, the
    second for unrelated texts that chance tables chain together. A group's members lie in blocks; those outside its
    largest component visit every block, in tiles of bounded size, and are compared there with members of other
    components. A task holds one block, and no pair of rows is formed outside it.
    """
    by_key = members.join(of, "id").select(F.lit(1).alias("kind"), F.col("key").alias("grp"), "cluster", "id", "c", "size")
    whole = of.select(F.lit(0).alias("kind"), F.col("cluster").alias("grp"), "cluster", "id", "c", "size")
    rows = by_key.union(whole)
    shape = cut(_shape(rows), "shapes")
    least = shape.groupBy("cluster").agg(F.sum(F.when(F.col("kind") == 1, F.col("moved"))).alias("tables"), F.sum(F.when(F.col("kind") == 0, F.col("moved"))).alias("whole"))
    chosen = shape.join(least, "cluster").filter("(kind = 1) = (tables < whole)").select("kind", "grp", "main", "blocks", "tiles")
    own = rows.join(chosen, ["kind", "grp"]).select("kind", "grp", "id", "c", (F.col("c") != F.col("main")).alias("odd"), "blocks", "tiles")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    home, place = dealt("blocks", 1), dealt("tiles", 2)
    at_home = F.transform(every("tiles"), lambda t: F.struct(home.alias("block"), t.alias("tile"), F.lit(False).alias("guest")))
    visits = F.transform(every("blocks"), lambda b: F.struct(b.alias("block"), place.alias("tile"), F.lit(True).alias("guest")))
    found = own.join(texts.hint("merge"), "id").select("kind", "grp", F.explode(F.when(F.col("odd"), F.concat(at_home, visits)).otherwise(at_home)).alias("p"), "id", "c", "text")
    found = found.select("kind", "grp", "p.block", "p.tile", "p.guest", "id", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, comps, sets, rights, by_left, root = None, [], [], [], [], {}, {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        for batch in batches:
            kind, grp, block, tile, guest, i_, c_ = (batch.column(x).to_pylist() for x in range(7))
            found = _sets(batch.column(7), k)
            keys = half_keys(found, halves)
            out = []
            for r in range(len(found)):
                if now != (kind[r], grp[r], block[r], tile[r]):
                    now, ids, comps, sets, rights, by_left, root = (kind[r], grp[r], block[r], tile[r]), [], [], [], [], {}, {}
                left, right = keys[r, :halves].tolist(), keys[r, halves:]
                if not guest[r]:
                    for x in enumerate(left):
                        by_left.setdefault(x, []).append(len(ids))
                    ids.append(i_[r])
                    comps.append(c_[r])
                    sets.append(found[r])
                    rights.append(right)
                    continue
                for m in {m for x in enumerate(left) for m in by_left.get(x, ())}:
                    a, b = find(c_[r]), find(comps[m])
                    if a != b and (rights[m] == right).any() and similar(found[r], sets[m], percent):
                        out.append((i_[r], ids[m]))
                        root[a] = b  # what this task has linked needs no second link
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    placed = ["kind", "grp", "block", "tile"]
    return found.repartition(*placed).sortWithinPartitions(*placed, "guest").mapInArrow(run, "a long, b long")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) after more links (a, b): components of components."""
    ends = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
    between = links.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    up = components(between)
    new = comp.join(up.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    fresh = up.join(comp.select("id"), "id", "left_anti").select("id", "component")
    out = cut(new.union(fresh), "components")
    drop(comp, up)
    return out


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs with one of the rows that are equal in doc_id (null or not) and text. Texts move only if there are such rows."""
    keys = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), F.col("text").isNull().alias("none"))
    return docs.dropDuplicates(["doc_id", "text"]) if keys.groupBy("id", "row", "none").count().filter("count > 1").head(1) else docs


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, halves: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    A node of the graph is a set of shingles. First each node is checked against the most central of its tables' pivots
    (a table's pivot shares the most table entries with others), so a family of copies is one star; then against the
    other pivots that lie in other components; where members of shared tables still lie in several components, the pairs
    across those are checked too, so no link between candidates is lost. At last the nodes of one doc_id are joined.
    """
    spark = docs.sparkSession
    tune(spark)
    sig = cut(signatures(docs, k, halves), "signatures")
    digest = ["d1", "d2", "n_shingles"]
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy(*digest).agg(F.min_by(F.struct("doc_id", "row", "left", "right"), F.struct("doc_id", "row")).alias("h"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("id"), *digest, "h.doc_id", "h.row", "h.left", "h.right"), "nodes")
    rows = cut(sig.select("doc_id", *digest).join(reps.select(*digest, "id"), digest, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "rows")
    drop(sig)
    keys = (
        reps.select("id", F.posexplode("left").alias("i", "x"), "right")
        .select("id", "i", "x", F.posexplode("right").alias("j", "y"))
        .select(F.xxhash64("x", "y", "i", "j").alias("key"), "id")
    )
    members = cut(_members(keys), "members")
    central = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("id").agg(F.sum("n").alias("weight"))
    pivots = members.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("p"))
    first = members.join(pivots, "key").filter("p.id != id").groupBy(F.col("p.id").alias("a"), F.col("id").alias("b")).agg(F.max("p.weight").alias("weight"))
    first = cut(first, "pairs")
    need = members.select("id").distinct().join(reps.select("id", "doc_id", "row"), "id")
    texts = docs.select(F.col("doc_id").cast("long"), _row(), "text").join(need.hint("merge"), ["doc_id", "row"]).groupBy("doc_id", "row", "id").agg(F.first("text").alias("text")).select("id", "text")
    texts = cut(texts, "texts")
    best = first.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b")
    links = cut(verified(texts, best, k, percent), "links")
    comp = components(links)
    drop(links)

    def apart() -> DataFrame:
        """The candidates' ends' components, where they differ."""
        ends = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
        return first.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select("a", "b", F.coalesce("ac", "a").alias("ac"), F.coalesce("bc", "b").alias("bc")).filter("ac != bc")

    second = cut(apart().join(best, ["a", "b"], "left_anti").select("a", "b"), "pairs")
    if second.head(1):
        links = cut(verified(texts, second, k, percent), "links")
        comp = _joined(comp, links)
        drop(links)
    drop(second)
    open_ = cut(apart().select(F.col("ac").alias("a"), F.col("bc").alias("b")).distinct(), "pairs")
    if open_.head(1):
        clusters = components(open_)
        ends = reps.select("id", F.col("n_shingles").alias("size")).join(comp, "id", "left").select("id", "size", F.coalesce("component", "id").alias("c"))
        of = cut(ends.join(clusters.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "c"), "open")
        links = cut(links_across(texts, members, of, k, percent, halves), "links")
        if links.head(1):
            comp = _joined(comp, links)
        drop(links, of, clusters)
    drop(open_, members, first, texts)
    # rows that share a doc_id are one document
    own = rows.filter("id is not null").select("doc_id", "id").distinct()
    several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a != z").select("doc_id", "a")
    shared = cut(own.join(several, "doc_id").filter("a != id").select("a", F.col("id").alias("b")), "links")
    if shared.head(1):
        comp = _joined(comp, shared)
    drop(shared)
    node = reps.select("id", "doc_id").join(comp, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_id = own.join(node.select("id", "component").join(least, "component"), "id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
