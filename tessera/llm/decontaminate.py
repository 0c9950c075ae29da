"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces; a text within k edits holds one of them unchanged, at
its place give or take k. Exact piece hits come from one automaton for each block of items; around each hit Myers'
bit-parallel distance decides. Texts are compared in lower case with every white space run as one space.

Defined results: null or empty texts and items match nothing; items of equal text each report; equal rows each report;
a null doc_id or item_id is reported as null; empty tables give no rows; other columns are ignored here, and kept by
clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tune

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items in one block; each block is a pass over the documents.
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of an item, of nearly equal length, with their places."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str) -> int:
    """The least edit distance of item to any substring of text (bit-parallel, one machine step for each character)."""
    m = len(item)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best = m
    for c in text:
        e = eq.get(c, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(v | plus)), plus & v
    return best


class Matcher:
    """All items of a block, ready to be looked for in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.ids: dict[str, list[int | None]] = {}
        for i, t in items:
            self.ids.setdefault(t, []).append(i)
        self.items = list(self.ids)
        self.errors = [budget(len(t), rate) for t in self.items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (t, k) in enumerate(zip(self.items, self.errors)):
            for a, p in pieces(t, k):
                at.setdefault(p, []).append((n, a))
        self.machine = ahocorasick.Automaton()
        for p, where in at.items():
            self.machine.add_word(p, (len(p), where))
        if at:
            self.machine.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item's number, distance) of the items that lie within their budget of a part of the text."""
        starts: dict[int, list[int]] = {}
        for end, (n, where) in self.machine.iter(text):
            for item, a in where:
                starts.setdefault(item, []).append(end + 1 - n - a)
        for item, begins in starts.items():
            t, k = self.items[item], self.errors[item]
            best, m = k + 1, len(t)
            begins.sort()
            i = 0
            while i < len(begins) and best:
                a = b = begins[i]
                while i < len(begins) and begins[i] <= b + 2 * k + 1:  # hits near one another share a window
                    b = begins[i]
                    i += 1
                if b + m + k > 0 and a - k < len(text):
                    best = min(best, myers(t, text[max(0, a - k) : b + m + k]))
            if best <= k:
                yield item, best


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, distance, errors_allowed, item_chars): items that a document holds within their budget.

    items is a stated query set: it comes to the driver in blocks of at most block_chars characters, one block at a time
    and one pass each; what all but the last one find is written to the shared folder.
    """
    spark = docs.sparkSession
    tune(spark)
    schema = "doc_id long, item_id long, distance int, errors_allowed int, item_chars int"
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text")

    def search(block: list[tuple[int | None, str]]) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Matcher(sent.value, rate)
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if found.any and t:
                        for n, distance in found.find(normal(t)):
                            rows += [(d, i, distance, found.errors[n], len(found.items[n])) for i in found.ids[found.items[n]]]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "distance", "errors_allowed", "item_chars"])

        return texts.mapInArrow(run, schema), sent

    out, block, size = None, [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        if size and size + len(t) > block_chars:  # this block's pass is done, and its items leave every worker, before the next
            found, sent = search(block)
            found = cut(found, "matches")
            sent.destroy()
            out = found if out is None else out.union(found)
            block, size = [], 0
        block.append((r["item_id"], t))
        size += len(t)
    last, _ = search(block)
    return last if out is None else out.union(last)


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item; a document without id stays."""
    bad = matches(docs, items, rate).select("doc_id").filter("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti")
