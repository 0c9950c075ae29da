"""Packing, token output, rollups and the external shuffle."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import packing, rollup, shuffle
from tessera.llm.bpe import Encoder

from .helpers import SCHEMA, corpus, frame


def test_room_tree_finds_the_least_room_that_is_enough():
    rng = random.Random(1)
    tree, free = packing.RoomTree(50), []
    for b in range(2000):
        if rng.random() < 0.5:
            f = rng.randrange(0, 51)
            tree.put(f, b)
            free.append(f)
        else:
            need = rng.randrange(0, 51)
            got = tree.take(need)
            want = min((f for f in free if f >= need), default=None)
            assert (got[0] if got else None) == want
            if got:
                free.remove(want)


def plain_best_fit(lengths, most):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b + n <= most]
        if fits:
            bins[bins.index(max(fits))] += n
        else:
            bins.append(n)
    return sorted(bins)


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 80))]
        bins, offsets, n = packing.best_fit_decreasing(lengths, 100)
        used = Counter()
        for i in sorted(range(len(lengths)), key=lambda i: offsets[i]):
            assert offsets[i] == used[bins[i]]
            used[bins[i]] += lengths[i]
        assert sorted(used.values()) == plain_best_fit(lengths, 100) and len(used) == n


def test_variable_best_fit_uses_the_cheapest_size_and_shrinks():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 8193) for _ in range(300)] + [1] * 50 + [8192]
    bins, offsets, capacity = packing.variable_best_fit(lengths)
    used = Counter()
    for n, b in zip(lengths, bins):
        used[b] += n
    for b, u in used.items():
        assert capacity[b] == min(s for s in packing.SIZES if s >= u)
    spans = sorted((b, o, o + n) for b, o, n in zip(bins, offsets, lengths))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(spans, spans[1:]))
    assert sum(map(packing.bin_cost, capacity)) < 1.15 * sum(n * packing.bin_cost(1024) / 1024 if n <= 1024 else packing.bin_cost(min(s for s in packing.SIZES if s >= n)) for n in lengths)
    assert packing.variable_best_fit([]) == ([], [], [])
    assert packing.variable_best_fit([3])[2] == [512]


def plain_variable(lengths, sizes, cost):
    """Best fit over a list of bins, each [capacity, used]."""
    bins, place, left = [], {}, sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= n]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([min((s for s in sizes if s >= n), key=lambda s: (cost(s) / min(s, max(n, left)), s)), 0])
        place[i] = b, bins[b][1]
        bins[b][1] += n
        left -= n
    return [place[i][0] for i in range(len(lengths))], [place[i][1] for i in range(len(lengths))], [min(s for s in sizes if s >= u) for _, u in bins]


def test_variable_best_fit_is_the_plain_one():
    rng = random.Random(4)
    for k in range(60):
        sizes = sorted(rng.sample(range(8, 200), 3))
        lengths = [rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(0, 70))]
        cost = [packing.bin_cost, lambda s: 1 + s, lambda s: s**0.5][k % 3]
        assert packing.variable_best_fit(lengths, sizes, cost) == plain_variable(lengths, sizes, cost)


def test_pack_places_every_part_once(spark):
    rows = corpus()
    got = packing.pack(frame(spark, rows), sizes=(64, 128, 256), per_group=20).collect()
    want = Counter()
    for i, t, *_ in rows:
        for p, n in enumerate(packing.split_length(len((t or "").encode().split()) + 1, 256)):
            want[i, p, n] += 1
    assert Counter((r.doc_id, r.part, r.n_tokens) for r in got) == want
    spans = sorted((r.bin_id, r.bin_offset, r.bin_offset + r.n_tokens, r.capacity) for r in got)
    assert all(s[2] <= s[3] for s in spans) and all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    assert packing.pack(frame(spark, [])).collect() == []
    assert got == packing.pack(frame(spark, rows).repartition(3), sizes=(64, 128, 256), per_group=20).collect() or sorted(map(str, got)) == sorted(map(str, packing.pack(frame(spark, rows).repartition(3), sizes=(64, 128, 256), per_group=20).collect()))


def test_pack_keeps_large_ids_beside_null_ids(spark):
    rows = [((1 << 60) + 1, "a b", "en", "a", 3), (None, "c", "en", "a", 1), ((1 << 60) + 2, "d", "en", "a", 1)]
    got = packing.pack(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter({((1 << 60) + 1, 3): 1, (None, 2): 1, ((1 << 60) + 2, 2): 1})


def test_pack_by_token_ids(spark):
    rows = corpus()
    e = Encoder.of("byte_bpe_50k").encoding
    want = Counter()
    for i, t, *_ in rows:
        for p, n in enumerate(packing.split_length(len(e.encode_ordinary(t or "")) + 1, 256)):
            want[i, p, n] += 1
    got = packing.pack(frame(spark, rows), sizes=(64, 128, 256), per_group=20, tokenizer="byte_bpe_50k").collect()
    assert Counter((r.doc_id, r.part, r.n_tokens) for r in got) == want
    used = Counter()
    for r in got:
        used[r.bin_id] += r.n_tokens
    assert all(used[r.bin_id] <= r.capacity for r in got)
    assert packing.pack(frame(spark, []), tokenizer="byte_bpe_50k").collect() == []
    with pytest.raises(ValueError, match="exclude"):
        packing.pack(frame(spark, rows), packing.n_words(), tokenizer="byte_bpe_50k")


def test_encoder_is_the_vocabulary():
    e = Encoder.of("byte_bpe_50k")
    texts = [t for _, t, *_ in corpus()] + ["a  b", " lead", "trail ", "x\n y", "x \ny", "a\n \nb", "it's  'll", "tab\tx y", "a  b", "   ", "\n", "mixed 12,5 €3!", "<|endoftext|> z"]
    for _ in range(2):
        got = e.batch(texts)
        assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [e.encoding.encode_ordinary(t or "") for t in texts]


def test_packed_ids_round_trip(spark, tmp_path):
    rows = corpus()
    packed = packing.pack_ids(frame(spark, rows), capacity=256, group_bytes=40_000)
    packing.write_matrices(packed, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m")).collect()
    e = Encoder.of("byte_bpe_50k")
    parts = Counter()
    for r in got:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert (ids[r.n_tokens :] == e.end).all()
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.parts):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d, p, tuple(ids[a:b].tolist())] += 1
    want = Counter()
    for i, t, *_ in rows:
        ids = [*e.encoding.encode_ordinary(t or ""), e.end]
        for p in range(0, len(ids), 256):
            want[i, p // 256, tuple(ids[p : p + 256])] += 1
    assert parts == want
    assert packing.pack_ids(frame(spark, [])).collect() == []


def test_rollup_equals_a_recount_and_batches_count_once(spark, tmp_path):
    changes = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"
    roll = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().collect() == []
    one = spark.createDataFrame([("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", 2, None)], changes)
    two = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 9, 7), ("delete", None, None, "v1", 2, None)], changes)
    assert roll.commit("1", one) and not roll.commit("1", one) and roll.commit("2", two) and not roll.commit("2", two)
    assert roll.commit("3", spark.createDataFrame([], changes))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 1, 9)]
    for bad in [("update", "a", "en", "v1", 5, None), (None, "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", None, None)]:
        with pytest.raises(Exception, match="no change"):
            roll.commit("bad", spark.createDataFrame([bad], changes))
    for n in range(2):  # the sum and the batches since
        roll.compact()
        assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 1, 9 + 4 * n)]
        assert not roll.commit("1", one) and not roll.commit("2", two)
        assert roll.commit(f"5{n}", spark.createDataFrame([("revise", "a", "en", "v1", 4, 0)], changes))
        assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 1, 13 + 4 * n)]
    assert roll.commit("60", spark.createDataFrame([("revise", "a", "en", "v1", 9, 17)], changes))
    (tmp_path / "r" / "batch=4").mkdir()  # begun, never finished
    assert not roll.committed("4") and roll.totals().count() == 1


def test_history_of_a_corpus(spark, tmp_path):
    rows = corpus()
    got = rollup.corpus_history(spark, frame(spark, rows), f"file://{tmp_path}/h").totals().collect()
    old, new = Encoder.of("byte_bpe_50k").encoding, Encoder.of("byte_bpe_multi_50k").encoding
    n, tokens, first = Counter(), Counter(), {}
    for i, t, *_ in rows:
        k = (t, t is None)
        first[k] = min(first.get(k, 1 << 60), -1 if i is None else i)
    for i, t, lang, source, _ in rows:
        if (-1 if i is None else i) == first[t, t is None]:
            k = (source, lang, "byte_bpe_50k" if lang == "en" else "byte_bpe_multi_50k")
            n[k] += 1
            tokens[k] += len((old if lang == "en" else new).encode_ordinary(t or "")) + 1
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == {k: (n[k], tokens[k]) for k in n}


def test_shuffle_deals_every_row_evenly_and_repeatably(spark, tmp_path):
    rows = corpus()
    how = {"shards": 3, "bucket_bytes": 30_000}
    got = shuffle.shuffle(frame(spark, rows), **how)
    assert "title" in got.columns
    d = shuffle.digest(got).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in d) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {s: sorted(r.slot for r in d if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(d) == key(shuffle.digest(shuffle.shuffle(frame(spark, rows).repartition(5), **how)).collect())
    assert key(d) != key(shuffle.digest(shuffle.shuffle(frame(spark, rows), seed=2, **how)).collect())
    shuffle.write_shards(got, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert shuffle.shuffle(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("length,most,want", [(0, 4, []), (4, 4, [4]), (9, 4, [4, 4, 1])])
def test_split_length(length, most, want):
    assert packing.split_length(length, most) == want
