"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import common, minhash, suffix

from .helpers import corpus, edited, frame, prose, shingles


def near_truth(rows, k, percent=80):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t, k))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_near(spark, rows, k):
    got = minhash.near_duplicates(frame(spark, rows), k=k).collect()
    assert len(got) == len(rows)
    want = near_truth(rows, k)
    named = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in named} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in named)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t, k))) for i, t, *_ in rows)


def test_near_duplicates_on_odd_texts(spark):
    check_near(spark, corpus(), 4)


def test_near_duplicates_in_a_family_of_edits(spark):
    rng = random.Random(3)
    base = prose(rng, 150)
    texts = [base, *[edited(rng, base, rng.randrange(1, 12)) for _ in range(40)]]
    texts += [edited(rng, texts[-1], 2), edited(rng, texts[-2], 2)]
    rng.shuffle(texts)
    check_near(spark, [(i * 3, t, "en", "a", 1) for i, t in enumerate(texts)], 5)


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(15)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(i, t, "en", "a", 1) for i, t in ((5, a), (5, b), (2, a), (3, b), (9, c), (9, ""), (8, c), (7, None), (7, edited(rng, a, 1)))]
    check_near(spark, rows, 4)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()}
    assert got == {(5, 2), (2, 2), (3, 2), (9, 8), (8, 8), (7, 2)}


def test_near_duplicates_in_chained_families(spark, monkeypatch):
    """Families that pivots alone leave apart, compared as a whole and table by table."""
    rng = random.Random(16)
    text, texts = prose(rng, 90), []
    for _ in range(60):
        text = edited(rng, text, 2)
        texts.append(text)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(rng.sample(texts, len(texts)))]
    check_near(spark, rows, 4)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    check_near(spark, rows, 4)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, []), k=4).collect() == []


def test_blocks_and_salts_do_not_change_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash, "SALT_ROWS", 3)
    rng = random.Random(4)
    base = prose(rng, 120)
    check_near(spark, [(i, edited(rng, base, rng.randrange(1, 10)), "en", "a", 1) for i in range(25)], 4)


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (20, 21), (5, 5), (2, 1)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    chain = [(i, i + 1) for i in range(200)]
    assert {r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_few_links_take_no_steps(spark, monkeypatch):
    """A chain over many partitions is ended by one task, not by steps that each cost every partition a task; so many
    links that one task may not hold them still go through the steps."""
    chain = [(i, i + 1) for i in range(100)] + [(300, 200), (200, 400), (7, 7), (500, 500)]
    random.Random(5).shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long").repartition(16)
    want = {**{i: 0 for i in range(101)}, 200: 200, 300: 200, 400: 200}
    written, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: written.append(name) or cut(df, name))

    def got():
        rows = common.components(links).collect()
        assert len(rows) == len(want)
        return {r.id: r.component for r in rows}

    assert got() == want and written == ["edges", "components"]
    monkeypatch.setattr(common, "FOREST_ROWS", 5)
    assert got() == want and written.count("edges") > 2
    assert common.components(links.filter("a = b")).collect() == []


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["a  b\tc", None, "", "word " * 50, "x" * 300 + " y", "Ä ö z"]
    one = common.word_hashes(*common.text_bytes(pa.array(texts)))
    monkeypatch.setattr(common, "CHUNK", 16)
    two = common.word_hashes(*common.text_bytes(pa.array(texts)))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    assert np.diff(one[1]).tolist() == [len((t or "").encode().split()) for t in texts]


def repeats_truth(rows, length=200):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(zip((r[0] for r in rows), out))


def check_repeats(spark, rows, **how):
    got = suffix.digest(suffix.remove_repeats(frame(spark, rows), **how)).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == repeats_truth(rows, how.get("length", 200))


def test_repeats_on_odd_texts(spark):
    check_repeats(spark, corpus())


def test_repeats_across_chunks_groups_and_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_ROWS", 2)
    check_repeats(spark, corpus(2)[:60], batches=3)
    check_repeats(spark, corpus(3)[:50], length=40, batches=1)


def test_bytes_decide_where_hashes_agree(monkeypatch):
    """Windows that share a hash but not their bytes are told apart."""
    import pyarrow as pa

    rng = random.Random(17)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 40))) for _ in range(30)]
    texts += texts[:4]
    arrays = [np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.arange(len(texts)), np.zeros(len(texts), np.int32)]
    seen = Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))

    def covered(out):
        return {(r, x) for b in out for r, a, z in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()) for x in range(a, z)}

    want = {(n, x) for n, t in enumerate(texts) for i in range(len(t) - 4) if seen[t[i : i + 5]] > 1 for x in range(i, i + 5)}
    assert covered(suffix._marks(*arrays, pa.array(texts), 5)) == want
    monkeypatch.setattr(suffix, "_hash", lambda c, down, i, length: (common.mix((c[i + length] - c[i]) * down[i]) & np.uint64(7)))
    assert covered(suffix._marks(*arrays, pa.array(texts), 5)) == want


def test_one_repetitive_text_is_spread(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_ROWS", 8)
    rng = random.Random(18)
    part = prose(rng, 60)
    check_repeats(spark, [(1, " ".join([part] * 60), "en", "a", 1), (2, prose(rng, 300), "en", "a", 1), (3, "ab" * 5000, "en", "a", 1)])


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(frame(spark, [])).collect() == []


def test_levels_double(spark):
    family = suffix.SuffixFamily(spark)
    sizes = []
    for b in range(5):
        family.add(frame(spark, corpus()[b * 8 : b * 8 + 8]))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    family.drop()


def test_kept_text_cuts_whole_characters():
    b = "aéüb".encode()
    assert suffix.kept_text(b, [(1, 3)]) == "aüb" and suffix.kept_text(b, [(2, 4)]) == "aéüb" and suffix.kept_text(b, []) == "aéüb"
    assert suffix.kept_text(b, [(0, 6)]) == ""
