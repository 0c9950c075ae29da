"""Small tables for the corpus operators, and plain forms of what they compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for with river stone green walking morning light seven under bridge paper window quiet engine harbour table winter letter market garden signal copper".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(99))
    return " ".join(w)


def corpus(seed: int = 1) -> list[tuple]:
    """Prose with exact and near copies, shared passages, nulls, empty, short, very long and multi-byte texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1], edited(rng, texts[2], 2), edited(rng, texts[2], 3), edited(rng, texts[3], 9), edited(rng, texts[4], 4)]
    passage = prose(rng, 70)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(3)]
    texts += [None, None, "", "   \n\t ", "one", "One", "two words", "three little words", "ü" * 300, "é" * 260 + " " + "ü" * 250, prose(rng, 20000), "ab" * 400]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[6], "en", "a", 3), (None, None, None, None, None)]


def frame(spark, rows: list[tuple] | None = None):
    """The rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("kept", "removed", "id", "key", "c", "n", "slot", "shard", "n_words", "h", "g", "_rid", "a", "b", "fp", "title")})


def shingles(text: str | None, k: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
