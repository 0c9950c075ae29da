"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries end in the same base, the common words of ordinary text, and begin with what their own class repeats
and the other doesn't: runs of 6-byte grams whose rate over distinct word contexts is at least `ODDS` times the other
class's, best first. A window of eight words is compressed under both; where toxic phrases occur the toxic dictionary
gives the shorter result. Both dictionaries and every window end in the same mark, so that a window always has a match
and a short one more is not lost to a stored block. A document's windows are summed up in four figures, and a logistic curve, fitted on labelled
documents that the dictionaries had not seen, turns them into a score.

Training sample: at most `train_rows` labelled documents of each class (those of least hash) whose texts have at most
`train_bytes` bytes; every document is scored, over its whole text. Ids, languages, sources and labels are no inputs.

Defined results: a null or empty text has no windows and gets the score of none; without labels of either class every
score is the share of toxic labels (0 without any); a null doc_id is scored and never trained on; a repeated label's
larger value holds; equal rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

GRAM = 6
WINDOW_WORDS = 8
ODDS = 20
LEAST_CONTEXTS = 4
PART_BYTES = 4096
BASE_WORDS = 1500
THRESHOLD = 0.7
#: The mark: bytes that no text has.
MARK = bytes(range(1, 9)) + bytes(range(14, 30))
_LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split() if text else []


def _contexts(texts: Iterable[str]) -> tuple[Counter, int]:
    """Distinct (previous word, word, next word) of each word, so that copies of a text count once."""
    seen: set[int] = set()
    found: Counter = Counter()
    for text in texts:
        own = [b"", *words(text), b""]
        for i in range(1, len(own) - 1):
            h = hash((own[i - 1], own[i], own[i + 1]))
            if h not in seen:
                seen.add(h)
                found[own[i]] += 1
    return found, len(seen)


def _grams(found: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in found.items():
        x = b" " + w + b" "
        for g in {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}:
            out[g] += n
    return out


def _segments(own: Counter, own_n: int, other: Counter, other_n: int, found: Counter) -> bytes:
    """The class's telling runs, the best last (nearest to the base)."""
    good = {g for g, c in own.items() if c >= LEAST_CONTEXTS and (c + 0.5) * (other_n + 1) >= ODDS * (other[g] + 0.5) * (own_n + 1)}
    runs: Counter = Counter()
    for w, n in found.items():
        x = b" " + w + b" "
        i = 0
        while i <= len(x) - GRAM:
            j = i
            while j <= len(x) - GRAM and x[j : j + GRAM] in good:
                j += 1
            if j > i:
                runs[x[i : j + GRAM - 1]] += n * (j - i)
            i = j + 1
    out, text = [], b""
    for run, _ in sorted(runs.items(), key=lambda r: (-r[1], r[0])):
        if run not in text and len(text) + len(run) <= PART_BYTES:
            out.append(run)
            text += run
    return b"".join(reversed(out))


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary, of equal length."""
    (tw, tn), (ow, on) = _contexts(toxic), _contexts(ordinary)
    tg, og = _grams(tw), _grams(ow)
    a, b = _segments(tg, tn, og, on, tw), _segments(og, on, tg, tn, ow)
    common = sorted(((n, w) for w, n in ow.items() if len(w) > 3), reverse=True)[:BASE_WORDS]
    base = b" " + b" ".join(w for _, w in reversed(common)) + b" "
    size = max(len(a), len(b))
    return bytes(size - len(a)) + a + base + MARK, bytes(size - len(b)) + b + base + MARK


class Distance:
    """Compression lengths of windows under both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=14, hash_log=13, chain_log=13, search_log=5, min_match=GRAM, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=False)
        self.by = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.by.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)

    def figures(self, text: str | None) -> tuple[float, float, float, float]:
        """Greatest saving of a window, and the logarithms of the savings' sum, of the windows that save, and of all."""
        own, (ordinary, toxic) = words(text), self.by
        most = total = saving = 0
        for i in range(0, len(own), WINDOW_WORDS):
            x = b" " + b" ".join(own[i : i + WINDOW_WORDS]) + b" " + MARK
            d = len(ordinary(x)) - len(toxic(x))
            if d > 0:
                total += d
                saving += 1
                most = max(most, d)
        n = -(-len(own) // WINDOW_WORDS)
        return most, float(np.log1p(total)), float(np.log1p(saving)), float(np.log1p(n))


def fit(figures: np.ndarray, label: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights, the last for the constant, by Newton's steps; the penalty keeps separable cases finite."""
    x = np.column_stack([figures, np.ones(len(figures))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, content: tuple[bytes, bytes] | None, weights: list[float]):
        self.content, self.weights = content, weights
        self._distance: Distance | None = None

    def __getstate__(self) -> dict:
        return {"content": self.content, "weights": self.weights, "_distance": None}

    def score(self, text: str | None) -> float:
        if self.content is None:
            return self.weights[0]
        if self._distance is None:
            self._distance = Distance(*self.content)
        z = sum(w * f for w, f in zip(self.weights, (*self._distance.figures(text), 1.0)))
        return round(1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))), 6)


def train(rows: list[tuple[str, int, int]]) -> Model:
    """rows: (text, toxic, fold 0 or 1). The curve is fitted on figures under dictionaries of the other fold."""
    label = np.array([t for _, t, _ in rows], float)
    if not 0 < label.sum() < len(label):
        return Model(None, [float(label.mean()) if len(label) else 0.0])
    figures = np.zeros((len(rows), 4))
    pick = lambda toxic, folds: [x for x, t, f in rows if t == toxic and f in folds]
    for fold in (0, 1):
        d = Distance(*dictionaries(pick(1, (1 - fold,)), pick(0, (1 - fold,))))
        for i, (text, _, f) in enumerate(rows):
            if f == fold:
                figures[i] = d.figures(text)
    return Model(dictionaries(pick(1, (0, 1)), pick(0, (0, 1))), fit(figures, label).tolist())


def score(docs: DataFrame, labels: DataFrame, train_rows: int = 2000, train_bytes: int = 32768) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    tune(spark, 500)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    parts = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(train_rows) for t in (0, 1)]
    ids = F.broadcast(parts[0].union(parts[1]))  # at most twice train_rows ids
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sample = docs.filter(F.octet_length("text") <= train_bytes).join(ids, F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int").alias("fold"))
    rows = sorted((r["doc_id"], r["text"], int(r["toxic"]), r["fold"]) for r in sample.toLocalIterator())
    model = train([r[1:] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
