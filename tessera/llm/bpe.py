"""Byte-pair encoding of whole texts with a vocabulary file of public ranks, cached by space-separated piece."""

from __future__ import annotations

import base64

import numpy as np

#: Where the public vocabulary files lie; a parameter of every operator that reads one.
TOKENIZER_DIR = "/opt/tokenizers"
#: The pre-token pattern that belongs to the byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHED = 250_000
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a text as little-endian uint16 bytes (uint32 for vocabularies over 65,536 ids).

    A space followed by another character always opens a pre-token, so a piece " word" has the same ids in every text;
    pieces that are empty or begin or end with white space don't, and texts with such a piece are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(self.end, np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]
        self.cache: dict[str, bytes | None] = {}

    @classmethod
    def of(cls, name: str, folder: str = TOKENIZER_DIR) -> "Encoder":
        path = f"{folder}/{name}.tiktoken"
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def whole(self, text: str) -> bytes:
        return self._ids(text).astype(self.dtype).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _learn(self, words: set[str]) -> dict[str, bytes | None]:
        safe = [w for w in words if w and w.strip() == w]
        found: dict[str, bytes | None] = dict.fromkeys(words)
        if safe:
            text = " " + " ".join(safe)
            ids, data = self._ids(text), np.frombuffer(text.encode(), np.uint8)
            stops = np.append(np.flatnonzero(data == 32)[1:], len(data))  # pieces have no space inside
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), stops) + 1
            raw, p, size = ids.astype(self.dtype).tobytes(), 0, self.dtype.itemsize
            for w, e in zip(safe, (ends * size).tolist()):
                found[w] = raw[p:e]
                p = e
        return found

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        parts = [t.split(" ") if t else [] for t in texts]
        cache = self.cache
        fresh = self._learn(set().union(*parts).difference(cache))
        cache.update(fresh)
        out = []
        for t, p in zip(texts, parts):
            if not p:
                out.append(b"")
                continue
            try:
                if p[0] and p[0][-1].isspace():
                    raise TypeError
                out.append((self.whole(p[0]) if p[0] else b"") + b"".join(map(cache.__getitem__, p[1:])))
            except TypeError:  # a piece whose ids depend on its neighbours
                out.append(self.whole(t))
        over = len(cache) - _CACHED
        if over > 0:  # the pieces that have no room go with their batch
            for w in list(fresh)[-over:]:
                del cache[w]
        return out
