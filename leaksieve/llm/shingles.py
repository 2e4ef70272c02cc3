"""Sets of word shingles as sorted 64-bit hashes, for tasks that read Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Words in a shingle.
SHINGLE = 5
#: Bytes that are hashed at once; longer texts go in parts that end at white space.
BLOCK = 1 << 17
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Odd base of the words' polynomial hash modulo 2^64.
_BASE = 0xD1342543DE82EF95


def _factors(n: int) -> list[np.uint64]:
    """Odd factors of a shingle's words: the multilinear hash of already mixed word hashes."""
    return [np.uint64(int(x) | 1) for x in _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX[0]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sets; bytes are lower-cased in A-Z alone and split at U+0020 and U+0009 to U+000D."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.factors = size, _factors(size)
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX[0]))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers(BLOCK + 1)

    def _powers(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, inverse))

    def _words(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word: prefix sums of byte * base^place, moved to the word's start."""
        if len(block) >= len(self.up):
            self._powers(len(block))
        b = np.frombuffer(block, np.uint8)
        edge = np.diff(np.r_[True, self.space[b], True].astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.r_[np.uint64(0), np.cumsum(self.letters[b] * self.up[: len(b)])]
        return _mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def _parts(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > BLOCK:
            end = at + BLOCK
            while end > at and text[end - 1] not in b" \t\n\x0b\x0c\r":
                end -= 1
            if end == at:  # a word longer than a block
                end = at + BLOCK
                while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def _set(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(0, np.uint64)
        k = min(self.size, len(ids))
        return np.unique(self._combined(ids, k))

    def _combined(self, ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - k + 1
        found = np.full(n, k, np.uint64)
        for i, f in enumerate(self.factors[:k]):
            found += ids[i : n + i] * f
        return _mixed(found)

    def sets(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingles; a shorter text's whole word sequence is its one shingle."""
        text = (text or b"").lower()
        return self._set(np.concatenate([self._words(x)[0] for x in self._parts(text)]))

    def sets_of(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """``sets`` of each text in turn; small texts are hashed together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if held and size + len(text) >= BLOCK:
                yield from self._together(held)
                held, size = [], 0
            if len(text) >= BLOCK:
                yield self.sets(text)
            else:
                held.append(text)
                size += len(text) + 1
        if held:
            yield from self._together(held)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        ids, start = self._words(b"\n".join(texts).lower())
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(start, first)
        k = self.size
        found = self._combined(ids, k) if len(ids) >= k else np.zeros(0, np.uint64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield np.unique(found[a : b - k + 1]) if b - a >= k else self._set(ids[a:b])


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name for a set, equal for equal sets."""
    h = xxhash.xxh64_intdigest(found.tobytes(), seed=len(found))
    return h - (1 << 64) if h >= 1 << 63 else h
