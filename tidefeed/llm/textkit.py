"""What runs in Python workers: 64-bit hashes of all words of a batch of texts without a Python object per word, and bounded batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def slices(batches: Iterable[pa.RecordBatch], rows: int = 400, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that at most `rows` rows and about `size` bytes (one row at least) are looked at in one go."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n + 1, np.uint64(_BASE))
        up[0] = 1
        down = np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """Lower-cases A-Z (unless told not to), splits at space and U+0009 to U+000D, hashes each word (a polynomial over random byte values)."""

    def __init__(self, seed: int = 1, lower: bool = True):
        rng = np.random.default_rng(seed)
        value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        if lower:
            value[65:91] = value[97:123]
        self.value = value
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        self.white = white
        self.up, self.down = _tables(2 * PIECE)

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data and where they start."""
        a = np.frombuffer(data, np.uint8)
        n = len(a)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= len(self.up):
            self.up, self.down = _tables(n)
        edge = np.diff(np.concatenate([[True], self.white[a], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[a] * self.up[:n], out=total[1:])
            return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in order, and offsets[i]:offsets[i + 1] of text i. Long texts go in pieces that end at white space."""
        return self.encoded([(t or "").encode("utf-8", "surrogatepass") for t in texts])

    def encoded(self, datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As words, of texts in UTF-8."""
        found, counts, i = [], np.zeros(len(datas), np.int64), 0
        while i < len(datas):
            if len(datas[i]) > PIECE:
                at, data = 0, datas[i]
                while at < len(data):
                    to = min(at + PIECE, len(data))
                    while to < len(data) and not self.white[data[to]]:
                        to += 1
                    h, _ = self._piece(data[at:to])
                    found.append(h)
                    counts[i] += len(h)
                    at = to
                i += 1
                continue
            j, size = i, 0
            while j < len(datas) and len(datas[j]) <= PIECE and size + len(datas[j]) <= PIECE or j == i:
                size += len(datas[j]) + 1
                j += 1
            h, start = self._piece(b" ".join(datas[i:j]))
            begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in datas[i:j]])])
            counts[i:j] = np.diff(np.searchsorted(start, begins))
            found.append(h)
            i = j
        return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hashes of each n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(_BASE) + words[i : len(words) - n + 1 + i]
        return mix64(h)
