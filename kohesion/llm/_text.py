"""Vectorised word and shingle hashing over batches of texts.

Texts are joined to one byte buffer, words are found with array operations, and
each word gets a 64-bit polynomial hash.  Equal words always get equal hashes;
callers that need exactness verify matches on the text itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text handled at once, unless one text is longer.
CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Yields (index of the first text, texts) with about ``limit`` characters each; null is empty."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= limit:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


_kept: dict[str, object] = {}


def kept(name: str, make):
    """An object that a worker process keeps for its next tasks; it keeps one, and none through other operators' tasks."""
    if name not in _kept:
        _kept.clear()
        give_back()
        _kept[name] = make()
    return _kept[name]


def pieces(batches, rows: int = 512):
    """The batches in slices of a few rows, so that a task holds the Python strings of those only."""
    _kept.clear()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Gives freed memory back to the system, where the C library can: workers live through many tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hashes(array: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of a byte array."""
    _grow(len(array) + 1)
    total = np.zeros(len(array) + 1, np.uint64)
    np.cumsum((array.astype(np.uint64) + np.uint64(1)) * _powers[: len(array)], out=total[1:])
    return mix((total[ends] - total[starts]) * _inverse[starts])


def take_segments(array: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The segments one after another."""
    before = np.cumsum(sizes) - sizes
    return array[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@dataclass
class Words:
    """The words of some texts.  ``doc`` is each word's text; ``first`` each text's first word, with the total at the end."""

    data: bytes
    array: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return segment_hashes(self.array, self.starts, self.ends)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of each run of ``k`` words inside one text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * _BASE + h[j : j + n]
        inside = self.doc[:n] == self.doc[k - 1 :]
        return mix(total[inside]), self.doc[:n][inside]


def find_words(texts: Iterable[str], lower: bool = True) -> Words:
    """Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; ``lower`` folds A-Z only."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = b"\n".join(raw) + b"\n"
    if lower:
        data = data.lower()
    array = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    word = ~_SPACE[array]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(starts, bounds)
    return Words(data, array, bounds, starts, ends, doc, first)


def split_words(text: str | None) -> list[bytes]:
    """The words of one text, A-Z folded, for exact comparisons."""
    return (text or "").encode("utf-8", "replace").lower().split()
