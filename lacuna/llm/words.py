"""Word and shingle hashes, computed in bulk inside Python tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hashes a worker keeps at a time.
CACHE = 1 << 17
#: Rows of an Arrow batch worked on at a time; whole batches of long texts would take much memory.
SLICE = 1024


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
_U = np.uint64


def tidy(work: Callable[..., Iterator[pa.RecordBatch]], *given) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work(batches, *given)`` for mapInArrow, giving back the worker's memory when a task ends.

    Workers live on between tasks and stages, so what one holds is missing for all later ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches, *given)
        _HASHES.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009 to U+000D, as UTF-8.

    Splitting and lower-casing bytes touches ASCII alone.
    """
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.array([_HASHES[w] for w in words], dtype=_U)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U(27))
    values = values * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by the position of its first word."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    out = np.full(count, width, dtype=_U)
    for i in range(width):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[i:i + count]
        out ^= out >> _U(29)
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes, rising, of the ``width``-word shingles of the lower-cased text.

    A text of fewer words has one shingle, its whole sequence; one without words none.
    """
    hashes = word_hashes(split_words(text, lower=True))
    return np.unique(gram_hashes(hashes, min(width, len(hashes)))) if len(hashes) else hashes
