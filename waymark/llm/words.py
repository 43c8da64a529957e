"""Words and their hashes for the operators that run in Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"\w+")
#: Forgets the words seen beyond so many, so that a worker's memory stays bounded.
MOST_WORDS = 200_000
U = np.uint64
#: Of glibc only.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(text: str | None, cache: Hashes) -> np.ndarray:
    found = tokens(text)
    return np.fromiter(map(cache.__getitem__, found), U, len(found))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about ``most`` bytes of text, and their texts; a longer text is alone.

    Only one part's texts are Python strings at a time.
    """
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start, n = 0, 0
    for k, size in enumerate(sizes):
        n += size
        if n >= most or k + 1 == len(sizes):
            part = batch.slice(start, k + 1 - start)
            yield part, part.column(at).to_pylist()
            start, n = k + 1, 0
    give_back()


def give_back() -> None:
    """Returns freed memory to the system; an idle worker would keep it beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
