"""Word shingles of whole texts as sets of 64-bit hashes (numpy over Arrow batches inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .textstats import _UPPER, passes, words_of

SIZE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A content hash of each word; each distinct word is hashed once."""
    _, first = np.unique(codes, return_index=True)
    raw = data.tobytes()
    each = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.uint64, len(first))
    return each[codes]


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of consecutive rows): sorted distinct hashes; A-Z count as a-z.

    With fewer than `size` words the whole sequence is the one shingle; without words the set is empty.
    """
    for row, n, data, at in passes(texts):
        data = np.where(_UPPER[data], data + np.uint8(32), data).astype(np.uint8)
        starts, ends, doc, codes = words_of(data, at)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        words = _word_hashes(data, starts, ends, codes) if len(codes) else np.zeros(0, np.uint64)
        h = words.copy()
        with np.errstate(over="ignore"):
            for step in range(1, size):
                h = mix(h[: len(words) - step] * np.uint64(0x9E3779B97F4A7C15) + words[step:]) if len(words) > step else np.zeros(0, np.uint64)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                own = np.sort(h[a : b - size + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                sets.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield row, sets


def class_of(own: np.ndarray) -> int:
    """A hash of a whole set: equal sets, equal class."""
    return xxhash.xxh3_64_intdigest(own.tobytes())


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
