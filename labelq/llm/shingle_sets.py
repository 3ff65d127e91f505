"""Sets of hashed word shingles of whole texts, made batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xD6E8FEB86659FD93)
HALF, STEP = np.uint64(32), np.uint64(29)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> HALF)
    x = x * LAST
    return x ^ (x >> HALF)


#: Texts whose words are held at once; as Python objects these take many times the text.
TEXTS = 100


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its shingles of ``k`` words.

    Words are what ASCII white space leaves, with A-Z lower-cased. A text of fewer than ``k`` words has its whole
    sequence as one shingle; one without words, or null, has none.
    """
    for at in range(0, len(column), TEXTS):
        yield from _sets(column.slice(at, TEXTS), k)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    words = [(x.as_py() or "").encode().lower().split() for x in column]
    lengths = np.array([len(w) for w in words])
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = [w for own in words for w in own]
    h = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
    x = h.copy()
    for j in range(1, k):
        if len(x) > j:
            head = x[:-j]
            x[:-j] = ((head * ODD) ^ (head >> STEP)) + h[j:]
    x = _stir(x)
    at = 0
    for n in lengths.tolist():
        if n >= k:
            yield np.unique(x[at:at + n - k + 1])
        elif n:
            short = np.uint64(n)
            for w in h[at:at + n]:
                short = np.uint64((int(short) * int(ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield _stir(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n
