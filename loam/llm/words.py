"""Words of whole batches of texts by classes of bytes: no Python object a word, and no text is cut.

In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so a class of code points that takes all of those is a class of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table from a byte to the byte that it counts as: A-Z lower-cased, 0 where it is no part of a word. ranges: first and last bytes, beside 0x80 and beyond."""
    table = np.zeros(256, np.uint8)
    for low, high in (*ranges, (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    capital = np.arange(ord("A"), ord("Z") + 1)
    table[capital] = np.where(table[capital] > 0, capital + 32, 0)
    return table


LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
ALPHANUMERIC = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts one after the other, the number of words of each text). A null text has none."""
    column = pa.compute.fill_null(texts, "").cast(pa.large_string())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    low = table[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    within = low > 0
    first = ends[:-1][ends[:-1] < len(low)]  # where texts begin; no word goes over such a place
    before = np.concatenate([[False], within[:-1]])[: len(low)]
    before[first] = False
    after = np.concatenate([within[1:], [False]])[: len(low)]
    after[first[first > 0] - 1] = False
    start = np.flatnonzero(within & ~before)
    length = np.flatnonzero(within & ~after) + 1 - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    kind, size = (pa.string(), np.int32) if offsets[-1] < 2**31 else (pa.large_string(), np.int64)
    words = pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(offsets.astype(size)), pa.py_buffer(low[within])])
    return words, np.diff(np.searchsorted(start, ends))
