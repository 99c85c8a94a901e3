"""The default embedder: signed feature hashing of words and letter n-grams, deterministic and without a model file.

A text becomes DIMENSIONS numbers: each of its features adds or takes, by one bit of its hash, a weight at the place that the
other bits name; the vector is scaled to length 1. Texts that share words or parts of words lie near each other; unlike a
learned embedder it knows no synonyms. The tables it needs are made once a worker process, on first use.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
GRAMS = (3, 4)  #: lengths of letter n-grams
WORD_WEIGHT = 2.0
MODEL_ID = f"hashed-ngrams-{DIMENSIONS}"
WORDS_KEPT = 200_000  #: words whose vector a worker remembers

_WORD = re.compile(r"[^\W_]+")


class Hashed:
    """embed(texts) -> vectors; None for a text without a letter or digit."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of a word's features."""
        found = self.known.get(word)
        if found is None:
            edged = f"<{word}>"
            features = [f"w:{word}", *(edged[k : k + n] for n in GRAMS for k in range(len(edged) - n + 1))]
            codes = np.array([zlib.crc32(f.encode()) for f in features], np.int64)
            weight = np.full(len(features), 1.0 / max(1, len(features) - 1))
            weight[0] = WORD_WEIGHT
            found = (codes >> 1) % self.dimensions, np.where(codes & 1, weight, -weight)
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
            words = _WORD.findall(plain)
            vector = np.zeros(self.dimensions)
            for word in words:
                at, weight = self._word(word)
                np.add.at(vector, at, weight)
            norm = np.sqrt((vector * vector).sum())
            out.append((vector / norm).astype(np.float32).tolist() if norm > 0 else None)
        return out


_loaded: list[Hashed] = []


def default(texts: list[str | None]) -> list[list[float] | None]:
    """The worker's embedder, made at its first use."""
    if not _loaded:
        _loaded.append(Hashed())
    return _loaded[0](texts)


def embedded(text: Column) -> Column:
    """The vector of each text (array of floats, null without a letter or digit)."""

    @F.pandas_udf("array<float>")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(default(part.tolist()), index=part.index, dtype=object)

    return work(text)
