"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms and accents are decomposed, homoglyphs of other scripts and digits or
signs that stand for letters become those letters, case goes, and everything else separates words. The lexicon is
learned from labelled rows: words that toxic documents use far more often than others, weighted by their log-odds, and
beginnings that say so of several words together (a word counts once, with its heaviest entry). A phrase of a
lexicon word with a neighbour is an exception, and takes the word's weight back, if the documents that hold it are clean
ones by far, whatever the word's other documents are.
A document's weight is set against its length, and a logistic curve fitted on the same sample turns both into a score.

The sample is bounded: DOCS labelled documents of either label, from rows that are not held out. Nothing else is.

Edge cases: a null or empty text scores what weight 0 does; with no labelled row to learn from the lexicon is empty and every score 0;
null labels are not learned from; repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import forget, held_out, rows_of, written

DOCS = 8000  #: bound of the sample: labelled documents of either label
LEAST_DOCS = 4  #: sampled documents that a lexicon word or an exception is found in
STEMS = range(4, 9)  #: letters of a beginning that stands for all words with it
LEAST_WEIGHT = 1.5  #: log-odds of a lexicon word
CLEANER = 4  #: how many times larger an exception's share of the clean documents is than that of the toxic ones
FLOOR = (0.002, 2)  #: added to both shares of documents, so that entries of a few documents weigh little: a share, at least so many documents
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авеёкмнорстухіїјѕԁԛԝһαβγεικνορτυχωɑɡıłøđ", "abeekmhopctyxiijsdqwhabyeiknoptuxwagilod", strict=True))
DIGITS = dict(zip("013457@$!|", "oieastasil", strict=True))
HIDDEN = "­​‌‍⁠﻿"  #: characters without a width, which go

_ascii = {c: " " for c in range(128)} | {c: chr(c) for c in range(ord("a"), ord("z") + 1)} | {ord(c): c for c in "2689"} | {ord(a): b for a, b in DIGITS.items()}


class _Fold(dict):
    """For str.translate: what a character of decomposed lower-case text becomes; filled as characters turn up."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        kind = unicodedata.category(x)
        self[c] = out = HOMOGLYPHS[x] if x in HOMOGLYPHS else "" if x in HIDDEN or kind == "Mn" else x if kind[0] in "LN" else " "
        return out


_fold = _Fold(_ascii)
_trailing = re.compile(r"[!|$@]+(?!\w)")  # signs are letters only before others
_spaced = re.compile(r"(?<![^ ])[a-z](?: [a-z]){2,}(?![^ ])")


def fold(text: str | None) -> str:
    """Folded words with one blank before, between and after."""
    low = (text or "").lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    words = " ".join(_trailing.sub(" ", low).translate(_fold).split())
    if " " in words and _spaced.search(words):  # letters set apart, as in i d i o t
        words = _spaced.sub(lambda m: m[0].replace(" ", ""), words)
    return f" {words} "


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)  #: entries: a whole word ends with a blank, a beginning does not
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)  #: of the weight, of the weight by length, constant
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w, weight in self.words.items():
                a.add_word(f" {w}", (len(w), weight))
            for p in self.exceptions:
                a.add_word(f" {p} ", (len(p) + 1, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def weigh(self, folded: str) -> tuple[float, float]:
        """(weight of all words outside exceptions, the same against the length in words)."""
        if not self.words:
            return 0.0, 0.0
        found: dict[int, float] = {}  # by where the word starts
        free = []
        for end, (n, weight) in self.automaton().iter(folded):
            start = end - n + 1
            if weight is None:
                free.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        for a, b in free:
            for start in [x for x in found if a <= x < b]:
                del found[start]
        total = math.fsum(found.values())
        return total, total / (4 + folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        if not self.words:
            return 0.0
        a, b, c = self.curve
        total, density = self.weigh(fold(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * math.log1p(total) + b * math.log1p(100 * density) + c))))


def entries(folded: str) -> set[str]:
    """What a folded text may put into the lexicon."""
    words = set(folded.split())
    return {f"{w} " for w in words} | {w[:n] for w in words for n in STEMS if len(w) > n}


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the sample: the labelled ids that come first in a hash order, DOCS of either label; of rows that share an id
    that with the least hash of its text counts, and of equal texts one. So the sample has 2 * DOCS rows at most."""
    spark = docs.sparkSession
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = [r for t in (0, 1) for r in known.filter(F.col("toxic") == t).distinct().orderBy(*order).limit(DOCS).collect()]
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int").coalesce(1))  # 2 * DOCS rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")  # combined before the shuffle, however often an id repeats
    rows = written(rows.groupBy("doc_id", "toxic").agg(least).select("doc_id", "toxic", "x.*"), "toxic-rows")
    once = F.row_number().over(Window.partitionBy("hash", "toxic").orderBy("doc_id"))
    return rows.withColumn("n", once).filter("n = 1").select("text", "toxic")


def _floor(clean: int, toxic: int) -> float:
    return max(FLOOR[0], FLOOR[1] / min(clean, toxic))


def _odds(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Smoothed log-odds of toxicity of what is in n of the clean and t of the toxic documents, at equal shares of both."""
    return {w: math.log(t / toxic + _floor(clean, toxic)) - math.log(n / clean + _floor(clean, toxic)) for w, n, t in counts}


def beginnings(found: dict[str, tuple[int, int]]) -> set[str]:
    """The beginnings (entries without a final blank) to keep, of entries found in (clean, toxic) documents.

    One that stands for a single word, or for no more than a longer beginning does, adds nothing but other words that it
    would hit: it must be in LEAST_DOCS more toxic documents than any longer entry that is listed.
    """
    kept: set[str] = set()
    best: dict[str, int] = {}
    for w in sorted(found, key=lambda w: (-len(w), w)):
        toxic = found[w][1]
        if w.endswith(" ") or toxic - best.get(w, 0) >= LEAST_DOCS:
            if not w.endswith(" "):
                kept.add(w)
            for n in STEMS:
                if len(w) > n:
                    best[w[:n]] = max(toxic, best.get(w[:n], 0))
    return kept


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from labelled documents. What is counted on the executors comes back as far as it enters the lexicon; of each sampled document, two numbers."""
    rows = written(_sampled(docs, labels), "toxic-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in rows_of(batches, text=0):
            found = [(w, t) for text, t in step for w in entries(fold(text))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())], names=["word", "toxic"])

    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        return Lexicon()

    def counted(frame: DataFrame, keep) -> list[tuple[str, int, int]]:
        counts = frame.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("n"), F.sum("toxic").alias("t"))
        return [(r.word, r.n, r.t) for r in counts.filter(keep).collect()]

    floor = _floor(clean, toxic)
    odds = F.log(F.col("t") / toxic + floor) - F.log(F.col("n") / clean + floor)
    found = counted(rows.mapInArrow(words, "word string, toxic int"), (F.col("n") + F.col("t") >= LEAST_DOCS) & (odds >= LEAST_WEIGHT))
    kept = beginnings({w: (n, t) for w, n, t in found})
    lexicon = Lexicon(_odds([x for x in found if x[0].endswith(" ") or x[0] in kept], clean, toxic))
    listed = set(lexicon.words)
    is_listed = lambda w: f"{w} " in listed or any(w[:n] in listed for n in STEMS)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in rows_of(batches, text=0):
            pairs = []
            for text, t in step:
                own = fold(text).split()
                pairs += [(p, t) for p in {f"{a} {b}" for a, b in zip(own, own[1:]) if is_listed(a) or is_listed(b)}]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.int32())], names=["word", "toxic"])

    harmless = (F.col("n") >= LEAST_DOCS) & (F.col("n") * toxic >= CLEANER * F.col("t") * clean)
    lexicon.exceptions = {p for p, _, _ in counted(rows.mapInArrow(phrases, "word string, toxic int"), harmless)}

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in rows_of(batches, text=0):
            w = [lexicon.weigh(fold(text)) for text, _ in step]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in w], pa.float64()), pa.array([x for _, x in w], pa.float64()), pa.array([t for _, t in step], pa.int32())], names=["total", "density", "toxic"])

    points = sorted((r.total, r.density, r.toxic) for r in rows.mapInArrow(weights, "total double, density double, toxic int").collect())  # 2 * DOCS rows at most
    lexicon.curve = _curve(np.array(points))
    lexicon._automaton = None
    forget(rows)
    return lexicon


def _curve(points: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a ridge."""
    x = np.stack([np.log1p(points[:, 0]), np.log1p(100 * points[:, 1]), np.ones(len(points))], axis=1)
    y, w = points[:, 2], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from the whole text alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            s = [lexicon.score(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(work, SCHEMA)
