"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents, a step of texts at a time, into shards: arrays of word numbers of which the suffixes are
sorted by prefix doubling, to as many words as the longest test stretch has. Every suffix of every test item is then
binary-searched in every shard, word by word within the interval of suffixes that agree so far; where the interval would
be empty the suffix's longest verbatim match ends, and the interval holds all its locations. The interval at the tenth
word holds the occurrences of a window, whose words are hit, and whose documents go.

Test items meet all documents, in blocks: of BLOCK_WORDS words on average, each collected and broadcast on its own, with
which the documents' rows pass one after the other and carry on what was found. Documents are neither shuffled nor cut;
texts beyond SHARD_WORDS make several shards, which overlap by the length of a test stretch. Items beyond STRETCH words are
searched in stretches that overlap by a window less one word, so a longer match is found as several.

Edge cases: a null or empty text, or one without a word, has no words, no hits and no items; an item without words has no
windows; rows of one item_id are one item; a null item_id is written as the empty string; rows that repeat a doc_id, or have
none, are documents of their own; an empty table of documents gives no rows, an empty benchmark no hits; other columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import steps, written
from loam.llm.words import ALPHANUMERIC, words_of

WINDOW = 10  #: consecutive words of a window
BLOCK_WORDS = 1 << 18  #: words of a block of test items, about
STRETCH = 4096  #: words of an item that are searched as one
SHARD_WORDS = 1 << 19  #: words of a shard, at most
BLOCKS_A_STAGE = 8  #: blocks that one stage's rows pass before they are written

STATE = "__n_words long, __n_hit long, __hit binary, __items array<string>"
MATCH = "item_id string, position long, length long, doc_id long, doc_position long"


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The places of an array of numbers (>= 0) in the order of the suffixes that begin there, compared by `depth` numbers at least; beyond the end they
    go on with zeros.

    The first sort packs several words into a key; each further one doubles the words, and takes only suffixes still tied.
    """
    n = len(words)
    bits = max(1, int(words.max(initial=0)).bit_length())
    known = max(1, min(depth, 62 // bits))
    padded = np.concatenate([words, np.zeros(known, words.dtype)]).astype(np.int64)
    key = padded[:n].copy()
    for k in range(1, known):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    rank = np.zeros(n + 1, np.int64)  # 1 + the place of the first suffix of its tie; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    while known < depth:
        tied = np.flatnonzero(~head | np.concatenate([~head[1:], [False]])[:n])
        if not len(tied):
            break
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + known, n)]
        own = np.argsort(key)
        order[tied] = at[own]
        key = key[own]
        head[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(head[tied], tied, 0)) + 1
        known *= 2
    return order


def _bound(words: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, asked: np.ndarray, right: bool) -> np.ndarray:
    """Binary searches side by side: the first place of each [low, high) whose suffix has at `depth` a word beyond (right) or not below the asked one."""
    low, high = low.copy(), high.copy()
    while len(still := np.flatnonzero(low < high)):
        middle = (low[still] + high[still]) >> 1
        word = words[order[middle] + depth]
        under = word <= asked[still] if right else word < asked[still]
        low[still[under]] = middle[under] + 1
        high[still[~under]] = middle[~under]
    return low


class Tests:
    """A block of test items: their words in stretches (0: the end of one), and what each suffix belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        words, counts = words_of(pa.array([text for _, text in items], pa.string()), ALPHANUMERIC)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        parts: list[tuple[np.ndarray, ...]] = []
        a = 0
        for (item_id, _), n in zip(items, counts.tolist(), strict=True):
            for b in range(0, max(1, n - window + 1), STRETCH - window + 1) if n else ():
                own = codes[a + b : a + min(n, b + STRETCH)]
                k = len(own)
                parts.append((np.append(own, 0), np.full(k + 1, number[item_id]), np.append(np.arange(k, 0, -1), 0), np.full(k + 1, min(window, n)), np.arange(b, b + k + 1)))
            a += n
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        self.words, self.item, self.left, self.window, self.position = columns
        self.depth = int(self.left.max(initial=0))

    def numbered(self, vocabulary: pa.Array) -> np.ndarray:
        """The words as numbers of a shard's vocabulary, from 1; -1 for one that is not there."""
        at = pa.compute.fill_null(pa.compute.index_in(self.vocabulary.cast(vocabulary.type), value_set=vocabulary), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return np.concatenate([[-1], at])[self.words]


def search(words: np.ndarray, order: np.ndarray, asked: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """For each test suffix: the length of its longest match, the interval of `order` with its locations, and that of its window (empty if none)."""
    m, n = len(asked), len(order)
    padded = np.concatenate([words, np.zeros(tests.depth + 1, words.dtype)])
    first = words[order]
    length, low, high = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    from_, to = np.zeros(m, np.int64), np.zeros(m, np.int64)
    alive = np.flatnonzero((asked > 0) & (n > 0))
    a, b = np.searchsorted(first, asked[alive], "left"), np.searchsorted(first, asked[alive], "right")
    depth = 1
    while len(alive):
        found = a < b
        alive, a, b = alive[found], a[found], b[found]
        length[alive], low[alive], high[alive] = depth, a, b
        whole = tests.window[alive] == depth
        from_[alive[whole]], to[alive[whole]] = a[whole], b[whole]
        more = tests.left[alive] > depth
        alive, a, b = alive[more], a[more], b[more]
        word = asked[alive + depth]
        a, b = _bound(padded, order, depth, a, b, word, False), _bound(padded, order, depth, a, b, word, True)
        depth += 1
    return length, low, high, from_, to


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the interval, place) of all places of the intervals."""
    size = high - low
    own = np.repeat(np.arange(len(low)), size)
    return own, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


class Shards:
    """The suffix arrays of a step of texts, built one at a time."""

    def __init__(self, texts: pa.Array, depth: int) -> None:
        words, self.counts = words_of(texts, ALPHANUMERIC)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.begin = np.concatenate([[0], np.cumsum(self.counts + 1)])  # a 0 ends each text
        self.words = np.zeros(self.begin[-1], np.int32)
        own = np.arange(len(words)) + np.repeat(np.arange(len(self.counts)), self.counts)
        self.words[own] = coded.indices.to_numpy(zero_copy_only=False) + 1
        self.depth = depth

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the shard, its words and those that its suffixes go on with, its suffix array)."""
        for a in range(0, len(self.words), SHARD_WORDS):
            words = self.words[a : a + SHARD_WORDS + self.depth]
            order = suffix_array(words, self.depth)
            yield a, words, order if len(words) <= SHARD_WORDS else order[order < SHARD_WORDS]

    def texts_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1


def _contaminated(texts: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of words of each text, hit or not for each place of the step's words, item numbers of each text)."""
    shards = Shards(texts, tests.depth)
    asked = tests.numbered(shards.vocabulary)
    cover = np.zeros(len(shards.words) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for at, words, order in shards:
        *_, low, high = search(words, order, asked, tests)
        found = np.flatnonzero(low < high)
        # Suffixes that begin with the same window have the same interval: its places are looked at once.
        spans, which = np.unique(np.stack([low[found], high[found], tests.window[found]], 1), axis=0, return_inverse=True)
        span, place = _expanded(spans[:, 0], spans[:, 1])
        place = order[place] + at
        cover += np.bincount(place, minlength=len(cover)) - np.bincount(place + spans[span, 2], minlength=len(cover))
        met = np.unique(span * len(shards.begin) + shards.texts_at(place))
        span, text = met // len(shards.begin), met % len(shards.begin)
        holds = np.unique(which.reshape(-1) * len(tests.ids) + tests.item[found])
        bounds = np.searchsorted(holds, np.arange(len(spans) + 1) * len(tests.ids))
        own, k = _expanded(bounds[span], bounds[span + 1])
        pairs.append(np.unique(text[own] * len(tests.ids) + holds[k] % len(tests.ids)))
    pair = np.unique(np.concatenate(pairs))
    bounds = np.searchsorted(pair, np.arange(len(shards.counts) + 1) * len(tests.ids))
    items = [pair[a:b] % len(tests.ids) if b > a else pair[:0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return shards.counts, np.cumsum(cover[:-1]) > 0, items


def _passed(names: list[str], at: int, tests):
    """A pass of the rows (all columns of documents, then those of STATE) by one block of tests."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = tests.value
        for batch in steps(batches, at):
            counts, hit, items = _contaminated(batch.column(at), block)
            ends = np.cumsum(counts + 1)
            n_hit, masks, found = [], [], []
            for n, end, own, before, held in zip(counts.tolist(), ends.tolist(), items, batch.column(len(names) + 2).to_pylist(), batch.column(len(names) + 3).to_pylist(), strict=True):
                mask = hit[end - 1 - n : end - 1]
                if before is not None:
                    mask = mask | np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                n_hit.append(int(mask.sum()))
                masks.append(np.packbits(mask).tobytes() if n_hit[-1] else None)
                found.append(sorted({*(held or ()), *(block.ids[k] for k in own)}))
            state = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *state], names=[*names, "__n_words", "__n_hit", "__hit", "__items"])

    return work


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Tests]:
    """The distinct items, dealt by hash into blocks of BLOCK_WORDS words on average; one block is held at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    n = max(1, -(-(rows.agg(F.sum(words)).first()[0] or 0) // BLOCK_WORDS))  # one row
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Tests(sorted((tuple(r) for r in own.collect()), key=repr), window)  # a block's words, or those of one item


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with __n_words, __n_hit, __hit (a bit a word, null if none is hit) and __items (ids of items with occurring windows, sorted)."""
    spark, names = docs.sparkSession, docs.columns
    kind = T.StructType([*docs.schema.fields, *T._parse_datatype_string(STATE).fields])
    rows = docs.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[len(names) :]))
    for k, block in enumerate(_blocks(benchmark, window)):
        if k and k % BLOCKS_A_STAGE == 0:
            rows = written(rows, "decontamination")
        rows = rows.mapInArrow(_passed(names, names.index("text"), spark.sparkContext.broadcast(block)), kind)
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, as they were."""
    return contamination(docs, benchmark, window).filter("__n_hit = 0").select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """For each suffix of an item (item_id, position) that `least` words or more of occur in a document: the length of its
    longest verbatim match, and all its locations (doc_id, doc_position), in words."""
    spark, out = docs.sparkSession, None

    def work(tests):
        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = tests.value
            for batch in steps(batches, 1):
                shards = Shards(batch.column(1), block.depth)
                asked = block.numbered(shards.vocabulary)
                for at, words, order in shards:
                    length, low, high, *_ = search(words, order, asked, block)
                    long = np.flatnonzero(length >= least)
                    own, place = _expanded(low[long], high[long])
                    own, place = long[own], order[place] + at
                    text = shards.texts_at(place)
                    ids = pa.array([block.ids[k] for k in block.item[own]], pa.string())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(block.position[own]), pa.array(length[own]), batch.column(0).take(pa.array(text)), pa.array(place - shards.begin[text])], names=["item_id", "position", "length", "doc_id", "doc_position"])

        return located

    for block in _blocks(benchmark, least):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work(spark.sparkContext.broadcast(block)), MATCH)
        out = found if out is None else out.unionByName(found)
    out = written(out, "longest-matches")
    most = out.groupBy("item_id", "position").agg(F.max("length").alias("length"))
    return out.join(most, ["item_id", "position", "length"], "left_semi").distinct()
