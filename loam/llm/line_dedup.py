"""Line dedup over levelled sorted runs.

The state is a set of runs: tables of 16-byte line hashes, each dealt into buckets by hash and sorted within them, in
levels. A new batch of documents is merge-anti-joined with the runs: its distinct hashes are shuffled into the same buckets
once, and merged with every run, none of which is shuffled or sorted again. Hashes found there are repeats, the others are
first seen in this batch, stay in the smallest doc_id that holds them, and become a run of level 0. FAN_OUT runs of one
level are compacted into one of the next, so a hash is rewritten once a level. Batches come in ascending order of doc_id,
which makes the first holder the smallest id.

Only (hash, doc_id) pairs are shuffled to decide, but for those of hot lines, which stay where they are; the texts move
once, to meet the hashes they lose.

Edge cases: a null or empty text is one empty line; rows without an id rank after all others, as one document; rows that
repeat a doc_id are one document, whose lines all stay where that id is the first holder; a line whose key has under 10
code points always stays; an empty table gives an empty one; other columns pass through `dedup_lines` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import SPACES, forget, hot_join, hot_keys, rows_of, steps, written

MIN_CHARS = 10
BATCHES = 5  #: batches that a one-off job over a whole table is dealt in
FAN_OUT = 3  #: runs of a level that are compacted into one
LAST = (1 << 63) - 1  #: stands for a null doc_id
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  #: scans of sorted buckets count as sorted


def key_hash(line: bytes) -> bytes | None:
    """The hash of a line's key, or None where the key is too short to count."""
    key = line.strip(SPACES).lower()  # bytes.lower changes A-Z alone
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        ids, parts, hashes = [], [], []
        for doc_id, text, part in rows:
            found = {key_hash(line) for line in (text or "").encode().split(b"\n")} - {None}
            ids += [doc_id] * len(found)
            parts += [part] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], names=["h", "doc", "part"])


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED, None)
    spark.conf.set(SORTED, "true")
    try:
        yield
    finally:
        spark.conf.unset(SORTED) if before is None else spark.conf.set(SORTED, before)


class Runs:
    """The levelled runs: tables bucketed and sorted by h, the hashes of a run being those of its rows that are not `known`."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def mark(self, hashes: DataFrame) -> DataFrame:
        """hashes (h, ...) with `known`: whether a run holds h. Merges the sorted runs with the hashes; only the hashes are shuffled, once."""
        runs = [t for level in self.levels for t in level]
        for k, t in enumerate(runs):
            hashes = hashes.join(t.filter("not known").select("h", F.lit(True).alias(f"in_{k}")).hint("merge"), "h", "left")
        known = reduce(lambda a, b: a | b, (F.col(f"in_{k}").isNotNull() for k in range(len(runs))), F.lit(False))
        return hashes.withColumn("known", known).drop(*(f"in_{k}" for k in range(len(runs))))

    def add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_OUT:
            old, self.levels[level] = self.levels[level], []
            merged = reduce(DataFrame.unionByName, (t.filter("not known").select("h", "known") for t in old))
            buckets = int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.add(written(merged.repartition(buckets, "h"), f"line-run-{level + 1}", bucketed="h"), level + 1)
            for t in old:
                forget(t)

    def drop(self) -> None:
        for level in self.levels:
            for t in level:
                forget(t)
        self.levels = []


def feed(runs: Runs, docs: DataFrame, more: bool = True) -> DataFrame:
    """Decide on a batch whose ids lie above all fed before: (doc, part, h) of the lines to lose, written. `more`: keep the batch's own hashes for later ones."""
    spark = docs.sparkSession
    pairs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", part_of().alias("part")).mapInArrow(_pairs, "h binary, doc long, part long")
    pairs = written(pairs, "line-pairs")
    with sorted_scans(spark):
        first = pairs.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
        marked = written(runs.mark(first), "line-run-0", bucketed="h")
        repeats = marked.filter("known or first < last").select("h", F.when(~F.col("known"), F.col("first")).alias("first"))
        # A line that a good share of the documents hold is hot: its rows stay where they are.
        joined = hot_join(pairs, repeats, "h", hot_keys(marked, "h"))
        lost = written(joined.filter("first is null or doc <> first").select("doc", "part", "h"), "line-lost")
        if more:
            runs.add(marked)
        else:
            forget(marked)
    forget(pairs)
    return lost


def part_of() -> Column:
    """Rows without an id share LAST; the hash of the text tells them apart."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        out: list[list] = [[], [], [], []]
        for number, text, lost in rows:
            lines = (text or "").encode().split(b"\n")
            gone = set(lost or ())
            stay = [x for x in lines if not gone or key_hash(x) not in gone]
            for column, value in zip(out, (number, b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["doc_id", "kept", "n_lines", "n_dropped"])


def lost_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, part, hashes) of all lines to lose, from `batches` batches by ranges of doc_id."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    runs, lost = Runs(), []
    for k in range(len(cuts) + 1):
        low = F.lit(True) if not k else F.col("doc_id") > int(cuts[k - 1])
        high = F.col("doc_id") <= int(cuts[k]) if k < len(cuts) else F.lit(True)
        part = low & high if k < len(cuts) else low | F.col("doc_id").isNull()
        lost.append(feed(runs, docs.filter(part), more=k < len(cuts)))
    runs.drop()
    return reduce(DataFrame.unionByName, lost).groupBy("doc", "part").agg(F.collect_list("h").alias("lost"))


def _with_lost(docs: DataFrame, batches: int) -> DataFrame:
    """docs with a column __lost; the lists of a row are bounded by its own lines, ids or none."""
    gone = lost_lines(docs, batches).select(F.col("doc").alias("__doc"), F.col("part").alias("__part"), F.col("lost").alias("__lost"))
    on = (F.coalesce("doc_id", F.lit(LAST)) == F.col("__doc")) & (part_of() == F.col("__part"))
    return docs.join(gone, on, "left").drop("__doc", "__part")


def kept_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept (the lines that stay, joined by \\n), n_lines, n_dropped; one row for each row of docs."""
    rows = _with_lost(docs.select("doc_id", "text"), batches)
    return rows.mapInArrow(_kept, "doc_id long, kept string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with the lines that stay as `text`, all other columns as they were (n_chars follows the text)."""
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                gone = set(lost or ())
                texts.append(text if not gone else b"\n".join(x for x in text.encode().split(b"\n") if key_hash(x) not in gone).decode())
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = _with_lost(docs, batches).mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
