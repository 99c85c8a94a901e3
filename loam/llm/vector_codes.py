"""Product codes of vectors: codebooks by Lloyd's rounds in integers, nearest entries by annular norm pruning.

Vectors become blocks of integers, written once. A round goes over the blocks: a task assigns each part of its vectors to the
nearest entry, and sends one row an entry, with the sum of its parts, so nothing but sums is shuffled, and the driver gets one codebook
(ENTRIES rows a part).

Annular pruning: entries are sorted by norm. By the triangle inequality an entry at a distance of d or less from a part has a norm
within d of the part's own. So the entries nearest in norm give a first best distance, a binary search the interval of norms that it
allows, ends included, and only those entries are evaluated. Norms are compared as doubles with room for their rounding; distances are
integers, so the nearest entry is exact, and of equal ones the first.

Where components are so large that 64 bits may not hold a distance or a sum, the same is done with Python's integers; an error
beyond 64 bits is null.

Edge cases: a null vector, or one with a null or non-finite component, is left out; fewer than ENTRIES vectors make a smaller codebook;
a vec_id that repeats is a vector each time, and a null one ranks last; a length that four does not divide has longer parts first; vectors
of different lengths have codebooks of their own; an empty vector has code 00000000 and error 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import hot_join, hot_keys, release, slices, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 1024  #: vectors of a packed block
RING = 8  #: entries nearest in norm that give a first best distance
TILE = 256  #: parts that are compared with an annulus at a time
LIMIT = 2.0**20  #: components (scaled) up to this are packed in 32 bits

PACKED = "dim int, wide boolean, ids array<long>, labels array<string>, cells binary"
SUMS = "part int, entry int, n long, total array<long>"
BIG_SUMS = "part int, entry int, n string, total array<string>"
CODES = "vec_id long, label string, code string, error long"


def whole(vector: list[float]) -> list[int]:
    """floor(SCALE * x) of finite components of any size."""
    return [SCALE * int(x) if abs(x) > 2.0**60 else int(np.floor(SCALE * x)) for x in vector]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns vec_id, label, embedding to blocks of vectors of one length; those with large components stay doubles, in blocks of their own."""
    for batch in slices(batches, BLOCK):
        column = batch.column(2)
        flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        length = pa.compute.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(np.maximum(length, 0))
        start = end - np.maximum(length, 0)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(SCALE * flat)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # a null component is nan here
            large = np.concatenate([[0], np.cumsum(~(np.abs(scaled) <= LIMIT))])
        fine = np.flatnonzero((length >= 0) & (bad[end] == bad[start]))
        wide = large[end] > large[start]
        for dim, big in sorted({(int(length[k]), bool(wide[k])) for k in fine}):
            own = fine[(length[fine] == dim) & (wide[fine] == big)]
            at = start[own][:, None] + np.arange(dim)
            cells = flat[at].astype("<f8") if big else scaled[at].astype("<i4")
            ids, labels = (batch.column(k).take(pa.array(own)).to_pylist() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([big]), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([cells.tobytes()], pa.binary())], names=["dim", "wide", "ids", "labels", "cells"])


def _vectors(cells: bytes, wide: bool, n: int, dim: int, exact: type) -> np.ndarray:
    """The vectors of a block as integers: of kind `exact` (np.int64, or object where 64 bits may be too few)."""
    if wide:
        return np.array([whole(v) for v in np.frombuffer(cells, "<f8").reshape(n, dim)], object).reshape(n, dim)
    rows = np.frombuffer(cells, "<i4").reshape(n, dim)
    return rows.astype(np.int64) if exact is np.int64 else np.array([[int(x) for x in v] for v in rows], object).reshape(n, dim)


def bounds(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and last + 1 components of the parts."""
    size = [dim // parts + (k < dim % parts) for k in range(parts)]
    return [(sum(size[:k]), sum(size[: k + 1])) for k in range(parts)]


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norm = self._norms(entries)
        self.order = np.argsort(norm, kind="stable")
        self.norm, self.entries = norm[self.order], entries[self.order]

    @staticmethod
    def _norms(rows: np.ndarray) -> np.ndarray:
        return np.array([_root(x) for x in (rows * rows).sum(1)], np.float64) if rows.dtype == object else np.sqrt((rows * rows).sum(1).astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row. Where doubles hold every distance exactly the products are taken in doubles, else in the rows' own kind."""
        kind, entries = rows.dtype, self.entries
        if kind == np.int64 and max(1, rows.shape[1]) * (_most(rows) + _most(entries)) ** 2 < 2**53:
            rows, entries = rows.astype(np.float64), entries.astype(np.float64)
        n, size = len(rows), len(entries)
        norm = self._norms(rows)
        place = np.searchsorted(self.norm, norm)
        best, entry = np.zeros(n, rows.dtype), np.zeros(n, np.int64)
        by_norm = np.argsort(norm, kind="stable")  # rows of like norms share most of their annuli
        for a in range(0, n, TILE):
            own = by_norm[a : a + TILE]
            part = rows[own]
            low = np.clip(place[own] - RING // 2, 0, max(0, size - RING))
            ring = np.minimum(low[:, None] + np.arange(min(RING, size)), size - 1)
            gap = entries[ring] - part[:, None, :]
            first = (gap * gap).sum(2).min(1)
            reach = np.array([_root(x) for x in first], np.float64) if rows.dtype == object else np.sqrt(first.astype(np.float64))
            slack = 1e-9 * (norm[own] + reach + 1)
            low = np.searchsorted(self.norm, norm[own] - reach - slack, "left")
            high = np.searchsorted(self.norm, norm[own] + reach + slack, "right")
            base, top = int(low.min()), int(high.max())
            among, index = entries[base:top], self.order[base:top]
            distance = (part * part).sum(1)[:, None] - 2 * (part @ among.T) + (among * among).sum(1)
            inside = (np.arange(base, top) >= low[:, None]) & (np.arange(base, top) < high[:, None])
            least = np.where(inside, distance, first[:, None] + 1).min(1)
            entry[own] = np.where(inside & (distance == least[:, None]), index, size).min(1)
            best[own] = least
        return entry, best.astype(kind)


def _most(rows: np.ndarray) -> int:
    return int(np.abs(rows).max(initial=0))


def _root(x: int) -> float:
    """The square root of an integer of any size; beyond all doubles, the largest: the pruning then rules nothing out."""
    try:
        return float(math.isqrt(int(x)))
    except OverflowError:
        return np.finfo(np.float64).max / 8


def _floor_mean(total: list, n: int) -> list[int]:
    return [int(x) // int(n) for x in total]


def _assigned(batches: Iterator[pa.RecordBatch], dim: int, books: list[Codebook], exact: type) -> Iterator[tuple]:
    """(ids, labels, vectors, [(entry, distance) a part]) of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            rows = _vectors(row["cells"], row["wide"], len(row["ids"]), dim, exact)
            yield row["ids"], row["labels"], rows, [book.nearest(rows[:, a:b]) for book, (a, b) in zip(books, bounds(dim), strict=True)]
    release()


def _fit(blocks: DataFrame, dim: int, entries: list[np.ndarray], exact: type) -> list[np.ndarray]:
    """One round: each entry becomes the floor of its parts' mean; unused entries stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(x) for x in entries]
        sums = [np.zeros(x.shape, exact) for x in entries]
        count = np.zeros((PARTS, len(entries[0])), np.int64)
        for _, _, rows, found in _assigned(batches, dim, books, exact):
            for k, ((entry, _), (a, b)) in enumerate(zip(found, bounds(dim), strict=True)):
                np.add.at(sums[k], entry, rows[:, a:b])
                count[k] += np.bincount(entry, minlength=count.shape[1])
        part, entry = np.nonzero(count)
        total = [sums[k][e].tolist() for k, e in zip(part, entry, strict=True)]
        kind = pa.int64() if exact is np.int64 else pa.string()
        total = total if exact is np.int64 else [[str(x) for x in t] for t in total]
        n = count[part, entry].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n if exact is np.int64 else [str(x) for x in n], kind), pa.array(total, pa.list_(kind))], names=["part", "entry", "n", "total"])

    def added(table: pa.Table) -> pa.Table:
        total = [str(sum(map(int, x))) for x in zip(*table.column("total").to_pylist(), strict=True)]
        n = str(sum(map(int, table.column("n").to_pylist())))
        return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1], "n": pa.array([n]), "total": pa.array([total], pa.list_(pa.string()))})

    if exact is np.int64:
        sums = blocks.mapInArrow(work, SUMS)
        width = bounds(dim)[0][1]
        each = [F.sum(F.try_element_at("total", F.lit(k + 1))) for k in range(width)]
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array_compact(F.array(*each)).alias("total") if each else F.array().cast("array<long>").alias("total"))
    else:
        sums = blocks.mapInArrow(work, BIG_SUMS).groupBy("part", "entry").applyInArrow(added, BIG_SUMS)
    out = [x.copy() for x in entries]
    for row in sums.collect():  # PARTS * ENTRIES rows at most
        out[row["part"]][row["entry"]] = _floor_mean(row["total"], row["n"])
    return out


def _coded(blocks: DataFrame, dim: int, entries: list[np.ndarray], exact: type) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(x) for x in entries]
        for ids, labels, _, found in _assigned(batches, dim, books, exact):
            digits = np.stack([e for e, _ in found], 1).astype(np.uint8).tobytes().hex()
            errors = [int(x) for x in sum(d for _, d in found)]
            codes = [digits[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(codes, pa.string()), pa.array([x if x < 1 << 63 else None for x in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(work, CODES)


def digest(entries: list[np.ndarray]) -> str:
    text = ",".join(str(int(x)) for part in entries for entry in part for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Columns vec_id, label, embedding: vec_id, code, error, label_error (summed over equal labels), codebooks_sha256."""
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>").alias("embedding"))
    packed = written(rows.mapInArrow(_packed, PACKED), "codes-vectors")
    out = None
    sizes = packed.groupBy("dim").agg(F.max("wide").alias("wide"), F.sum(F.size("ids")).alias("n")).collect()  # one row a length
    for dim, wide, n in sorted(tuple(r) for r in sizes):
        blocks = packed.filter(F.col("dim") == dim)
        # 64 bits hold squared distances of differences up to 2 * LIMIT, and sums of n components.
        exact = object if wide or dim * (2 * LIMIT) ** 2 >= 2.0**62 or n * LIMIT >= 2.0**62 else np.int64
        first = _smallest(rows, dim, exact)
        entries = [first[:, a:b] for a, b in bounds(dim)]
        for _ in range(rounds):
            entries = _fit(blocks, dim, entries, exact)
        coded = _coded(blocks, dim, entries, exact).withColumn("codebooks_sha256", F.lit(digest(entries)))
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = written(out, "codes-coded")
    sums = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(19,0)")).alias("sum"), F.count("*").alias("n"), F.bool_or(F.col("error").isNull()).alias("over"))
    sums = sums.select("label", F.when(~F.col("over"), F.col("sum").try_cast("long")).alias("label_error"), "n")
    return hot_join(out, sums.drop("n"), "label", hot_keys(sums, "label")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _smallest(rows: DataFrame, dim: int, exact: type) -> np.ndarray:
    """The vectors of the ENTRIES smallest ids, as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = rows.filter((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False))).select("vec_id", "embedding")
    own = own.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    return np.array([whole(r["embedding"]) for r in own], exact).reshape(len(own), dim)
