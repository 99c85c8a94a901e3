"""Exact top-k search by integer inner product.

Vectors are packed into blocks of rows; every pair of a query tile and a candidate shard is one cell of a grid, and a
cell is a few matrix products with a partial selection after each. The cells' short lists meet in a merge tree.
Queries and candidates both grow with the table, so nothing is broadcast: a cell gets its tile and its shard by a
shuffle of packed blocks.

Vectors with a component beyond LIMIT (of floor(SCALE * x), that is, x beyond about 4096) are packed apart, as doubles; their
products are taken in doubles or 64-bit integers where these are exact, and else in Python's integers, for the candidates
that rounding leaves in question. A score beyond 64 bits is null; its rank is exact.

Edge cases: a null vector, or one with a null or non-finite component, takes no part; a null vec_id takes no part; only vectors of equal length are compared; the rows of one query id that repeat count as one query
(the least vector) while repeated candidates are candidates each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import written

SCALE = 256
BLOCK = 1024  #: vectors of a packed block
TILE = 4096  #: queries of a tile
SHARD = 8192  #: candidates of a shard, about
STRIP = 2048  #: candidates of one matrix product
FAN_IN = 32  #: lists that one merge takes
LIMIT = 2.0**20  #: scaled components up to this are packed in 32 bits

PACKED = "dim int, n int, wide boolean, ids binary, cells binary"
PARTIAL = "query_id long, shard int, vec_id long, score long, beyond binary"


def quantised(vectors: list[list | None] | pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers that take part, their vectors: floor(SCALE * x) as int32, or x as double where one goes beyond LIMIT)."""
    column = vectors if isinstance(vectors, pa.ListArray) else pa.array(vectors, pa.list_(pa.float64()))
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)  # a null component is nan here
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        wide = np.concatenate([[0], np.cumsum(~(np.abs(scaled) <= LIMIT))])
    fine = (lengths >= 0) & (bad[ends] == bad[starts])
    beyond = wide[ends] > wide[starts]
    whole = np.where(np.isfinite(scaled), scaled, 0).clip(-LIMIT, LIMIT).astype(np.int32)
    rows = np.flatnonzero(fine)
    return rows, [(values if beyond[r] else whole)[starts[r] : ends[r]] for r in rows]


def _packed(batches):
    """Blocks of BLOCK vectors of one length and kind; what a partition leaves over is flushed at its end."""
    held: dict[tuple[int, bool], tuple[list, list]] = {}

    def block(dim: int, wide: bool, ids: list, rows: list) -> pa.RecordBatch:
        data = np.array(rows, "<f8" if wide else "<i4").reshape(len(rows), dim)
        arrays = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([wide]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["dim", "n", "wide", "ids", "cells"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows, vectors = quantised(batch.column(1))
        for r, v in zip(rows, vectors, strict=True):
            kind = len(v), v.dtype == np.float64
            own = held.setdefault(kind, ([], []))
            own[0].append(ids[r])
            own[1].append(v)
            if len(own[0]) == BLOCK:
                yield block(*kind, *held.pop(kind))
    for kind, own in held.items():
        yield block(*kind, *own)


def _unpacked(blocks: pa.Table, dim: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the blocks of a kind; wide vectors as floor(SCALE * x) in doubles, or Python integers where a double cannot hold it."""
    blocks = blocks.filter(pa.compute.equal(blocks.column("wide"), wide))
    kind = "<f8" if wide else "<i4"
    ids = [np.frombuffer(x, "<i8") for x in blocks.column("ids").to_pylist()]
    cells = [np.frombuffer(x, kind).reshape(-1, dim) if dim else np.zeros((len(i), 0), kind) for x, i in zip(blocks.column("cells").to_pylist(), ids, strict=True)]
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, dim), kind)
    rows = np.concatenate(cells)
    if wide:
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * rows)
        rows = scaled if np.isfinite(scaled).all() else np.array([[SCALE * int(x) if abs(x) > 2**60 else int(np.floor(SCALE * x)) for x in v] for v in rows], object)
    return np.concatenate(ids), rows


def _most(rows: np.ndarray) -> int:
    return int(np.abs(rows).max(initial=0))


def best_of_any_size(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As `best`, with scores of any size: (query number, candidate id, score).

    Products of vectors scaled to 1 tell, within their rounding, which candidates can be among the k best; those are scored exactly.
    """
    unit = lambda x: (x / max(1, _most(x))).astype(np.float64)
    dim = rows.shape[1]
    slack = 4 * (dim + 8) ** 2 * 2.0**-53
    small, out = unit(rows), []
    for n, (own, q) in enumerate(zip(query_ids, queries, strict=True)):
        at = np.flatnonzero(ids != own)
        if not len(at):
            continue
        near = small[at] @ unit(q)
        if len(at) > k:
            at = at[near >= np.partition(near, len(near) - k)[len(near) - k] - slack]
        asked = [int(x) for x in q]
        found = sorted((-sum(x * int(y) for x, y in zip(asked, rows[c], strict=True)), int(ids[c])) for c in at)
        out += [(n, i, -s) for s, i in found[:k]]
    return out


def _beyond(score: int) -> bytes:
    """Orders scores that 64 bits do not hold: above, between or below those that they do."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x80"
    size = (score.bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\xff" + raw if score > 0 else b"\x00" + bytes(255 - x for x in raw)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate id, score) of each query's k best, its own id left out; ties to the smaller id.

    Candidates come in the order of their ids, so of equal scores the first in a strip is the one to keep, and a later
    strip only matters where it beats a query's k-th score.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64  # exact in each
    queries, rows = queries.astype(kind), rows.astype(kind)
    top = np.full((len(queries), k), np.iinfo(np.int64).min)
    who = np.zeros((len(queries), k), np.int64)
    none = np.iinfo(np.int64).min
    for a in range(0, len(ids), STRIP):
        part = ids[a : a + STRIP]
        score = queries @ rows[a : a + STRIP].T
        over = score > top[:, -1:].astype(kind if kind is np.int64 else np.float64)
        over &= part[None, :] != query_ids[:, None]
        for q in np.flatnonzero(over.any(axis=1)):
            c = np.flatnonzero(over[q])
            s = score[q, c].astype(np.int64)
            if len(c) > 4 * k:  # partial selection: all that reach the k-th score, of which the stable sort keeps the first
                c, s = c[keep := s >= np.partition(s, len(s) - k)[len(s) - k]], s[keep]
            s, i = np.concatenate([top[q], s]), np.concatenate([who[q], part[c]])
            keep = np.argsort(-s.astype(np.float64) if bound < 2**53 else [-int(x) for x in s], kind="stable")[:k]
            top[q], who[q] = s[keep], i[keep]
    q, at = np.nonzero(top != none)
    return q, who[q, at], top[q, at]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """Columns (vec_id, embedding): the k highest candidates of every query row as query_id, rank, vec_id, score."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    candidates = written(rows.mapInArrow(_packed, PACKED), "topk-candidates")
    queries = written(asked.mapInArrow(_packed, PACKED), "topk-queries")
    # One row of sizes each, however large the table is.
    n_shards = max(1, -(-(candidates.agg(F.sum("n")).first()[0] or 0) // SHARD))
    n_tiles = max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // TILE))
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")  # noqa: E731  of a block's partition and place
    left = queries.withColumn("tile", dealt(n_tiles)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    right = candidates.withColumn("shard", dealt(n_shards)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))

    def cell(key, asked: pa.Table, among: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[2].as_py()
        parts = []
        for wide_q, wide_c in itertools.product((False, True), repeat=2):
            query_ids, q = _unpacked(asked, dim, wide_q)
            ids, c = _unpacked(among, dim, wide_c)
            if _most(q) * _most(c) * max(1, dim) < 2**62:
                who, vec, score = best(query_ids, q, ids, c, k)
                beyond = pa.array([_beyond(0)] * len(who), pa.binary())
            else:
                found = best_of_any_size(query_ids, q, ids, c, k)
                who, vec = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
                beyond = [_beyond(x[2]) for x in found]
                score = pa.array([x[2] if y == _beyond(0) else None for x, y in zip(found, beyond, strict=True)], pa.int64())
                beyond = pa.array(beyond, pa.binary())
            parts.append(pa.table({"query_id": query_ids[who], "shard": pa.array(np.full(len(who), shard, np.int32)), "vec_id": vec, "score": score, "beyond": beyond}))
        return pa.concat_tables(parts)

    keys = ("dim", "tile", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, PARTIAL)
    rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    while n_shards > 1:  # one level of the merge tree
        n_shards = -(-n_shards // FAN_IN)
        lists = lists.withColumn("shard", (F.col("shard") % n_shards).cast("int")).withColumn("rank", rank).filter(F.col("rank") <= k)
        lists = lists if n_shards == 1 else lists.drop("rank")
    lists = lists.withColumn("rank", rank) if "rank" not in lists.columns else lists
    return lists.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
