"""Sharding by a minimax contiguous partition.

Documents with equal texts form a group that no cut may split. Groups are dealt by a hash of the text into CELLS
ordered cells, the atoms of the partition: a bounded table of at most CELLS sizes, however large the corpus is. A binary
search finds the smallest capacity for which greedy filling needs no more than the asked number of shards; the cuts are
then set within that capacity, as near to even shares of what is left as the atoms allow.

Slots are numbered from counts: a cell's rows start where the rows of the cells before it in its shard end. A cell with
many rows (a hot text) is dealt into parts by doc_id, rows without one by a number of their own, so that no task numbers an unbounded group.

Law `bytes`: sizes are as near to equal as atoms allow. grown_shard is null under it.

Edge cases: a null text has size 1 and belongs to the group of the empty text; a null doc_id ranks first in its cell;
repeated rows get a slot each; an empty table gives no rows; a group larger than an even share fills a shard beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import written

SHARDS = 16
CELLS = 1 << 16
PART_ROWS = 20_000  #: rows of a cell that are numbered in one group, about


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The least capacity with which greedy filling in order needs at most `shards` shards."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])

    def needed(capacity: int) -> int:
        at, used = 0, 0
        while at < len(sizes):
            at = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
            used += 1
        return used

    low, high = int(max(sizes, default=0)), int(ends[-1])
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    return low


def cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """shards + 1 atom numbers: shard s holds atoms [cuts[s], cuts[s + 1]), none above the smallest capacity."""
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    must = [n]  # how far shards must have come so that the rest fits, from the last backwards
    for _ in range(shards):
        must.append(int(np.searchsorted(ends, ends[must[-1]] - capacity, "left")))
    must.reverse()
    out = [0]
    for s in range(1, shards):
        ideal = ends[out[-1]] + (ends[n] - ends[out[-1]]) / (shards - s + 1)
        at = int(np.searchsorted(ends, ideal, "left"))
        if at > out[-1] and ideal - ends[at - 1] <= ends[min(at, n)] - ideal:
            at -= 1
        most = int(np.searchsorted(ends, ends[out[-1]] + capacity, "right")) - 1
        out.append(max(min(at, most, n), must[s], out[-1]))
    return [*out, n]


def order_of(cells: list[tuple[int, int]], shards: int) -> list[int]:
    """The order of the atoms (cell, size): those of half a share and more first, by size, so that each ends a shard; then by cell."""
    share = sum(size for _, size in cells) / (2 * shards)
    return [c for c, _ in sorted(cells, key=lambda x: (x[1] < share, -x[1] if x[1] >= share else 0, x[0]))]


def shard(docs: DataFrame, shards: int = SHARDS, n_cells: int = CELLS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(n_cells)).cast("int").alias("cell"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "shard-rows")
    found = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # n_cells rows at most
    order = order_of([(r["cell"], r["size"]) for r in found], shards)
    size, count = ({r["cell"]: r[k] for r in found} for k in ("size", "n"))
    at = cuts([size[c] for c in order], shards)
    plan = []
    for s in range(shards):
        for c in order[at[s] : at[s + 1]]:
            plan.append((c, s, len(plan), max(1, -(-count[c] // part_rows))))
    cells = F.broadcast(spark.createDataFrame(plan, "cell int, shard int, place int, parts int").coalesce(1))  # n_cells rows at most
    placed = rows.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.col("parts")).cast("int")).drop("parts")
    starts = placed.groupBy("shard", "place", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("place", "part").orderBy("doc_id", "size", "text_crc32"))
    out = placed.withColumn("number", number).join(starts, ["place", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
