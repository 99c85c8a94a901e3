"""Audit queries over the store: listing, search by substring, history, counts, citations, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import public_id
from loam.session import LIMITS


def matching(memories: DataFrame, query: str) -> DataFrame:
    """Memories whose text or public id holds the query, whatever the case, with the section they are listed in."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("text"), q) | F.contains(F.lower(public_id(F.col("memory_id"))), q)
    return memories.filter(hit).withColumn("section", F.when(F.col("state") == "active", "active").otherwise("other"))


def every(memories: DataFrame) -> DataFrame:
    """Memories of all states, in the order of their ids."""
    return memories.orderBy("memory_id")


def one(memories: DataFrame, memory_id: int) -> DataFrame:
    """The memory of an id, whatever its state; no row without one."""
    return memories.filter(F.col("memory_id") == memory_id)


def count_by_state(memories: DataFrame) -> DataFrame:
    """One row for active and retired each, 0 where there is none."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return memories.agg(count("active"), count("retired")).select(F.expr("stack(2, 'active', active, 'retired', retired) AS (state, n)"))


def page(versions: DataFrame, memory_id: int, offset: int = 0, size: int = LIMITS.page, most: int = LIMITS.page_max) -> DataFrame:
    """One memory's versions, newest first; `next_offset` is null on the last page."""
    size = max(1, min(size, most))
    own = versions.filter(F.col("memory_id") == memory_id)
    w = Window.partitionBy("memory_id").orderBy(F.desc("version_id"))
    every = own.withColumn("place", F.row_number().over(w) - 1).withColumn("total", F.count("*").over(Window.partitionBy("memory_id")))
    more = F.when(F.col("total") > offset + size, F.lit(offset + size))
    return every.filter((F.col("place") >= offset) & (F.col("place") < offset + size)).withColumn("next_offset", more).drop("total")


def uncited_or_changed(cited: DataFrame, memories: DataFrame) -> DataFrame:
    """Citations (memory_id, text) whose memory is no longer active, or says something else."""
    live = memories.filter("state = 'active'").select("memory_id", "text")
    return cited.join(live, ["memory_id", "text"], "left_anti")


def status(memories: DataFrame, citations: DataFrame, runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row: counts by state, citations, unreported runs, the running one, the newest mtime that was processed."""
    counts = memories.agg(F.count(F.when(F.col("state") == "active", 1)).alias("active"), F.count(F.when(F.col("state") == "retired", 1)).alias("retired"))
    cited = citations.agg(F.count("*").alias("citations"))
    ran = runs.agg(F.count(F.when(F.col("status").isin("completed", "failed") & ~F.col("reported"), 1)).alias("unreported"), F.max_by(F.when(F.col("status").isin("claimed", "running"), F.col("run_id")), F.when(F.col("status").isin("claimed", "running"), F.col("started_ms"))).alias("running"))
    seen = checkpoints.agg(F.max("mtime_ms").alias("newest_mtime_ms"))
    one = F.lit(1)
    out = counts.withColumn("k", one)
    for other in (cited, ran, seen):  # one row each
        out = out.join(other.withColumn("k", one), "k")
    return out.drop("k")
