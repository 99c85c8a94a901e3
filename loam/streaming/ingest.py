"""Incremental ingestion: a file stream of transcripts, committed batch by batch to a snapshot store.

The store's checkpoint table decides what is new, not the stream's own bookkeeping: a file that grew is due again, and a
batch that is replayed after a failure finds its sessions covered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.control import with_checkpoints
from loam.operators.store import SnapshotStore, upsert
from loam.sources import transcripts

CHECKPOINTS = "session_id string, mtime_ms long, content_hash string, offset long, total long"


def commit_batch(store: SnapshotStore, raw: DataFrame, consume: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> int:
    """Commit the sessions of raw (path, mtime_ms, length, content) that are not covered yet; the number of them."""
    spark = raw.sparkSession
    found = transcripts.hashed(raw).withColumn("session_id", F.col("path"))
    old = store.read("checkpoints") if store.current() else spark.createDataFrame([], CHECKPOINTS)
    new = with_checkpoints(found, old).filter(~F.col("current")).select(*found.columns)
    lines = transcripts.visible(transcripts.messages(transcripts.entries(new))).withColumn("line", transcripts.line_of())
    segments = transcripts.pack(lines.select("session", "index", "line"))
    totals = lines.groupBy("session").agg(F.count("*").alias("total")).withColumnRenamed("session", "session_id")
    marks = new.select("session_id", "mtime_ms", "content_hash").join(totals, "session_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    marks = marks.select("session_id", "mtime_ms", "content_hash", F.col("total").alias("offset"), "total")
    if (n := marks.count()) == 0:
        return 0
    before = store.read("segments").join(new.select(F.col("session_id").alias("session")), "session", "left_anti") if store.current() else None
    tables = {"checkpoints": upsert(old, marks, ["session_id"]), "segments": before.unionByName(segments) if before is not None else segments}
    store.commit(tables | (consume(segments) if consume else {}))
    return n


def follow(spark: SparkSession, root: str, store: SnapshotStore, state_dir: str, files_per_batch: int = 1000):
    """A query that ingests what is below root and stops (availableNow); start it again for what has come since."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(root)
    rows = stream.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), "length", "content")
    return rows.writeStream.foreachBatch(lambda batch, _: commit_batch(store, batch)).option("checkpointLocation", state_dir).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window; rows later than `late` are dropped by a stream, never by a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
