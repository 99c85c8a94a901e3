"""A run's manifest: which session files it mines, with the hash of each one's snapshot and the cursor to start at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3  #: fixed value: the version that manifests are written with
FIELDS = "session_id string, path string, cwd string, mtime_ms long, snapshot_path string, content_hash string, mined_offset long"


def snapshot(due: DataFrame, path: str) -> DataFrame:
    """Copy due sessions (session_id, path, cwd, mtime_ms, content, start_offset) to Parquet; the rows of their manifest."""
    kept = due.select("session_id", "path", "cwd", "mtime_ms", F.sha2("content", 256).alias("content_hash"), F.coalesce("start_offset", F.lit(0)).cast("long").alias("mined_offset"), "content")
    kept.write.parquet(path)
    return due.sparkSession.read.schema(kept.schema).parquet(path).select("session_id", "path", "cwd", "mtime_ms", F.lit(path).alias("snapshot_path"), "content_hash", "mined_offset")


def save(rows: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows.select(F.lit(VERSION).alias("version"), *names).write.json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows; reading fails where one has no snapshot or hash. A missing cursor is 0: all of it is mined anew."""
    rows = spark.read.schema(f"version int, {FIELDS}").option("mode", "FAILFAST").json(path)
    whole = F.col("snapshot_path").isNotNull() & F.col("content_hash").isNotNull()
    checked = F.when(whole, F.col("content_hash")).otherwise(F.raise_error(F.concat(F.lit("manifest without a snapshot: "), F.coalesce("session_id", F.lit("null")))))
    return rows.withColumns({"content_hash": checked, "mined_offset": F.coalesce("mined_offset", F.lit(0))}).drop("version")
