"""The incremental control plane: which sessions are due, run claims, cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.session import LIMITS


def with_checkpoints(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """files (session_id, mtime_ms, content_hash) with `current`: nothing new to mine. Cheap tests come before the hash."""
    marks = checkpoints.select("session_id", F.col("mtime_ms").alias("c_mtime"), F.col("content_hash").alias("c_hash"), "offset", "total", F.lit(True).alias("known"))
    partial = (F.col("total") > 0) & (F.col("offset") < F.col("total"))
    current = F.when(F.col("known").isNull() | (F.col("c_mtime") < F.col("mtime_ms")) | F.coalesce(partial, F.lit(False)), False).when(F.col("c_hash").isNull(), True).otherwise(F.col("c_hash") == F.col("content_hash"))
    return files.join(marks, "session_id", "left").withColumn("current", F.coalesce(current, F.lit(False))).withColumn("start_offset", F.when(F.col("c_hash") == F.col("content_hash"), F.col("offset")).otherwise(0))


def by_time(files: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (session_id, mtime_ms) apart: those that are due whatever they hold (unknown, newer, or mined in part), and those that
    only their hash can tell. Sessions that were checkpointed without a hash, and are no newer, are neither."""
    marks = checkpoints.select("session_id", F.col("mtime_ms").alias("c_mtime"), F.col("content_hash").alias("c_hash"), "offset", "total", F.lit(True).alias("known"))
    both = files.join(marks, "session_id", "left")
    partial = F.coalesce((F.col("total") > 0) & (F.col("offset") < F.col("total")), F.lit(False))
    open_ = F.col("known").isNull() | (F.col("c_mtime") < F.col("mtime_ms")) | partial
    return both.filter(open_).select(*files.columns), both.filter(~open_ & F.col("c_hash").isNotNull()).select(*files.columns)


def due(files: DataFrame, checkpoints: DataFrame, keys: tuple[str, ...] = ("workspace_id",), most: int = LIMITS.manifest_sessions) -> DataFrame:
    """The sessions to mine, newest first, `most` a workspace: current ones do not take a place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("mtime_ms"), "session_id")
    return with_checkpoints(files, checkpoints).filter(~F.col("current")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def uncovered(manifest: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Manifest rows that no checkpoint covers: none, another hash, or an older mtime. The cursor is not looked at."""
    marks = checkpoints.select("session_id", F.col("mtime_ms").alias("c_mtime"), F.col("content_hash").alias("c_hash"), F.lit(True).alias("known"))
    bad = F.col("known").isNull() | ~F.col("c_hash").eqNullSafe(F.col("content_hash")) | (F.col("c_mtime") < F.col("mtime_ms"))
    return manifest.join(marks, "session_id", "left").filter(bad).select(manifest.columns)


def coverage_error(missing: DataFrame) -> DataFrame:
    """One row: what is not covered, null if nothing. The names are those of a manifest, which is bounded."""
    names = F.array_join(F.array_sort(F.collect_list("session_id")), ", ")
    return missing.agg(F.when(F.count("*") > 0, F.concat(F.lit("Sessions without a checkpoint: "), names)).alias("error"))


def claimable(runs: DataFrame, now_ms, stale_ms: int = LIMITS.stale_ms, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """A workspace: whether a run may be claimed, and the stale runs that a claim fails first. A start that cannot be read is stale."""
    open_ = F.col("status").isin("claimed", "running")
    live = open_ & F.coalesce(F.lit(now_ms) - F.col("started_ms") < stale_ms, F.lit(False))
    return runs.groupBy(*keys).agg((F.count(F.when(live, 1)) == 0).alias("may_claim"), F.count(F.when(open_ & ~live, 1)).alias("stale_runs"))


def acquire(runs: DataFrame, claims: DataFrame, now_ms: int, stale_ms: int = LIMITS.stale_ms, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """The run table after claims (keys, run_id): one claim a workspace, the least, is granted where no run is live; it fails the stale ones."""
    open_ = F.col("status").isin("claimed", "running")
    live = runs.filter(open_ & F.coalesce(F.lit(now_ms) - F.col("started_ms") < stale_ms, F.lit(False))).select(*keys).distinct()
    granted = claims.groupBy(*keys).agg(F.min("run_id").alias("run_id")).join(live, [*keys], "left_anti")
    marked = runs.join(granted.select(*keys, F.lit(True).alias("__granted")), [*keys], "left")
    fails = F.coalesce("__granted", F.lit(False)) & open_
    marked = marked.withColumns({"status": F.when(fails, "failed").otherwise(F.col("status")), "finished_ms": F.when(fails, F.lit(now_ms)).otherwise(F.col("finished_ms"))})
    new = granted.withColumns({"status": F.lit("claimed"), "started_ms": F.lit(now_ms).cast("long"), "finished_ms": F.lit(None).cast("long"), "reported": F.lit(False)})
    return marked.select(*runs.columns).unionByName(new, allowMissingColumns=True)


def owns(runs: DataFrame, run_id: str) -> bool:
    """Whether the claim of a run still stands: no other claim has failed it as stale."""
    return not runs.filter((F.col("run_id") == run_id) & F.col("status").isin("claimed", "running")).isEmpty()


def start(runs: DataFrame, run_id: str) -> DataFrame:
    """The run table with a claimed run running; a run in any other state stays as it is."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "claimed")
    return runs.withColumn("status", F.when(mine, "running").otherwise(F.col("status")))


def active_run(runs: DataFrame, now_ms, stale_ms: int = LIMITS.stale_ms, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """A workspace's latest open run that is not beyond the stale limit (at the limit it still counts, unlike in a claim)."""
    open_ = runs.filter(F.col("status").isin("claimed", "running") & ~(F.lit(now_ms) - F.col("started_ms") > stale_ms))
    return open_.groupBy(*keys).agg(F.max_by("run_id", F.struct("started_ms", "run_id")).alias("run_id"))


def unreported(runs: DataFrame, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """Ended runs that were not reported, with their place in the order of reporting (oldest end first)."""
    w = Window.partitionBy(*keys).orderBy("finished_ms", "run_id")
    return runs.filter(F.col("status").isin("completed", "failed") & ~F.col("reported")).withColumn("place", F.row_number().over(w))


def report_next(runs: DataFrame, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """The run table with each workspace's next run to report marked as reported."""
    next_ = unreported(runs, keys).filter("place = 1").select("run_id", F.lit(True).alias("__next"))
    return runs.join(next_, "run_id", "left").withColumn("reported", F.col("reported") | F.coalesce("__next", F.lit(False))).select(*runs.columns)


def finish(runs: DataFrame, run_id: str, status: str, now_ms: int) -> DataFrame:
    """The run table with an open run ended; ended runs stay as they are."""
    mine = (F.col("run_id") == run_id) & F.col("status").isin("claimed", "running")
    return runs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "finished_ms": F.when(mine, F.lit(now_ms)).otherwise(F.col("finished_ms"))})


def cadence(state: DataFrame, now_ms, min_turns: int = LIMITS.min_turns, min_minutes: int = LIMITS.min_minutes) -> DataFrame:
    """state (turns, last_success_ms, last_failure_ms, enabled, has_due) with `due` and the minutes since (null: never)."""
    since = F.when(F.col("last_success_ms") > 0, (F.lit(now_ms) - F.col("last_success_ms")) / 60_000)
    failed = F.when((F.col("last_failure_ms") > 0) & (F.col("last_failure_ms") > F.col("last_success_ms")), (F.lit(now_ms) - F.col("last_failure_ms")) / 60_000)
    enough = lambda c: F.coalesce(c >= min_minutes, F.lit(True))
    turns = F.col("turns") + 1
    return state.withColumns({"turns": turns, "minutes": since, "failure_minutes": failed, "due": F.col("enabled") & (turns >= min_turns) & enough(since) & enough(failed) & F.col("has_due")})


STATE = "workspace_id string, turns long, generation long, last_success_ms long, last_failure_ms long, newest_mtime_ms long, recall_error string, embedding_error string"
RUNS = "workspace_id string, run_id string, status string, started_ms long, finished_ms long, reported boolean, error string"


def new_state(spark: SparkSession, workspace_id: str) -> DataFrame:
    """The state row of a workspace that has seen nothing yet."""
    return spark.createDataFrame([(workspace_id, 0, 0, 0, 0, None, None, None)], STATE).coalesce(1)


def settled(state: DataFrame) -> DataFrame:
    """One more turn settled, and the next generation of activity."""
    return state.withColumns({"turns": F.col("turns") + 1, "generation": F.col("generation") + 1})


def patched(state: DataFrame, **values) -> DataFrame:
    """The state with some of its columns set; a column that a state has not is an error."""
    if unknown := sorted(values.keys() - set(state.columns)):
        raise ValueError(f"no such state: {', '.join(unknown)}")
    kinds = dict(state.dtypes)
    return state.withColumns({name: F.lit(v).cast(kinds[name]) for name, v in values.items()})


def succeeded(state: DataFrame, now_ms: int, newest_mtime_ms=None) -> DataFrame:
    """After a complete run: turns count anew, and the newest time that was seen never goes back."""
    newest = F.greatest(F.col("newest_mtime_ms"), F.lit(newest_mtime_ms).cast("long"))  # skips nulls
    return patched(state, turns=0, last_success_ms=now_ms).withColumn("newest_mtime_ms", newest)


def failed(state: DataFrame, now_ms: int) -> DataFrame:
    """After a failed run: the turns stay, the back-off starts."""
    return patched(state, last_failure_ms=now_ms)


def diagnostics(state: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """What a workspace should be told at its start: what is degraded, and how many runs wait to be reported."""
    waiting = runs.filter(F.col("status").isin("completed", "failed") & ~F.col("reported")).groupBy(*keys).agg(F.count("*").alias("unreported"), F.count(F.when(F.col("status") == "failed", 1)).alias("unreported_failures"))
    out = state.join(waiting, [*keys], "left").fillna(0, ["unreported", "unreported_failures"])
    return out.select(*keys, F.col("recall_error").isNotNull().alias("recall_degraded"), F.col("embedding_error").isNotNull().alias("embedding_degraded"), "recall_error", "embedding_error", "unreported", "unreported_failures")
