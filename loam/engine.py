"""One workspace's memory as an object: search, briefing, mining runs, audit and the commands on them.

Every step is one of the operators over the workspace's tables; the tables are written together as a snapshot, so a step
that fails leaves all of them as they were. Models are plain callables, and what they answered is written before it is used:
a lost executor repeats no call whose answer was kept.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.abort import Abort
from loam.functions import text as T
from loam.operators import audit, budgets, control, embedder, index, mining, retrieval, store, synthesis, vectors
from loam.session import LIMITS, Limits
from loam.sources import config, manifest, sessions as session_files, transcripts

CHECKPOINTS = "session_id string, path string, cwd string, mtime_ms long, content_hash string, offset long, total long"
DIAGNOSTICS = "run_id string, step string, at_ms long, name string, value long"
CITATIONS = "request_id string, memory_id long, source string, at_ms long"
EMBEDDINGS = "node_id long, model_id string, content_hash string, vector array<float>"
SEQ = ", seq long"
#: Tables of the workspace; those of KEYS are appended to, and the last row of a key (by seq) counts.
TABLES = {"log": store.LOG, **store.STATE, "postings": index.POSTINGS, "index_stats": index.STATS, "checkpoints": CHECKPOINTS + SEQ, "citations": CITATIONS, "embeddings": EMBEDDINGS, "runs": control.RUNS + SEQ, "state": control.STATE, "diagnostics": DIAGNOSTICS}
KEYS = {"memories": ("workspace_id", "memory_id"), "checkpoints": ("session_id",), "runs": ("run_id",)}
HOUR_MS = 3_600_000
COMMANDS = ("status", "list", "open", "dream", "pause", "resume", "forget")  # fixed values

log = logging.getLogger("loam")


def trace(step: str, **facts) -> None:
    """One JSON line a step; it never fails."""
    try:
        log.info(json.dumps({"step": step, **facts}, default=str))
    except (TypeError, ValueError):
        log.info('{"step": "unprintable"}')


def command(line: str) -> tuple[str, str]:
    """A command and its argument; nothing is `status`, an unknown command is an error."""
    name, _, rest = line.strip().partition(" ")
    name = name.lower() or "status"
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name}; one of {', '.join(COMMANDS)}")
    return name, rest.strip()


class Engine:
    """embed(texts) -> vectors (None for a text without one) and model_id name the embedder: by default hashed n-grams. With embed=None search is lexical alone."""

    def __init__(self, spark: SparkSession, root: str, workspace_id: str, config_path: str | None = None, embed: Callable | None = embedder.default, model_id: str = embedder.MODEL_ID, limits: Limits = LIMITS) -> None:
        self.spark, self.workspace, self.config_path, self.embed, self.model_id, self.limits = spark, workspace_id, config_path, embed, model_id, limits
        self.root = f"{root.rstrip('/')}/{workspace_id}"
        self.store = store.SnapshotStore(spark, f"{self.root}/store")
        self.embedder = "not_loaded" if embed else "absent"
        self._abort: Abort | None = None
        if self.store.current() is None:
            empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
            self.store.commit({**empty, "state": control.new_state(spark, workspace_id)})
        else:
            self.store.open(TABLES)

    def table(self, name: str) -> DataFrame:
        """A table as it is now."""
        rows = self.store.read(name)
        return store.latest(rows, *KEYS[name]).drop("seq") if name in KEYS else rows

    def _changed(self, name: str, after: DataFrame) -> DataFrame:
        """What to append to a table of KEYS so that it is `after`: the rows that are new or differ."""
        return after.exceptAll(self.table(name).select(after.columns)).withColumn("seq", F.lit(self.store.current()).cast("long"))

    def maintain(self, grace_ms: int = HOUR_MS) -> int:
        """Compact tables of many parts and delete what no reader can hold any more; the number of deletions. Commits call it now and then."""
        for name, keys in KEYS.items():
            self.store.compact(name, lambda df, keys=keys: store.latest(df, *keys).select(df.columns))
        for name in ("log", "versions", "citations", "index_stats", "diagnostics"):
            self.store.compact(name)
        for name, keys in (("marks", ("workspace_id", "session_id")), ("heads", ("workspace_id",))):
            self.store.compact(name, lambda df, keys=keys: store.latest(df, *keys).select(df.columns))
        self.store.compact("postings", lambda df: index.compacted(df, self.table("index_stats")))
        store.delete_older(self.spark, f"{self.root}/steps", grace_ms)
        return self.store.sweep(grace_ms)

    def config(self) -> config.Config:
        return config.load(self.config_path) if self.config_path else config.Config()

    # Audit and commands

    def status(self) -> DataFrame:
        """One row: counts, runs, what is degraded, and whether the workspace is enabled."""
        facts = audit.status(self.table("memories"), self.table("citations"), self.table("runs"), self.table("checkpoints"))
        state = self.table("state").select(F.lit(self.config().enabled).alias("enabled"), "turns", "last_success_ms", "last_failure_ms", "recall_error", "embedding_error", F.lit(self.embedder).alias("embedder"))
        one = F.lit(1)
        return facts.withColumn("k", one).join(state.withColumn("k", one), "k").drop("k")  # one row each

    def list(self, query: str = "") -> DataFrame:
        return audit.matching(self.table("memories"), query)

    def open(self, memory_id: int, offset: int = 0, size: int = LIMITS.page) -> DataFrame:
        return audit.page(self.table("versions"), memory_id, offset, size)

    def forget(self, memory_id: int) -> bool:
        """Retire a memory by hand; False where there is none."""
        if audit.one(self.table("memories"), memory_id).isEmpty():
            return False
        read = self.store.paths()
        row = (self.workspace, self._next_commit(), 0, None, None, 0, None, None, 0, store.BY_HAND, None, memory_id, None, None)
        rows = self.spark.createDataFrame([row], store.LOG)
        self._commit_log(rows, self._folded(rows), {}, {}, read)
        return True

    def every(self) -> DataFrame:
        """Memories of all states, in the order of their ids."""
        return audit.every(self.table("memories"))

    def one(self, memory_id: int) -> DataFrame:
        """The memory of an id, whatever its state."""
        return audit.one(self.table("memories"), memory_id)

    def pause(self) -> config.Config:
        return self._paused(True)

    def resume(self) -> config.Config:
        return self._paused(False)

    def _paused(self, paused: bool) -> config.Config:
        if self.config_path is None:
            raise ValueError("an engine without a configuration file cannot be paused")
        return config.pause(self.config_path, paused)

    def run_command(self, line: str):
        """status, list [text], open M:n, forget M:n, pause, resume; `dream` needs its models and is a method."""
        name, rest = command(line)
        if name in ("open", "forget"):
            if not rest.startswith("M:") or not rest[2:].isdigit() or int(rest[2:]) == 0:
                raise ValueError(f"no memory id: {rest}")
            return getattr(self, name)(int(rest[2:]))
        if name == "dream":
            raise ValueError("call dream with its models")
        return self.list(rest) if name == "list" else getattr(self, name)()

    # Control

    def settled(self, now_ms: int, has_due: bool = True, sessions: str | None = None, cwd: str | list[str] | None = None) -> bool:
        """Note a settled turn; whether a run is due with it. With a folder of sessions, one that is to be mined is looked for
        (last, as it reads their files)."""
        c = self.config()
        while True:
            read, state = self.store.paths(), self.table("state")
            facts = state.withColumns({"enabled": F.lit(c.enabled), "has_due": F.lit(has_due)})
            due = bool(control.cadence(facts, now_ms, c.minTurns, c.minMinutes).first()["due"])
            try:
                self.store.commit({"state": control.settled(state)}, {"state": read["state"]})
                break
            except store.Conflict:  # another turn settled meanwhile: this one counts on top of it
                continue
        return due and (sessions is None or not self._due(sessions, cwd, 1).isEmpty())

    def report(self) -> str | None:
        """The next ended run to tell of, marked as told together with the commit; None without one."""
        while True:
            read, runs = self.store.paths(), self.table("runs")
            row = control.unreported(runs).filter("place = 1").select("run_id").first()
            try:
                if row:
                    told = runs.filter(F.col("run_id") == row["run_id"]).first()
                    state, changed = self.table("state"), self._changed("runs", control.report_next(runs))
                    if told["status"] == "completed":  # the cadence starts anew in the same commit
                        newest = self.table("checkpoints").agg(F.max("mtime_ms")).first()[0]
                        self.store.commit({"state": control.succeeded(state, told["finished_ms"], newest)}, {k: read[k] for k in ("runs", "state")}, {"runs": changed})
                    else:
                        self.store.commit({}, {"runs": read["runs"]}, {"runs": changed})
                return row["run_id"] if row else None
            except store.Conflict:  # another caller may have told of this run
                continue

    def diagnostics(self) -> DataFrame:
        return control.diagnostics(self.table("state"), self.table("runs"))

    # Reading

    def candidates(self, queries: DataFrame, limits: Limits | None = None) -> DataFrame:
        """queries (query_id long, text): what retrieval finds among the active memories, in order."""
        limits = limits or self.limits
        memories = self.table("memories").withColumnRenamed("memory_id", "node_id")
        indexed = self.table("postings"), self.table("index_stats")
        if not self.embed or self.table("embeddings").filter(F.col("model_id") == self.model_id).isEmpty():
            return retrieval.retrieve(memories, queries, limits=limits, indexed=indexed)
        asked = retrieval.segmented(queries, limits.query_segment_chars)
        return retrieval.retrieve(memories, queries, self.table("embeddings").filter(F.col("model_id") == self.model_id), self._vectors(asked), limits, indexed)

    def _vectors(self, segments: DataFrame) -> DataFrame:
        embed = self.embed

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [None if v is None else [float(x) for x in v] for v in embed(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.float32()))], names=["query_id", "segment_no", "vector"])

        return self._kept(segments.select("query_id", "segment_no", "text").mapInArrow(work, "query_id long, segment_no int, vector array<float>"), "query-vectors")

    def payload(self, queries: DataFrame) -> DataFrame:
        """The memories that go with each query: query_id, place, node_id, text, line, within the payload's budget."""
        line = T.payload_line(F.col("node_id"), F.col("kind"), F.col("state"), F.col("recurrence"), F.col("text"))
        rows = self.candidates(queries).withColumn("line", line).withColumn("chars", F.length("line").cast("long"))
        return budgets.prefix_budget(rows, ["query_id"], ["place"], "chars", self.limits.payload_chars, self.limits.payload_units)

    def preferences(self) -> str:
        """The preferences section of a briefing: those said most often first, as many as fit, and how many more there are."""
        rows = self.table("memories").filter("state = 'active' AND kind = 'preference'").orderBy(F.desc("recurrence"), "memory_id").select(T.preference_line(F.col("memory_id"), F.col("text")).alias("line"))
        kept, used, more = [], 0, 0
        for r in rows.toLocalIterator():  # a store of one workspace's preferences, a line each; what does not fit is only counted
            if used + len(r.line) <= self.limits.section_chars:
                kept.append(r.line)
                used += len(r.line)
            else:
                more += 1
        return "\n".join([*kept, *([f"… and {more} more (see /memory list for all)"] if more else [])])

    def _answered(self, request: str, purpose: str, complete: Callable[[str, str], str], now_ms: int, window: int | None, most_output: int | None) -> dict:
        request_id = uuid.uuid4().hex
        shown = self._kept(self.payload(self.spark.createDataFrame([(1, request)], "query_id long, text string")).select("node_id", "text", "line", "place"), "payload")
        parts = shown.agg(F.array_sort(F.collect_list(F.struct("place", "line", "node_id"))).alias("x"))  # bounded by the payload's budget
        whole = parts.select(F.lit(request_id).alias("request_id"), F.lit(purpose).alias("purpose"), F.lit(request).alias("request"), F.array_join(F.transform("x", lambda p: p["line"]), "\n").alias("payload"), F.transform("x", lambda p: T.public_id(p["node_id"])).alias("payload_ids"), F.lit(window).cast("long").alias("context_window"), F.lit(most_output).cast("long").alias("most_output"))
        found = self._kept(synthesis.synthesize(whole, complete, self.limits), "answers")
        checked = synthesis.revalidated(found, shown.select(F.lit(request_id).alias("request_id"), F.col("node_id").alias("memory_id"), "text"), self.table("memories"))
        result = checked.first().asDict()
        trace(purpose, request_id=request_id, error=result["error"], calls=result["calls"])
        more = {}
        if result["error"] is None and result["sources"]:
            more["citations"] = synthesis.citations(self.spark.createDataFrame([result], checked.schema)).withColumn("at_ms", F.lit(now_ms).cast("long"))
        detail = result["detail"] if result["error"] == "provider_context_insufficient" else None
        while True:  # the answer is paid for: what others committed meanwhile is kept, and this goes on top
            read, state = self.store.paths(), self.table("state")
            try:
                self.store.commit({"state": control.patched(state, recall_error=detail)}, {"state": read["state"]}, more)
                return result
            except store.Conflict:
                continue

    def search(self, query: str, complete: Callable[[str, str], str], now_ms: int, window: int | None = None, most_output: int | None = None) -> dict:
        """Answer a question from memory: content, sources and error. A greeting finds nothing and asks no model."""
        return self._answered(query, "search", complete, now_ms, window, most_output)

    def briefing(self, request: str, complete: Callable[[str, str], str], now_ms: int, window: int | None = None, most_output: int | None = None) -> str | None:
        """The message that opens a session, None while paused; without an answer it holds the preferences alone."""
        if not self.config().enabled:
            return None
        answer = self._answered(request, "briefing", complete, now_ms, window, most_output)["content"] or ""
        one = self.spark.range(1).select(synthesis.briefing_message(F.lit(self.preferences()), F.lit(answer)).alias("message"))
        return one.first()["message"]

    # Mining

    def dream(self, sessions: str, cwd: str | list[str], extract: Callable, decide: Callable, now_ms: int, abort: Abort | None = None) -> dict | None:
        """Mine what is new below the folder `sessions`: counts of the run, None where another run is live or the workspace is paused.

        Claims are single: of two at once, one finds the runs changed and gives None. The run's results are committed only while
        its claim stands, and only onto the tables that they were made from.

        cwd: the workspace's folder, or its worktrees; sessions that began in one of them or below are mined. abort: cancels the run,
        model calls included: its claim ends failed, and nothing of it is committed.

        extract(segment text, problem) and decide(prompt, problem) are the two models. Sessions are mined newest first; the
        first that fails or is cut off by the run's budget ends the run.
        """
        if not self.config().enabled:
            return None
        run_id = f"{now_ms}-{uuid.uuid4().hex[:8]}"
        claims = self.spark.createDataFrame([(self.workspace, run_id)], "workspace_id string, run_id string")
        began, read = time.time(), self.store.paths()
        runs = self._kept(control.acquire(self.table("runs"), claims, now_ms, self.limits.stale_ms), "runs")
        if runs.filter(F.col("run_id") == run_id).isEmpty():
            return None
        try:
            self.store.commit({}, {"runs": read["runs"]}, {"runs": self._changed("runs", control.start(runs, run_id))})
        except store.Conflict:
            return None
        try:
            read = self.store.paths()
            with abort or nullcontext():
                self._abort = abort
                changes, more, folded, result = self._mined(run_id, sessions, cwd, extract, decide, began + 60 * self.limits.run_minutes)
            read |= {k: v for k, v in self.store.paths().items() if k in ("runs", "state")}  # these are read again below
            if not control.owns(self.table("runs"), run_id):
                raise store.Conflict(f"run {run_id} lost its claim")
            ended = "failed" if result["error"] else "completed"
            runs = control.finish(self.table("runs"), run_id, ended, now_ms)
            more["runs"] = self._changed("runs", runs.withColumn("error", F.when(F.col("run_id") == run_id, F.lit(result["error"])).otherwise(F.col("error"))))
            state = control.failed(self.table("state"), now_ms) if result["error"] else control.succeeded(self.table("state"), now_ms, result["newest_mtime_ms"])
            changes["state"] = control.patched(state, embedding_error=result.pop("embedding_error"))
            facts = [(run_id, "dream", now_ms, k, v) for k, v in result.items() if isinstance(v, int)]
            more["diagnostics"] = self.spark.createDataFrame(facts, DIAGNOSTICS)
            self._commit_log(more.pop("log"), folded, changes, more, read)
        except BaseException as e:
            self._abort = None
            self._failed(run_id, now_ms, str(e) or type(e).__name__)
            raise
        finally:
            self._abort = None
        if self.store.current() % store.PARTS == 0:
            self.maintain()
        trace("dream", **result)
        return result

    def _failed(self, run_id: str, now_ms: int, error: str) -> None:
        """End a run that raised: whatever else was committed meanwhile stays."""
        while True:
            read, runs = self.store.paths(), control.finish(self.table("runs"), run_id, "failed", now_ms)
            ended = runs.withColumn("error", F.when((F.col("run_id") == run_id) & F.col("error").isNull(), F.lit(error[:400])).otherwise(F.col("error")))
            try:
                self.store.commit({"state": control.failed(self.table("state"), now_ms)}, {k: read[k] for k in ("runs", "state")}, {"runs": self._changed("runs", ended)})
                break
            except store.Conflict:
                continue
        trace("dream", run_id=run_id, error=error)

    def _mined(self, run_id: str, sessions: str, cwd: str, extract: Callable, decide: Callable, until: float) -> tuple[dict[str, DataFrame], dict[str, DataFrame], store.Folded, dict]:
        """What the run puts in place of tables, what it appends, the fold of its commits, and its counts."""
        limits, home = self.limits, f"{self.root}/runs/{run_id}"
        entries = manifest.snapshot(self._bodies(self._due(sessions, cwd, limits.manifest_sessions)), f"{home}/snapshot")
        manifest.save(entries, f"{home}/manifest")
        entries = manifest.load(self.spark, f"{home}/manifest").withColumn("session_order", F.row_number().over(Window.orderBy(F.desc("mtime_ms"), "session_id")))  # `manifest_sessions` rows
        raw = transcripts.verified(self.spark.read.parquet(f"{home}/snapshot").withColumn("length", F.length("content")), entries)
        lines = transcripts.visible(transcripts.messages(transcripts.entries(raw))).withColumn("line", transcripts.line_of(limits)).select("session", "index", "line")
        lines = self._kept(lines, "lines")
        marks = entries.select(F.col("path").alias("session"), "session_id", "session_order", "mined_offset")
        fresh = lines.join(marks, "session").filter(F.col("index") >= F.col("mined_offset"))
        segments = transcripts.pack(fresh.select("session", "index", "line"), limits.segment_chars, limits.segment_messages)
        within = mining.within_budget(segments.join(marks, "session").withColumn("run_id", F.lit(run_id)), limits.run_chars)
        within = self._kept(within, "segments")
        candidates = self._kept(mining.extract(within, extract, limits, until), "candidates")
        late = candidates.filter(F.col("error") == mining.OUT_OF_TIME).join(marks, "session").agg(F.min(F.struct("session_order", "segment_no")).alias("at")).first()["at"]
        if late is not None:  # as with the budget of characters: what lies before is mined, the rest is due in the next run
            before = F.struct("session_order", "segment_no") < F.struct(F.lit(late["session_order"]).alias("session_order"), F.lit(late["segment_no"]).alias("segment_no"))
            within = within.filter(before).withColumn("partial", F.col("partial") | (F.col("session_order") == late["session_order"]))
            candidates = candidates.join(within.select("session", "segment_no"), ["session", "segment_no"], "left_semi")
        bad = candidates.filter("error is not null").join(marks, "session").agg(F.min("session_order").alias("at"), F.min_by("error", "session_order").alias("error")).first()
        stop = F.lit(True) if bad["at"] is None else F.col("session_order") < bad["at"]
        mined = within.filter(stop)
        sound = candidates.filter("error is null").join(marks.filter(stop), "session").select(candidates.columns)
        numbered = self._kept(sound.withColumn("query_id", F.row_number().over(Window.orderBy("session", "segment_no", "candidate_id")).cast("long")), "numbered")  # bounded by sessions and candidates of a run
        recalled = self.candidates(numbered.select("query_id", F.col("memory_text").alias("text")), replace(limits, retrieval_units=limits.recall_units))
        recalled = recalled.join(numbered.select("query_id", "session", "candidate_id"), "query_id").select("session", "candidate_id", (F.col("place") + 1).alias("rank"), "node_id", "text")
        operations = self._kept(mining.consolidate(sound, recalled, decide, limits, until), "operations")
        wrong = operations.filter("error is not null").join(marks, "session").agg(F.min("session_order").alias("at"), F.min_by("error", "session_order").alias("error")).first()
        go = F.lit(True) if wrong["at"] is None else F.col("session_order") < wrong["at"]
        ends = mined.filter(go).groupBy("session").agg(F.max("end_index").cast("long").alias("offset"), F.sum("chars").alias("chars"), F.count("*").alias("segments"))
        totals = lines.groupBy("session").agg(F.count("*").alias("total"))
        cut = [x for x in (bad["at"], wrong["at"]) if x is not None]
        partial = within.agg(F.max(F.when(F.col("partial"), F.col("session_order")))).first()[0]
        # A session without visible messages is covered as it is; one that the budget kept out is not.
        named = entries.withColumnRenamed("path", "session").join(ends, "session", "left").join(totals, "session", "left")
        empty = F.coalesce("total", F.lit(0)) <= F.col("mined_offset")
        named = named.filter((F.col("offset").isNotNull() | empty) & (F.col("session_order") < min(cut) if cut else F.lit(True)) & (F.col("session_order") <= partial if partial is not None else F.lit(True)))
        named = self._kept(named.withColumns({"offset": F.coalesce("offset", "total", F.lit(0)).cast("long"), "total": F.coalesce("total", F.lit(0)), "commit_seq": F.lit(self._next_commit()) + F.col("session_order")}), "sessions")
        of = named.select("session", "session_id", "commit_seq", "content_hash", "mtime_ms", "offset", "total")
        generation = self.table("state").first()["generation"]
        rows = operations.filter("error is null").join(of, "session").withColumns({"workspace_id": F.lit(self.workspace), "generation": F.lit(generation).cast("long")})
        columns = [c.split()[0] for c in store.LOG.split(", ")]
        added = self._kept(rows.select(columns), "log")
        folded = self._folded(added)
        refused = folded.rejected
        fine = named.join(refused.select("commit_seq"), "commit_seq", "left_anti")
        kept_log = added.join(refused.select("commit_seq"), "commit_seq", "left_anti").select(columns)
        marked = fine.select(F.col("session_id"), F.col("session").alias("path"), "cwd", "mtime_ms", "content_hash", "offset", "total")
        first_refused = refused.orderBy("commit_seq").first()
        counts = fine.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.max("mtime_ms").alias("newest_mtime_ms")).first()
        done = kept_log.count()
        error = wrong["error"] or bad["error"] or (first_refused["error"] if first_refused else None)
        result = {"run_id": run_id, **counts.asDict(), "operations": done, "error": error, "embedding_error": None}
        changes: dict[str, DataFrame] = {}
        more = {"log": kept_log, "checkpoints": marked.withColumn("seq", F.lit(self.store.current()).cast("long"))}
        if self.embed:
            try:
                now = store.current(self.store.read("memories").unionByName(folded.changes()["memories"]))
                changes["embeddings"], problem = self._embedded(now)
                self.embedder, result["embedding_error"] = "failed" if problem else "ready", problem
            except Exception as e:  # an embedder that fails degrades search, it does not undo what was mined
                self.embedder, result["embedding_error"] = "failed", str(e)[:400]
        return changes, more, folded, result

    def _found(self, sessions: str, cwd: str | list[str] | None) -> DataFrame:
        """The workspace's session files by their headers: path, mtime_ms, cwd, session_id. No body is read."""
        session_files.register(self.spark)
        trees = [cwd] if isinstance(cwd, str) else list(cwd or [])
        found = self.spark.read.format("loam_sessions").option("path", sessions).option("worktrees", json.dumps(trees)).load()
        return found.select("path", "mtime_ms", "length", "cwd", F.coalesce("session_id", T.fallback_session_id(F.col("path"), F.col("cwd"))).alias("session_id"), F.lit(self.workspace).alias("workspace_id"))

    def _due(self, sessions: str, cwd: str | list[str] | None, most: int) -> DataFrame:
        """The sessions to mine, newest first. Only files whose time says nothing are read for their hash."""
        found, marks = self._found(sessions, cwd), self.table("checkpoints")
        clear, doubtful = control.by_time(found, marks)
        hashed = session_files.with_bodies(doubtful, self.limits.session_bytes, content=False)
        files = clear.withColumn("content_hash", F.lit(None).cast("string")).unionByName(hashed)
        return control.due(files, marks, most=most).select(*found.columns)

    def _bodies(self, due: DataFrame) -> DataFrame:
        """Due sessions (bounded) with their contents, and where to start in them."""
        return control.with_checkpoints(session_files.with_bodies(due, self.limits.session_bytes), self.table("checkpoints"))

    def _embedded(self, memories: DataFrame) -> tuple[DataFrame, str | None]:
        """The embeddings after a pass, and what ended it early."""
        active = self._kept(memories.filter("state = 'active'").select(F.col("memory_id").alias("node_id"), "text"), "active")
        have = self.table("embeddings")
        made = self._kept(vectors.tried(vectors.stale(active, have, self.model_id), self.embed), "embedded")
        problem = made.agg(F.min("error")).first()[0]
        return self._kept(vectors.merged(active, have, made, self.model_id), "embeddings"), problem

    # Tables

    def _next_commit(self) -> int:
        return (self.table("log").agg(F.max("commit_seq")).first()[0] or 0) + 1

    def _folded(self, commits: DataFrame) -> store.Folded:
        """New commits folded onto the store's state, written once: it costs what the commits touch."""
        state = {name: self.store.read(name) for name in store.STATE}
        return store.Folded(self._kept(store.fold_commits(commits, state).rows, "folded"))

    def _commit_log(self, rows: DataFrame, folded: store.Folded, changes: dict[str, DataFrame], more: dict[str, DataFrame], read: dict[str, list[str]]) -> None:
        """Append commits, what their fold changed, and the postings of the texts that came and went; `changes` are tables put in place of others."""
        made, old = folded.changes(), self.store.read("memories")
        touched = made["memories"].select("workspace_id", "memory_id")
        active = lambda df: df.filter("state = 'active'").select(F.col("memory_id").alias("node_id"), "text")
        before = store.current(old.join(touched, ["workspace_id", "memory_id"], "left_semi"))
        postings, stats = index.changes(active(before), active(made["memories"]), (self.store.current() or 0) + 1, self.table("index_stats"))
        append = {**more, "log": rows, **made, "postings": postings, "index_stats": stats}
        tables = {*changes, *append} - {"diagnostics", "citations"}
        self.store.commit(changes, {k: v for k, v in read.items() if k in tables}, append)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written below the workspace and read back: what a model said, or what several tables derive from, is computed once."""
        if self._abort is not None:
            self._abort.check()
        path = f"{self.root}/steps/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
