"""The versioned store: an append-only log of versions, everything else derived from it.

A commit's operations depend on each other (a create merges into an active memory of the same text, a forget frees it), so
one workspace's log is folded in order and workspaces are folded side by side. The fold is incremental: the new commits of
a workspace meet the memories that they touch (by id, or by an active text), its checkpoints and its counters in a cogroup,
and come out once, as rows that are tagged with the table they belong to (`Folded`). So a commit costs what it changes, and
the log, versions, memories and checkpoints are appended to; a memory's last row counts (`latest`). A log of creates alone
needs no fold: `dedupe_creates` is plain Catalyst.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import normalise

SCHEMA_VERSION = 8
GROUP = 20_000  #: operations that are folded in one group, about


def normalised(text: str) -> str:
    return re.sub(r"[\s﻿]+", " ", text.strip(" ﻿\t\n\r\x0b\x0c\xa0").strip()).lower()


class CommitError(ValueError):
    """A commit that must leave the store as it was."""


@dataclass
class Memory:
    id: int
    kind: str
    text: str
    state: str = "active"
    current: int = 0
    recurrence: int = 0  #: sessions that state it
    sessions: set = field(default_factory=set)  #: those of them that are known here
    retired_session: str | None = None
    retired_evidence: str | None = None


@dataclass
class Workspace:
    """State of one workspace while commits are folded: the memories that they touch, and counters of all that there were before.
    Active memories are found by text in an index, and a commit that fails is taken back from a journal, so a commit costs what
    it changes, whatever the size of the store."""

    memories: dict[int, Memory] = field(default_factory=dict)
    versions: list[dict] = field(default_factory=list)  #: those made here
    n_memories: int = 0
    n_versions: int = 0  #: made before
    changed: set[int] = field(default_factory=set)
    checkpoints: dict[str, dict] = field(default_factory=dict)
    by_text: dict[str, int] = field(default_factory=dict)  #: normalised texts of the active memories
    journal: list[tuple] = field(default_factory=list)

    def load(self, m: Memory) -> None:
        self.memories[m.id] = m
        if m.state == "active":
            self.by_text[normalised(m.text)] = m.id

    def _active(self, text: str) -> Memory | None:
        return self.memories.get(self.by_text.get(normalised(text), 0))

    def _set(self, m: Memory, **values) -> None:
        """Change a memory, its place in the index with it."""
        if m.state == "active":
            self.by_text.pop(normalised(m.text), None)
        for name, value in values.items():
            setattr(m, name, value)
        if m.state == "active":
            self.by_text[normalised(m.text)] = m.id
        self.changed.add(m.id)

    def _change(self, m: Memory, session: str | None, seen: bool, **values) -> None:
        """As _set, noted in the journal. seen: the session is one more that states the memory."""
        added = seen and session not in m.sessions
        self.journal.append((m, {name: getattr(m, name) for name in values}, session, added))
        self._set(m, **values)
        if added:
            m.sessions.add(session)
            m.recurrence += 1

    def _undo(self, versions: int) -> None:
        while self.journal:
            m, values, session, added = self.journal.pop()
            if values.get("current") == 0:  # its first version: it was made in this commit
                self._set(m, state="retired")
                del self.memories[m.id]
                self.n_memories -= 1
                continue
            self._set(m, **values)
            if added:
                m.sessions.discard(session)
                m.recurrence -= 1
        del self.versions[versions:]

    def _version(self, m: Memory, text: str, evidence: str | None, session: str | None, generation: int) -> None:
        version = {"version_id": self.n_versions + len(self.versions) + 1, "memory_id": m.id, "text": text, "evidence": evidence, "session_id": session, "generation": generation, "previous_version_id": m.current or None}
        self.versions.append(version)
        self._change(m, session, True, current=version["version_id"], text=text)

    def _target(self, op: dict) -> Memory:
        m = self.memories.get(op["memory_id"])
        if m is None or m.state != "active":
            raise CommitError(f"memory {op['memory_id']} is not active")
        return m

    def apply(self, op: dict, session: str | None, generation: int) -> None:
        what = op["op"]
        if what == "no_op":
            return
        if what == "create":
            same = self._active(op["memory_text"])
            if same is not None:  # a restatement: text and kind stay
                self._version(same, same.text, op.get("evidence_text"), session, generation)
            else:
                self.n_memories += 1
                m = Memory(self.n_memories, op["kind"], op["memory_text"].strip())
                self.memories[m.id] = m
                self._version(m, m.text, op.get("evidence_text"), session, generation)
        elif what == "update":
            m = self._target(op)
            text = op.get("memory_text") or m.text
            other = self._active(text)
            if other is not None and other is not m:
                raise CommitError(f"memory {other.id} already says so")
            self._version(m, text.strip(), op.get("evidence_text"), session, generation)
        elif what == "forget":
            self._change(self._target(op), session, False, state="retired", retired_session=session, retired_evidence=op.get("evidence_text"))
        else:
            raise CommitError(f"unknown operation {what}")

    def commit(self, entry: dict) -> bool:
        """Apply one session's commit, all or nothing; False where it was there already."""
        session, digest = entry["session_id"], entry.get("content_hash")
        old = self.checkpoints.get(session)
        mark = {k: entry.get(k) for k in ("session_id", "path", "cwd", "mtime_ms", "content_hash", "offset", "total")}
        if old is not None and digest is not None and old["content_hash"] == digest and not (old["total"] and (old["offset"] or 0) < old["total"]):
            self.checkpoints[session] = {**old, **{k: mark[k] for k in ("path", "cwd", "mtime_ms")}}
            return False
        if old is not None and old["content_hash"] is None and digest is None and entry["mtime_ms"] <= old["mtime_ms"]:
            return False
        before = len(self.versions)
        self.journal.clear()
        try:
            for op in entry["operations"]:
                self.apply(op, session, entry.get("generation", 0))
        except CommitError:
            self._undo(before)
            raise
        self.checkpoints[session] = mark
        return True

    def forget(self, memory_id: int) -> bool:
        """Retire by hand: no session, no evidence, whatever the state."""
        m = self.memories.get(memory_id)
        if m is None:
            return False
        self._set(m, state="retired", retired_session=None, retired_evidence=None)
        return True


LOG = "workspace_id string, commit_seq long, op_seq int, session_id string, content_hash string, mtime_ms long, offset long, total long, generation long, op string, kind string, memory_id long, memory_text string, evidence_text string"
MEMORIES = "workspace_id string, memory_id long, kind string, state string, text string, normalized_text string, current_version_id long, recurrence long, retired_session string, retired_evidence string, seq long"
VERSIONS = "workspace_id string, version_id long, memory_id long, previous_version_id long, session_id string, generation long, text string, evidence_text string"
MARKS = "workspace_id string, session_id string, content_hash string, mtime_ms long, offset long, total long, seq long"
HEADS = "workspace_id string, n_memories long, n_versions long, seq long"
REJECTED = "workspace_id string, commit_seq long, error string"
STATE = {"memories": MEMORIES, "versions": VERSIONS, "marks": MARKS, "heads": HEADS}
BY_HAND = "forget_by_hand"  #: an operation of the log that retires a memory without a session


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _union(*schemas: str) -> str:
    """A schema with the columns of all, each once."""
    return ", ".join(dict.fromkeys(c for schema in schemas for c in schema.split(", ")))


#: What the fold puts out: `tag` says which table a row belongs to, the other columns are null.
TAGGED = "tag string, " + _union(MEMORIES, VERSIONS, MARKS, HEADS, REJECTED)
#: What commits meet: memories that they touch, sessions that state those, checkpoints, counters.
MET = "tag string, " + _union(MEMORIES, MARKS, HEADS)


def latest(table: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, by seq."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(*keys, "x.*")


def current(memories: DataFrame) -> DataFrame:
    """The memories as they are now, from the appended table."""
    return latest(memories, "workspace_id", "memory_id").drop("seq")


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}


def touched(commits: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """What the commits (LOG) need of the state, as rows of MET: never a memory that they do not name."""
    null = lambda df, tag: df.withColumn("tag", F.lit(tag)).select("tag", *(F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in MET.split(", ")[1:])))
    ids = commits.filter("memory_id is not null").select("workspace_id", "memory_id")
    texts = commits.filter("memory_text is not null").select("workspace_id", normalise(F.col("memory_text")).alias("normalized_text"))
    # Rows of a text may be old ones: the ids are looked up for their last rows.
    named = ids.unionByName(state["memories"].join(texts.distinct(), ["workspace_id", "normalized_text"], "left_semi").select("workspace_id", "memory_id")).distinct()
    memories = latest(state["memories"].join(named, ["workspace_id", "memory_id"], "left_semi"), "workspace_id", "memory_id")
    sessions = commits.select("workspace_id", "session_id").distinct()
    known = state["versions"].join(sessions, ["workspace_id", "session_id"], "left_semi").join(named, ["workspace_id", "memory_id"], "left_semi")
    known = known.select("workspace_id", "session_id", "memory_id").distinct()
    marks = latest(state["marks"].join(sessions, ["workspace_id", "session_id"], "left_semi"), "workspace_id", "session_id")
    heads = latest(state["heads"].join(commits.select("workspace_id").distinct(), "workspace_id", "left_semi"), "workspace_id")
    return null(memories, "memory").unionByName(null(known, "session")).unionByName(null(marks, "mark")).unionByName(null(heads, "head"))


def _fold_workspace(rows: list[dict], met: list[dict]) -> list[dict]:
    """New commits of one workspace (rows of LOG, in order) and what they meet (MET) -> rows of TAGGED, as far as they are not null."""
    w, out = Workspace(), []
    for r in met:
        if r["tag"] == "memory":
            w.load(Memory(r["memory_id"], r["kind"], r["text"], r["state"], r["current_version_id"], r["recurrence"], set(), r["retired_session"], r["retired_evidence"]))
        elif r["tag"] == "mark":
            w.checkpoints[r["session_id"]] = {k: r[k] for k in ("session_id", "content_hash", "mtime_ms", "offset", "total")}
        elif r["tag"] == "head":
            w.n_memories, w.n_versions = r["n_memories"], r["n_versions"]
    for r in met:
        if r["tag"] == "session":
            w.memories[r["memory_id"]].sessions.add(r["session_id"])
    last, marked = 0, set()
    for seq, own in itertools.groupby(rows, key=lambda r: r["commit_seq"]):
        ops = list(own)
        first, last = ops[0], seq
        if first["op"] == BY_HAND:
            w.forget(first["memory_id"])
            continue
        entry = {k: first[k] for k in ("session_id", "content_hash", "mtime_ms", "offset", "total", "generation")}
        entry["operations"] = [{k: r[k] for k in ("op", "kind", "memory_id", "memory_text", "evidence_text")} for r in ops]
        try:
            w.commit(entry)
            marked.add(first["session_id"])
        except CommitError as e:
            out.append({"tag": "rejected", "commit_seq": last, "error": str(e)})
    for m in (w.memories[k] for k in sorted(w.changed & w.memories.keys())):
        out.append({"tag": "memory", "memory_id": m.id, "kind": m.kind, "state": m.state, "text": m.text, "normalized_text": normalised(m.text), "current_version_id": m.current, "recurrence": m.recurrence, "retired_session": m.retired_session, "retired_evidence": m.retired_evidence, "seq": last})
    out += [{"tag": "version", **{k: v for k, v in version.items() if k != "evidence"}, "evidence_text": version["evidence"]} for version in w.versions]
    out += [{"tag": "mark", "session_id": k, **{c: w.checkpoints[k][c] for c in ("content_hash", "mtime_ms", "offset", "total")}, "seq": last} for k in sorted(marked & w.checkpoints.keys())]
    out.append({"tag": "head", "n_memories": w.n_memories, "n_versions": w.n_versions + len(w.versions), "seq": last})
    return out


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_OUT = pa.schema([(c, ARROW[kind]) for c, kind in (x.split() for x in TAGGED.split(", "))])


def _fold_group(rows: pa.Table, met: pa.Table) -> pa.Table:
    """The workspaces of a group, one after the other: what a group costs beyond its rows is paid once, not by each workspace."""
    known: dict[str | None, list[dict]] = {}
    for r in met.to_pylist():
        known.setdefault(r["workspace_id"], []).append(r)
    out = []
    place = lambda r: (r["workspace_id"] is None, r["workspace_id"] or "", r["commit_seq"], r["op_seq"])
    for ws, own in itertools.groupby(sorted(rows.to_pylist(), key=place), key=lambda r: r["workspace_id"]):
        out += [{**r, "workspace_id": ws} for r in _fold_workspace(list(own), known.get(ws, []))]
    return pa.Table.from_pylist(out, schema=_OUT)


@dataclass(frozen=True)
class Folded:
    """The tagged rows of one fold; each table reads its own. Write `rows` once before several are used."""

    rows: DataFrame

    def _of(self, tag: str, schema: str) -> DataFrame:
        return self.rows.filter(F.col("tag") == tag).select(*_names(schema))

    def changes(self) -> dict[str, DataFrame]:
        """What to append to each table of the state."""
        return {"memories": self._of("memory", MEMORIES), "versions": self._of("version", VERSIONS), "marks": self._of("mark", MARKS), "heads": self._of("head", HEADS)}

    @property
    def rejected(self) -> DataFrame:
        return self._of("rejected", REJECTED)


def fold_commits(commits: DataFrame, state: dict[str, DataFrame] | None = None) -> Folded:
    """Fold new commits (LOG, later than all that the state saw) onto a state (tables of STATE; none: an empty one).

    A commit that fails is left out whole, and named in `rejected`. A workspace's new commits are folded in one task, in order; workspaces share
    groups of some GROUP operations.
    """
    met = touched(commits, state) if state is not None else commits.sparkSession.createDataFrame([], MET)
    groups = -(-commits.count() // GROUP) or 1
    group = F.pmod(F.xxhash64("workspace_id"), F.lit(groups)).alias("group")
    return Folded(commits.groupBy(group).cogroup(met.groupBy(group)).applyInArrow(_fold_group, TAGGED))


def fold(log: DataFrame) -> DataFrame:
    """A whole log of operations (LOG) -> memories. A commit that fails is left out whole."""
    return fold_commits(log).changes()["memories"].drop("seq")


def fold_versions(log: DataFrame) -> DataFrame:
    """A whole log of operations -> the versions of all memories, each with the one before it."""
    return fold_commits(log).changes()["versions"]


def rejected(log: DataFrame) -> DataFrame:
    """The commits of a whole log that fail, and why."""
    return fold_commits(log).rejected


def dedupe_creates(versions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A log of creates (version_id, session_id, kind, text): one memory a normalised text, with the first text and kind, and its recurrence."""
    named = versions.withColumn("normalized_text", normalise(F.col("text")))
    first = lambda c: F.min_by(c, "version_id").alias(c)
    return named.groupBy(*keys, "normalized_text").agg(F.min("version_id").alias("memory_id"), first("text"), first("kind"), F.max("version_id").alias("current_version_id"), F.count("*").alias("versions"), F.countDistinct("session_id").alias("recurrence"))


def version_chain(versions: DataFrame) -> DataFrame:
    """Adds memory_id (the first version of the text) and previous_version_id to a log of creates."""
    w = Window.partitionBy("normalized_text").orderBy("version_id")
    named = versions.withColumn("normalized_text", normalise(F.col("text")))
    return named.withColumn("memory_id", F.min("version_id").over(w)).withColumn("previous_version_id", F.lag("version_id").over(w))


def recurrence(versions: DataFrame) -> DataFrame:
    return versions.groupBy("memory_id").agg(F.countDistinct("session_id").alias("recurrence"))


def hydrate(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """memories with the text of their current version and their recurrence: one aggregate, not a lookup a row."""
    current = versions.select(F.col("version_id").alias("current_version_id"), "text")
    return memories.join(current, "current_version_id").join(recurrence(versions), "memory_id", "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(0)))


PARTS = 32  #: parts of a table beyond which it is compacted


class Conflict(RuntimeError):
    """Another writer changed a table that a commit was based on; nothing was committed."""


class SnapshotStore:
    """Tables on any file system that Spark reads, each a list of parts: a commit writes new tables, or parts that are appended
    to tables, then a numbered pointer to all.

    The pointer of version n + 1 is made by an exclusive rename, so of two writers one wins; the other commits on top of it,
    or fails with Conflict where a table that it read is no longer the one it read. (The rename must not replace a file: so
    on HDFS and its like, not on bare object stores.) A writer that dies leaves the last pointer; CURRENT only tells readers
    where to start looking for it. `open` brings a store of an older schema up to date, and refuses a damaged or a newer one;
    `sweep` deletes what no pointer names any more.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, name: str) -> dict | None:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if state["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"store has schema {state['schema_version']}, newer than {SCHEMA_VERSION}")
        return state | {"tables": {name: [x] if isinstance(x, str) else x for name, x in state.get("tables", {}).items()}}

    def _publish(self, state: dict, name: str, replace: bool) -> bool:
        """Write a pointer under a name of its own, then rename it; False where it may not replace one that is there."""
        fs, temp = self._fs(f"{self.root}/{name}.{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        jvm, (_, final) = self.spark._jvm, self._fs(f"{self.root}/{name}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, int(replace))
        if replace:
            modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        try:
            context.rename(temp, final, modes)
        except Py4JJavaError:
            if replace or not fs.exists(final):
                raise
            fs.delete(temp, False)
            return False
        return True

    def _state(self) -> dict | None:
        state = self._pointer("CURRENT")
        while (later := self._pointer(f"pointer-{(state or {}).get('version', 0) + 1}")) is not None:
            state = later
        return state

    def current(self) -> int | None:
        """The version of the last commit, None in an empty store."""
        state = self._state()
        return state["version"] if state else None

    def paths(self) -> dict[str, list[str]]:
        """The parts of each table now: what a commit says it has read."""
        return (self._state() or {"tables": {}})["tables"]

    def read(self, name: str) -> DataFrame:
        tables = self.paths()
        if name not in tables:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(*(f"{self.root}/{part}" for part in tables[name]))

    def commit(self, tables: dict[str, DataFrame], read: dict[str, list[str]] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Write `tables` anew and `append` as parts, then the pointer; all others stay where they are.

        read: paths() of what was read to make them. A table that is appended to may have got other parts meanwhile, unless it was read.
        """
        append = append or {}
        read = {k: v for k, v in self.paths().items() if k in tables} if read is None else read
        made = {name: f"{name}-{uuid.uuid4().hex}" for name in (*tables, *append)}
        for name, df in (tables | append).items():
            df.write.parquet(f"{self.root}/{made[name]}")
        while True:
            now = self._state() or {"version": 0, "tables": {}}
            if changed := sorted(name for name, path in read.items() if now["tables"].get(name) != path):
                raise Conflict(f"changed by another writer: {', '.join(changed)}")
            parts = {name: [*(now["tables"].get(name, []) if name in append else []), path] for name, path in made.items()}
            if self._moved(now, now["tables"] | parts):
                return now["version"] + 1

    def _moved(self, now: dict, tables: dict[str, list[str]]) -> bool:
        """Publish the pointer after `now`; False where another writer did."""
        state = {"version": now["version"] + 1, "schema_version": SCHEMA_VERSION, "tables": tables}
        if not self._publish(state, f"pointer-{state['version']}", replace=False):
            return False
        self._publish(state, "CURRENT", replace=True)
        return True

    def compact(self, name: str, by: Callable[[DataFrame], DataFrame] = lambda df: df, most: int = PARTS) -> bool:
        """Rewrite a table of over `most` parts as one (by: what is left of its rows); whether it was. Of two writers the other one wins."""
        read = {name: self.paths().get(name, [])}
        if len(read[name]) <= most:
            return False
        try:
            self.commit({name: by(self.read(name))}, read)
        except Conflict:
            return False
        return True

    def open(self, tables: dict[str, str]) -> None:
        """Check the store against its tables' schemas (name: DDL). A store of an older schema is migrated step by step, and published
        by the same compare-and-swap as a commit; one that lacks a table or a column is refused. An empty store stays empty."""
        while (state := self._state()) is not None:
            version = state["schema_version"]
            if version == SCHEMA_VERSION:
                break
            if version not in MIGRATIONS:
                raise ValueError(f"store has schema {version}, older than any that can be migrated")
            made = {}
            for name, df in MIGRATIONS[version](self, state, tables).items():
                made[name] = [f"{name}-{uuid.uuid4().hex}"]
                df.write.parquet(f"{self.root}/{made[name][0]}")
            self._moved(state, state["tables"] | made)
        for name, ddl in tables.items() if state else ():
            wanted = T._parse_datatype_string(ddl)
            if name not in state["tables"]:
                raise ValueError(f"the store has no table {name}")
            for part in state["tables"][name]:
                fs, path = self._fs(f"{self.root}/{part}/_SUCCESS")
                if not fs.exists(path):
                    raise ValueError(f"part {part} of table {name} is missing or was not written to its end")
            have = {f.name: f.dataType for f in self.read(name).schema}
            if bad := [f.name for f in wanted if have.get(f.name) != f.dataType]:
                raise ValueError(f"table {name} lacks, or has of another type: {', '.join(bad)}")

    def sweep(self, grace_ms: int = 3_600_000, now_ms: int | None = None) -> int:
        """Delete parts and pointers that no reader can still hold: those that the last pointer does not name, and no pointer
        that was current within the grace time. Parts younger than that may belong to a commit under way. The number of deletions."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        fs, root = self._fs(self.root)
        files = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(root)}
        state = self._state()
        if state is None:
            return 0
        self._publish(state, "CURRENT", replace=True)  # readers look for pointers from here on
        old = now_ms - grace_ms
        live, numbers = {part for parts in state["tables"].values() for part in parts}, sorted(int(x.removeprefix("pointer-")) for x in files if re.fullmatch(r"pointer-\d+", x))
        gone = []
        for k in numbers:
            # A pointer was current until the next one was made.
            replaced = files.get(f"pointer-{k + 1}")
            if k >= state["version"] or replaced is None or replaced > old:
                live |= {part for parts in (self._pointer(f"pointer-{k}") or {"tables": {}})["tables"].values() for part in parts}
            else:
                gone.append(f"pointer-{k}")
        gone += [x for x, at in files.items() if re.fullmatch(r"\w+-[0-9a-f]{32}", x) and x not in live and at <= old]
        gone += [x for x, at in files.items() if re.fullmatch(r"(pointer-\d+|CURRENT)\.[0-9a-f]{32}", x) and at <= old]
        for name in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
        return len(gone)


def _from_7(store: SnapshotStore, state: dict, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Schema 7 had one folder a table, and no checkpoints and counters of the fold: they come from one fold of its log."""
    names = state["tables"]
    if "log" not in names:
        return {}
    log = store.read("log")
    made = {name: df for name, df in fold_commits(log).changes().items() if name in tables}
    return made | {name: store.spark.createDataFrame([], ddl) for name, ddl in tables.items() if name not in names and name not in made}


#: The step from each schema to the next: tables to write anew.
MIGRATIONS: dict[int, Callable[[SnapshotStore, dict, dict[str, str]], dict[str, DataFrame]]] = {7: _from_7}


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes in place of the rows of table with the same keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete_older(spark: SparkSession, folder: str, age_ms: int) -> int:
    """Delete what lies directly in a folder and is older than age_ms; the number of deletions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    old = [s.getPath() for s in fs.listStatus(path) if s.getModificationTime() <= int(time.time() * 1000) - age_ms]
    for p in old:
        fs.delete(p, True)
    return len(old)


def write_config(path: str, config: dict) -> None:
    """Atomic: temporary file, flush to disk, rename; mode 0600."""
    temp = f"{path}.{uuid.uuid4().hex}"
    fd = os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(config, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
