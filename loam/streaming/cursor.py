"""A stateful cursor over transcripts: of a file that has grown only what is new goes on, of one that is replayed nothing.

State a path: how many bytes were taken, the hash of those bytes and of the whole file, its time, a generation that
counts rewrites, and the tools that calls named, so that a result in a later part still finds its call. The state lives in the query's state
store and is part of its checkpoint; the tables that a batch is committed to tell a batch that is replayed after a failure.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loam.operators.store import SnapshotStore, latest
from loam.session import LIMITS
from loam.sources import sessions, transcripts

STATE = "offset long, taken string, whole string, mtime_ms long, generation int"
TAIL = "path string, mtime_ms long, content_hash string, generation int, start long, content binary, tools string"
CHECKPOINTS = "session_id string, mtime_ms long, content_hash string, generation int, offset long, total long, seq long"
SEGMENTS = "session string, generation int, segment_no int, start_index long, end_index long, text string, chars long"


def complete_part(content: bytes, start: int) -> int:
    """Where what can be taken from `start` on ends: after the last line that is whole. A last line without an end counts if it is JSON."""
    last = content.rfind(b"\n", start)
    rest = content[last + 1 if last >= start else start :]
    try:
        json.loads(rest)
        return len(content)
    except ValueError:
        return last + 1 if last >= start else start


def tool_calls(part: bytes) -> tuple[dict[str, str], set[str]]:
    """(call id to tool of the calls in a part of a file, ids that results without a name ask for)."""
    made, asked = {}, set()
    for line in part.split(b"\n"):
        try:
            message = json.loads(line)["message"]
            if message.get("role") == "toolResult" and not message.get("toolName") and isinstance(message.get("toolCallId"), str):
                asked.add(message["toolCallId"])
            blocks = message["content"] if message.get("role") == "assistant" and isinstance(message.get("content"), list) else []
            made.update({b["id"]: b["name"] for b in blocks if b.get("type") == "toolCall" and b.get("id") and b.get("name")})
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return made, asked


class Cursor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", STATE)
        self.tools = handle.getMapState("tools", "call string", "tool string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [r for frame in rows for r in frame.itertuples(index=False)]
        out = []
        for r in sorted(found, key=lambda r: (r.mtime_ms, r.length)):
            content = bytes(r.content)
            offset, taken, whole, mtime, generation = self.state.get() if self.state.exists() else (0, None, None, -1, 0)
            digest = hashlib.sha256(content).hexdigest()
            if digest == whole or r.mtime_ms < mtime:
                continue
            if taken is not None and hashlib.sha256(content[:offset]).hexdigest() != taken:
                offset, generation = 0, generation + 1  # not the same file grown: all of it is new
                self.tools.clear()
            end = complete_part(content, offset)
            made, asked = tool_calls(content[offset:end])
            known = {c: self.tools.getValue((c,))[0] for c in asked - made.keys() if self.tools.containsKey((c,))}
            for call, tool in made.items():
                self.tools.updateValue((call,), (tool,))
            self.state.update((end, hashlib.sha256(content[:end]).hexdigest(), digest, int(r.mtime_ms), generation))
            if end > offset:
                out.append((key[0], int(r.mtime_ms), digest, generation, offset, content[offset:end], json.dumps(known)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TAIL.split(", ")])

    def close(self) -> None:
        pass


def commit_tails(store: SnapshotStore, tails: DataFrame) -> int:
    """Append the segments of tails (TAIL) that are not committed yet, numbered on from what their sessions hold; how many tails.

    Rows are appended: nothing of what the tables hold is written again.
    """
    spark = tails.sparkSession
    if store.current() is None:
        store.commit({"segments": spark.createDataFrame([], SEGMENTS), "checkpoints": spark.createDataFrame([], CHECKPOINTS)})
    version = store.current()
    marks = latest(store.read("checkpoints"), "session_id").select(F.col("session_id").alias("path"), F.col("generation").alias("g"), "total", F.col("content_hash").alias("seen"))
    new = tails.join(marks, "path", "left").filter(~F.col("seen").eqNullSafe(F.col("content_hash")))
    new = new.withColumn("base", F.when(F.col("g") == F.col("generation"), F.col("total")).otherwise(0)).drop("g", "total", "seen").persist()
    try:
        n = new.count()
        if n == 0:
            return 0
        tools = new.select(F.col("path").alias("session"), F.explode(F.from_json("tools", "map<string,string>")).alias("call", "known"))
        seen = transcripts.visible(transcripts.messages(transcripts.entries(new.select("path", "content")), tools))
        base = new.select(F.col("path").alias("session"), "generation", "base")
        lines = seen.join(base, "session").withColumn("index", F.col("index") + F.col("base")).withColumn("line", transcripts.line_of()).select("session", "generation", "base", "index", "line")
        made = transcripts.pack(lines.select("session", "index", "line")).join(base, "session")
        before = store.read("segments").groupBy("session", "generation").agg((F.max("segment_no") + 1).alias("first"))
        made = made.join(before, ["session", "generation"], "left").withColumn("segment_no", (F.col("segment_no") + F.coalesce("first", F.lit(0))).cast("int"))
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        made = made.withColumns({c: F.col(c).cast("long") for c in ("start_index", "end_index", "chars")}).select(names)
        counts = lines.groupBy(F.col("session").alias("path")).agg(F.count("*").alias("n"))
        after = new.join(counts, "path", "left").select(F.col("path").alias("session_id"), "mtime_ms", "content_hash", "generation", (F.col("base") + F.coalesce("n", F.lit(0))).alias("total"))
        after = after.select("session_id", "mtime_ms", "content_hash", "generation", F.col("total").alias("offset"), "total", F.lit(version).cast("long").alias("seq"))
        store.commit({}, append={"segments": made, "checkpoints": after})
        return n
    finally:
        new.unpersist()


def current_segments(store: SnapshotStore) -> DataFrame:
    """The segments of each session's last generation."""
    rows = store.read("segments")
    last = latest(store.read("checkpoints"), "session_id").select(F.col("session_id").alias("session"), "generation")
    return rows.join(last, ["session", "generation"], "left_semi")


def follow(spark: SparkSession, root: str, store: SnapshotStore, state_dir: str):
    """A query that takes what is new below root and stops; start it again with the same state_dir for what has come since."""
    sessions.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files = spark.readStream.format("loam_session_stream").option("path", root).load().filter(F.col("length") <= LIMITS.session_bytes)
    tails = files.groupBy("path").transformWithStateInPandas(Cursor(), TAIL, "Append", "None")
    return tails.writeStream.foreachBatch(lambda batch, _: commit_tails(store, batch)).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
