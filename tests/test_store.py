import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loam.operators import audit, control, mining, store
from loam.sources import config, transcripts
from loam.streaming import ingest


def commit(session, *ops, digest="h", mtime=1, offset=1, total=1):
    return {"session_id": session, "content_hash": digest, "mtime_ms": mtime, "offset": offset, "total": total, "path": session, "cwd": "/w", "operations": list(ops)}


def create(text, kind="preference"):
    return {"op": "create", "kind": kind, "memory_text": text, "memory_id": None, "evidence_text": "e"}


def test_commits_are_replayed_once():
    w = store.Workspace()
    assert w.commit(commit("a", create("Prefer tabs"))) and not w.commit(commit("a", create("Prefer tabs"), mtime=9))
    assert len(w.memories[1].sessions) == 1 and w.checkpoints["a"]["mtime_ms"] == 9 and w.checkpoints["a"]["offset"] == 1


def test_creates_merge_and_updates_collide():
    w = store.Workspace()
    w.commit(commit("a", create("Prefer tabs over spaces")))
    w.commit(commit("b", create("  prefer  TABS over spaces", "fact")))
    m = w.memories[1]
    assert len(w.memories) == 1 and m.text == "Prefer tabs over spaces" and m.kind == "preference" and len(m.sessions) == 2 and len(w.versions) == 2
    assert w.versions[1]["previous_version_id"] == 1
    w.commit(commit("c", create("other")))
    with pytest.raises(store.CommitError):
        w.commit(commit("d", create("third"), {"op": "update", "memory_id": 2, "memory_text": "PREFER tabs over spaces"}))
    assert len(w.memories) == 2 and len(w.versions) == 3 and "d" not in w.checkpoints
    with pytest.raises(store.CommitError):
        w.commit(commit("e", {"op": "forget", "memory_id": 9}))
    w.commit(commit("f", {"op": "forget", "memory_id": 2, "evidence_text": "no"}))
    assert w.memories[2].state == "retired" and w.memories[2].retired_session == "f"
    assert w.forget(1) and w.memories[1].retired_session is None


def test_partial_sessions_apply_again():
    w = store.Workspace()
    assert w.commit(commit("a", create("x"), offset=2, total=5))
    assert w.commit(commit("a", create("y"), offset=5, total=5)) and not w.commit(commit("a", create("z"), offset=5, total=5))
    assert sorted(m.text for m in w.memories.values()) == ["x", "y"]


def test_fold_of_a_log(spark):
    rows = [("w1", 1, 0, "s1", "h1", "create", "fact", None, "A b"), ("w1", 2, 0, "s2", "h2", "create", "fact", None, "a  B"), ("w1", 3, 0, "s3", "h3", "update", None, 7, "x"), ("w2", 1, 0, "s1", "h1", "create", "preference", None, "q"), ("w2", 2, 0, "s9", "h9", "forget", None, 1, None)]
    log = spark.createDataFrame([(w, c, o, s, h, 1, 1, 1, 0, op, k, m, t, "e") for w, c, o, s, h, op, k, m, t in rows], store.LOG)
    got = {(r.workspace_id, r.memory_id): (r.state, r.recurrence) for r in store.fold(log).collect()}
    assert got == {("w1", 1): ("active", 2), ("w2", 1): ("retired", 1)}


def test_snapshots_move_by_pointer(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "store"))
    assert s.current() is None
    s.commit({"a": spark.range(3), "b": spark.range(1)})
    s.commit({"a": spark.range(5)})
    assert s.read("a").count() == 5 and s.read("b").count() == 1
    (tmp_path / "store" / "CURRENT").write_text(json.dumps({"snapshot": "x", "schema_version": 99}))
    (tmp_path / "store" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        s.current()


def test_pages(spark):
    versions = spark.range(1, 8).select(F.lit(1).alias("memory_id"), F.col("id").alias("version_id"))
    got = audit.page(versions, 1, 0, 3).orderBy("place").collect()
    assert [r.version_id for r in got] == [7, 6, 5] and got[0].next_offset == 3
    assert {r.next_offset for r in audit.page(versions, 1, 6, 99).collect()} == {None}


def test_checkpoints(spark):
    files = spark.createDataFrame([("w", s, m, h) for s, m, h in (("new", 5, "a"), ("same", 5, "a"), ("newer", 6, "a"), ("partial", 5, "a"), ("changed", 5, "b"), ("nohash", 5, "b"))], "workspace_id string, session_id string, mtime_ms long, content_hash string")
    marks = spark.createDataFrame([("same", 5, "a", 3, 3), ("newer", 5, "a", 3, 3), ("partial", 5, "a", 1, 3), ("changed", 5, "a", 3, 3), ("nohash", 5, None, 3, 3)], ingest.CHECKPOINTS)
    assert {r.session_id for r in control.due(files, marks).collect()} == {"new", "newer", "partial", "changed"}
    assert {r.session_id for r in control.uncovered(files, marks).collect()} == {"new", "newer", "changed", "nohash"}
    assert "changed, new, newer, nohash" in control.coverage_error(control.uncovered(files, marks)).first().error
    assert control.coverage_error(files.limit(0)).first().error is None


def test_claims_and_cadence(spark):
    runs = spark.createDataFrame([("a", "1", "running", 0), ("b", "2", "running", 1), ("c", "3", "completed", 1), ("d", "4", "claimed", None)], "workspace_id string, run_id string, status string, started_ms long").withColumns({"finished_ms": F.lit(5), "reported": F.lit(False)})
    now = 3_600_000
    assert {r.workspace_id: (r.may_claim, r.stale_runs) for r in control.claimable(runs, now).collect()} == {"a": (True, 1), "b": (False, 0), "c": (True, 0), "d": (True, 1)}
    assert {r.workspace_id for r in control.active_run(runs, now).collect()} >= {"a", "b"}
    assert control.finish(runs, "1", "failed", 9).filter("run_id = '1'").first().status == "failed"
    assert control.finish(runs, "3", "failed", 9).filter("run_id = '3'").first().status == "completed"
    minute = 60_000
    state = spark.createDataFrame([(9, 0, 0, True, True), (8, 0, 0, True, True), (9, 200 * minute, 0, True, True), (9, 10 * minute, 250 * minute, True, True), (9, 0, 0, False, True), (9, 0, 0, True, False), (9, 180 * minute, 20 * minute, True, True)], "turns int, last_success_ms long, last_failure_ms long, enabled boolean, has_due boolean")
    assert [r.due for r in control.cadence(state, 300 * minute).collect()] == [True, False, False, False, False, False, True]


def entry(**x):
    return json.dumps(x)


SESSION = "\n".join(
    [
        "", "{", "null", "[1,2]", '"hello"', "42", entry(type="other"),
        entry(type="session", id="s1", cwd="/w", timestamp="2026-01-01T00:00:00Z"),
        entry(type="message", message={"role": "user", "content": "use tabs", "timestamp": 5}),
        entry(type="message", message={"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "toolCall", "id": "t1", "name": "memory_search", "arguments": {"q": 1}}, {"type": "toolCall", "id": "t2", "name": "bash", "arguments": {"cmd": "ls"}}]}),
        entry(type="message", message={"role": "toolResult", "toolCallId": "t1", "content": "hits"}),
        entry(type="message", message={"role": "toolResult", "toolCallId": "t2", "content": [{"type": "text", "text": "y" * 4004}], "isError": True}),
        entry(type="custom_message", customType="x", content="made up"),
        entry(type="compaction", summary="so far"),
    ]
)


def test_transcripts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text(SESSION)
    raw = transcripts.files(spark, str(tmp_path))
    head = raw.select(transcripts.header(F.col("content")).alias("h")).first().h
    assert (head.cwd, head.id) == ("/w", "s1")
    messages = transcripts.messages(transcripts.entries(raw))
    assert [r.role for r in messages.orderBy("position").collect()] == ["user", "assistant", "toolResult", "toolResult", "custom", "compaction"]
    seen = transcripts.visible(messages)
    lines = {r["index"]: r.line for r in seen.select("index", transcripts.line_of().alias("line")).collect()}
    assert len(lines) == 4 and lines[0] == "[0] user:\nuse tabs"
    assert lines[1] == '[1] assistant:\nok\n[toolCall bash {"cmd":"ls"}]'
    assert lines[2].startswith("[2] toolResult:\n[toolResult bash ERROR yyy") and "chars omitted" in lines[2] and len(lines[2]) < 1000
    segments = transcripts.pack(seen.select("session", "index", transcripts.line_of().alias("line")), 40)
    assert [(r.start_index, r.end_index) for r in segments.orderBy("segment_no").collect()][0] == (0, 1)
    manifest = transcripts.hashed(raw).select("path", "content_hash")
    assert transcripts.verified(raw, manifest).count() == 1
    with pytest.raises(Exception, match="snapshot changed"):
        transcripts.verified(raw, manifest.withColumn("content_hash", F.lit("x"))).select("content").collect()


def test_stream_ingests_grown_files_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = store.SnapshotStore(spark, str(tmp_path / "store"))
    (tmp_path / "in" / "a.jsonl").write_text(SESSION)
    ingest.follow(spark, str(tmp_path / "in"), s, str(tmp_path / "state")).awaitTermination(120)
    assert s.read("checkpoints").first().total == 4
    raw = transcripts.files(spark, str(tmp_path / "in"))
    assert ingest.commit_batch(s, raw) == 0
    (tmp_path / "in" / "a.jsonl").write_text(SESSION + "\n" + entry(type="message", message={"role": "user", "content": "more"}))
    assert ingest.commit_batch(s, transcripts.files(spark, str(tmp_path / "in"))) == 1
    assert s.read("checkpoints").first().total == 5 and s.read("segments").count() == 1


def test_mining(spark):
    answers = {"good": json.dumps({"candidates": [{"kind": "fact", "memoryText": "m", "evidenceText": "e"}, {"kind": "bad"}]}), "bad": "no json", "fixed": None}

    def complete(text, problem):
        if text == "fixed":
            return answers["good"] if problem else "[]"
        return f"```json\n{answers[text]}\n```"

    segments = spark.createDataFrame([("s", 0, "good"), ("s", 1, "fixed"), ("t", 0, "bad")], "session string, segment_no int, text string")
    found = mining.extract(segments, complete)
    rows = found.collect()
    assert sorted(r.candidate_id for r in rows if not r.error) == ["S0C1", "S1C1"] and [r.session for r in rows if r.error] == ["t"]
    recalled = spark.createDataFrame([("s", "S0C1", 1, 5, "old"), ("s", "S0C1", 4, 6, "far")], "session string, candidate_id string, rank int, node_id long, text string")

    def decide(prompt, problem):
        assert "M:5" in prompt and "M:6" not in prompt
        return json.dumps({"operations": [{"op": "update", "memoryId": "M:5", "evidenceText": "e"}, {"op": "no_op"}]})

    ops = mining.consolidate(found, recalled, decide).orderBy("op_seq").collect()
    assert [(o.op, o.memory_id) for o in ops] == [("update", 5), ("no_op", None)]
    bad = mining.consolidate(found, recalled, lambda *_: json.dumps({"operations": [{"op": "no_op"}, {"op": "update", "memoryId": "M:0"}]})).collect()
    assert len(bad) == 1 and bad[0].error


def test_run_budget(spark):
    rows = spark.createDataFrame([("r", 1, 0, 50), ("r", 1, 1, 40), ("r", 2, 0, 20), ("r", 3, 0, 1)], "run_id string, session_order int, segment_no int, chars int")
    got = [(r.session_order, r.segment_no, r.partial) for r in mining.within_budget(rows, 95).collect()]
    assert sorted(got) == [(1, 0, False), (1, 1, False)]


def test_synthesis_answers(spark):
    rows = [("a", ["M:1"], "briefing", None), ("", [], "briefing", None), ("", ["M:1"], "briefing", "both"), ("a", ["M:9"], "search", "visible"), ("a", ["M:1", "M:1"], "search", "duplicate"), ("none", [], "search", None), ("a", [], "search", "nothing"), ("a", ["x"], "search", "invalid"), (None, [], "search", "string")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, s array<string>, p string, want string")
    ids = F.array(F.lit("M:1"), F.lit("M:2"))
    for r in df.withColumn("e", mining.synthesis_error(F.col("c"), F.col("s"), ids, F.col("p"), "none")).collect():
        assert (r.e is None) if r.want is None else r.want in r.e


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path).enabled
    config.pause(path)
    assert not config.load(path).enabled
    for bad in ("{", "[]", '{"version": 1, "x": 1}', '{"version": 2}', '{"version": 1, "dreamModel": "m"}'):
        (tmp_path / "c.json").write_text(bad)
        assert not config.load(path).enabled
    (tmp_path / "c.json").write_text('{"version": 1, "minTurns": 0, "minMinutes": 7.9}')
    assert (config.load(path).minTurns, config.load(path).minMinutes) == (10, 7)


def random_log(seed, commits=60):
    """A log of two workspaces whose commits merge, collide, fail and replay: rows of store.LOG."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, commits + 1):
        ws, session = rng.choice(["w1", "w2"]), f"s{rng.randint(0, 5)}"
        digest, total = rng.choice(["a", "b", None]), rng.choice([None, 0, 3])
        if rng.random() < 0.1:
            rows.append((ws, seq, 0, None, None, 0, None, None, 0, store.BY_HAND, None, rng.randint(1, 9), None, None))
            continue
        for n in range(rng.randint(1, 3)):
            op = rng.choice(["create", "create", "update", "forget", "no_op"])
            text = rng.choice(["A", " a", "B", "b  c", "B c", "d", "e"]) if op == "create" or op == "update" and rng.random() < 0.7 else None
            rows.append((ws, seq, n, session, digest, rng.randint(1, 3), rng.choice([1, 3]), total, seq, op, "fact" if op == "create" else None, None if op in ("create", "no_op") else rng.randint(1, 6), text, "e"))
    return rows


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


MEMORY = ("workspace_id", "memory_id", "kind", "state", "text", "normalized_text", "current_version_id", "recurrence", "retired_session")
VERSION = ("workspace_id", "version_id", "memory_id", "previous_version_id", "session_id", "generation", "text", "evidence_text")


@pytest.mark.parametrize("seed", range(2))
def test_incremental_fold_is_the_whole_fold(spark, seed):
    rows = random_log(seed)
    whole = store.fold_commits(spark.createDataFrame(rows, store.LOG))
    state, bad = store.empty_state(spark), []
    for a, b in ((1, 20), (21, 21), (22, 40), (41, 60)):
        new = spark.createDataFrame([r for r in rows if a <= r[1] <= b], store.LOG)
        step = store.fold_commits(new, state)
        bad += rows_of(step.rejected, "workspace_id", "commit_seq", "error")
        state = {name: spark.createDataFrame(state[name].unionByName(made).collect(), store.STATE[name]) for name, made in step.changes().items()}
    assert rows_of(store.current(state["memories"]), *MEMORY) == rows_of(whole.changes()["memories"], *MEMORY)
    assert rows_of(state["versions"], *VERSION) == rows_of(whole.changes()["versions"], *VERSION)
    assert sorted(bad, key=repr) == rows_of(whole.rejected, "workspace_id", "commit_seq", "error") and bad
    assert rows_of(store.latest(state["heads"], "workspace_id"), "workspace_id", "n_memories", "n_versions") == rows_of(whole.changes()["heads"], "workspace_id", "n_memories", "n_versions")


def test_a_commit_meets_only_what_it_touches(spark):
    big = [("w", k, 0, f"s{k}", "h", 1, 1, 1, 0, "create", "fact", None, f"text {k}", "e") for k in range(1, 201)]
    state = store.fold_commits(spark.createDataFrame(big, store.LOG)).changes()
    new = spark.createDataFrame([("w", 300, 0, "s5", "x", 1, 1, 1, 0, "create", "fact", None, "TEXT 7", "e"), ("w", 300, 1, "s5", "x", 1, 1, 1, 0, "forget", None, 9, None, "e")], store.LOG)
    met = store.touched(new, state)
    assert rows_of(met.filter("tag = 'memory'"), "memory_id") == [(7,), (9,)] and met.count() <= 5  # and a checkpoint and the counters
    made = store.fold_commits(new, state).changes()
    assert rows_of(made["memories"], "memory_id", "state", "recurrence") == [(7, "active", 2), (9, "retired", 1)] and made["versions"].first().version_id == 201


def test_parts_are_appended_compacted_and_swept(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.commit({"a": spark.range(1), "b": spark.range(1)})
    for k in range(4):
        s.commit({}, append={"a": spark.range(10 * k, 10 * k + 2)})
    assert s.read("a").count() == 9 and len(s.paths()["a"]) == 5 and len(s.paths()["b"]) == 1
    read = s.paths()
    s.commit({}, append={"a": spark.range(1)})  # another writer's part
    s.commit({}, {"b": read["b"]}, {"a": spark.range(1)})
    with pytest.raises(store.Conflict, match="a"):
        s.commit({}, {"a": read["a"]}, {"a": spark.range(1)})
    held = s.read("a")
    assert s.compact("a", lambda df: df.distinct(), most=3) and not s.compact("a", most=3) and s.read("a").count() == 8 and len(s.paths()["a"]) == 1
    assert s.sweep(grace_ms=3_600_000) == 0 and held.count() == 11  # a reader within the grace time
    for _ in range(30):
        s.commit({"b": spark.range(2)})
    assert s.sweep(grace_ms=0, now_ms=int(time.time() * 1000) + 5000) > 60
    left = [x for x in os.listdir(tmp_path / "s") if not x.startswith(".")]
    assert len(left) <= 4 and s.read("a").count() == 8 and s.read("b").count() == 2 and s.current() == 38  # two parts, a pointer, CURRENT
    assert s.commit({"b": spark.range(3)}) == 39


def test_old_stores_migrate_and_damaged_ones_are_refused(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([("w", 1, 0, "s1", "h", 1, 1, 1, 0, "create", "fact", None, "x", "e")], store.LOG)
    s.commit({"log": log, "memories": store.fold(log), "versions": store.fold_versions(log)})

    def rewrite(**changes):
        path = tmp_path / "s" / "CURRENT"
        state = json.loads(path.read_text()) | changes
        for f in (path, tmp_path / "s" / f"pointer-{state['version']}"):
            f.write_text(json.dumps(state))
            (tmp_path / "s" / f".{f.name}.crc").unlink(missing_ok=True)
        return state

    tables = {"log": store.LOG, **store.STATE, "later": "n long"}
    rewrite(schema_version=7, tables={k: v[0] for k, v in s.paths().items()})  # as the older schema had it
    s.open(tables)
    assert s.current() == 2 and rows_of(s.read("memories"), "memory_id", "seq") == [(1, 1)] and rows_of(s.read("heads"), "n_memories", "n_versions") == [(1, 1)] and s.read("later").isEmpty()
    s.open(tables)
    assert s.current() == 2
    with pytest.raises(ValueError, match="no table other"):
        s.open(tables | {"other": "n long"})
    with pytest.raises(ValueError, match="log lacks"):
        s.open(tables | {"log": store.LOG + ", more int"})
    part = tmp_path / "s" / s.paths()["marks"][0]
    (part / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="marks is missing"):
        s.open(tables)
    rewrite(schema_version=3)
    with pytest.raises(ValueError, match="older than any"):
        s.open(tables)


def test_workspaces_share_groups(spark, monkeypatch):
    """Many workspaces in one group, or one in each, come out the same."""
    ops = [(f"w{k % 7}", k // 7, 0, "s", str(k), k, 1, 1, 0, ("create", "update", "forget")[k // 7 % 3], "fact", 1, f"says {k % 3}", "e") for k in range(63)]
    log = spark.createDataFrame(ops, store.LOG)
    found = []
    for size in (1, 1000):
        monkeypatch.setattr(store, "GROUP", size)
        rows = store.fold_commits(log).rows
        found.append(sorted(map(str, rows.collect())))
    assert found[0] == found[1] and len({r for r in found[0] if "tag='head'" in r}) == 7
