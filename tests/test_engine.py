import json
import os
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loam import engine as E
from loam.abort import Abort, Aborted
from loam.operators import audit, control, store, vectors
from loam.session import LIMITS

HOUR = 3_600_000


def transcript(path, session, *texts, cwd="/w"):
    rows = [{"type": "session", "id": session, "cwd": cwd}, *({"type": "message", "message": {"role": "user", "content": t}} for t in texts)]
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (1_700_000_000, 1_700_000_000))  # runs take the newest first: files of one test are of one age, whatever the clock


def extract(text, problem):
    if "broken" in text:
        return "no json"
    found = [x for x in text.splitlines() if x.startswith("prefer")]
    return json.dumps({"candidates": [{"kind": "preference", "memoryText": x, "evidenceText": "said so"} for x in found]})


def decide(prompt, problem):
    found = [x.partition(": ")[2] for x in prompt.splitlines() if "(preference): " in x]
    return json.dumps({"operations": [{"op": "create", "kind": "preference", "memoryText": x, "evidenceText": "e"} for x in found]})


def embed(texts):
    return [[float("tabs" in t), float("cache" in t), 0.1] for t in texts]


def test_a_workspace_from_sessions_to_answers(spark, tmp_path):
    inbox = tmp_path / "in"
    transcript(inbox / "a.jsonl", "s1", "prefer tabs over spaces", "thanks")
    transcript(inbox / "b.jsonl", "s2", "prefer  Tabs over spaces")
    transcript(inbox / "c.jsonl", "s3", "prefer nothing of this", cwd="/elsewhere")
    e = E.Engine(spark, str(tmp_path / "root"), "w", str(tmp_path / "config.json"), embed)
    run = e.dream(str(inbox), "/w", extract, decide, 10 * HOUR)
    assert (run["sessions"], run["segments"], run["operations"], run["error"]) == (2, 2, 2, None)
    m = e.list("tabs").collect()
    assert len(m) == 1 and m[0].recurrence == 2 and e.open(1).count() == 2 and e.table("embeddings").count() == 1
    status = e.status().first()
    assert status.active == 1 and status.unreported == 1 and status.embedder == "ready" and status.last_success_ms == 10 * HOUR
    assert e.report() == run["run_id"] and e.report() is None
    again = e.dream(str(inbox), "/w", extract, decide, 11 * HOUR)
    assert again["sessions"] == 0 and again["operations"] == 0 and e.list().count() == 1

    answer = e.search("which indentation, tabs?", lambda purpose, prompt: json.dumps({"content": "Tabs.", "sources": ["M:1"]}), 12 * HOUR)
    assert answer["error"] is None and answer["content"] == "Tabs." and e.status().first().citations == 1
    refused = e.search("which indentation, tabs?", lambda purpose, prompt: "{}", 12 * HOUR, window=100)
    assert refused["error"] == "provider_context_insufficient" and e.diagnostics().first().recall_degraded
    asked = []
    assert e.search("good morning!", lambda *x: asked.append(x), 12 * HOUR)["error"] == "no_memories" and not asked and not e.diagnostics().first().recall_degraded
    message = e.briefing("about tabs", lambda purpose, prompt: json.dumps({"content": "", "sources": []}), 12 * HOUR)
    assert "prefer tabs over spaces" in message.lower() and "## Context" not in message

    assert e.forget(1) and not e.forget(9) and e.list().first().section == "other"
    e.pause()
    assert e.dream(str(inbox), "/w", extract, decide, 13 * HOUR) is None and e.briefing("x", None, 0) is None and not e.status().first().enabled
    e.resume()
    assert e.run_command("list tabs").count() == 1 and e.run_command("").first().retired == 1
    for line in ("fly", "open M:0", "forget x", "dream"):
        with pytest.raises(ValueError):
            e.run_command(line)


def test_a_failed_session_ends_the_run(spark, tmp_path):
    inbox = tmp_path / "in"
    transcript(inbox / "a.jsonl", "s1", "broken")
    e = E.Engine(spark, str(tmp_path / "root"), "w")
    run = e.dream(str(inbox), "/w", extract, decide, 10 * HOUR)
    assert run["sessions"] == 0 and run["error"] and e.table("runs").first().status == "failed" and e.table("checkpoints").count() == 0
    assert e.table("state").first().last_failure_ms == 10 * HOUR
    with pytest.raises(Exception, match="no such folder|does not exist|PATH_NOT_FOUND"):
        e.dream(str(tmp_path / "none"), "/w", extract, decide, 12 * HOUR)
    assert e.table("runs").filter("status = 'failed'").count() == 2


def test_state(spark):
    s = control.new_state(spark, "w")
    s = control.settled(control.settled(s))
    assert (s.first().turns, s.first().generation) == (2, 2)
    s = control.succeeded(control.patched(s, embedding_error="x"), 7, 5)
    assert (s.first().turns, s.first().generation, s.first().newest_mtime_ms, s.first().embedding_error) == (0, 2, 5, "x")
    assert control.succeeded(s, 8, 3).first().newest_mtime_ms == 5 and control.succeeded(s, 8).first().newest_mtime_ms == 5
    assert control.failed(s, 9).first().last_failure_ms == 9
    with pytest.raises(ValueError):
        control.patched(s, nothing=1)
    runs = spark.createDataFrame([("w", "1", "failed", 0, 1, False, None), ("w", "2", "completed", 0, 1, True, None)], control.RUNS)
    d = control.diagnostics(s, runs).first()
    assert d.embedding_degraded and not d.recall_degraded and (d.unreported, d.unreported_failures) == (1, 1)


def test_commands():
    assert E.command("") == ("status", "") and E.command(" LIST two words ") == ("list", "two words")
    E.trace("x", what=object())


def test_of_two_writers_one_wins(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    assert s.commit({"a": spark.range(1), "b": spark.range(1)}) == 1
    read = s.paths()
    assert s.commit({"a": spark.range(2)}, {"a": read["a"]}) == 2
    with pytest.raises(store.Conflict, match="a"):
        s.commit({"a": spark.range(3)}, {"a": read["a"]})
    assert s.commit({"b": spark.range(4)}, {"b": read["b"]}) == 3  # a table that nobody else changed
    assert s.read("a").count() == 2 and s.read("b").count() == 4 and s.paths()["a"] != read["a"]
    assert not s._publish({"version": 3, "schema_version": 1, "tables": {}}, "pointer-3", replace=False)
    (tmp_path / "s" / "CURRENT").unlink()  # as after a writer that died before it moved it
    (tmp_path / "s" / ".CURRENT.crc").unlink(missing_ok=True)
    assert s.current() == 3
    with pytest.raises(FileNotFoundError):
        s.read("c")


def test_a_run_commits_only_under_its_claim(spark, tmp_path):
    inbox = tmp_path / "in"
    transcript(inbox / "a.jsonl", "s1", "prefer tabs")
    e = E.Engine(spark, str(tmp_path / "root"), "w", embed=None)

    def mine(between):
        real, run = e._mined, {}

        def mined(run_id, *args):
            out = real(run_id, *args)
            between(run_id)
            return out

        e._mined = mined
        try:
            run = e.dream(str(inbox), "/w", extract, decide, 10 * HOUR)
        finally:
            del e._mined
        return run

    def rival(run_id):
        runs = control.acquire(e.table("runs"), spark.createDataFrame([("w", "rival")], "workspace_id string, run_id string"), 20 * HOUR)
        e.store.commit({}, append={"runs": e._kept(e._changed("runs", runs), "rival")})

    with pytest.raises(store.Conflict, match="lost its claim"):
        mine(rival)
    assert e.list().count() == 0 and {r.run_id[-5:]: r.status for r in e.table("runs").collect()}["rival"] == "claimed"
    assert e.dream(str(inbox), "/w", extract, decide, 20 * HOUR) is None
    e.store.commit({}, append={"runs": e._kept(e._changed("runs", control.finish(e.table("runs"), "rival", "failed", 21 * HOUR)), "ended")})
    assert mine(lambda run_id: e.settled(1))["operations"] == 1 and e.table("state").first().generation == 1
    transcript(inbox / "b.jsonl", "s2", "prefer spaces")
    with pytest.raises(store.Conflict, match="log"):
        mine(lambda run_id: e.forget(1))
    assert audit.one(e.table("memories"), 1).first().state == "retired" and e.table("runs").filter("status in ('claimed', 'running')").isEmpty()
    assert [r.memory_id for r in e.every().collect()] == [1] and e.one(2).isEmpty()


def test_a_run_ends_with_its_time(spark, tmp_path):
    inbox = tmp_path / "in"
    transcript(inbox / "a.jsonl", "s1", "prefer tabs")
    e = E.Engine(spark, str(tmp_path / "root"), "w", embed=None, limits=replace(LIMITS, run_minutes=0))
    run = e.dream(str(inbox), "/w", extract, decide, 10 * HOUR)
    assert (run["sessions"], run["operations"], run["error"]) == (0, 0, None) and e.table("checkpoints").isEmpty()
    for _ in range(9):
        assert not e.settled(50 * HOUR)
    assert e.settled(50 * HOUR, True, str(inbox), "/w") and not e.settled(50 * HOUR, True, str(inbox), "/elsewhere")
    e.limits = LIMITS
    assert e.dream(str(inbox), "/w", extract, decide, 60 * HOUR)["sessions"] == 1
    for _ in range(9):
        e.settled(90 * HOUR)
    assert e.settled(90 * HOUR) and not e.settled(90 * HOUR, True, str(inbox), "/w")
    with pytest.raises(ValueError):
        e.pause()


def test_an_embedder_that_fails_keeps_what_was_done(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "node_id long, text string").coalesce(1)
    old = spark.createDataFrame([(2, "m", "old", [1.0]), (9, "other", "x", [1.0])], E.EMBEDDINGS)

    def embed(texts):
        if "bad" in texts:
            raise ValueError("too long")
        return [[1.0] for _ in texts]

    made = vectors.tried(vectors.stale(docs, old, "m").coalesce(1).sortWithinPartitions("node_id"), embed)
    assert [(r.node_id, r.error) for r in made.collect()] == [(1, None), (2, "too long")]
    after = vectors.merged(docs, old, made, "m")
    assert sorted((r.node_id, r.model_id) for r in after.collect()) == [(1, "m"), (9, "other")]
    assert sorted(r.node_id for r in vectors.stale(docs, after, "m").collect()) == [2, 3]


def test_a_cancelled_run_stops_and_commits_nothing(spark, tmp_path):
    inbox = tmp_path / "in"
    transcript(inbox / "a.jsonl", "s1", "prefer tabs")
    e = E.Engine(spark, str(tmp_path / "root"), "w", embed=None)
    begun = tmp_path / "begun"

    def waits(text, problem):
        begun.touch()
        time.sleep(600)

    abort = Abort(spark)

    def cancel():
        while not begun.exists():
            time.sleep(0.05)
        cancelled.append(time.time())
        abort.cancel("no longer wanted")

    cancelled: list[float] = []
    threading.Thread(target=cancel, daemon=True).start()
    real = e._failed
    ended = []
    e._failed = lambda *args: (ended.append(time.time()), real(*args))
    with pytest.raises(Aborted, match="no longer wanted"):
        e.dream(str(inbox), "/w", waits, decide, 10 * HOUR, abort)
    assert ended[0] - cancelled[0] < 1
    run = e.table("runs").first()
    assert (run.status, run.error) == ("failed", "no longer wanted") and e.every().isEmpty() and e.table("checkpoints").isEmpty() and e.table("log").isEmpty()
    with pytest.raises(Aborted, match="over 0.2 seconds"), Abort(spark, 0.2):
        spark.range(4).repartition(4).mapInPandas(lambda frames: (time.sleep(30) or f for f in frames), "id long").count()
    with pytest.raises(Aborted):
        abort.check()
    assert spark.range(3).count() == 3
