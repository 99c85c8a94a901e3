import json

import pytest
from pyspark.sql import functions as F

from loam.operators import control, synthesis
from loam.sources import manifest

REQUESTS = "request_id long, purpose string, request string, payload string, payload_ids array<string>, context_window long, most_output long"


def complete(purpose, text):
    """A model that does what the request says, and reads the note on its last answer."""
    asked = text.split("<request>\n")[1].split("\n</request>")[0]
    if asked == "fail":
        raise RuntimeError("no provider")
    if asked == "nonsense":
        return "I would rather not"
    if asked == "learn" and "was not accepted" not in text:
        return json.dumps({"content": "uses tabs", "sources": ["M:77"]})
    if asked == "number":
        return json.dumps({"content": 7, "sources": ["M:1"]})
    if asked == "nothing":
        return json.dumps({"content": synthesis.NOTHING_FOUND, "sources": []})
    return "Here it is:\n```json\n" + json.dumps({"content": "uses tabs", "sources": ["M:1", "M:2"]}) + "\n```"


@pytest.fixture(scope="module")
def results(spark):
    rows = [(1, "briefing", "do"), (2, "search", "learn"), (3, "briefing", "nonsense"), (4, "search", "fail"), (5, "search", "nothing"), (6, "briefing", "number")]
    rows = [(*r, "- M:1: a\n- M:2: b", ["M:1", "M:2"], None, None) for r in rows]
    rows += [(7, "search", "do", "", [], None, None), (8, "search", "do", "- M:1: a", ["M:1"], 100, None), (9, "search", None, None, None, None, None)]
    return synthesis.synthesize(spark.createDataFrame(rows, REQUESTS), complete)


def test_requests_are_answered_with_one_retry_at_most(results):
    got = {r.request_id: (r.error, r.sources, r.calls) for r in results.collect()}
    assert got == {
        1: (None, ["M:1", "M:2"], 1),
        2: (None, ["M:1", "M:2"], 2),
        3: ("malformed", None, 2),
        4: ("provider_error", None, 1),
        5: (None, [], 1),
        6: ("malformed", None, 2),
        7: ("no_memories", None, 0),
        8: ("provider_context_insufficient", None, 0),
        9: ("no_memories", None, 0),
    }


def test_changed_sources_fail_their_answers_alone(spark, results):
    shown = spark.createDataFrame([(i, m, "old") for i in range(1, 7) for m in (1, 2)], "request_id long, memory_id long, text string")
    memories = lambda *texts: spark.createDataFrame([(k + 1, t, "active") for k, t in enumerate(texts)], "memory_id long, text string, state string")
    same = synthesis.revalidated(results, shown, memories("old", "old"))
    assert {r.request_id for r in same.filter("error is null").collect()} == {1, 2, 5}
    assert sorted((r.request_id, r.memory_id, r.source) for r in synthesis.citations(same).collect()) == [(1, 1, "briefing"), (1, 2, "briefing"), (2, 1, "search"), (2, 2, "search")]
    new = {r.request_id: r for r in synthesis.revalidated(results, shown, memories("old", "new")).collect()}
    assert new[1].error == new[2].error == "stale_source" and new[1].detail == "M:2" and new[1].content is None and new[5].error is None


def test_briefing_leaves_blank_parts_out(spark):
    df = spark.createDataFrame([(1, " tabs ", None), (2, "", " said\n"), (3, None, None)], "k int, p string, a string")
    got = {r.k: r.m for r in df.select("k", synthesis.briefing_message(F.col("p"), F.col("a")).alias("m")).collect()}
    assert got[1] == f"{synthesis.PREFERENCES_HEADING}\n\ntabs\n\n{synthesis.SEARCH_HINT}"
    assert got[2] == f"{synthesis.CONTEXT_HEADING}\n\nsaid\n\n{synthesis.SEARCH_HINT}" and got[3] == synthesis.SEARCH_HINT


def test_manifests(spark, tmp_path):
    due = spark.createDataFrame([("s1", "/p", "/c", 5, bytearray(b"abc"), 3), ("s2", "/q", "/c", 6, bytearray(b""), None)], "session_id string, path string, cwd string, mtime_ms long, content binary, start_offset long")
    manifest.save(manifest.snapshot(due, f"{tmp_path}/snap"), f"{tmp_path}/manifest")
    got = {r.session_id: r for r in manifest.load(spark, f"{tmp_path}/manifest").collect()}
    assert got["s1"].mined_offset == 3 and got["s2"].mined_offset == 0 and got["s1"].content_hash.startswith("ba7816bf")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"session_id": "s", "snapshot_path": "p"}\n')
    with pytest.raises(Exception, match="without a snapshot"):
        manifest.load(spark, f"{tmp_path}/bad").collect()


def test_claims(spark):
    runs = spark.createDataFrame([("a", "r1", "running", 0, None, False), ("b", "r2", "running", 950, None, False), ("c", "r3", "claimed", None, None, False), ("d", "r4", "failed", 1, 2, False), ("d", "r5", "completed", 1, 1, False)], "workspace_id string, run_id string, status string, started_ms long, finished_ms long, reported boolean")
    claims = spark.createDataFrame([(w, f"n{w}{k}") for w in "abcd" for k in (1, 2)], "workspace_id string, run_id string")
    got = control.acquire(runs, claims, 1000, 100)
    assert {r.run_id: (r.status, r.finished_ms) for r in got.collect()} == {"r1": ("failed", 1000), "r2": ("running", None), "r3": ("failed", 1000), "r4": ("failed", 2), "r5": ("completed", 1), "na1": ("claimed", None), "nc1": ("claimed", None), "nd1": ("claimed", None)}
    assert {r.run_id for r in control.start(got, "na1").filter("status = 'running'").collect()} == {"na1", "r2"}
    assert [r.run_id for r in control.report_next(runs).filter("reported").collect()] == ["r5"]
