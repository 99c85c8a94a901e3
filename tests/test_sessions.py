"""The session source and the stateful cursor."""

import json
import os

from pyspark.sql import functions as F

from loam.operators import store
from loam.sources import sessions
from loam.streaming import cursor


def lines(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def said(text, role="user"):
    return {"type": "message", "message": {"role": role, "content": text}}


def write(path, text, at):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_worktrees_resolve_by_components():
    trees = sessions.Worktrees(["/a/b", "/a/b/c", "/x", "C:\\w"])
    found = [trees.resolve(x) for x in ("/a/b", "/a/b/", "/a/bc", "/a/b/c/d", "/a/b/d", "/a", "/x/../a/b/./q", "c:/w", "C:\\w\\z", None, "")]
    assert found == ["/a/b", "/a/b", None, "/a/b/c", "/a/b", None, "/a/b", None, "C:\\w", None, None]
    assert sessions.Worktrees(["/"]).resolve("/any") == "/" and sessions.Worktrees([]).resolve("/any") is None


def test_source_reads_headers_and_takes_filters(spark, tmp_path, monkeypatch):
    sessions.register(spark)
    head = lambda cwd, i: lines({"type": "other"}, {"type": "session", "cwd": cwd, "id": i})
    write(tmp_path / "in" / "a.jsonl", head("/w/one", "s1"), 1000)
    write(tmp_path / "in" / "deep" / "b.jsonl", head("/w/two/sub", "s2") + "x" * 20_000, 2000)
    write(tmp_path / "in" / "c.jsonl", "x" * 9000 + "\n" + head("/w/one", "late"), 3000)  # its header lies beyond 8 KiB
    write(tmp_path / "in" / "d.jsonl", head("/elsewhere", None), 4000)
    write(tmp_path / "in" / "e.txt", head("/w/one", "no"), 4000)
    read = lambda **o: spark.read.format("loam_sessions").option("path", str(tmp_path / "in")).options(**o).load()
    rows = {r.session_id: r for r in read().collect() if r.session_id}
    assert rows.keys() == {"s1", "s2"} and rows["s1"].mtime_ms == 1_000_000 and rows["s1"].path == f"file:{tmp_path}/in/a.jsonl" and read().count() == 4
    assert [r.session_id for r in read().filter("cwd = '/w/one'").collect()] == ["s1"]
    late = read().filter("mtime_ms > 1000000 AND cwd IN ('/w/one', '/w/two/sub')")
    assert [r.session_id for r in late.collect()] == ["s2"]
    trees = read(worktrees=json.dumps(["/w/two", "/w/one"])).collect()
    assert sorted((r.session_id, r.worktree) for r in trees) == [("s1", "/w/one"), ("s2", "/w/two")]
    reader = sessions.SessionReader({"path": str(tmp_path / "in")})
    kept = list(reader.pushFilters([sessions.GreaterThan(("mtime_ms",), 1_500_000), sessions.EqualTo(("cwd",), "/w/one"), sessions.EqualTo(("session_id",), "s1")]))
    assert len(kept) == 1 and sum(len(p.files) for p in reader.partitions()) == 3


def test_cursor_takes_only_what_is_new(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "store"))
    path = tmp_path / "in" / "a.jsonl"
    go = lambda: cursor.follow(spark, str(tmp_path / "in"), s, str(tmp_path / "state")).awaitTermination(120)
    texts = lambda: [(r.segment_no, r.start_index, r.end_index, r.text) for r in cursor.current_segments(s).orderBy("segment_no").collect()]
    call = {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "t1", "name": "bash", "arguments": {}}]}}
    first = lines({"type": "session", "cwd": "/w", "id": "s"}, said("one"), call)
    write(path, first + '{"type": "mess', 1000)  # the last line is being written
    go()
    assert texts() == [(0, 0, 2, "[0] user:\none\n\n[1] assistant:\n[toolCall bash {}]")]
    result = {"type": "message", "message": {"role": "toolResult", "toolCallId": "t1", "content": "done"}}
    write(path, first + lines(said("two"), result), 2000)
    go()
    assert texts()[1:] == [(1, 2, 4, "[2] user:\ntwo\n\n[3] toolResult:\n[toolResult bash done]")]  # the call's name comes from the state
    go()
    os.utime(path, (2500, 2500))  # touched, not changed
    go()
    assert len(texts()) == 2 and len(s.paths()["segments"]) == 3
    write(path, lines({"type": "session", "cwd": "/w", "id": "s"}, said("other")), 3000)  # rewritten
    go()
    assert texts() == [(0, 0, 1, "[0] user:\nother")] and s.read("segments").count() == 3
    tail = spark.createDataFrame([(f"file:{path}", 3000, s.read("checkpoints").orderBy(F.desc("seq")).first().content_hash, 1, 0, b"{}", "{}")], cursor.TAIL)
    assert cursor.commit_tails(s, tail) == 0  # a batch that comes again


def test_parts_of_files():
    assert cursor.complete_part(b'{"a": 1}\n{"b"', 0) == 9 and cursor.complete_part(b'{"a": 1}\n{"b": 2}', 0) == 17 and cursor.complete_part(b'{"a', 0) == 0
    made, asked = cursor.tool_calls(lines({"message": {"role": "assistant", "content": [{"type": "toolCall", "id": "a", "name": "n"}, {"type": "text"}]}}, {"message": {"role": "toolResult", "toolCallId": "z"}}, {"message": 5}).encode() + b"junk")
    assert made == {"a": "n"} and asked == {"z"}
