"""Session files as data sources that Spark plans over: a batch source of their headers and a stream of those that changed.

`loam_sessions` lists *.jsonl files below a folder and yields a row each: path, mtime_ms, length, and cwd, session_id of the header. Filters on
path, mtime_ms and length are pushed into the listing, those on cwd into the read, which takes the first 8 KiB of a file and no
more. With the option `worktrees` (a JSON list of folders) only sessions within one of them are yielded, and `worktree` names the innermost.

`loam_session_stream` yields (path, mtime_ms, length, content) of files that are new or have grown. Unlike Spark's file stream
it yields a path again when its time changes; a file whose time equals the last batch's may come twice, which the cursor in `streaming.ingest` tells.

Both read through pyarrow's file systems: local folders, HDFS, S3.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

HEADER_BYTES = 8192  # fixed value
FILES_A_TASK = 256
SCHEMA = "path string, mtime_ms long, length long, cwd string, session_id string, worktree string"
STREAM = "path string, mtime_ms long, length long, content binary"


class Worktrees:
    """Folders as a trie of path components: which one a working directory lies in, the innermost of several."""

    def __init__(self, folders: Iterable[str]) -> None:
        self.root: dict = {}
        for folder in folders:
            node = self.root
            for part in self._parts(folder):
                node = node.setdefault(part, {})
            node[None] = folder

    @staticmethod
    def _parts(path: str) -> list[str]:
        out: list[str] = []
        for part in path.replace("\\", "/").split("/"):
            if part == "..":
                out = out[:-1]
            elif part not in ("", "."):
                out.append(part)
        return out

    def resolve(self, cwd: str | None) -> str | None:
        if not cwd:
            return None
        node, found = self.root, self.root.get(None)
        for part in self._parts(cwd):
            node = node.get(part)
            if node is None:
                break
            found = node.get(None, found)
        return found


def _filesystem(path: str):
    """(file system, path in it, what comes before a path so that Spark reads it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, mtime_ms, length) of the session files below a folder, each once."""
    from pyarrow import fs

    system, inner, before = _filesystem(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(f"folder {path} does not exist")
    found = {}
    for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
        if info.type == fs.FileType.File and info.path.endswith(".jsonl"):
            found[before + info.path] = (before + info.path, info.mtime_ns // 1_000_000, info.size)
    return sorted(found.values())


def _opened(path: str):
    system, inner, _ = _filesystem(path)
    return system.open_input_stream(inner)


def header(raw: bytes) -> tuple[str, str | None] | None:
    """(cwd, id) of the first session line with a cwd in the first bytes of a file; None on anything else."""
    for line in raw[:HEADER_BYTES].decode("utf-8", "replace").split("\n"):
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict) and entry.get("type") == "session" and isinstance(entry.get("cwd"), str) and entry["cwd"]:
            return entry["cwd"], entry["id"] if isinstance(entry.get("id"), str) else None
    return None


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.files = files


def _partitions(files: list[tuple[str, int, int]]) -> list[Files]:
    return [Files(files[a : a + FILES_A_TASK]) for a in range(0, len(files), FILES_A_TASK)] or [Files([])]


#: Pushed comparisons of numbers and strings with a literal.
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
_LISTED = ("path", "mtime_ms", "length")


class SessionReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.worktrees = json.loads(options["worktrees"]) if options.get("worktrees") else None
        self.of_list: list[tuple[int, type, object]] = []
        self.of_header: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and name in _LISTED:
                self.of_list.append((_LISTED.index(name), type(f), f.value))
            elif type(f) in (EqualTo, In) and name == "cwd":
                self.of_header.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = listed(self.path)
        for k, kind, value in self.of_list:
            files = [f for f in files if _TESTS[kind](f[k], value)]
        return _partitions(files)

    def read(self, partition: Files) -> Iterator[tuple]:
        trees = Worktrees(self.worktrees) if self.worktrees is not None else None
        for path, mtime, length in partition.files:
            try:
                with _opened(path) as stream:
                    found = header(stream.read(HEADER_BYTES))
            except OSError:  # gone or unreadable: no session
                continue
            cwd, session_id = found or (None, None)
            tree = trees.resolve(cwd) if trees else None
            if trees is not None and tree is None or any(cwd is None or not _TESTS[kind](cwd, value) for kind, value in self.of_header):
                continue
            yield path, mtime, length, cwd, session_id, tree


class Sessions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loam_sessions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options)


class ChangedReader(DataSourceStreamReader):
    """Offsets are times: a batch holds the files whose time lies from the last offset's, included, to its own."""

    def __init__(self, options) -> None:
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"mtime_ms": -1}

    def latestOffset(self) -> dict:
        return {"mtime_ms": max((f[1] for f in listed(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _partitions([f for f in listed(self.path) if start["mtime_ms"] <= f[1] <= end["mtime_ms"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, mtime, length in partition.files:
            try:
                with _opened(path) as stream:
                    yield path, mtime, length, stream.read()
            except OSError:
                continue


class ChangedSessions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loam_session_stream"

    def schema(self) -> str:
        return STREAM

    def streamReader(self, schema) -> ChangedReader:
        return ChangedReader(self.options)


def with_bodies(files: DataFrame, most: int, content: bool = True) -> DataFrame:
    """files (path, ...) with content_hash, and content: read in tasks, one file at a time. One over `most` bytes stops the job; one that is gone is left out."""
    kind = T.StructType([*files.schema.fields, T.StructField("content_hash", T.StringType()), *([T.StructField("content", T.BinaryType())] if content else [])])
    at = files.columns.index("path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(at).to_pylist()):
                try:
                    with _opened(path) as stream:
                        body = stream.read(most + 1)
                except OSError:
                    continue
                if len(body) > most:
                    raise ValueError(f"session file too large: {path}")
                more = [pa.array([hashlib.sha256(body).hexdigest()])] + ([pa.array([body], pa.binary())] if content else [])
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *more], names=kind.names)

    return files.mapInArrow(work, kind)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, with filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sessions)
    spark.dataSource.register(ChangedSessions)
