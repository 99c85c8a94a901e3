import hashlib

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(f(*(F.col(n) for n in names)).alias("x")).first()
    return row.x


@pytest.mark.parametrize(("raw", "want"), [("  Prefer\t tabs \n over ", "prefer tabs over"), ("﻿a b", "a b"), ("", ""), (None, None)])
def test_normalise(spark, raw, want):
    assert one(spark, T.normalise, raw) == want


def test_terms_and_match(spark):
    assert one(spark, T.terms, 'Tabs AND "quotes" héllo-42') == ["tabs", "and", "quotes", "héllo", "42"]
    assert one(spark, T.search_terms, "Héllo ÑANDÚ") == ["hello", "nandu"]
    assert one(spark, T.match_expression, "a b!") == '"a" OR "b"' and one(spark, T.match_expression, "?!") is None


def test_redaction(spark):
    text = "Bearer abcdefgh12 token = \"0123456789\" sk-ABCDEFGHIJKLMNOP1 postgres://u:p@h/db\n-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----\nCookie: a=b; c"
    got = one(spark, T.redact, text)
    for gone in ("abcdefgh12", "0123456789", "ABCDEFGHIJKLMNOP1", "u:p@h", "a=b", "\nx\n"):
        assert gone not in got
    assert one(spark, T.redact, "étoken=12345678 mytoken=12345678") == "é[REDACTED_SECRET] mytoken=12345678"


def test_edges(spark):
    assert one(spark, lambda x: T.keep_edges(x, 5), "abcdefghij") == "abc…[5 chars omitted]…ij"
    assert one(spark, lambda x: T.keep_edges(x, 10), "abcdefghij") == "abcdefghij"


def test_bodies(spark):
    assert one(spark, T.body_error, " ") == "Memory text must be non-empty"
    assert one(spark, T.body_error, "a\nb") == "Memory text must be a single line"
    assert one(spark, T.body_error, "x" * 401) == "Memory text exceeds 400 characters"
    assert one(spark, T.body_error, " " + "x" * 400 + "\n") is None


@pytest.mark.parametrize(("raw", "want"), [("M:12", 12), (" M:5 ", 5), ("O:x", None), ("O:1", None), ("S:3", None), ("M:0", None), ("M:x", None), ("M:99999999999999999999", None)])
def test_ids(spark, raw, want):
    assert one(spark, T.parse_id, raw) == want
    assert (one(spark, T.id_error, raw) is None) == (want is not None)


@pytest.mark.parametrize(("raw", "greeting", "skip"), [("hi", True, True), ("Hello!", True, True), ("good morning", True, True), ("hey, what's up?", True, True), ("hi, add caching to the API", False, False), ("hello world", False, False), ("", False, True), ("ok", False, True)])
def test_greetings(spark, raw, greeting, skip):
    assert one(spark, T.greeting_only, raw) == greeting and one(spark, T.skips_retrieval, raw) == skip


@pytest.mark.parametrize("raw", ["git@GitHub.com:Org/Repo.git", "https://github.com/org/repo", "https://GITHUB.com/Org/Repo.git/", "ssh://git@github.com/org/repo.git"])
def test_remotes(spark, raw):
    assert one(spark, T.canonical_remote, raw) == "github.com/org/repo"
    assert one(spark, T.canonical_remote, "nonsense") is None


def test_rendering(spark):
    line = lambda *c: T.payload_line(F.lit(7), F.lit("preference"), *c[:1], F.lit(3), *c[1:])
    assert one(spark, line, "active", "Do not use emoji in commits") == "- M:7 (preference, r=3): Do not use emoji in commits"
    assert one(spark, line, "retired", "x") == "- M:7 (preference, retired, r=3): x"
    assert one(spark, T.session_dir_name, "/home/a/b:c") == "--home-a-b-c--"
    assert one(spark, T.json_object, '```json\n{"a": 1}\n```') is not None and one(spark, T.json_object, "[1]") is None


@pytest.mark.parametrize(("remote", "common", "cwd", "source", "name"), [("git@GitHub.com:Org/My Repo.git", "/x", "/y", "github.com/org/my repo", "my-repo"), ("nonsense", "/a/b.git/", "/y", "/a/b.git/", "b"), (None, None, "/", "/", "workspace"), (None, None, "/a/--" + "é" * 3 + "x" * 40, None, "x" * 32)])
def test_workspace_ids(spark, remote, common, cwd, source, name):
    got = one(spark, T.workspace_id, remote, common, cwd)
    assert got == hashlib.sha256((source or cwd).encode()).hexdigest()[:12] + "_" + name
