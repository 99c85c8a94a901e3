import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions.text import match_expression, significant
from loam.operators import budgets, embedder, index, lexical, retrieval, vectors


def plain_greedy(lengths, most, units):
    kept, used = [], 0
    for k, n in enumerate(lengths):
        if len(kept) < units and used + n <= most:
            kept.append(k)
            used += n
    return kept


def plain_bins(lengths, most, items):
    bins, used = [], 0
    for n in lengths:
        if not bins or used + n > most or len(bins[-1]) >= items:
            bins.append([])
            used = 0
        bins[-1].append(n)
        used += n
    return bins


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=20))
def test_folds_match_plain_loops(spark, lists):
    df = spark.createDataFrame([(k, [(i, n) for i, n in enumerate(own)]) for k, own in enumerate(lists)], "k int, items array<struct<i:int,n:int>>")
    got = df.select("k", budgets.greedy_budget(F.col("items"), lambda x: x["n"], 40, 3).alias("g"), budgets.fill_bins(F.col("items"), lambda x: x["n"], 40, 3).alias("b")).collect()
    for r in got:
        assert [x.i for x in r.g] == plain_greedy(lists[r.k], 40, 3)
        assert [[x.n for x in b] for b in r.b] == plain_bins(lists[r.k], 40, 3)


def test_prefix_budget_stops_and_greedy_skips(spark):
    df = spark.createDataFrame([(1, 10), (2, 50), (3, 5)], "id int, n int").withColumn("k", F.lit(1))
    assert [r.id for r in budgets.prefix_budget(df, ["k"], ["id"], "n", 40, 9).collect()] == [1]


def test_bm25_is_that_of_a_full_text_index(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(r.doc_id + 1, r.text) for r in rows])
    docs = spark.createDataFrame([(r.doc_id + 1, r.text) for r in rows], "node_id long, text string")
    asked = [(1, "the of and"), (2, "élle de la keit"), (3, "thing thing ing"), (4, "zzzz")]
    queries = spark.createDataFrame(asked, "query_id long, text string").withColumn("segment_no", F.lit(0))
    got = {(r.query_id, r.node_id): r.score for r in lexical.bm25(docs, queries).collect()}
    for n, text in asked:
        match = spark.createDataFrame([(text,)], "t string").select(match_expression(F.col("t"))).first()[0]
        want = {(n, i): -s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert {k: v for k, v in got.items() if k[0] == n}.keys() == want.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_segments(spark):
    text = "One. Two two! Three?\nFour\n\n" + "x" * 30 + ". Five"
    got = spark.createDataFrame([(text,), ("  ",)], "t string").select(retrieval.segments(F.col("t"), 14).alias("s")).collect()
    assert got[0].s == ["One. Two two!", "Three? Four", "x" * 30 + ".", "Five"] and got[1].s == []


TOPICS = {"tabs": 0, "indentation": 0, "caching": 1, "cache": 1, "caches": 1, "ci": 2, "pnpm": 3}


def embed(text):
    v = np.zeros(4)
    for w in text.lower().split():
        if w in TOPICS:
            v[TOPICS[w]] += 1
    n = np.linalg.norm(v)
    return [float(x) for x in v / n] if n else None


def search(spark, query, memories, limits=None, semantic=True):
    rows = spark.createDataFrame([(k + 1, t, s) for k, (t, s) in enumerate(memories)], "node_id long, text string, state string")
    queries = spark.createDataFrame([(1, query)], "query_id long, text string")
    found = [(k + 1, embed(t)) for k, (t, _) in enumerate(memories) if embed(t)]
    stored = spark.createDataFrame(found, "node_id long, vector array<double>") if semantic and found else None
    asked = spark.createDataFrame([(1, 0, embed(query))], "query_id long, segment_no int, vector array<double>") if semantic and embed(query) else None
    kw = {"limits": limits} if limits else {}
    return retrieval.retrieve(rows, queries, stored, asked, **kw).orderBy("place").collect()


def test_retrieval_fuses_both_rankers(spark):
    memories = [("Prefer tabs over spaces", "active"), ("CI caches pnpm", "active"), ("Deploy to the edge", "active")]
    got = search(spark, "tabs and caching", memories)
    assert [r.node_id for r in got] == [1, 2]
    assert got[0].lexical_rank and got[0].semantic_rank and got[1].lexical_rank is None and got[1].semantic_rank == 2
    assert got[0].score == pytest.approx(2 / 61)
    assert search(spark, "quick brown fox jumps", memories) == [] and search(spark, "good morning!", memories) == []
    assert [r.node_id for r in search(spark, "edge AND \"OR", [*memories[:2], (memories[2][0], "retired")])] == []


def test_caps(spark):
    from loam.session import Limits

    many = [(f"shared topic number {k}", "active") for k in range(20)]
    assert len(search(spark, "shared topic", many, Limits(retrieval_units=10), semantic=False)) == 10
    mixed = [("shared topic " + "x" * 387, "active")] + [(f"shared topic {k}", "active") for k in range(5)]
    assert sorted(r.node_id for r in search(spark, "shared topic", mixed, Limits(retrieval_chars=300), semantic=False)) == [2, 3, 4, 5, 6]


def test_cosine_tiles_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [(60, None), (61, []), (62, [0.0] * 5), (63, [1.0, 2.0])]
    stored = spark.createDataFrame(rows, "node_id long, vector array<float>")
    asked = stored.filter("node_id < 12").select(F.col("node_id").alias("query_id"), F.lit(0).alias("segment_no"), "vector")
    whole = sorted(map(tuple, vectors.cosine_hits(stored, asked).collect()))
    monkeypatch.setattr(vectors, "TILE", 5)
    assert [w[:3] for w in whole] == [w[:3] for w in sorted(map(tuple, vectors.cosine_hits(stored, asked).collect()))]
    assert all(s >= 0.15 for *_, s in whole) and {n for _, _, n, _ in whole} <= set(range(60)) | {63}


def test_embeddings_are_refreshed_by_hash(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None if False else "none")], "node_id long, text string")
    empty = spark.createDataFrame([], "node_id long, model_id string, content_hash string, vector array<float>")
    first = vectors.refresh(docs, empty, "m", lambda texts: [None if t == "none" else [float(len(t)), 1.0] for t in texts])
    assert {r.node_id for r in first.collect()} == {1, 2}
    changed = docs.withColumn("text", F.when(F.col("node_id") == 2, "bb").otherwise(F.col("text")))
    assert {r.node_id for r in vectors.stale(changed, first, "m").collect()} == {2, 3}


def test_common_terms_rank_by_score(spark):
    """A term of over half of the documents weighs 1e-6: scores lie close together, and still order the hits."""
    docs = spark.createDataFrame([(1, "the cat sat by the door of the house"), (2, "the dog"), (3, "the the the bird of"), (4, "over the hill and far away the wind"), (5, "the end of the day of")], "node_id long, text string")
    asked = spark.createDataFrame([(1, 0, "the"), (2, 0, "the of and")], "query_id long, segment_no int, text string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    for r in docs.collect():
        con.execute("INSERT INTO f(rowid, t) VALUES (?, ?)", (r.node_id, r.text))
    got = lexical.ranked(lexical.bm25(docs, asked)).orderBy("query_id", "rank").collect()
    for q, match in ((1, '"the"'), (2, '"the" OR "of" OR "and"')):
        want = [r[0] for r in con.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rank, rowid", (match,))]
        assert [r.node_id for r in got if r.query_id == q] == want
    assert [r.x for r in spark.createDataFrame([(1.2345678901234e-6,), (987.65432109876543,)], "v double").select(significant(F.col("v"), 4).alias("x")).collect()] == [1.235e-6, 987.7]


def test_cells_change_nothing_and_keep_the_best(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(120)] + [(200, None), (201, "w1 w2"), (202, "w2 w1")], "node_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, k % 2, " ".join(rng.choices(words, k=12))) for k in range(9)] + [(50, 0, "unknown"), (51, 0, None)], "query_id long, segment_no int, text string")
    whole = {tuple(r)[:3]: r.score for r in lexical.bm25(docs, asked).collect()}
    for name, value in (("SHARD_TERMS", 300), ("TILE_TERMS", 30), ("CELLS", 7)):
        monkeypatch.setattr(lexical, name, value)
    small = {tuple(r)[:3]: r.score for r in lexical.bm25(docs, asked).collect()}
    assert small.keys() == whole.keys() and all(abs(small[k] - whole[k]) < 1e-12 for k in whole)
    best = lexical.ranked(lexical.bm25(docs, asked, most=5), most=5).select("query_id", "segment_no", "node_id", "rank")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, lexical.ranked(lexical.bm25(docs, asked), most=5).select("query_id", "segment_no", "node_id", "rank").collect()))


def _searched(spark, n_queries=12):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(150)], "node_id long, text string")
    asked = spark.createDataFrame([(k % 4, k // 4, " ".join(rng.choices(words, k=2 + k))) for k in range(n_queries)], "query_id long, segment_no int, text string")
    return docs, asked


def test_no_more_hits_than_asked_for_leave_the_search(spark, monkeypatch):
    """Documents are not copied for each tile, and their parts' hits are ranked before they are handed on."""
    docs, asked = _searched(spark)
    monkeypatch.setattr(lexical, "SHARD_TERMS", 200)
    monkeypatch.setattr(lexical, "TILE_QUERIES", 5)
    rows = lexical.bm25(docs, asked, most=5).groupBy("query_id", "segment_no").count().collect()
    assert len(rows) == 12 and all(r["count"] == 5 for r in rows)


def test_segments_beyond_the_quota_are_not_searched(spark, monkeypatch):
    docs, asked = _searched(spark)
    key = ["query_id", "segment_no", "node_id", "rank"]
    every, some = (lexical.ranked(lexical.bm25(docs, asked, most=m, shared=shared), most=m).select(*key) for m, shared in ((40, False), (40, True)))
    assert some.select("segment_no").distinct().count() < 3 == every.select("segment_no").distinct().count()
    rows = lambda hits: sorted(map(tuple, lexical.quota(hits, most=40).collect()))
    assert rows(some) == rows(every) and len(rows(some)) >= 80


def test_dense_terms_change_nothing(spark, monkeypatch):
    docs, asked = _searched(spark)
    key = ["query_id", "segment_no", "node_id", "rank"]
    found = []
    for share in (0.0, 2.0):  # all terms, none
        monkeypatch.setattr(lexical, "DENSE", share)
        found.append(sorted(map(tuple, lexical.ranked(lexical.bm25(docs, asked, most=7), most=7).select(*key).collect())))
    assert found[0] == found[1]


def test_index_is_a_scan_after_every_commit_and_reads_less(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "PIECE", 60)
    monkeypatch.setattr(index, "SMALL", 0)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(25)]
    text = lambda: "common " * rng.randint(1, 3) + " ".join(rng.choices(words, k=rng.randint(1, 25)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "node_id long, text string")
    now = {k: text() for k in range(150)}
    postings, stats = index.build(frame(now), 1)
    asked = spark.createDataFrame([(1, 0, "common w1"), (2, 0, "w2 w3 w3"), (3, 0, "w4 common w5 w6"), (4, 0, "nothing")], "query_id long, segment_no int, text string")
    for seq in (2, 3, 4):
        touched = rng.sample(sorted(now), 20)
        before = {k: now[k] for k in touched}
        after = {k: text() for k in touched[:12]} | {1000 + 10 * seq + k: text() for k in range(5)} | {touched[12]: now[touched[12]]}
        for k in touched:
            del now[k]
        now |= after
        more, moved = index.changes(frame(before), frame(after), seq, stats)
        postings = spark.createDataFrame(postings.unionByName(more).collect(), index.POSTINGS)
        stats = spark.createDataFrame(stats.unionByName(moved).collect(), index.STATS)
    want = lexical.ranked(lexical.bm25(frame(now), asked), most=6)
    check = lambda p: sorted((r.query_id, r["rank"], r.node_id, round(r.score, 9)) for r in index.search(p, stats, asked, 6).collect())
    expected = sorted((r.query_id, r["rank"], r.node_id, round(r.score, 9)) for r in want.collect())
    assert check(postings) == expected and len(expected) == 18
    small = spark.createDataFrame(index.compacted(postings, stats).collect(), index.POSTINGS)
    assert check(small) == expected and small.filter("sign < 0").isEmpty() and small.agg(F.sum("n")).first()[0] < postings.agg(F.sum("n")).first()[0]
    two = spark.createDataFrame([(1, 0, "w1", 1), (1, 0, "w2", 1)], "query_id long, segment_no int, term string, times long")
    own = small.filter(F.col("term").isin("w1", "w2"))
    n, avg = index.average(stats)
    bound = index.bounded(own, index.weights(own, two, n), avg)
    third = lexical.ranked(lexical.bm25(frame(now), spark.createDataFrame([(1, 0, "w1 w2")], "query_id long, segment_no int, text string"))).filter("rank = 3").select("query_id", "segment_no", F.col("score").alias("reached"))
    assert index.first_blocks(bound, 3).count() <= 4
    one = index.bounded(own, index.weights(own, two.filter("term = 'w1'"), n), avg)
    best = index.scored(own, None, index.weights(own, two.filter("term = 'w1'"), n), avg, 3).filter("rank = 3").select("query_id", "segment_no", F.col("score").alias("reached"))
    assert 0 < index.needed(one, best).count() <= one.count() / 3
    assert 0 < index.needed(bound, third).count() < own.count() and index.needed(bound, third.limit(0)).count() == own.count()


def test_many_queries_meet_the_index_by_documents(spark, monkeypatch):
    """Postings are not joined to the queries one by one, dead ones stay out, and the hits are those of the bounded search."""
    docs, asked = _searched(spark)
    before = docs.filter("node_id < 40")
    after = before.filter("node_id < 30").withColumn("text", F.concat("text", F.lit(" w1 w1 w2")))
    first, moved = index.build(docs, 1)
    more, also = index.changes(before, after, 2, moved)
    postings = spark.createDataFrame(first.unionByName(more).collect(), index.POSTINGS)
    stats = spark.createDataFrame(moved.unionByName(also).collect(), index.STATS)
    found = lambda: sorted((r.query_id, r.segment_no, r["rank"], r.node_id, round(r.score, 9)) for r in index.search(postings, stats, asked, 2).collect())
    few = found()
    monkeypatch.setattr(index, "MANY", 100)
    monkeypatch.setattr(index, "scored", None)
    assert found() == few and len(few) == 24


def test_terms_are_counted_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_TERMS", 4)
    texts = ["a b a Ä", None, "", "?!", "c " * 9, "b"]
    docs = spark.createDataFrame([(k, t, -1) for k, t in enumerate(texts)], "node_id long, text string, sign int").coalesce(1)
    got = {r.node_id: (dict(zip(r.terms, r.tfs, strict=True)), r.doc_len, r.sign) for r in lexical.counted(docs).collect()}
    assert got == {0: ({"a": 3, "b": 1}, 4, -1), 1: ({}, 0, -1), 2: ({}, 0, -1), 3: ({}, 0, -1), 4: ({"c": 9}, 9, -1), 5: ({"b": 1}, 1, -1)}


def test_postings_are_packed_across_batches(spark, monkeypatch):
    """Blocks and documents that lie in several Arrow batches come out whole, as without such cuts."""
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "PIECE", 60)
    monkeypatch.setattr(index, "MANY", 100)
    docs, asked = _searched(spark)
    gone = docs.filter("node_id % 5 = 0")
    left = docs.join(gone, "node_id", "left_anti")
    want = sorted((r.query_id, r.segment_no, r["rank"], r.node_id, round(r.score, 9)) for r in lexical.ranked(lexical.bm25(left, asked, most=4), most=4).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        first, stats = index.build(docs, 1)
        rows = first.collect()
        more, moved = index.changes(gone, docs.limit(0), 2, stats)
        got = index.search(first.unionByName(more), stats.unionByName(moved), asked, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.query_id, r.segment_no, r["rank"], r.node_id, round(r.score, 9)) for r in got) == want
    blocks = {}
    for r in rows:
        assert r.n == len(r.nodes) <= 8 and r.nodes == sorted(r.nodes) and (r.max_tf, r.min_tf, r.max_len, r.min_len) == (max(r.tfs), min(r.tfs), max(r.lens), min(r.lens))
        blocks.setdefault((r.term, r.piece), []).append((r.block, r.n))
    assert all([b for b, _ in sorted(own)] == list(range(len(own))) and all(n == 8 for _, n in sorted(own)[:-1]) for own in blocks.values())
    assert max(p for _, p in blocks) > 0


def test_streamed_folds_are_the_plain_loops(spark):
    rng = random.Random(2)
    lists = [[rng.randint(0, 30) for _ in range(rng.randint(0, 50))] for _ in range(12)] + [[1] * 3000]
    rows = [(k if k else None, i, n) for k, own in enumerate(lists) for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "k int, i int, n long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        greedy = sorted(((r.k or 0), r.place, r.i) for r in budgets.greedy_rows(df, ["k"], ["i"], "n", 40, 5).collect())
        bins = sorted(((r.k or 0), r.i, r.bin) for r in budgets.bin_rows(df, ["k"], ["i"], "n", 40, 4).collect())
        alone = sorted(((r.k or 0), r.i, r.bin) for r in budgets.bin_rows(df, ["k"], ["i"], "n", 20, joint=1, alone_over=True).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert greedy == [(k, p, i) for k, own in enumerate(lists) for p, i in enumerate(plain_greedy(own, 40, 5))]
    sizes = [[len(b) for b in plain_bins(own, 40, 4)] for own in lists]
    assert bins == [(k, i, b) for k, own in enumerate(sizes) for i, b in enumerate(x for b, n in enumerate(own) for x in [b] * n)]
    items = spark.createDataFrame([(k, [(i, n) for i, n in enumerate(own)]) for k, own in enumerate(lists[:12])], "k int, items array<struct<i:int,n:int>>")
    folded = items.select("k", F.posexplode(budgets.fill_bins(F.col("items"), lambda x: x["n"], 20, joint=1, alone_over=True)).alias("b", "own")).select("k", "b", F.explode("own").alias("x")).collect()
    assert [x for x in alone if x[0] < 12] == sorted((r.k, r.x.i, r.b) for r in folded)


def test_cosine_blocks_are_brute_force_and_are_ruled_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] * (1 + k % 3) + rng.normal(size=8) * 0.05]) for k in range(300)] + [(300, [0.0] * 8), (301, None), (302, [1.0, 2.0]), (303, [])]
    stored = spark.createDataFrame(rows, "node_id long, vector array<double>").repartition(3)
    asked = stored.filter("node_id % 7 = 0 or node_id > 299").select(F.col("node_id").alias("query_id"), F.lit(0).alias("segment_no"), "vector")
    monkeypatch.setattr(vectors, "PACK", 16)
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "TILE", 20)
    for floor in (0.15, -0.2):
        want = set()
        for q, a in rows:
            if a is None or q % 7 and q < 300:
                continue
            for n, b in rows:
                m = min(len(a), len(b or []))
                x, y = np.array(a[:m]), np.array((b or [])[:m])
                s = float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) if m and np.linalg.norm(x) > 0 and np.linalg.norm(y) > 0 else 0.0
                if s >= floor:
                    want.add((q, n, round(s, 9)))
        got = vectors.cosine_hits(stored, asked, floor).collect()
        assert {(r.query_id, r.node_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)
    far = [vectors._block([(0, 0, k, np.eye(8)[j] + 0.01 * rng.normal(size=8)) for k in range(5)]) for j in (0, 1)]
    far = [b | {"centre": np.frombuffer(b["centre"]), "cells": np.frombuffer(b["cells"]).reshape(5, 8)} for b in far]
    assert vectors.ruled_out(far[0], far[1], 0.15) and not vectors.ruled_out(far[0], far[0], 0.15)


def test_default_embedder(spark):
    a, b, c, none = embedder.default(["Prefer tabs over spaces", "prefers  TABS, not spaces", "the database listens on port 5432", " ?!"])
    cosine = lambda x, y: float(np.dot(x, y))
    assert none is None and abs(cosine(a, a) - 1) < 1e-6 and cosine(a, b) > 0.3 > cosine(a, c)
    assert embedder.Hashed()(["Prefer tabs over spaces"])[0] == a
    rows = spark.createDataFrame([("Prefer tabs over spaces",), (None,)], "t string").repartition(2).select(embedder.embedded(F.col("t")).alias("v")).collect()
    assert sorted((r.v for r in rows), key=lambda v: v is None) == [a, None]


def test_a_block_of_vectors_meets_all_queries_of_a_cell_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    table = lambda rows: pa.Table.from_batches(vectors._packer(rng.normal(size=(8, 4)), 0.15)([pa.RecordBatch.from_pylist(rows)]))
    row = lambda q, n, v: {"query_id": q, "segment_no": 0, "node_id": n, "vector": [float(x) for x in v]}
    asked, stored = rng.normal(size=(30, 4)), rng.normal(size=(90, 4))
    calls, plain = [], vectors.cosine
    monkeypatch.setattr(vectors, "cosine", lambda a, b: calls.append(1) or plain(a, b))
    left, right = table([row(k, 0, v) for k, v in enumerate(asked)]), table([row(0, k, v) for k, v in enumerate(stored)])
    found = vectors._cell(0.15)((0, 0), left, right).to_pylist()
    want = {(q, n) for q, n in zip(*np.nonzero(plain(asked, stored) >= 0.15), strict=True)}
    assert {(r["query_id"], r["node_id"]) for r in found} == want and len(found) == len(want)
    assert left.num_rows > 1 and len(calls) == right.num_rows


def test_the_first_units_need_no_more_rows_than_they_hold(spark, monkeypatch):
    """Rows that cannot be among a query's first units are left out before texts are looked at; nodes without a text take no place."""
    rng = random.Random(9)
    lex = [(q, n, k + 1) for q in range(3) for k, n in enumerate(rng.sample(range(200), 20))]
    sem = [(q, n, k + 1, 1 - k / 200) for q in range(3) for k, n in enumerate(rng.sample(range(200), 150))]
    fused = retrieval.fuse(spark.createDataFrame(lex, "query_id long, node_id long, rank int"), spark.createDataFrame(sem, "query_id long, node_id long, rank int, score double"))
    sizes = spark.createDataFrame([(n, 1 + n % 5) for n in range(200) if n % 6], "node_id long, chars long")
    first = lambda rows: sorted(map(tuple, budgets.prefix_budget(rows.join(sizes, "node_id"), ["query_id"], [F.desc(F.round("score", 12)), "node_id"], "chars", 40, 15).select("query_id", "node_id").collect()))
    some = retrieval.leading(fused, 15, 34)
    assert first(some) == first(fused) and len(first(some)) > 30
    assert some.count() < fused.count() * 0.7
    assert retrieval.leading(fused, 15, retrieval.CERTAIN) is fused


def test_documents_without_an_id_are_hits_without_one(spark, monkeypatch):
    monkeypatch.setattr(index, "MANY", 0)
    docs = spark.createDataFrame([(None, "w1 w2"), ((1 << 60) + 1, "w1"), (3, "w3 w4")], "node_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, 0, "w1")], "query_id long, segment_no int, text string")
    want = {None, (1 << 60) + 1}
    assert {r.node_id for r in lexical.bm25(docs, asked, most=5).collect()} == want
    assert {r.node_id for r in index.search(*index.build(docs, 1), asked, 5).collect()} == want
