import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from loam.llm import common, line_dedup, media, mixing, sharding, topk


# --- media


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_container_round_trip(n):
    payload = random.Random(n).randbytes(n * 192)
    content = media.store(payload)
    got = media.read(content)
    assert got.error is None and got.codec == "raw " and got.duration == n * 192
    assert media.read_back(content, got) == payload
    assert got.keyframe_ranges()[0][1] - got.keyframe_ranges()[0][0] == 192
    assert len(got.keyframes) == -(-n // 16)


def test_broken_containers_say_so():
    content = media.store(b"x" * 192)
    assert media.read(None).error and media.read(b"").error and media.read(b"\0\0\0\1mdat").error
    for cut in range(0, len(content), 37):
        assert media.read(content[:cut]).error


def plain_media(content):
    """An independent reading of what `store` writes: (samples, keyframes), by searching for the tables by name."""
    u32 = lambda at: int.from_bytes(content[at : at + 4], "big")
    body = lambda kind: content.index(kind) + 8
    size, count = u32(body(b"stsz")), u32(body(b"stsz") + 4)
    chunks = [u32(body(b"stco") + 4 + 4 * k) for k in range(u32(body(b"stco")))]
    runs = [[u32(body(b"stsc") + 4 + 12 * k + 4 * j) for j in range(2)] for k in range(u32(body(b"stsc")))]
    samples = []
    for number, at in enumerate(chunks, 1):
        per = [p for first, p in runs if first <= number][-1]
        samples += [(at + k * size, at + (k + 1) * size) for k in range(per)]
    assert len(samples) == count
    return samples, [samples[u32(body(b"stss") + 4 + 4 * k) - 1] for k in range(u32(body(b"stss")))]


@pytest.mark.parametrize("n", [1, 16, 17, 64, 65, 1000])
def test_container_against_an_independent_reading(n):
    payload = random.Random(n).randbytes(n * 192)
    content = media.store(payload)
    samples, keys = plain_media(content)
    assert b"".join(content[a:b] for a, b in samples) == payload
    got = media.read(content)
    assert [tuple(x) for x in got.keyframe_ranges().tolist()] == keys
    packed = b"".join(a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in keys)
    ends = ",".join(dict.fromkeys(f"{a}-{b}" for a, b in (keys[0], keys[-1])))
    assert media.feature(got) == f"brand=qt;codec=raw;seconds={n * 192 / 8000:.3f};samples={n};keyframes={-(-n // 16)};ranges={ends};ranges_crc32={zlib.crc32(packed):08x}"


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def words(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def test_hostile_containers_say_so():
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    assert "deep" in media.read(deep).error
    table = lambda *parts: box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", *parts)))))
    tracemalloc.start()
    got = media.read(table(box(b"stsz", words(0, 1, 2**32 - 1)), box(b"stsc", words(0, 1, 1, 2**32 - 1, 1)), box(b"stco", words(0, 1, 0))))
    assert got.error and tracemalloc.get_traced_memory()[1] < 2**22
    tracemalloc.stop()
    content = media.store(bytes(192 * 70))
    at = content.index(b"stsz") + 12
    for count in (69, 71, 2**31):  # other than the chunks hold
        assert media.read(content[:at] + words(count) + content[at + 4 :]).error
    at = content.index(b"stss") + 12
    assert media.read(content[:at] + words(0) + content[at + 4 :]).error and media.read(content[:at] + words(71) + content[at + 4 :]).error


def test_fragments_are_read():
    track = box(b"trak", box(b"tkhd", words(0, 0, 0, 7)), box(b"mdia", box(b"mdhd", words(0, 0, 0, 1000, 0)), box(b"minf", box(b"stbl", box(b"stsz", words(0, 0, 0))))))
    head = box(b"moov", track, box(b"mvex", box(b"trex", words(0, 7, 1, 0, 3, 0x10000))))

    def fragment(offset):
        return box(b"moof", box(b"traf", box(b"tfhd", words(0x20000, 7)), box(b"trun", words(0x205, 3, offset, 0), words(4, 5, 6))), box(b"traf", box(b"tfhd", words(0x20000, 8)), box(b"trun", words(0x1, 1, offset))))

    moof = fragment(0)
    moof = fragment(len(moof) + 8)
    content = head + moof + box(b"mdat", b"aaaabbbbbcccccc")
    got = media.read(content)
    assert got.error and "run" in got.error  # the other track's samples have no size
    content = content.replace(words(0x20000, 8), words(0x20000, 7))
    got = media.read(content)
    assert got.error is None and media.read_back(content, got) == b"aaaabbbbbccccccaaa"
    assert [content[a:b] for a, b in got.keyframe_ranges().tolist()] == [b"aaaa"]


def test_media_of_odd_texts(odd_docs, no_docs):
    got = media.text_media(odd_docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        raw = texts[r.doc_id]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_error is None and len(r.keyframe_ranges) == -(-(len(payload) // 192) // 16)
    assert media.text_media(no_docs).count() == 0


def test_media_columns(spark):
    files = spark.createDataFrame([("a", bytearray(media.store(b"y" * 1920))), ("b", None), ("c", bytearray(b"junk"))], "path string, content binary")
    got = {r.path: r for r in media.media_columns(files).collect()}
    assert got["a"].codec == "raw " and got["a"].n_samples == 10 and len(got["a"].keyframe_ranges) == 1
    assert got["b"].error and got["c"].error


# --- exact top-k


def plain_top(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in sorted(i for i in ok if i % 50 == 0):
        mine = min(ok[q])
        found = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, vs in ok.items() if i != q for v in vs if len(v) == len(mine))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]  # ties
    rows += [(903, None), (904, [None] * 8), (950, [float("nan")] * 8), (951, [float("inf")] + [0.0] * 7), (1000, [1.0, 2.0]), (None, [0.0] * 8), (10, [0.25] * 8), (50, [0.25] * 8), (1050, []), (1051, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(5)
    import pyspark.sql.functions as F

    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == plain_top(rows)


def test_top_k_across_tiles_and_shards(spark, monkeypatch):
    import pyspark.sql.functions as F

    for name, value in (("BLOCK", 16), ("TILE", 8), ("SHARD", 20), ("STRIP", 8), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == plain_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- line dedup


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    rank = lambda d: (d is None, d)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d, key=rank)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup_matches_brute_force(odd_docs, real_docs, batches):
    for docs in (odd_docs, real_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = line_dedup.kept_lines(docs, batches).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == plain_lines(rows)


def test_registered_batches_reach_a_second_level_of_sorted_runs(real_docs, monkeypatch):
    levels, plans, names = [], [], line_dedup.written

    def spied(df, name, bucketed=None):
        if bucketed:
            levels.append(int(name.rsplit("-", 1)[1]))
        if name == "line-run-0" and max(levels) > 0:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return names(df, name, bucketed)

    monkeypatch.setattr(line_dedup, "written", spied)
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    got = line_dedup.kept_lines(real_docs).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == plain_lines(rows)
    assert max(levels) == 1
    initial = plans[-1].split("== Initial Plan ==")[-1]
    assert initial.count("SortMergeJoin") == 2 and initial.count("Exchange hashpartitioning(h") == 1  # a run of each level; the batch alone moves


def test_hot_lines_and_rows_without_ids(spark, monkeypatch):
    rows = [(k if k % 3 else None, f"a line that all of them hold\nown line number {k // 2}\n{'x' * (k % 7)}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot in (10, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = line_dedup.kept_lines(docs).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == plain_lines(rows)


def test_line_dedup_keeps_columns(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.filter("doc_id = 2").first().text == "other words follow in here"
    assert out.filter("doc_id = 3").first().text is None
    assert line_dedup.kept_lines(no_docs).count() == 0


# --- sharding


def test_smallest_capacity_is_the_minimax():
    import itertools

    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(0, 8))]
        k = rng.randint(1, 4)
        best = min((max((sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))), default=0) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)), default=0)
        assert sharding.smallest_capacity(sizes, k) == best
        at = sharding.cuts(sizes, k)
        assert at[0] == 0 and at[-1] == len(sizes) and at == sorted(at) and len(at) == k + 1
        assert max((sum(sizes[a:b]) for a, b in itertools.pairwise(at)), default=0) <= best


def test_shards(odd_docs, real_docs, no_docs):
    for docs in (odd_docs, real_docs):
        rows = sharding.shard(docs, part_rows=2).collect()
        assert len(rows) == docs.count()
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        by_text, slots, sizes = {}, {}, {}
        for r in rows:
            assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
            slots.setdefault(r.shard, []).append(r.slot)
            assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
            sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(16))
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 16
    assert sharding.shard(no_docs).count() == 0


# --- mixing


def test_quotas():
    assert mixing.quotas([100, 100, 100], (5, 2, 1)) == [200.0, 250 * 2 / 3, 250 / 3]
    assert mixing.quotas([]) == [] and mixing.quotas([0, 0]) == [0.0, 0.0]
    for sizes in ([3, 50, 1000, 7], [1], [10**12, 5, 5]):
        got = mixing.quotas(sizes)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes))


def test_flow_repeats_only_when_it_must():
    # pattern 0 serves both sources, pattern 1 the second alone
    flow = mixing.min_cost_flow([10, 10], [[0, 1], [1]], [12, 8])
    assert flow[0].get(0, 0) == 12 and sum(flow[1].values()) == 8
    flow = mixing.min_cost_flow([10, 10], [[0, 1], [1]], [5, 15])
    assert sum(flow[0].values()) == 10 and sum(flow[1].values()) == 10


def test_mix(real_docs, odd_docs, no_docs):
    import pyspark.sql.functions as F

    for docs in (real_docs, odd_docs):
        rows = mixing.mix(docs, F.array("source")).collect()
        assert len(rows) == docs.count()
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), F.array("source")).collect()))
        by = {}
        for r in rows:
            assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
            by.setdefault(r.pattern, []).append(r)
        for own in by.values():
            assert sum(r["size"] for r in own) == own[0].source_size
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.pattern: r.target for r in rows}.values()) - 1.5 * total) < 1
    assert mixing.mix(no_docs, F.array("source")).count() == 0


ALIKE = {
    "no ids": [(None, f"{'w ' * 30}{k}") for k in range(100)],
    "copies without ids": [(None, "w " * 30)] * 100,
    "one id": [(7, "w " * (k % 5 + 28)) for k in range(100)],
    "one row": [(7, "w " * 30)] * 100,
}


@pytest.mark.parametrize("case", sorted(ALIKE))
def test_rows_that_share_an_id_are_cut_apart(spark, case):
    import pyspark.sql.functions as F

    others = [(1000 + k, "v " * 40, "b") for k in range(100)] + [(2000 + k, "v " * 90, "c") for k in range(100)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in ALIKE[case]] + others, "doc_id long, text string, source string")
    rows = mixing.mix(docs, F.array("source")).collect()
    assert len(rows) == 300
    for name in "abc":
        own = [r for r in rows if name in r.pattern]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
        assert all(r.taken <= 2 * r["size"] for r in own)


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    import pyspark.sql.functions as F

    monkeypatch.setattr(mixing, "PATTERNS", 9)
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(docs, F.array("source"))


def test_mix_of_overlapping_sources(spark):
    import pyspark.sql.functions as F

    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), [["a"], ["a", "b"], ["b", None], []][i % 4]) for i in range(400)], "doc_id long, text string, sources array<string>")
    rows = mixing.mix(docs, F.col("sources")).collect()
    assert sum(r.taken for r in rows if r.pattern == '{"s":[]}') == 0
    assert 0 < sum(r.taken for r in rows) <= 2 * sum(r["size"] for r in rows)
