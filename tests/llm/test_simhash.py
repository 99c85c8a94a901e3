import random
import re

import numpy as np
import xxhash

from loam.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items):
    """(id, fingerprint) -> id -> least id, by all pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(items))]


def test_golay_code_is_perfect():
    code = simhash.golay()
    assert len(set(code.near.tolist())) == 2048
    assert max(int(e).bit_count() for e in code.near) == 3
    full = (code.far >= 0).all(axis=1)
    assert all(full[s] == (int(code.near[s]).bit_count() == 3) for s in range(2048))


def test_keys_of_linked_fingerprints_meet():
    rng = random.Random(5)
    a = [rng.getrandbits(64) for _ in range(4000)]
    b = []
    for x in a:
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << bit
        b.append(x)
    ka, ra, sa = simhash.keys_of(np.array(a, np.uint64))
    kb, rb, sb = simhash.keys_of(np.array(b, np.uint64))
    left = {(int(r), int(k), int(s)) for k, r, s in zip(ka, ra, sa)}
    right = {(int(r), int(k), int(s)) for k, r, s in zip(kb, rb, sb)}
    met = {r for r, k, s in left if (r, k, {0: 1, 1: 0, 2: 2}[s]) in right}
    assert met == set(range(len(a)))


def test_fingerprints_and_components_match_brute_force(real_docs, odd_docs):
    for docs in (real_docs, odd_docs.filter("doc_id is not null")):
        rows = docs.select("doc_id", "text").collect()
        items = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
        want = sorted((d, f, g) for (d, f), g in zip(items, groups(items)))
        got = simhash.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_close_fingerprints_link_without_all_pairs(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(300):  # a large group of near copies, chained
        x = rng.choice(sorted(values))
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << bit
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)}
    items = [(v, v) for v in sorted(values)]
    want = dict(zip((v for v, _ in items), groups(items)))
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    got = {r.fp % 2**64: r.root % 2**64 for r in simhash.link(fps).collect()}
    for v in values:
        for w in values:
            assert (want[v] == want[w]) == (got.get(v, v) == got.get(w, w))


def test_finer_keys_keep_every_link():
    rng = random.Random(6)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = []
    for x in a:
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << bit
        b.append(x)
    met = set()
    sides = []
    for values in (a, b):
        fps = np.array(values, np.uint64)
        key, row, side = simhash.keys_of(fps)
        longer, at = simhash.finer_keys(key, fps[row])
        sides.append({(int(r), int(k), int(s)) for r, k, s in zip(row[at], longer, side[at])})
    met = {r for r, k, s in sides[0] if (r, k, {0: 1, 1: 0, 2: 2}[s]) in sides[1]}
    assert met == set(range(len(a)))


def test_crowded_buckets_of_short_documents(spark, monkeypatch):
    rng = random.Random(8)
    # Five words have two shingles: a bit is set with chance 1/4, and keys pile up. Templates differ in 5 to 10 bits.
    values = {rng.getrandbits(64) & rng.getrandbits(64) for _ in range(700)}
    template = rng.getrandbits(64)
    for _ in range(700):
        x = template
        for bit in rng.sample(range(64), rng.randint(3, 6)):
            x ^= 1 << bit
        values.add(x)
    values = sorted(values)
    want = dict(zip(values, groups([(v, v) for v in values])))
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    for crowd in (0, 3, 32):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r.fp % 2**64: r.root for r in simhash.link(fps).collect()}
        least = {}
        for v in values:
            assert least.setdefault(want[v], got[v]) == got[v]
        assert len(set(least.values())) == len(least)


def test_rows_without_ids_and_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = ["one text that a third of all rows hold word for word"] * 40 + [f"text {k} of its own {k * k} words {k + 7} here" for k in range(40)] + [None, "", " "]
    rows = [(None if k % 4 == 0 else k // 2, t) for k, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    items = [((d is None, d), plain_fingerprint(t)) for d, t in rows]
    want = [(d, f, g[1]) for ((_, d), f), g in zip(items, groups(items))]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.fp for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_two_large_components_of_a_bucket_are_dealt_into_finer_ones(spark):
    """The tests that a bucket would take count, not its components."""
    rows = [(1, k, k // 60, simhash.EXACT) for k in range(120)] + [(2, k, k // 3, simhash.EXACT) for k in range(6)]
    got = {r.key: r.pairs for r in simhash._open(spark.createDataFrame(rows, simhash.MEMBER)).collect()}
    assert got == {1: 120 * 60, 2: 6 * 3} and got[1] > simhash.CROWD >= got[2]
