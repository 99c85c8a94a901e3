"""Product codes against a plain version in Python's integers, and the pruning against all distances."""

import hashlib
import math

import numpy as np
import pytest

from loam.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, dim int"


def plain(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) of rows (vec_id, vector, label) of one length, by the contract's words."""
    exact = lambda x: 1024 * int(x) if abs(x) > 2**60 else math.floor(1024 * x)
    kept = [(i, [exact(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = vc.bounds(len(kept[0][1]))
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cut]
    gap = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    near = lambda: [[min((gap(v[a:b], e), k) for k, e in enumerate(book)) for book, (a, b) in zip(books, cut, strict=True)] for _, v, _ in kept]
    for _ in range(rounds):
        found = near()
        for p, (a, b) in enumerate(cut):
            for k in range(len(books[p])):
                own = [v[a:b] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(kept, near(), strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, code, fit(e), fit(sum(x[2] for x in out if x[3] == label)), sha) for i, code, e, label in out), key=repr)


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vc.compress(df).collect()), key=repr)


@pytest.mark.parametrize("dim", [8, 6, 1])
def test_codes_are_the_plain_ones(spark, dim, monkeypatch):
    monkeypatch.setattr(vc, "ENTRIES", 20)
    rng = np.random.default_rng(dim)
    rows = [(k, [float(x) for x in rng.normal(size=dim)], [1, 2, None][k % 3]) for k in range(150)]
    rows += [(200 + k, rows[0][1], None) for k in range(30)]  # copies: ties and a crowded entry
    rows += [(300, [0.0] * dim, 7), (301, None, 7), (302, [float("nan")] * dim, 7), (303, [None] * dim, 1), (304, [float("-inf")] * dim, 1), (None, [0.25] * dim, 7), (5, [0.5] * dim, 7), (5, [0.5] * dim, 7)]
    assert coded(spark, rows) == plain(rows, 20)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(k, [k / 3, 1.0, -k / 7, 0.1], k) for k in range(9)]
    assert coded(spark, rows) == plain(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    assert [r[1:4] for r in coded(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0, 0)] * 2


@pytest.mark.parametrize("size", [3e5, 1e9, 1e30, 1e300])
def test_components_of_any_size(spark, size, monkeypatch):
    monkeypatch.setattr(vc, "ENTRIES", 6)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) * (size if k % 3 == 0 else 1) for x in rng.normal(size=4)], k % 2) for k in range(40)]
    assert coded(spark, rows) == plain(rows, 6)


def test_lengths_have_codebooks_of_their_own(spark):
    one = [(k, [k / 5, -k / 3, 0.5, 1.0], 1) for k in range(6)]
    two = [(k, [k / 5] * 8, None) for k in range(6)]
    got = coded(spark, one + two)
    assert {r[4] for r in got} == {plain(one)[0][4], plain(two)[0][4]} and len(got) == 12


def test_pruning_finds_the_nearest_of_all(monkeypatch):
    rng = np.random.default_rng(3)
    for scale in (1, 40, 10**6, 10**8):  # in doubles, and in 64-bit integers
        entries = rng.integers(-scale, scale + 1, (256, 5))
        entries[100:140] = entries[:40]  # equal entries: the first counts
        rows = rng.integers(-2 * scale, 2 * scale + 1, (700, 5))
        rows[:256] = entries
        gaps = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
        entry, best = vc.Codebook(entries).nearest(rows)
        assert (entry == gaps.argmin(1)).all() and (best == gaps.min(1)).all()
