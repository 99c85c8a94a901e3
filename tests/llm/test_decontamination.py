"""Decontamination against windows sought word by word, and suffix arrays against sorted suffixes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import decontamination as dc
from loam.llm.words import ALPHANUMERIC, LETTERS, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items):
    """(doc_id, n_words, n_hit, item ids) of each document."""
    windows = []
    for item_id, text in items:
        w = WORD.findall(lower(text))
        k = min(10, len(w))
        windows += [("" if item_id is None else str(item_id), w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for item_id, own in windows:
            for i in range(len(w) - len(own) + 1):
                if w[i : i + len(own)] == own:
                    hit |= set(range(i, i + len(own)))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made(seed):
    """Documents of few different words, with passages of items, some cut short by a word."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["das", "Haus", "ÄÖ", "x1", "7", "the", "of", "日本", "é", "\U0001f600"])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "-", ", ", "\x00", "_"]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 40]))) for k in range(12)]
    items += [(3, text(15)), (None, text(12)), (50, None), (51, ""), (52, " ,.!"), (53, items[4][1].upper() if items[4][1].isascii() else items[4][1])]
    docs = [(k, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 9))) for k in range(40)]
    docs += [(41, None), (42, ""), (43, "..."), (44, docs[0][1]), (44, docs[0][1]), (None, docs[1][1]), (45, items[0][1])]
    return docs, items


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, None) for i, t in docs], "doc_id long, text string, __words string, n_words int, item_id string").repartition(3)
    out = dc.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r["doc_id"], r["__n_words"], r["__n_hit"], list(r["__items"])) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_contamination_is_the_plain_one(spark, seed):
    docs, items = made(seed)
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_stretches_and_shards_change_nothing(spark, monkeypatch):
    docs, items = made(7)
    items.append((90, " ".join(f"w{k}" for k in range(300))))
    docs.append((91, "vor " + items[-1][1] + " nach"))
    want = plain(docs, items)
    for name, value in (("BLOCK_WORDS", 40), ("STRETCH", 25), ("SHARD_WORDS", 64), ("BLOCKS_A_STAGE", 3)):
        monkeypatch.setattr(dc, name, value)
    assert found(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = made(1)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == plain(docs, [])


def test_decontaminate_keeps_clean_documents_as_they_were(spark):
    docs, items = made(2)
    d = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(docs)], "doc_id long, text string, source string")
    clean = {s for (_, _, n, _), s in zip([plain([x], items)[0] for x in docs], (f"s{k}" for k in range(len(docs))), strict=True) if not n}
    got = dc.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == d.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, d.filter(d.source.isin(clean)).collect()), key=repr)


def test_longest_matches_and_their_places(spark):
    docs, items = made(4)
    got = dc.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=6)
    got = [tuple(r) for r in got.collect()]
    words = [(i, WORD.findall(lower(t))) for i, t in docs]
    best: dict = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for p in range(len(w)):
            for doc_id, d in words:
                for q in range(len(d)):
                    n = 0
                    while p + n < len(w) and q + n < len(d) and w[p + n] == d[q + n]:
                        n += 1
                    if n >= 6:
                        best.setdefault(("" if item_id is None else str(item_id), p), set()).add((n, doc_id, q))
    want = set()
    for (i, p), x in best.items():
        want |= {(i, p, n, d, q) for n, d, q in x if n == max(y[0] for y in x)}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("depth", [1, 2, 7, 64])
def test_suffix_array_is_sorted(depth):
    rng = np.random.default_rng(depth)
    for top, n in ((1, 50), (3, 400), (2**20, 300), (5, 1), (1, 0)):
        words = rng.integers(0, top + 1, n).astype(np.int32)
        words[n // 2 :] = words[: n - n // 2]  # a copy
        order = dc.suffix_array(words, depth)
        assert sorted(order.tolist()) == list(range(n))
        longer = np.concatenate([words, np.zeros(depth, np.int32)])
        cut = [longer[p : p + depth].tolist() for p in order]
        assert cut == sorted(cut)


@pytest.mark.parametrize(("table", "pattern"), [(ALPHANUMERIC, WORD), (LETTERS, re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))])
def test_words_are_those_of_the_pattern(table, pattern):
    texts = ["ab", "cd Ef", None, "", "é1x_Y\x7f\x80ß", "z", " q", "\U0001f600　x", "A\x00b"]
    for column in (pa.array(texts, pa.string()), pa.array(["zz", *texts, "yy"], pa.string()).slice(1, len(texts)), pa.array([], pa.string())):
        words, counts = words_of(column, table)
        own = column.to_pylist()
        want = [[lower(w) for w in pattern.findall(t or "")] for t in own] if table is LETTERS else [pattern.findall(lower(t)) for t in own]
        assert words.to_pylist() == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
