"""The audit against a plain version in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, cell int"


def plain(docs, least=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    count, groups, df = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = Counter(lower(t) for t in TERM.findall(text or ""))
        groups[lang].add(source)
        count[lang, source] += terms
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 2) // (whole + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, x, k + 1) for k, (item, x) in enumerate(rows) if part == "pair" or k < 10]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["der", "Die", "das", "ÄÖü", "日本", "Ａ", "\U0001f600", *(f"w{c}" for c in "abcdefghijklmnop")]
    docs = []
    for k in range(n):
        lang, source = rng.choice(["de", "de", "en", None, ""]), rng.choice(["a", "a", "a", "b", None, "é", "z"])
        docs.append((k, rng.choice([" ", "9", "\n"]).join(rng.choices(words[: 5 + len(source or "") * 9], k=rng.randint(0, 40))), lang, source))
    docs += [(500, None, "fr", "a"), (501, "", "fr", "b"), (502, "allein", "it", "a"), (None, "das das", "de", "leer"), (3, docs[3][1], docs[3][2], docs[3][3]), (None, None, None, None)]
    return docs


def audited(spark, docs):
    df = spark.createDataFrame([(*d, "t", 1, 2) for d in docs], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in dv.audit(df).collect())


@pytest.mark.parametrize("seed", range(3))
def test_audit_is_the_plain_one(spark, seed):
    docs = made(seed)
    assert audited(spark, docs) == plain(docs)


def test_chunks_cells_and_tiles_change_nothing(spark, monkeypatch):
    docs = made(9)
    for name, value in (("CHUNK_WORDS", 30), ("CELL", 7), ("TILE", 8)):
        monkeypatch.setattr(dv, name, value)
    assert audited(spark, docs) == plain(docs)


def test_runs_go_on_over_batches(spark):
    docs = made(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert audited(spark, docs) == plain(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_languages_without_terms(spark):
    assert audited(spark, []) == []
    docs = [(k, "nie oft", "de", s) for k, s in enumerate("aabbc")]
    assert audited(spark, docs) == plain(docs) and {r[4] for r in audited(spark, docs)} == {0}


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randint(1, rng.choice([10, 10**6, 10**12, 9 * 10**17]))
        count = rng.choice([0, 1, total, rng.randint(0, total)])
        assert dv.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
