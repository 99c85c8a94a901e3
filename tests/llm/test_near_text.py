import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import near_text


def plain_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(items):
    """(id, text) -> id -> least id, by all pairs."""
    sets = [(i, plain_set(t)) for i, t in items]
    root = {i: i for i, _ in items}
    for i, a in sets:
        for j, b in sets:
            if i < j and (5 * len(a & b) >= 4 * len(a | b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return root


def made(seed):
    """Copies with changed, moved and added words at all similarities, a passage that many quote, and short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([3, 6, 30, 120, 400]))
        if rng.random() < 0.6:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy + rng.choices(words, k=rng.choice([0, 0, 1, 10])))
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, ""), (901, None), (902, " \n"), (903, texts[0][0].upper() + "  " + " ".join(texts[0][1:]))]


def test_components_match_brute_force(spark):
    for seed in (3, 4):
        items = made(seed)
        got = near_text.near_duplicates(spark.createDataFrame(items, "doc_id long, text string").repartition(3)).collect()
        want = plain_groups(items)
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(items)
        assert len(set(want.values())) < len(items) - 20


def test_stage_drops_a_copy_that_differs_in_many_bits(spark):
    from loam.llm import simhash

    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    copies = []
    for k in range(1, 12):
        copy = list(base)
        for at in rng.sample(range(0, 300, 25), min(k, 5)):  # up to 25 of 296 shingles
            copy[at] = f"x{k}"
        copies.append(" ".join(copy))
    far = [(simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(c)).bit_count() for c in copies]
    assert max(far) > 4
    items = [(k, t) for k, t in enumerate([" ".join(base), *copies, "another text of its own words entirely"])]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_duplicates(spark, docs, "").collect()) == [0, len(items) - 1]


def test_rows_with_null_or_repeated_ids_go_only_as_copies(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(20 + k))
    items = [(None, text(1), "a"), (None, text(2), "a"), (None, text(2), "b"), (7, text(3), "a"), (7, text(4), "b"), (7, text(3), "b"), (None, text(3), "a"), (8, text(4), "a")]
    docs = spark.createDataFrame(items, "doc_id long, text string, source string")
    kept = [tuple(r) for r in corpus_pipeline.no_near_duplicates(spark, docs.repartition(3), "").collect()]
    want = [(None, text(1), "a"), (None, text(2), "a"), (7, text(3), "a"), (7, text(4), "b")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    # The mix takes each of these rows for itself: never more than twice.
    mixed = [tuple(r) for r in corpus_pipeline.target_mix(spark, spark.createDataFrame(kept, docs.schema), "").collect()]
    assert mixed and set(mixed) <= set(want) and max(map(mixed.count, mixed)) <= 2


def test_empty_and_odd_tables(odd_docs, no_docs):
    got = near_text.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert near_text.near_duplicates(no_docs).count() == 0


def test_maps_rule_out_no_similar_pair():
    sets = [near_text.shingles(t) for _, t in made(5)]
    ruled_out = 0
    for a in sets:
        for b in sets:
            if len(a) and len(b):
                fit = near_text.possible(len(a), near_text.bit_map(a), len(b), near_text.bit_map(b))
                assert fit or not near_text.similar(a, b)
                ruled_out += not fit
    assert ruled_out > 1000


def test_stage_joins_links_by_simhash_and_by_shingles(spark):
    """0 and 1 are near by op4's rule alone (repeats count there), 1 and 2 by their sets of shingles alone; the chain is one group."""
    from loam.llm import simhash

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    refrain = [word() for _ in range(31)] * 40
    one = refrain + [word() for _ in range(200)]
    texts = [" ".join(t) for t in (refrain + [word() for _ in range(20)], one, refrain[:31] + one[-200:], [word() for _ in range(300)])]
    prints = [simhash.fingerprint(t) for t in texts]
    sets = [plain_set(t) for t in texts]
    by_hash = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    by_sets = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert by_hash(0, 1) and not by_sets(0, 1) and by_sets(1, 2) and not by_hash(1, 2) and not by_hash(0, 2) and not by_sets(0, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_duplicates(spark, docs, "").collect()) == [0, 3]


def test_similar_sets_share_the_keys_that_it_takes(spark):
    import numpy as np

    none = np.zeros(0, np.int64)
    rng = np.random.default_rng(1)
    cases = []
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        own = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        drop, more = int(rng.integers(0, 1 + len(own) // 4)), int(rng.integers(0, 1 + n // 4))
        other = np.unique(np.concatenate([rng.permutation(own)[drop:], rng.integers(-(1 << 62), 1 << 62, more)]))
        if len(other) and near_text.similar(own, other):
            keys = [near_text.prefix(x, none, none) for x in (own, other)]
            cases.append((len(own), len(other), len(np.intersect1d(*keys))))
    found = spark.createDataFrame(cases, "n long, m long, shared long").withColumn("least", near_text.least_keys(F.col("n"), F.col("m"))).collect()
    assert len(found) > 1000 and all(r.shared >= r.least for r in found)
    assert any(r.shared == r.least > 1 for r in found)


def test_texts_of_many_sizes_with_one_quote_need_no_more_stars(spark, monkeypatch):
    """Sizes alone rule their pairs out, so what is made stays in proportion to the texts, however many share the quote."""
    made_tables = []
    old = near_text.written
    monkeypatch.setattr(near_text, "SAMPLE", 1)
    monkeypatch.setattr(near_text, "written", lambda df, name, *a: made_tables.append(name) or old(df, name, *a))
    quote = min((" ".join(f"q{k}x{j}" for j in range(5)) for k in range(20000)), key=lambda t: (xxhash.xxh64_intdigest(t, 42) + 2**63) % 2**64)
    texts = [(k, " ".join([quote, *(f"w{k}x{j}" for j in range(int(10 * 1.3**k)))])) for k in range(20)]
    got = near_text.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k, _ in texts}
    assert made_tables.count("near-stars") == 1
