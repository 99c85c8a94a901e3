"""The pipeline against the plain versions of its stages."""

import numpy as np

import corpus_pipeline
from loam.llm import language_id, mixing, sentencepiece_codec

from .test_simhash import groups, plain_fingerprint
from .test_tables import plain_lines


def test_stages_against_brute_force(spark, tmp_path, real_docs):
    path = str(tmp_path / "documents.parquet")
    real_docs.write.parquet(path)
    docs = spark.read.parquet(path)
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            docs.write.parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
            assert docs.columns == real_docs.columns
        kept.append(docs.collect())
    # 1: what has no known language goes, nothing else; texts stay as they are
    first = {r.doc_id for r in kept[0]}
    assert all(r.asDict() == rows[r.doc_id] for r in kept[0])
    assert first == {r.doc_id for r in language_id.identify(real_docs).collect() if r.lang_pred != "und" and r.score >= 0.3}
    # 2: lines
    want = {d: t for d, _, _, t in plain_lines([(d, rows[d]["text"]) for d in first]) if t.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in kept[1]} == want and all(r.n_chars == len(r.text) for r in kept[1])
    # 3: one of each group
    items = sorted((d, plain_fingerprint(t)) for d, t in want.items())
    third = {d for (d, _), g in zip(items, groups(items), strict=True) if d == g}
    assert {r.doc_id for r in kept[2]} == third
    # 4: whole documents, at most twice, near the targets
    times = {}
    for r in kept[3]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == want[r.doc_id]
    assert set(times) <= third and max(times.values()) <= 2
    size = {r.doc_id: len(r.text.split()) for r in kept[2]}
    by = {}
    for d in third:
        by.setdefault(rows[d]["source"], []).append(d)
    names = sorted(by)
    for name, target in zip(names, mixing.quotas([sum(size[d] for d in by[n]) for n in names]), strict=True):
        assert abs(sum(size[d] * times.get(d, 0) for d in by[name]) - target) <= max(size[d] for d in by[name])
    # 5: ids give the texts back
    with open(sentencepiece_codec.MODEL, "rb") as f:
        m = sentencepiece_codec.load(f.read())
    surfaces = sentencepiece_codec.surfaces_of(m)
    assert len(kept[4]) == len(kept[3]) and all(r.lossless for r in kept[4])
    assert all(sentencepiece_codec.decode(m, np.array(r.token_ids), surfaces) == want[r.doc_id] for r in kept[4])


def test_empty_table(spark, tmp_path, real_docs):
    real_docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
