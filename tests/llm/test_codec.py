import hashlib
import random
import struct
import time

import numpy as np
import pytest
import sentencepiece

from loam.llm import sentencepiece_codec as codec


@pytest.fixture(scope="module")
def public():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(codec.MODEL, "rb") as f:
        return codec.Encoder(codec.load(f.read()))


def both(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_are_those_of_the_public_library(spark, encoder, public):
    rng = random.Random(4)
    m = encoder.m
    texts = ["", None, " ", "  a", "a  b ", "\n\n x\ty", "héllo wörld", "日本語のテキスト", "<0x41> <s> </s> <unk>", "a" * 90, "        def f(x):\n                return x", "\U0001f600\U0001f468‍\U0001f469", "x" * 5000 + "é" * 3000]
    texts += ["".join(rng.choice("aab bcde  ▁\nthing한é") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(m.texts[259:9000]) for _ in range(20)) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = both(encoder, texts)
    assert got == public.encode([t or "" for t in texts])
    surfaces = codec.surfaces_of(m)
    assert [codec.decode(m, np.array(x, np.int64), surfaces) for x in got] == public.decode(got)


def test_long_words_advance_in_stretches(encoder, public, monkeypatch):
    rng = random.Random(8)
    runs = ["".join(rng.choice("ABCDEFGHabcdefghijklmnop0123456789+/") for _ in range(30_000)), "a" * 9001, "abc" * 4000 + "x", "=" * 7777, "ab" * 3000 + "é" * 3000 + "thing" * 900, "日本語" * 3000]
    assert both(encoder, runs) == public.encode(runs)
    for name, value in (("LONG", 24), ("STRETCH", 16), ("OVERLAP", 8)):  # stretches that often have no piece in common
        monkeypatch.setattr(codec, name, value)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(25, 200))) for letters in ("ab", "thingse", "aA0=", "xyzé") for _ in range(100)]
    encoder.clear()
    assert both(encoder, words) == public.encode(words)


def test_a_run_of_two_million_letters_takes_seconds(encoder):
    rng = random.Random(9)
    run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2_000_000))
    began = time.perf_counter()
    ids, _ = encoder.encode([run])
    assert time.perf_counter() - began < 60
    assert codec.decode(encoder.m, ids, codec.surfaces_of(encoder.m)) == run


def test_words_are_forgotten_at_the_bound(encoder, monkeypatch):
    monkeypatch.setattr(codec, "HELD_WORDS", 3)
    a = both(encoder, ["one two three four five", "six"])
    assert both(encoder, ["one two three four five", "six"]) == a


def message(number, value):
    return bytes([number << 3 | 2]) + bytes([len(value)]) + value


def test_unigram_models_take_the_best_sum():
    pieces = {"▁a": -1.0, "b": -2.0, "ab": -2.5, "▁ab": -4.0, "bb": -3.0, "▁": -3.0, "a": -2.0}
    content = message(1, message(1, b"<unk>") + bytes([3 << 3, codec.UNKNOWN]))
    for t, s in pieces.items():
        content += message(1, message(1, t.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s))
    content += message(2, bytes([3 << 3, codec.UNIGRAM])) + message(3, bytes([4 << 3, 0]))
    m = codec.load(content)

    def best(word):
        table = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            ways = [(table[k][0] + pieces[word[k:end]], [*table[k][1], word[k:end]]) for k in range(end) if word[k:end] in pieces and k in table]
            if ways:
                table[end] = max(ways, key=lambda w: w[0])
        return table[len(word)][1]

    for text in ("ab", "abb", "bab", "aabbab", "b"):
        assert [m.texts[k] for k in both(codec.Encoder(m), [text])[0]] == best("▁" + text)


def test_tables(spark, odd_docs, no_docs, encoder):
    rows = codec.round_trip(odd_docs).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.n_tokens == len(r.token_ids)
        assert r.lossless == ("▁" not in texts[r.doc_id])
        if r.lossless:
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    coded = codec.encode_texts(odd_docs)
    back = {r.doc_id: r.text for r in codec.decode_ids(coded).collect()}
    assert all(back[d] == t.replace("▁", " ") for d, t in texts.items())
    assert codec.round_trip(no_docs).count() == 0
