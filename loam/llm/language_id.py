"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes from both sides, gives every position a distribution over languages,
and a document's score is the mean of its positions' distributions over the whole text. It is trained here, in numpy,
by backpropagation through time on a bounded sample: DOCS documents a language and SAMPLE in all, WINDOWS windows of each.

Edge cases: a null text, or one without a letter (Unicode's category L), is `und` with score 0; with no labelled row to learn from every text
is `und`; a null lang is not learned from; a null doc_id counts as the empty text when rows are held out; repeated rows
get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import held_out, rows_of, steps

DOCS = 300  #: bound of the sample: labelled documents a language
WINDOWS = 6  #: and windows of each of them, spread evenly from its beginning to its end
SAMPLE = 60_000  #: bound of the sample over all languages, which take turns
WINDOW = 64  #: bytes that the network reads at a time
HIDDEN = 8
STEPS = 220
BATCH = 192
RATE = 0.02
SEED = 11
AT_ONCE = 4096  #: windows that are run side by side
PAD = 256
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    inputs: np.ndarray  #: (2, 257, 3H): what a byte adds to reset, update and candidate, in both directions
    recurrent: np.ndarray  #: (2, H, 3H)
    outputs: np.ndarray  #: (2, H, C)
    bias: np.ndarray  #: (C,)


def _run(m: Model, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (T, 2, B, H) of windows x (B, T), both directions in the order of the positions; what training needs of each step."""
    b, t = x.shape
    h_size = m.recurrent.shape[1]
    h = np.zeros((2, b, h_size), np.float32)
    states, saved = np.empty((t, 2, b, h_size), np.float32), []
    two, gates = np.arange(2)[:, None], m.recurrent[:, :, : 2 * h_size]
    own = m.recurrent[:, :, 2 * h_size :]
    columns = np.ascontiguousarray(x.T)
    for k in range(t):
        into = m.inputs[two, columns[[k, t - 1 - k]]]
        g = into[:, :, : 2 * h_size] + h @ gates
        np.tanh(g, out=g)  # sigmoid(2a) = (1 + tanh a) / 2; the weights take the factor
        g += 1
        g *= 0.5
        r, z = g[:, :, :h_size], g[:, :, h_size:]
        rh = r * h
        c = np.tanh(into[:, :, 2 * h_size :] + rh @ own)
        new = c + z * (h - c)
        if keep:
            saved.append((h, r, z, rh, c))
        h = new
        states[k, 0], states[t - 1 - k, 1] = h[0], h[1]
    return states, saved


def _scores(m: Model, states: np.ndarray) -> np.ndarray:
    """(T, B, C) distributions."""
    s = states[:, 0] @ m.outputs[0] + states[:, 1] @ m.outputs[1] + m.bias
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    return s


def _gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients by backpropagation through time; every position that is no padding is labelled with its text's language."""
    b, t = x.shape
    states, saved = _run(m, x, keep=True)
    p = _scores(m, states)
    real = (x.T != PAD)[:, :, None] / max(1, (x != PAD).sum())
    loss = float(-(np.log(p[:, np.arange(b), y] + 1e-9)[:, :, None] * real).sum())
    p[:, np.arange(b), y] -= 1
    p *= real.astype(np.float32)
    d_out = np.stack([np.einsum("tbh,tbc->hc", states[:, d], p) for d in range(2)])
    d_states = np.stack([p @ m.outputs[d].T for d in range(2)])  # (2, T, B, H)
    d_in, d_rec = np.zeros_like(m.inputs), np.zeros_like(m.recurrent)
    n = m.recurrent.shape[1]
    gates, own = m.recurrent[:, :, : 2 * n].transpose(0, 2, 1), m.recurrent[:, :, 2 * n :].transpose(0, 2, 1)
    dh = np.zeros((2, b, n), np.float32)
    for k in range(t - 1, -1, -1):
        h, r, z, rh, c = saved[k]
        dh = dh + np.stack([d_states[0, k], d_states[1, t - 1 - k]])
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * (2 * z * (1 - z))
        d_rh = dc @ own
        dr = d_rh * h * (2 * r * (1 - r))
        dg = np.concatenate([dr, dz], axis=2)
        d_rec[:, :, : 2 * n] += h.transpose(0, 2, 1) @ dg
        d_rec[:, :, 2 * n :] += rh.transpose(0, 2, 1) @ dc
        both = np.concatenate([dg, dc], axis=2)
        np.add.at(d_in[0], x[:, k], both[0])
        np.add.at(d_in[1], x[:, t - 1 - k], both[1])
        dh = dh * z + d_rh * r + dg @ gates
    return loss, [d_in, d_rec, d_out, p.sum(axis=(0, 1))]


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Model | None:
    """A model from (window, language) pairs; None without any. Languages weigh alike, whatever their numbers of windows."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by = [np.stack([as_window(w) for w, lang in samples if lang == name]) for name in languages]
    spread = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    m = Model(languages, spread(2, 257, 3 * hidden), spread(2, hidden, 3 * hidden), spread(2, hidden, len(languages)), np.zeros(len(languages), np.float32))
    weights = [m.inputs, m.recurrent, m.outputs, m.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = np.stack([by[k][rng.integers(len(by[k]))] for k in y])
        _, gradients = _gradients(m, x, y)
        norm = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in gradients))))
        rate = RATE * (1 - 0.9 * step / steps)
        for w, g, a, v in zip(weights, gradients, first, second, strict=True):  # Adam
            g = g / norm
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def as_window(raw: bytes) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.int64)
    data = np.frombuffer(raw[:WINDOW], np.uint8)
    out[: len(data)] = data
    return out


def document_scores(m: Model, texts: list[str]) -> np.ndarray:
    """(texts, languages): mean distribution over all byte positions of each text; zeros for an empty one."""
    raws = [t.encode() for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raws], np.int64)
    owner = np.repeat(np.arange(len(raws)), counts)
    total = np.zeros((len(raws), len(m.languages)))
    data = np.frombuffer(b"".join(raws), np.uint8)
    lengths = np.array([len(r) for r in raws], np.int64)
    first = np.cumsum(lengths) - lengths
    start = first[owner] + (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]) * WINDOW
    size = np.minimum(WINDOW, first[owner] + lengths[owner] - start)
    for a in range(0, len(owner), AT_ONCE):
        at = start[a : a + AT_ONCE, None] + np.arange(WINDOW)
        real = np.arange(WINDOW) < size[a : a + AT_ONCE, None]
        x = np.where(real, data[np.minimum(at, len(data) - 1)].astype(np.int64), PAD)
        p = _scores(m, _run(m, x)[0])
        p *= real.T[:, :, None]
        np.add.at(total, owner[a : a + AT_ONCE], p.sum(axis=0))
    return total / np.maximum(lengths, 1)[:, None]


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """Windows of at most DOCS labelled documents a language, spread evenly over each whole text; never of held-out rows.

    Of rows that share an id and a language that with the least hash of its text counts. Of more languages than SAMPLE allows DOCS
    documents of, each gives its first before any gives its second, and so on.
    """
    spark = docs.sparkSession
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = known.select("lang", "doc_id").distinct().withColumn("rank", rank).filter(F.col("rank") <= DOCS)
    chosen = first.orderBy("rank", F.xxhash64("doc_id"), "doc_id", "lang").limit(SAMPLE).collect()
    ids = F.broadcast(spark.createDataFrame([(r.lang, r.doc_id) for r in chosen], "lang string, doc_id long").coalesce(1))  # SAMPLE rows at most
    step = F.greatest(F.lit(1), F.floor(F.length("text") / WINDOWS))
    places = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring("text", (k * step + 1).cast("int"), F.lit(WINDOW)))
    rows = known.join(ids, ["lang", "doc_id"], "left_semi").select("lang", "doc_id", F.xxhash64("text").alias("hash"), F.filter(F.array_distinct(places), lambda w: w != "").alias("windows"))
    rows = rows.groupBy("lang", "doc_id").agg(F.min(F.struct("hash", "windows")).alias("x")).select("lang", "doc_id", "x.windows").collect()  # SAMPLE rows at most
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.windows))
    return [(w.encode(), r.lang) for r in rows for w in r.windows if LETTER.search(w)]


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; without a model, one is trained on a sample of docs."""
    m = model or train(sample(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            lettered = [k for k, r in enumerate(rows) if m and r[1] and LETTER.search(r[1])]
            found: list[tuple[str, float]] = [("und", 0.0)] * len(rows)
            if lettered:
                p = document_scores(m, [rows[k][1] for k in lettered])
                for k, own in zip(lettered, p, strict=True):
                    best = int(own.argmax())
                    found[k] = (m.languages[best], min(1.0, float(own[best])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(work, SCHEMA)


def reject_unknown(docs: DataFrame, least: float = 0.3, model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known: not `und`, and with a score of `least` or more."""
    m = model or train(sample(docs))
    names, at = docs.columns, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = batch.column(at).to_pylist()
            keep = np.zeros(len(texts), bool)
            lettered = [k for k, text in enumerate(texts) if text and m and LETTER.search(text)]
            if lettered:
                keep[lettered] = document_scores(m, [texts[k] for k in lettered]).max(axis=1) >= least
            yield batch.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(work, docs.schema)
