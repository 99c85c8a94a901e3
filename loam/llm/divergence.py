"""Divergence of the sources within each language, audited by sorted streams of terms.

Each task sorts the terms of a chunk of its documents by (lang, term, source, document) and scans the run lengths into
partial runs: in how many documents, how often, and the first document. So a term of a third of all documents leaves a task as one row
a chunk and source. Partial runs are dealt by (lang, term), sorted by (lang, term, source, document) within the partition and
streamed through a second scan, which closes a term's run where the next begins, keeps it if enough documents hold it, and holds
one row a source at most.

A language's kept terms are dealt by hash into cells of CELL rows on average. A cell meets the sums of its language's
sources, and emits a partial value a pair of sources, and the first TOP terms a source; those sums are added up, and the short lists merged.
Every number is an integer.

Pairs come out for any two sources of a language: the output grows with their square by contract, and so does the work (terms x
sources x sources).

Edge cases: a null text, lang or source counts as empty; every row is a document, whether its id repeats or is null; a (lang, source)
group without terms, and a language that keeps no term, come out with values of 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import steps, written
from loam.llm.words import LETTERS, words_of

LEAST_DOCS = 10  #: documents of a language that a kept term occurs in
TOP = 10  #: ranks of part `term`
UNIT = 10**9
CHUNK_WORDS = 1 << 20  #: words that a task sorts at a time, about
CELL = 200_000  #: rows (term, source) of a cell, about
TILE = 1 << 20  #: numbers of a tile of terms x sources

RUN = "lang string, term string, source string, document long, docs long, n long"
KEPT = "lang string, term string, source string, n long"
PART = "lang string, source string, part string, item string, value long"


def _chunk_runs(lang: pa.Array, source: pa.Array, ids: pa.Array, words: list[pa.Array], counts: np.ndarray) -> pa.RecordBatch:
    """The partial runs of a chunk of documents, sorted by (lang, term, source, document) numbers."""
    coded = pa.concat_arrays(words).dictionary_encode()
    names = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    table = pa.table({"lang": lang, "source": source, "k": np.arange(len(lang))})
    groups = table.group_by(["lang", "source"]).aggregate([("k", "list")]).combine_chunks()
    group = np.zeros(len(lang), np.int64)
    members = groups.column("k_list").combine_chunks()
    group[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), members.value_lengths().to_numpy())
    n_docs, n_groups = len(lang), len(groups)
    document = np.repeat(np.arange(n_docs), counts)
    # Documents in the order of their groups: so one sort by (term, place of the document) is one by (term, group, document).
    by_group = np.argsort(group, kind="stable")
    place = np.empty(n_docs, np.int64)
    place[by_group] = np.arange(n_docs)
    key = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_docs + place[document])
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])  # runs of one term in one document
    times = np.diff(np.append(head, len(key)))
    term, doc = key[head] // max(1, n_docs), by_group[key[head] % max(1, n_docs)]
    run = term * n_groups + group[doc]
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])  # runs of one term in one group
    docs, n = np.diff(np.append(start, len(run))), np.add.reduceat(times, start) if len(start) else times
    g = pa.array(run[start] % max(1, n_groups))
    out = [groups.column("lang").combine_chunks().take(g), coded.dictionary.take(pa.array(term[start])).cast(pa.string()), groups.column("source").combine_chunks().take(g), ids.take(pa.array(doc[start])), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(out, names=["lang", "term", "source", "document", "docs", "n"])


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, doc_id, text to partial runs, a chunk of CHUNK_WORDS words or one document at a time."""
    held: list[tuple] = []
    size = 0

    def chunk() -> pa.RecordBatch:
        lang, source, ids, words, counts = zip(*held, strict=True)
        return _chunk_runs(pa.concat_arrays(lang), pa.concat_arrays(source), pa.concat_arrays(ids), list(words), np.concatenate(counts))

    for batch in steps(batches, 3):
        words, counts = words_of(batch.column(3), LETTERS)
        if held and size + len(words) > CHUNK_WORDS:
            yield chunk()
            held, size = [], 0
        held.append((batch.column(0), batch.column(1), batch.column(2), words, counts))
        size += len(words)
    if held:
        yield chunk()


def _scan(least: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted partial runs to (lang, term, source, n) of the kept terms. The last term of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []

        def closed(rows: pa.Table) -> pa.RecordBatch | None:
            lang, term, source = (rows.column(k).combine_chunks() for k in ("lang", "term", "source"))
            new_term, new_source = _changes(lang) | _changes(term), _changes(source)
            at = np.flatnonzero(new_term | new_source)
            if not len(at):
                return None
            n = np.add.reduceat(rows.column("n").to_numpy(), at)
            own = np.cumsum(new_term) - 1
            docs = np.bincount(own, rows.column("docs").to_numpy().astype(np.float64)).astype(np.int64)  # exact below 2^53
            stay = docs[own[at]] >= least
            k = pa.array(at[stay])
            return pa.RecordBatch.from_arrays([lang.take(k), term.take(k), source.take(k), pa.array(n[stay], pa.int64())], names=["lang", "term", "source", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(_changes(batch.column(0)) | _changes(batch.column(1)))
            begins = not held or batch.column(0)[0] != held[-1].column(0)[0] or batch.column(1)[0] != held[-1].column(1)[0]
            cut = int(new[-1])  # where the batch's last term begins
            if cut or begins:
                if held or cut:
                    done = closed(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    if done is not None and done.num_rows:
                        yield done
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            done = closed(pa.Table.from_batches(held))
            if done is not None and done.num_rows:
                yield done

    return scanned


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    return np.concatenate([[True], pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n): how often each kept term occurs in each group that holds it."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    runs = docs.select(text("lang"), text("source"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_partial_runs, RUN)
    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(_scan(least), KEPT)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) of counts up to their totals, in 64 bits a decimal digit at a time: exact for totals up to 9 * 10^17."""
    rest, out = np.broadcast_to(count, np.broadcast(count, total).shape).astype(np.int64), 0
    out = np.zeros_like(rest)
    for _ in range(9):
        out = 10 * out + (10 * rest) // total
        rest = (10 * rest) % total
    return out + 1  # a count equal to its total leaves no rest after the first digit, which is 10


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _cell(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial values of the pairs, and the first terms, of one cell of a language. groups: (source, n, v, all) of all its sources."""
    lang = key[0].as_py()
    sources = groups.column("source").combine_chunks()
    s = len(sources)
    n, v = groups.column("n").to_numpy(), int(groups.column("v")[0].as_py()) if s else 0
    total, whole = n + 2 * v, (int(groups.column("all")[0].as_py()) if s else 0) + 2 * v
    coded = terms.column("term").combine_chunks().dictionary_encode()
    names = coded.dictionary
    at = pa.compute.index_in(terms.column("source").combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False)
    row, n_terms = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    by_term = np.argsort(row, kind="stable")
    row, at, times = row[by_term], at[by_term], terms.column("n").to_numpy()[by_term]
    values = np.zeros((s, s), np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in range(s)]
    tile = max(1, TILE // max(1, s))
    for a in range(0, n_terms, tile):
        low, high = np.searchsorted(row, [a, a + tile])
        count = np.zeros((min(tile, n_terms - a), s), np.int64)
        count[row[low:high] - a, at[low:high]] = times[low:high]
        p = shares(count + 2, total)
        q = shares(count.sum(1) + 2, np.int64(whole))
        for g in range(s):
            if g + 1 < s:
                values[g, g + 1 :] += _gap(p[:, g : g + 1], p[:, g + 1 :]).sum(0)
            over = np.flatnonzero((count[:, g] > 0) & (p[:, g] > q))
            f = _gap(p[over, g], q[over])
            if len(over) > TOP:
                keep = f >= np.partition(f, len(f) - TOP)[len(f) - TOP]
                over, f = over[keep], f[keep]
            found = zip((-f).tolist(), (names[k + a].as_py() for k in over.tolist()), strict=True)
            best[g] = sorted([*best[g], *found], key=lambda x: (x[0], x[1].encode()))[:TOP]
    values += values.T
    pair = np.argwhere(~np.eye(s, dtype=bool))
    first = [(g, t, -f) for g in range(s) for f, t in best[g]]
    one = pa.array(pair[:, 0] if s else []).cast(pa.int64())
    parts = [
        pa.table({"lang": pa.array([lang] * len(pair), pa.string()), "source": sources.take(one), "part": pa.array(["pair"] * len(pair), pa.string()), "item": sources.take(pa.array(pair[:, 1])), "value": pa.array(values[pair[:, 0], pair[:, 1]])}),
        pa.table({"lang": pa.array([lang] * len(first), pa.string()), "source": sources.take(pa.array([x[0] for x in first], pa.int64())), "part": pa.array(["term"] * len(first), pa.string()), "item": pa.array([x[1] for x in first], pa.string()), "value": pa.array([x[2] for x in first], pa.int64())}),
    ]
    return pa.concat_tables(parts)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank: how far each source's terms lie from each other source's of its language, and which lead."""
    if top > TOP:
        raise ValueError(f"cells keep {TOP} terms a source")
    kept = written(kept_terms(docs, least), "divergence-kept")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang", "term").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"), F.sum("rows").alias("rows"))
    groups = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "all", "rows"])
    groups = groups.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL)).cast("int"))
    groups = written(groups, "divergence-groups")
    cells = groups.select("lang", "cells").distinct()
    dealt = kept.join(cells, "lang").withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")).cast("int")).drop("cells")
    beside = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("lang", "cell", "source", "n", "v", "all")
    parts = dealt.groupBy("lang", "cell").cogroup(beside.groupBy("lang", "cell")).applyInArrow(_cell, PART)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one cell
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= top))
