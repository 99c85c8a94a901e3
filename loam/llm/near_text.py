"""Near copies of texts by the Jaccard similarity of their word shingles, complete at SIMILARITY.

A text is the set of its 5-word shingles (64-bit hashes). In any one order of all shingles, two sets of n and m members
that share 4/5 of their union share one among their first n // 5 + 1 and m // 5 + 1, so those are the keys (prefix filter).
The order puts shingles that are common in a bounded sample of texts last, the most common at the very end: a passage that
many texts quote gives no keys unless it is most of a text.

Keys only propose: sizes and places in the order rule pairs out, then bit maps of the shingles do (each bit that one has alone
is a shingle that it has alone), and the others are verified on all shingles. Only connectivity is
asked for, so the members of a bucket are first tested against its least one, and in buckets where that leaves many apart, those
outside the bucket's largest component against a member of it, a few times; then buckets within one component are left
out, and elsewhere only the members outside the bucket's largest component are tested against the others. A pair of them
must share as many keys as it takes: of s shared shingles, the keys of the text whose last key comes first hold all but
those that it has alone, so n // 5 + 1 - (n - s) at least are keys of both. (A crowd of texts of which each pair shares
nearly enough and none enough is still tested pair by pair.) Links that another method has found come in with the first ones.

Edge cases: as in `simhash`: A-Z alone fold, exactly U+0020 and U+0009 to U+000D split; under 5 words, the whole sequence is
the only shingle; texts without words (null, empty, white space) are copies of each other and of nothing else; a null
doc_id ranks last as component_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import SPACES, forget, hot_join, hot_keys, rows_of, slices, written
from loam.llm.components import components

WORDS = 5  #: words of a shingle
PART, WHOLE = 4, 5  #: SIMILARITY is PART / WHOLE
SEED = 42
SAMPLE = 4096  #: texts at most that the common shingles are taken from
SAMPLE_CHARS = 4000  #: of each of them
CENTRES = 6  #: of a bucket's next stars
STARS = 3  #: rounds of stars at most, beyond the first, before its members are tested against each other
CROWDED = 4  #: tests a member that are made without another star
COMMON = 1 << 17  #: common shingles at most
SLOTS = 1 << 18  #: of hashes of texts; those in use are broadcast, so that few texts are shuffled


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = (text or "").encode().lower().split()  # on bytes, as in simhash
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - WORDS + 1)
    parts = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(WORDS)), strict=False)) if len(words) >= WORDS else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), np.uint64, n).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets share PART / WHOLE of their union; sets without members are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * shared >= PART * (len(a) + len(b) - shared)


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that several of the sampled texts hold, ascending; their texts)."""
    chosen = texts.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)  # SAMPLE rows
    part = texts.select("fp", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "fp")
    rows = part.groupBy("fp").agg(F.max("text").alias("text")).collect()
    found = [shingles(r.text) for r in rows]
    values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
    values, counts = values[counts > 1], counts[counts > 1]
    top = np.sort(np.argsort(-counts, kind="stable")[:COMMON])
    return values[top], counts[top]


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members that are keys, in order: rare ones by hash, then common ones by the texts that hold them."""
    if not len(own):
        return own
    at = np.searchsorted(common, own).clip(0, max(0, len(common) - 1))
    weight = np.where(common[at] == own, counts[at], 0) if len(common) else np.zeros(len(own), np.int64)
    return own[np.lexsort((own, weight))[: len(own) - -(-PART * len(own) // WHOLE) + 1]]


def bit_map(own: np.ndarray) -> np.ndarray:
    """Bytes of a map of 64 bits or more, a power of two, two or more a member."""
    size = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    bits = np.zeros(size, np.uint8)
    bits[own & (size - 1)] = 1
    return np.packbits(bits)


def possible(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Whether sets of n and m members with these maps can be similar."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    alone = lambda x, y: int(np.bitwise_count(x & ~y).sum())
    return (PART + WHOLE) * min(n - alone(a, b), m - alone(b, a)) >= PART * (n + m)


def _fit(a: str, b: str) -> Column:
    """Whether two members of a bucket (size n_, place p_ of the key) can be similar."""
    n, m, p, q = (F.col(x) for x in (f"n_{a}", f"n_{b}", f"p_{a}", f"p_{b}"))
    shared = 1 + F.least(n - p - 1, m - q - 1) + F.least(p, q)
    return (PART + WHOLE) * shared >= PART * (n + m)


def least_keys(n: Column, m: Column) -> Column:
    """How many keys similar sets of n and m members have in common at least."""
    return F.ceil(PART * (n + m) / (PART + WHOLE)) + 1 - F.ceil(PART * F.greatest(n, m) / WHOLE)


def loads(rooted: DataFrame) -> DataFrame:
    """rooted (key, n, p, root, main) -> key, rows, tests: about how many pairs of a bucket get past sizes and places.

    Similar sets differ in size by a fourth at most, and of two, the smaller has the first shared key in its first ninth.
    """
    band = F.floor(F.log("n") / F.log(F.lit(WHOLE / PART)))
    out, early = F.col("root") != F.col("main"), 9 * F.col("p") <= F.col("n")
    one = lambda x: x.cast("long")
    own = rooted.select("key", band.alias("band"), one(out & early).alias("out_early"), one(~out & early).alias("in_early"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("all"), one(out).alias("out"))
    below = own.select("key", (F.col("band") - 1).alias("band"), *(F.lit(0).cast("long").alias(x) for x in ("out_early", "in_early", "rows")), "all", "out")
    cells = own.unionByName(below).groupBy("key", "band").agg(*(F.sum(x).alias(x) for x in ("out_early", "in_early", "rows", "all", "out")))
    tests = F.col("out_early") * F.col("all") + F.col("in_early") * F.col("out")
    return cells.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum(tests).alias("tests"))


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) -> those whose texts (fp, text) are similar; sets (fp, n, bits)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, n, m, of_a, of_b = (c.to_pylist() for c in batch.columns)
            fit = [k for k in range(len(a)) if possible(n[k], np.frombuffer(of_a[k], np.uint8), m[k], np.frombuffer(of_b[k], np.uint8))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in fit], pa.int64()) for x in (a, b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for rows in rows_of(batches, text=2):
            out = []
            for a, b, text_a, text_b in rows:
                if a != last:
                    last, own = a, shingles(text_a)
                if similar(own, shingles(text_b)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    maps = lambda x, n: sets.select(F.col("fp").alias(x), F.col("n").alias(n), F.col("bits").alias(f"of_{x}"))
    pairs = pairs.distinct().join(maps("b", "m"), "b").join(maps("a", "n"), "a").select("a", "b", "n", "m", "of_a", "of_b")
    pairs = written(pairs.mapInArrow(mapped, "a long, b long"), "near-pairs")
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    slot = F.pmod("fp", F.lit(SLOTS))
    held = texts.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi")  # SLOTS rows at most
    held = held.drop("slot").join(wanted, "fp", "left_semi")
    held = written(held.groupBy("fp").agg(F.max("text").alias("text")), "near-texts")
    with_b = pairs.join(held.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(held.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def link(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """texts (fp, text; the same text has the same fp) -> (fp, root) of those that have a near copy; root is the component's least fp.

    known: links (a, b) of fps that hold whatever the texts share.
    """
    common, counts = common_shingles(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            own = [shingles(text) for _, text in rows]
            keys = [prefix(x, common, counts) for x in own]
            bits = [bit_map(x).tobytes() for x in own]
            arrays = [pa.array([fp for fp, _ in rows], pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["fp", "n", "keys", "bits"])

    sets = texts.mapInArrow(work, "fp long, n int, keys array<long>, bits binary").groupBy("fp")
    sets = written(sets.agg(*(F.first(x).alias(x) for x in ("n", "keys", "bits"))), "near-sets")
    members = sets.select("fp", "n", F.posexplode("keys").alias("p", "key"))
    # A key is of use where two texts hold it.
    bucket = Window.partitionBy("key")
    least = F.min(F.struct("fp", "n", "p")).over(bucket).alias("least")
    open_ = written(members.select("*", least, F.max("fp").over(bucket).alias("top")).filter("least.fp <> top").drop("top"), "near-open")
    stars = open_.select("fp", F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("least.fp").alias("b"), F.col("least.n").alias("n_b"), F.col("least.p").alias("p_b"))
    stars = stars.filter((F.col("fp") != F.col("b")) & _fit("a", "b")).select(F.col("fp").alias("a"), "b")
    tried = written(stars.distinct(), "near-stars")
    links = verified(tried, texts, sets)
    first = written(components(links.unionByName(known.select("a", "b")) if known is not None else links), "near-first")
    for again in range(STARS + 1):
        rooted = open_.drop("least").join(first, open_["fp"] == first["node"], "left").select("key", "fp", "n", "p", F.coalesce("root", "fp").alias("root"))
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots"), F.sum("size").alias("all"), F.max("size").alias("in_main"))
        rooted = written(rooted.join(main.filter("roots > 1").drop("roots"), "key"), "near-rooted")
        load = written(loads(rooted), "near-loads")
        ends = load.agg(F.sum("rows").alias("rows"), F.sum("tests").alias("tests")).first()
        if again == STARS or (ends.tests or 0) <= CROWDED * (ends.rows or 0):
            break
        # Large groups whose members are near each other, but not all near the least: more stars there, around members of the main component.
        centre = lambda k: F.min_by(F.struct("fp", "n", "p"), F.struct(F.xxhash64("fp", F.lit(again * CENTRES + k)), "fp"))
        crowded = rooted.join(load.filter(F.col("tests") > CROWDED * F.col("rows")).select("key"), "key", "left_semi")
        centres = crowded.filter("root = main").groupBy("key").agg(F.array_distinct(F.array(*(centre(k) for k in range(CENTRES)))).alias("centres"))
        pairs = rooted.filter("root <> main").join(centres, "key").withColumn("centre", F.explode("centres"))
        pairs = pairs.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("centre.fp").alias("b"), F.col("centre.n").alias("n_b"), F.col("centre.p").alias("p_b"))
        pairs = pairs.filter(_fit("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "near-stars")
        links = first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        first = written(components(links.unionByName(verified(pairs, texts, sets))), "near-first")
        tried = tried.unionByName(pairs)
        forget(rooted)
        forget(load)
    forget(open_)
    side = lambda x: [F.col("key"), F.col("fp").alias(x), F.col("root").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}")]
    some = rooted.filter("root <> main").select(*side("a"))
    cross = some.join(rooted.select(*side("b"), F.col("root").eqNullSafe(F.col("main")).alias("in_main")), "key")
    cross = cross.filter((F.col("r_a") != F.col("r_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _fit("a", "b"))
    # One row a key that the two share; how many it takes follows from the pair.
    cross = cross.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), least_keys(F.col("n_a"), F.col("n_b")).alias("least"))
    cross = cross.groupBy("a", "b", "least").agg(F.count("*").alias("shared")).filter("shared >= least").select("a", "b").join(tried, ["a", "b"], "left_anti")
    more = verified(written(cross, "near-cross"), texts, sets)
    forget(rooted)
    edges = first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(edges).select(F.col("node").alias("fp"), "root")


def fp_of(text: str) -> Column:
    """A hash of the column; texts without words share 0."""
    wordless = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES.decode())) == ""
    return F.when(wordless, F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def near_duplicates(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, fp (a hash of the text), root (the component's least fp), component_id (its smallest doc_id) for each row of docs.

    known: further links (a, b) between texts, by fp_of.
    """
    texts = docs.select(fp_of("text").alias("fp"), "text", "doc_id")
    least = written(texts.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "near-distinct")
    roots = written(link(texts.select("fp", "text"), known), "near-roots")
    joined = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(joined.select("fp", "root"), groups.select("root", "component_id"), "root", hot_keys(groups, "root"))
    named = written(named.select("fp", "root", "component_id"), "near-groups")
    return hot_join(texts.select("doc_id", "fp"), named, "fp", hot_keys(least, "fp")).select("doc_id", "fp", "root", "component_id")
