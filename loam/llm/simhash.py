"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints link at `DISTANCE` or fewer differing bits. 64 bits are cut into segments of 22, 21 and 21 bits, each
padded to a 23-bit word of the perfect binary Golay code, which puts every word within 3 errors of exactly one codeword.
With at most 4 errors over three segments, either a segment has none, or two segments have at most one each:

* no error in a segment: the others' bits, cut into 5 pieces, have one without error, so the segment beside each piece is
  a key (15 keys);
* one error at most in segments i and j, two at most in segment k: decoding y_i gives a codeword that lies within 4 of
  x_i, so x lists the codewords within 4 of x_i (6 at most) beside the one of x_j, y the one of y_i beside those within 4
  of y_j; the two lists meet in (codeword of y_i, codeword of x_j). One of 3 pieces of segment k has no error and makes
  the key longer. 54 keys on either side over the 3 pairs of segments.

Keys only propose: each candidate pair is verified on all 64 bits. Only connectivity is asked for, so no bucket is
expanded into all its pairs: the members of a bucket of exact keys are first tested against its least fingerprint, which
joins a group of near copies with as many rows as it has members; after that buckets within one component are left out,
and elsewhere only the members outside the bucket's largest component are tested against the others. A bucket that would
still take more than CROWD tests is dealt into finer ones before that: its pairs differ in few of the bits that its key
leaves open, so those are cut into one piece more than errors, of which one has none and makes the key longer. All of this
is on distinct fingerprints; copies share theirs. Fingerprints, roots and hubs with a good share of the rows stay where
they are in joins.

Edge cases: a null text, an empty text or one of white space alone has fingerprint zero and links like any other; under 4
words, the whole sequence is the only shingle; a null doc_id ranks last as component_id, which is null only where all
ids of a component are null; repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import forget, hot_join, hot_keys, rows_of, slices, written
from loam.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  #: (first bit, bits)
GENERATOR = 0b101011100011  #: fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RUN = 1 << 16  #: shingles whose bits are counted at a time
CROWD = 1024  #: tests of a bucket (members outside its largest component against all) beyond which it is dealt into finer ones
SPREAD = 20_000  #: fingerprints whose keys one task makes, about


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: bit b is 1 if it is 1 in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z alone change, and exactly \x20\x09-\x0D split
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digests = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED))
    for left in range(n, 0, -RUN):
        hashes = np.fromiter(itertools.islice(digests, RUN), np.uint64, min(RUN, left))
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def work(batches):
        for rows in rows_of(batches):
            fps = np.fromiter((fingerprint(text) for _, text in rows), np.uint64, len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


class Golay:
    """Decoding of 23-bit words: the error of each of the 2048 syndromes, and the 5 words of weight 4 that share it."""

    def __init__(self) -> None:
        self.near = np.zeros(2048, np.int64)
        self.far = np.full((2048, 5), -1, np.int64)
        filled = [0] * 2048
        for weight in range(5):
            for places in itertools.combinations(range(23), weight):
                error = sum(1 << p for p in places)
                s = int(self.syndrome(np.array([error], np.int64))[0])
                if weight < 4:
                    self.near[s] = error
                else:
                    self.far[s, filled[s]] = error
                    filled[s] += 1

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
        return rest

    def codeword(self, words: np.ndarray) -> np.ndarray:
        """The number of the one codeword within 3 errors."""
        return (words ^ self.near[self.syndrome(words)]) >> 11

    def codewords(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) numbers of the codewords within 4 errors; -1 fills."""
        far = self.far[self.syndrome(words)]
        more = np.where(far >= 0, (words[:, None] ^ far) >> 11, -1)
        return np.concatenate([self.codeword(words)[:, None], more], axis=1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


EXACT, LEFT, RIGHT = 2, 0, 1  #: sides of a key; a pair of rows is a candidate if its sides are (2, 2) or (0, 1)


def _pieces(fps: np.ndarray, segments: list[int], count: int) -> list[np.ndarray]:
    """The bits of these segments, in order, cut into `count` pieces."""
    places = np.array([p for k in segments for p in range(SEGMENTS[k][0], sum(SEGMENTS[k]))], np.uint64)
    out = []
    for own in np.array_split(places, count):
        piece = np.zeros(len(fps), np.int64)
        for n, p in enumerate(own):
            piece |= (fps >> p & np.uint64(1)).astype(np.int64) << n
        out.append(piece)
    return out


def keys_of(fps: np.ndarray, exact_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, side) of all keys of fingerprints (uint64). A key holds its kind, the number of its piece, the piece and the codes."""
    code, n, every = golay(), len(fps), range(len(SEGMENTS))
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    keys, rows, sides = [], [], []
    one, some = ([], []) if exact_only else ([code.codeword(p) for p in parts], [code.codewords(p) for p in parts])
    for k, p in enumerate(parts):
        for m, piece in enumerate(_pieces(fps, [x for x in every if x != k], DISTANCE + 1)):
            keys.append(p | piece << 24 | (k << 4 | m) << 40)
            rows.append(np.arange(n))
            sides.append(np.full(n, EXACT, np.int8))
    for number, (i, j) in enumerate(() if exact_only else itertools.combinations(every, 2), len(parts)):
        pieces = _pieces(fps, [x for x in every if x not in (i, j)], DISTANCE - 1)
        for side, first, second in ((LEFT, some[i], one[j][:, None]), (RIGHT, one[i][:, None], some[j])):
            both = np.where((first >= 0) & (second >= 0), first << 12 | second, -1)
            row, column = np.nonzero(both >= 0)
            codes = both[row, column]
            for m, piece in enumerate(pieces):
                keys.append(codes | piece[row] << 24 | (number << 4 | m) << 40)
                rows.append(row)
                sides.append(np.full(len(row), side, np.int8))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(sides)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        if len(fps):
            key, row, _ = keys_of(fps.view(np.uint64), exact_only=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps, roots = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if len(fps):
            key, row, side = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(roots[row]), pa.array(side)], names=["key", "fp", "root", "side"])


def finer_keys(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longer key, row) of members of buckets: the key mixed with each piece of the bits that it leaves open."""
    every = range(len(SEGMENTS))
    pairs = list(itertools.combinations(every, 2))
    kind, own = key >> 44, key >> 40 & 15
    keys, rows = [], []
    for k in np.unique(kind).tolist():
        exact = k < len(SEGMENTS)
        open_ = [x for x in every if x != k] if exact else [x for x in every if x not in pairs[k - len(SEGMENTS)]]
        count, errors = (DISTANCE + 1, DISTANCE) if exact else (DISTANCE - 1, 2)
        places = np.array([p for x in open_ for p in range(SEGMENTS[x][0], sum(SEGMENTS[x]))], np.uint64)
        for m, fixed in enumerate(np.array_split(places, count)):
            at = np.flatnonzero((kind == k) & (own == m))
            left = places[~np.isin(places, fixed)]
            for j, bits in enumerate(np.array_split(left, errors + 1)):
                piece = np.full(len(at), j, np.uint64)
                for p in bits:
                    piece = piece << np.uint64(1) | fps[at] >> p & np.uint64(1)
                keys.append((key[at].view(np.uint64) * MIX ^ piece * MIX2).view(np.int64))  # chance meetings are ruled out by verification
                rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        if batch.num_rows:
            key, fps, roots, side = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            longer, row = finer_keys(key, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(longer), pa.array(fps[row]), pa.array(roots[row]), pa.array(side[row])], names=["key", "fp", "root", "side"])


def near(a: str, b: str, distance: int = DISTANCE):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


MEMBER = "key long, fp long, root long, side byte"


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets where a left side and a right side come from two components, with the bucket's largest component (main) and the tests of the members outside of it against all (pairs)."""
    on = lambda side: F.when(F.col("side") != side, F.col("root"))
    ends = members.groupBy("key").agg(F.min(on(RIGHT)).alias("l"), F.max(on(RIGHT)).alias("ll"), F.min(on(LEFT)).alias("r"), F.max(on(LEFT)).alias("rr"))
    shared = ends.filter("l is not null and r is not null and (l <> r or l <> ll or r <> rr)").select("key")
    kept = written(members.join(shared, "key", "left_semi"), "simhash-shared")
    sizes = kept.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") * (F.sum("n") - F.max("n"))).alias("pairs"))
    out = written(kept.join(main, "key"), "simhash-open")
    forget(kept)
    return out


def _cross(members: DataFrame) -> DataFrame:
    """Links (a, b) between components: members outside a bucket's largest component against the others."""
    some = members.filter("root <> main").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"), F.col("side").alias("sa"))
    others = members.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"), F.col("side").alias("sb"))
    sides = ((F.col("sa") == EXACT) & (F.col("sb") == EXACT)) | (F.col("sa") + F.col("sb") == LEFT + RIGHT)
    return some.join(others, (some["key"] == others["key"]) & (F.col("ra") != F.col("rb")) & sides & near("a", "b")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def link(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root): the component of every one of them, under the least signed value in it."""
    spread = max(1, -(-fps.count() // SPREAD))
    fps = fps.repartition(spread)
    exact = fps.mapInArrow(_exact, "key long, fp long")
    reps = exact.groupBy("key").agg(F.min("fp").alias("rep"), F.max("fp").alias("top")).filter("rep <> top").select("key", "rep")
    stars = exact.join(reps, "key").filter((F.col("fp") != F.col("rep")) & near("fp", "rep"))
    first = components(stars.select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct())
    labelled = written(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-labelled")
    keyed = written(labelled.repartition(spread).mapInArrow(_keyed, MEMBER), "simhash-keys")
    members = _open(keyed)
    forget(keyed)
    links = _cross(members.filter(F.col("pairs") <= CROWD))
    crowded, finer = members.filter(F.col("pairs") > CROWD).select("key", "fp", "root", "side"), []
    if not crowded.isEmpty():
        finer = [_open(crowded.mapInArrow(_finer, MEMBER))]
        links = links.unionByName(_cross(finer[0]))
    second = components(links.distinct())
    for t in (members, *finer):
        forget(t)
    second = written(second.select(F.col("node").alias("root"), F.col("root").alias("last")), "simhash-second")
    counts = labelled.groupBy("root").agg(F.count("*").alias("n"))
    joined = hot_join(labelled, second, "root", hot_keys(counts, "root"), "left")
    return joined.select("fp", F.coalesce("last", "root").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for each row of docs."""
    hashed = written(fingerprints(docs), "simhash-fp")
    least = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    joined = written(least.join(link(least.select("fp")), "fp"), "simhash-roots")
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(joined.select("fp", "root"), groups.select("root", "component_id"), "root", hot_keys(groups, "root"))
    named = written(named.select("fp", "component_id"), "simhash-groups")
    return hot_join(hashed, named, "fp", hot_keys(least, "fp")).select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
