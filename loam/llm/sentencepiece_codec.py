"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut where no piece can reach across (before a blank, beside a character that no longer piece holds), and each
distinct stretch, called a word here, is encoded once. Words of equal length advance together: at each end position the
hashes of all substrings that end there probe the sorted hashes of the pieces, and the best way to reach the position is
a maximum over the substrings, kept as a backpointer.

Unigram models add piece scores. In a BPE model the encoding of a text is the one sequence in which every two neighbours
are what BPE makes of their concatenation; so a step onto a piece scores 0 if it and its predecessor are such neighbours
and minus infinity if not, and the maximum finds the same ids as the merges would. Whether two pieces may be neighbours
is looked up by undoing their merges, vectorised over pairs.

That also lets a long word (an unbroken run of letters) advance in overlapping stretches, all at once: where two of them
hold the same piece at the same place, their encodings join there, as every pair of neighbours stays one of either. Where
they hold none in common, the later stretch begins anew at the last pieces of the earlier one, back to the beginning if need
be. Under a unigram model a long word advances alone.

Edge cases: a null or empty text has no ids and decodes to the empty text; characters without a piece become byte pieces
(or the unknown piece where a model has none); a literal U+2581 decodes to a blank, as in the public library, so that
only such texts are not restored; repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.common import release, rows_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"  #: stands for a blank in pieces
# Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
HELD_WORDS = 1 << 18  #: words whose ids a worker remembers
HELD_PAIRS = 1 << 20  #: slots for pairs of pieces that a worker remembers
TOGETHER = 1 << 16  #: characters of words that advance together
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
LONG = 2048  #: characters beyond which a BPE word advances in stretches
STRETCH, OVERLAP = 512, 128  #: characters of a stretch before the next one begins, and after


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Pieces:
    kind: int
    texts: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool
    blanks_collapse: bool
    unknown: int
    by_text: dict[str, int] = field(default_factory=dict)  #: of what text can become
    bytes_: list[int] = field(default_factory=list)  #: ids of the 256 byte pieces, or empty
    keys: np.ndarray = None  #: sorted hashes
    ids: np.ndarray = None  #: in the order of keys
    filter_: np.ndarray = None
    codes: np.ndarray = None  #: (pieces, longest) code points
    lengths: np.ndarray = None
    longest: int = 1
    rank: np.ndarray = None  #: BPE: order of the merge that makes a piece, 0 for a single character
    left: np.ndarray = None
    right: np.ndarray = None
    merge_keys: np.ndarray = None
    merge_ranks: np.ndarray = None
    cutter: str = ""


def load(content: bytes) -> Pieces:
    texts, scores, kinds = [], [], []
    kind, prefix, collapse = UNIGRAM, True, True
    for number, value in _fields(content):
        if number == 1:
            text, score, own = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    own = v
            texts.append(text)
            scores.append(score)
            kinds.append(own)
        elif number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            prefix, collapse = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            if spec.get(2) or not spec.get(5, 1):
                raise NotImplementedError("models with a character map of their own, or without escaped blanks")
    if kind not in (UNIGRAM, BPE):
        raise NotImplementedError("neither a unigram nor a BPE model")
    m = Pieces(kind, texts, np.array(scores), kinds, prefix, collapse, next((k for k, x in enumerate(kinds) if x == UNKNOWN), 0))
    m.by_text = {t: k for k, (t, x) in enumerate(zip(texts, kinds, strict=True)) if x in (NORMAL, USER_DEFINED) and t}
    found = {t: k for k, (t, x) in enumerate(zip(texts, kinds, strict=True)) if x == BYTE}
    m.bytes_ = [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else []
    m.longest = max(map(len, m.by_text), default=1)
    m.codes = np.zeros((len(texts), m.longest), np.uint32)
    m.lengths = np.zeros(len(texts), np.int64)
    for t, k in m.by_text.items():
        m.codes[k, : len(t)] = [ord(c) for c in t]
        m.lengths[k] = len(t)
    order = np.fromiter(m.by_text.values(), np.int64, len(m.by_text))
    hashes = np.zeros(len(order), np.uint64)
    for c in range(m.longest):
        longer = m.lengths[order] > c
        hashes[longer] = hashes[longer] * BASE + m.codes[order[longer], c].astype(np.uint64) + np.uint64(1)
    at = np.argsort(hashes)
    m.keys, m.ids = hashes[at], order[at]
    if (m.keys[1:] == m.keys[:-1]).any():
        raise ValueError("two pieces share a hash")
    m.filter_ = np.zeros(1 << FILTER_BITS, bool)
    m.filter_[(m.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    longer = [t for t in m.by_text if len(t) > 1]
    joins = {c for t in longer for c in t} - {BLANK}
    if any(BLANK in t.lstrip(BLANK) for t in longer):
        m.cutter = r"(?s).+"  # pieces reach across blanks
    else:
        own = "[" + "".join(map(re.escape, sorted(joins))) + "]" if joins else r"(?!)"
        m.cutter = rf"(?s){BLANK}+{own}*|{own}+|."
    if kind == BPE:
        _merges(m)
    return m


def _merges(m: Pieces) -> None:
    """What BPE does to each piece: the order of merges, the last merge of each piece, and the order of every pair that can merge."""
    n = len(m.texts)
    made = sorted((t for t in m.by_text if len(t) > 1), key=lambda t: (-m.scores[m.by_text[t]], m.by_text[t]))
    m.rank, m.left, m.right = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    ranks: dict[float, int] = {}
    for t in made:
        m.rank[m.by_text[t]] = ranks.setdefault(float(m.scores[m.by_text[t]]), len(ranks) + 1)
    pairs = {}
    for t in made:
        for k in range(1, len(t)):
            if t[:k] in m.by_text and t[k:] in m.by_text:
                pairs[m.by_text[t[:k]], m.by_text[t[k:]]] = m.rank[m.by_text[t]]
    keys = np.array([a * n + b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    m.merge_keys, m.merge_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
    for t in made:
        ids = [m.by_text.get(c, -1) for c in t]
        while len(ids) > 2:  # the merges inside the piece; the leftmost of equals first
            best = min(((pairs.get((a, b), n * n), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(n * n, 0))
            if best[0] == n * n:
                break
            k = best[1]
            ids[k : k + 2] = [m.by_text[m.texts[ids[k]] + m.texts[ids[k + 1]]]]
        if len(ids) == 2:
            m.left[m.by_text[t]], m.right[m.by_text[t]] = ids


def neighbours(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE leaves pieces a and b, side by side, as they are.

    Undo the later of the two pieces' last merges, again and again: whatever then stands at the border must not have
    been able to merge before the merge that was undone (at equal order the left one of two merges comes first).
    """
    n = len(m.texts)
    out = np.ones(len(a), bool)
    x, y = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)  # merges at the border must not come before this
    live = np.arange(len(a))
    while len(live):
        key = x[live] * n + y[live]
        at = np.minimum(np.searchsorted(m.merge_keys, key), len(m.merge_keys) - 1)
        rank = np.where(m.merge_keys[at] == key, m.merge_ranks[at], np.iinfo(np.int64).max)
        bad = rank < limit[live]
        out[live[bad]] = False
        live = live[~bad]
        ra, rb = m.rank[x[live]], m.rank[y[live]]
        done = (ra == 0) & (rb == 0)
        live, ra, rb = live[~done], ra[~done], rb[~done]
        first = rb >= ra  # of equals the right one was merged last
        i, j = live[first], live[~first]
        limit[i] = rb[first] + 1  # the border lies left of it, so an equal order would have come first
        y[i] = m.left[y[i]]
        limit[j] = ra[~first]
        x[j] = m.right[x[j]]
    return out


class Encoder:
    """Encodes texts with one model; remembers words and pairs up to a bound."""

    def __init__(self, model: Pieces) -> None:
        self.m = model
        self.cut = re.compile(model.cutter).findall
        self.pair_keys = np.full(HELD_PAIRS if model.kind == BPE else 1, -1, np.int64)
        self.pair_fits = np.zeros(len(self.pair_keys), bool)
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.words: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def prepared(self, text: str | None) -> str:
        text = text or ""
        if self.m.blanks_collapse:
            text = " ".join(x for x in text.split(" ") if x)
        text = text.replace(" ", BLANK)
        return BLANK + text if text and self.m.dummy_prefix else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.words) > HELD_WORDS:
            self.clear()
        cut = [self.cut(self.prepared(t)) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for own in cut for w in own]
        known = self.words
        news = list(set(words).difference(known))
        if news:
            self._learn(news)
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        size, start = self.sizes[number], self.starts[number]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], np.diff(upto)

    def _learn(self, news: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in news:
            by.setdefault(len(w), []).append(w)
        sizes, flats, base = [], [], len(self.words)
        for n, same in by.items():
            alone = n > LONG and self.m.kind == BPE
            for a in range(0, len(same), step := 1 if alone else max(1, TOGETHER // n)):
                part = same[a : a + step]
                self.words.update(zip(part, range(base, base + len(part)), strict=True))
                base += len(part)
                ids, counts = self.long_path(part[0]) if alone else self.paths(part)
                flats.append(ids)
                sizes.append(counts)
        sizes = np.concatenate(sizes)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *flats]).astype(np.int32)

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words of one length one after the other, number of ids of each)."""
        codes, ids, ends = self._walk(words)
        return self._spelled(codes[ends], ids, ends.sum(axis=1))

    def long_path(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """`paths` of one long word of a BPE model, by stretches that are encoded together."""
        n, size = len(word), STRETCH + OVERLAP
        starts = range(0, n - OVERLAP, STRETCH)
        once: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # stretch -> (ends, pieces)
        fresh = sorted({word[a : a + size] for a in starts}, key=len)
        for length, same in itertools.groupby(fresh, len):
            same = list(same)
            for a in range(0, len(same), step := max(1, 4 * TOGETHER // length)):
                self._stretches(same[a : a + step], once)
        ends, ids, held = np.zeros(n, np.int64), np.zeros(n, np.int64), 0  # the path so far: `held` pieces
        for a in starts:
            own_ends, own_ids = once[word[a : a + size]]
            own_ends = own_ends + a
            low = max(0, held - len(own_ends))
            _, at, own_at = np.intersect1d(ends[low:held] * len(self.m.texts) + ids[low:held], own_ends * len(self.m.texts) + own_ids, return_indices=True)
            if len(at) or not held:
                held = low + int(at[-1]) + 1 if held else 0
                rest = slice(int(own_at[-1]) + 1 if held else 0, None)
                own_ends, own_ids = own_ends[rest], own_ids[rest]
            else:  # begin anew at a border of the path, each time further back, until the neighbours there fit
                for back in (1 << k for k in itertools.count()):
                    held = max(0, held - back)
                    border = int(ends[held - 1]) if held else 0
                    if word[border : a + size] not in once:
                        self._stretches([word[border : a + size]], once)
                    own_ends, own_ids = once[word[border : a + size]]
                    own_ends = own_ends + border
                    if not held or own_ids[0] < 0 or self._fit(ids[held - 1 : held], own_ids[:1])[0]:
                        break
            ends[held : held + len(own_ends)], ids[held : held + len(own_ids)] = own_ends, own_ids
            held += len(own_ends)
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return self._spelled(codes[ends[:held] - 1], ids[:held], np.array([held]))

    def _stretches(self, same: list[str], into: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        _, ids, ends = self._walk(same)
        cut = np.cumsum(ends.sum(axis=1))[:-1]
        into.update(zip(same, zip(np.split(np.nonzero(ends)[1] + 1, cut), np.split(ids, cut), strict=True), strict=True))

    def _walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of words of one length, their pieces one after the other, where pieces end). Tables have a row a place, a column a word."""
        m, n, b = self.m, len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(b, n)
        places = np.ascontiguousarray(codes.T)
        hashes = np.zeros((n + 1, b), np.uint64)
        for k in range(n):
            hashes[k + 1] = hashes[k] * BASE + places[k].astype(np.uint64) + np.uint64(1)
        powers = np.full(m.longest + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        score = np.full((n + 1, b), -np.inf)
        score[0] = 0
        reachable = np.zeros((n + 1, b), bool)
        reachable[0] = True
        last = np.full((n + 1, b), -1, np.int64)  # the piece that ends here; -1: a character without one, or the start
        back = np.zeros((n + 1, b), np.int32)
        lost = float(m.scores.min(initial=0)) - 10  # what a character without a piece costs
        for end in range(1, n + 1):
            for size in range(1, min(end, m.longest) + 1):
                start = end - size
                key = hashes[end] - hashes[start] * powers[size]
                rows = np.flatnonzero(m.filter_[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & reachable[start])
                if len(rows):
                    own = key[rows]
                    at = np.minimum(np.searchsorted(m.keys, own), len(m.keys) - 1)
                    ids = m.ids[at]
                    fits = (m.keys[at] == own) & (m.lengths[ids] == size)
                    rows, ids = rows[fits], ids[fits]
                    fits = (m.codes[ids, :size] == codes[rows, start:end]).all(axis=1)
                    rows, ids = rows[fits], ids[fits]
                if size == 1:
                    alone = reachable[start].copy()
                    alone[rows] = False
                    alone = np.flatnonzero(alone)
                    score[end, alone], back[end, alone], reachable[end, alone] = score[start, alone] + lost, 1, True
                if len(rows):
                    before = last[start, rows]
                    if m.kind == BPE:
                        fits = self._fit(before, ids)
                        rows, ids, gain = rows[fits], ids[fits], 0.0
                    else:
                        gain = m.scores[ids]
                    reached = score[start, rows] + gain
                    better = reached > score[end, rows]
                    rows, ids = rows[better], ids[better]
                    score[end, rows], last[end, rows], back[end, rows], reachable[end, rows] = reached[better], ids, size, True
        # The paths that the backpointers name, all words a step at a time.
        ends = np.zeros((b, n), bool)  # a piece ends with this character
        rows, at = np.arange(b), np.full(b, n)
        while len(rows):
            ends[rows, at - 1] = True
            at = at - back[at, rows]
            on = at > 0
            rows, at = rows[on], at[on]
        return codes, last[1:].T[ends], ends

    def _spelled(self, final: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with characters that have no piece spelled out; final: the code points that the pieces end with."""
        bare = ids < 0
        if bare.any():
            spelled = [self._bytes(chr(c)) for c in final[bare].tolist()]
            width = np.ones(len(ids), np.int64)
            width[bare] = [len(x) for x in spelled]
            counts = np.add.reduceat(width, np.cumsum(counts) - counts)
            filled = np.repeat(bare, width)
            ids = np.repeat(ids, width)
            ids[filled] = [y for x in spelled for y in x]
        return ids, counts

    def _bytes(self, c: str) -> list[int]:
        return [self.m.bytes_[x] for x in c.encode()] if self.m.bytes_ else [self.m.unknown]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a < 0
        at = np.flatnonzero(~out)
        pair = a[at] * len(self.m.texts) + b[at]
        slot = (pair * 0x9E3779B1 >> 7) & (HELD_PAIRS - 1)
        fresh = np.flatnonzero(self.pair_keys[slot] != pair)
        fits = self.pair_fits[slot]
        if len(fresh):
            once, back = np.unique(pair[fresh], return_inverse=True)
            found = neighbours(self.m, once // len(self.m.texts), once % len(self.m.texts))
            fits[fresh] = found[back]
            own = (once * 0x9E3779B1 >> 7) & (HELD_PAIRS - 1)
            keep = np.unique(own, return_index=True)[1]  # one pair a slot
            self.pair_keys[own[keep]], self.pair_fits[own[keep]] = once[keep], found[keep]
        out[at] = fits
        return out


def decode(m: Pieces, ids: np.ndarray, surfaces: list[bytes]) -> str:
    """The text of ids; surfaces: `surfaces_of(m)`."""
    text = b"".join(map(surfaces.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if m.dummy_prefix and text.startswith(" ") else text


def surfaces_of(m: Pieces) -> list[bytes]:
    """What each piece adds to a decoded text."""
    out = []
    for t, kind in zip(m.texts, m.kinds, strict=True):
        out.append(bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else t.replace(BLANK, " ").encode())
    return out


@cache
def _loaded(content: bytes) -> tuple[Encoder, list[bytes]]:
    m = load(content)
    return Encoder(m), surfaces_of(m)


def _content(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def encode_texts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids for each row of docs. The model file is read on the driver and goes along with the tasks."""
    content = docs.sparkSession.sparkContext.broadcast(_content(model))  # a vocabulary file: half a megabyte, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _loaded(content.value)
        for rows in rows_of(batches):
            ids, counts = encoder.encode([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(counts, pa.int64()), _lists(ids, counts)], names=["doc_id", "n_tokens", "token_ids"])
        encoder.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, token_ids array<int>")


def decode_ids(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for each row of (doc_id, token_ids); null ids give the empty text."""
    content = tokens.sparkSession.sparkContext.broadcast(_content(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, surfaces = _loaded(content.value)
        for batch in batches:
            texts = [decode(encoder.m, np.array(x or [], np.int64), surfaces) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(work, "doc_id long, text string")


ROUND_TRIP = "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string, lossless boolean"


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode each text and decode its ids again in one narrow pass: the ids, the SHA-256 of what came back, and whether it is the text."""
    content = docs.sparkSession.sparkContext.broadcast(_content(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, surfaces = _loaded(content.value)
        for rows in rows_of(batches):
            ids, counts = encoder.encode([r[1] for r in rows])
            texts = [decode(encoder.m, own, surfaces) for own in np.split(ids, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(counts, pa.int64()),
                    _lists(ids, counts),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([t == (r[1] or "") for t, r in zip(texts, rows, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "token_ids", "decoded_sha256", "lossless"],
            )
        encoder.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(work, ROUND_TRIP)
