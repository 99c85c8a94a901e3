"""Media columns: ISO base media containers.

`store` wraps bytes losslessly as 8-bit samples of a one-track container; `read` walks the nested boxes of any
container, decodes the sample tables and finds codec, duration and keyframe byte ranges without decoding a sample.

Edge cases: a null or empty payload is padded to one unit of 192 blanks by `text_media`; bytes that hold no movie box,
a truncated box, boxes nested too deep, a table that points outside the file or that disagrees with another on the number
of samples, and compact sample sizes (stz2) give a Media whose `error` says so, and no samples. Fragments (moof, trun) are
read. No table takes memory beyond some multiple of the file's size, whatever counts it claims.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm.common import rows_of, slices

UNIT = 192  #: bytes of a sample: one packet of 8-bit mono sound
RATE = 8000  #: samples a second of the sound, so also the time scale
PER_CHUNK = 64  #: media samples that one chunk holds
DEPTH = 32  #: boxes within boxes that are followed
KEY_EVERY = 16  #: every 16th media sample is written as a keyframe
# Fixed values of the format: box types that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Media:
    brand: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=_none)  #: offsets of the samples in decoding order
    sizes: np.ndarray = field(default_factory=_none)
    keyframes: np.ndarray = field(default_factory=_none)  #: sample numbers from 0
    error: str | None = None

    def keyframe_ranges(self) -> np.ndarray:
        """(keyframes, 2): byte ranges [start, end)."""
        start = self.starts[self.keyframes]
        return np.stack([start, start + self.sizes[self.keyframes]], axis=1)


def _box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join((head, *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of UNIT. The same payload gives the same bytes."""
    n = len(payload) // UNIT
    duration = n * UNIT
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    whole, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * (whole > 0) + [(whole + 1, rest)] * (rest > 0)
    chunks = whole + (rest > 0)
    keys = range(1, n + 1, KEY_EVERY)
    wide = len(payload) + 64 * n + (1 << 16) >= 1 << 32

    def moov(start: int) -> bytes:
        offsets = [start + k * PER_CHUNK * UNIT for k in range(chunks)]
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        head = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=7)
        movie = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, duration, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", movie, _box(b"trak", head, media))

    lead = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return b"".join((ftyp, moov(lead), _box(b"mdat", payload)))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of types, start of body, end) of every box, nested ones after the box that holds them, DEPTH levels at most."""
    at, end = start, len(data) if end is None else end
    if len(path) > DEPTH:
        raise ValueError(f"boxes nested more than {DEPTH} deep")
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            if at + 16 > end:
                raise ValueError("box header cut off")
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} at {at} ends outside what holds it")
        yield (*path, kind), at + head, at + n
        if kind in CONTAINERS:
            yield from boxes(data, at + head, at + n, (*path, kind))
        at += n


def read(content: bytes | None) -> Media:
    """What the first track with samples says, fragments included; sample payloads are never looked at."""
    out = Media()
    try:
        data = memoryview(content or b"")
        tracks: list[dict] = []
        fragments: list[dict] = []
        defaults: dict[int, tuple[int, int]] = {}
        for path, a, b in boxes(data):
            kind = path[-1]
            if kind == b"ftyp":
                out.brand = bytes(data[a : a + 4]).decode("latin-1")
            elif kind == b"trak":
                tracks.append({})
            elif kind == b"moof":
                start = a - 8
            elif kind == b"trex":
                track, _, _, size, flags = struct.unpack_from(">5I", data, a + 4)
                defaults[track] = size, flags
            elif kind == b"traf":
                fragments.append({"moof": start, "runs": []})
            elif fragments and kind == b"tfhd":
                fragments[-1]["tfhd"] = a
            elif fragments and kind == b"trun":
                fragments[-1]["runs"].append((a, b))
            elif tracks and kind == b"tkhd":
                tracks[-1]["id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif tracks and kind == b"mdhd":
                wide = data[a] == 1
                tracks[-1]["time"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif tracks and path[-2:-1] == (b"stbl",):
                if kind in tracks[-1]:
                    raise ValueError(f"second {kind.decode('latin-1')} table")
                tracks[-1][kind] = (a, b)
        mine = {f["tfhd"] for f in fragments if "tfhd" in f}
        moving = {struct.unpack_from(">I", data, at + 4)[0] for at in mine}
        track = next((t for t in tracks if b"stsz" in t and (_count(data, t) or t.get("id") in moving)), None) or next((t for t in tracks if b"stsz" in t), None)
        if track is None:
            raise ValueError("compact sample sizes are not read" if any(b"stz2" in t for t in tracks) else "no track with samples")
        out.timescale, out.duration = track.get("time", (0, 0))
        if b"stsd" in track:
            out.codec = bytes(data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16]).decode("latin-1")
        out.starts, out.sizes = _samples(data, track)
        if b"stss" in track:
            out.keyframes = _entries(data, track[b"stss"], 1, 4)[:, 0] - 1
        else:  # no table of sync samples: each sample is one
            out.keyframes = np.arange(len(out.starts))
        if len(out.keyframes) and not 0 <= out.keyframes.min() <= out.keyframes.max() < len(out.starts):
            raise ValueError("a keyframe is no sample")
        _moving(data, out, track.get("id"), fragments, defaults)
        if len(out.starts) and (out.starts.min() < 0 or (out.starts + out.sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
    except (ValueError, struct.error, KeyError, IndexError) as e:
        out.error, out.starts, out.sizes, out.keyframes = str(e) or type(e).__name__, _none(), _none(), _none()
    return out


def _entries(data: memoryview, at: tuple[int, int], fields: int, skip: int, kind: str = ">u4") -> np.ndarray:
    """(entries, fields) of a table box whose count stands `skip` bytes into its body."""
    a, b = at
    count, size = struct.unpack_from(">I", data, a + skip)[0], np.dtype(kind).itemsize * fields
    if a + skip + 4 + count * size > b:
        raise ValueError("table cut off")
    return np.frombuffer(data, kind, count * fields, a + skip + 4).astype(np.int64).reshape(count, fields)


def _count(data: memoryview, track: dict) -> int:
    return struct.unpack_from(">I", data, track[b"stsz"][0] + 8)[0]


def _samples(data: memoryview, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of the samples that the movie box lists. Nothing is allocated that the file cannot hold."""
    fixed, count = struct.unpack_from(">II", data, track[b"stsz"][0] + 4)
    if fixed and count * fixed > len(data):
        raise ValueError("samples are larger than the file")
    sizes = np.full(count, fixed, np.int64) if fixed else _entries(data, track[b"stsz"], 1, 8)[:, 0]
    if not count:
        return _none(), _none()
    chunks = (_entries(data, track[b"co64"], 1, 4, ">u8") if b"co64" in track else _entries(data, track[b"stco"], 1, 4))[:, 0]
    runs = _entries(data, track[b"stsc"], 3, 4)
    first = np.append(runs[:, 0] - 1, len(chunks))
    if not len(runs) or first[0] or (np.diff(first) < 0).any():
        raise ValueError("runs of chunks out of order")
    each = np.repeat(np.minimum(runs[:, 1], count), np.diff(first))  # samples of a chunk
    ends = np.cumsum(each)
    if not len(ends) or ends[-1] != count:
        raise ValueError("chunks hold other than the listed samples")
    before = np.cumsum(sizes) - sizes  # bytes of the samples before, over all chunks
    return np.repeat(chunks - before[np.minimum(ends - each, count - 1)], each) + before, sizes


def _moving(data: memoryview, out: Media, track: int | None, fragments: list[dict], defaults: dict[int, tuple[int, int]]) -> None:
    """Append the samples of movie fragments."""
    starts, sizes, keys = [out.starts], [out.sizes], [out.keyframes]
    held, upto = len(out.starts), 0
    for f in fragments:
        at = f["tfhd"]
        flags, owner = struct.unpack_from(">II", data, at)
        at += 8
        base = struct.unpack_from(">Q", data, at)[0] if flags & 0x1 else f["moof"]
        at += 8 * (flags & 1) + 4 * (flags >> 1 & 1) + 4 * (flags >> 3 & 1)
        size, sync = defaults.get(owner, (0, 0))
        if flags & 0x10:
            size, at = struct.unpack_from(">I", data, at)[0], at + 4
        if flags & 0x20:
            sync = struct.unpack_from(">I", data, at)[0]
        upto = base
        for a, b in f["runs"]:
            flags, count = struct.unpack_from(">II", data, a)
            a += 8
            if flags & 0x1:
                upto, a = base + struct.unpack_from(">i", data, a)[0], a + 4
            first = None
            if flags & 0x4:
                first, a = struct.unpack_from(">I", data, a)[0], a + 4
            columns = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
            if a + 4 * count * len(columns) > b or count * (size if 0x200 not in columns else 0) > len(data) or not columns and not size and count:
                raise ValueError("run cut off")
            rows = np.frombuffer(data, ">u4", count * len(columns), a).astype(np.int64).reshape(count, len(columns))
            own = rows[:, columns.index(0x200)] if 0x200 in columns else np.full(count, size, np.int64)
            marks = rows[:, columns.index(0x400)] if 0x400 in columns else np.full(count, sync, np.int64)
            if first is not None and count:
                marks[0] = first
            if owner == track:
                starts.append(upto + np.cumsum(own) - own)
                sizes.append(own)
                keys.append(held + np.flatnonzero(~marks & 0x10000))  # not marked as depending on others
                held += count
            upto += int(own.sum())
    out.starts, out.sizes, out.keyframes = (np.concatenate(x).astype(np.int64) for x in (starts, sizes, keys))


def read_back(content: bytes, media: Media) -> bytes:
    """The stored samples, in order."""
    data = memoryview(content)
    if len(media.starts) and (media.starts[1:] == (media.starts + media.sizes)[:-1]).all():  # one stretch
        return bytes(data[int(media.starts[0]) : int(media.starts[-1] + media.sizes[-1])])
    return b"".join(data[a : a + n] for a, n in zip(media.starts.tolist(), media.sizes.tolist(), strict=True))


def feature(media: Media) -> str:
    """Codec, duration and the keyframes' byte ranges in words; the ranges as a count, the first, the last and a checksum of all."""
    ranges = media.keyframe_ranges()
    check = zlib.crc32(ranges.astype(">u8").tobytes())
    ends = ",".join(f"{a}-{b}" for a, b in dict.fromkeys(map(tuple, ranges[[0, -1]].tolist() if len(ranges) else [])))
    seconds = media.duration / media.timescale if media.timescale else 0.0
    return f"brand={media.brand.strip()};codec={media.codec.strip()};seconds={seconds:.3f};samples={len(media.starts)};keyframes={len(ranges)};ranges={ends};ranges_crc32={check:08x}"


def _ranges(medias: list[Media]) -> pa.Array:
    """The keyframes' byte ranges of each file as an array of structs."""
    each = [m.keyframe_ranges() for m in medias]
    flat = np.concatenate([np.zeros((0, 2), np.int64), *each])
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pairs)


RANGES = "keyframe_ranges array<struct<start:long,end:long>>"
SCHEMA = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string, {RANGES}"


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text's UTF-8 bytes, blank-padded to whole units, in a container; read it back and describe it.

    One narrow pass: nothing is shuffled, and a text is held once as payload and once as file. Null and empty texts
    are one unit of blanks; equal texts give equal values; other columns of docs are not read.
    """

    def work(batches):
        for rows in rows_of(batches):
            out: list[list] = [[] for _ in range(9)]
            medias = []
            for doc_id, text in rows:
                raw = (text or "").encode()
                content = store(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "))
                media = read(content)
                payload = read_back(content, media)
                values = (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature(media), media.error)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                medias.append(media)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [*(c.split()[0] for c in SCHEMA.split(", ")[:9]), "keyframe_ranges"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), _ranges(medias)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


READ_SCHEMA = f"path string, codec string, seconds double, n_samples long, {RANGES}, error string"


def media_columns(files: DataFrame) -> DataFrame:
    """Columns (path, content) of binary files: describe each container. Null or broken content gives a row with `error`."""

    def work(batches):
        for batch in slices(batches, 1):  # a file at a time
            (path,), (content,) = (c.to_pylist() for c in batch.columns)
            m = read(content)
            seconds = m.duration / m.timescale if m.timescale else 0.0
            arrays = [pa.array([path], pa.string()), pa.array([m.codec]), pa.array([seconds]), pa.array([len(m.starts)], pa.int64()), _ranges([m]), pa.array([m.error], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "codec", "seconds", "n_samples", "keyframe_ranges", "error"])

    return files.select("path", "content").mapInArrow(work, READ_SCHEMA)
