"""Operator 9: media columns in ISO media containers.

``parse`` walks the nested boxes of a file, decodes its sample tables, and gives codec, duration and
the byte ranges of keyframes, of every track and of the video first of all, without decoding any payload; the
sample runs of movie fragments count as well.  ``wrap`` makes such a file around a
payload: one track of uncompressed 8 x 8 RGB frames (192 bytes of 8-bit samples each), 25 a second,
every ``GOP``-th marked as a sync sample.  ``payload_of`` reads the samples back through the tables.

Files are values of a binary column, one per row, so memory is bounded by a batch of rows.

Cases: null text is an empty payload, and padding is added up to a positive multiple of 192, so every
payload has at least one frame; null media gives null columns; a damaged file gives an ``error`` text
and no other value; equal texts give equal values; repeated rows are separate rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

FRAME = 192
WIDTH = HEIGHT = 8
RATE = 25
GOP = 12
#: Frames in a chunk, the unit whose offset a file states.
CHUNK = 16
#: Boxes that hold boxes, and how many bytes come before those.
NESTED = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0, "edts": 0, "udta": 0, "mvex": 0, "moof": 0, "traf": 0, "meta": 4}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Damaged(ValueError):
    """A file that breaks the rules of its format."""


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind.encode("latin-1")) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind.encode("latin-1"), size + 8) + body


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the frame size."""
    return data + b" " * (FRAME - len(data) if len(data) < FRAME else -len(data) % FRAME)


def wrap(payload: bytes) -> bytes:
    """A file with the payload (a positive multiple of the frame size) as raw video frames."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    keys = range(1, n + 1, GOP)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    entry = box("raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 24, -1))
    head = box("ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
        wide = first + len(payload) >= 1 << 32
        table = box(
            "stbl",
            full("stsd", struct.pack(">I", 1), entry),
            full("stts", struct.pack(">III", 1, n, 1)),
            full("stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full("stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full("stsz", struct.pack(">II", FRAME, n)),
            full("co64" if wide else "stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        info = box("minf", full("vmhd", struct.pack(">4H", 0, 0, 0, 0), flags=1), box("dinf", full("dref", struct.pack(">I", 1), full("url ", flags=1))), table)
        media = box("mdia", full("mdhd", struct.pack(">4IHH", 0, 0, RATE, n, 0x55C4, 0)), full("hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"frames\0"), info)
        track = full("tkhd", struct.pack(">5I", 0, 0, 1, 0, n), b"\0" * 8, struct.pack(">4H", 0, 0, 0, 0), UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        movie = full("mvhd", struct.pack(">4I", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, UNITY, b"\0" * 24, struct.pack(">I", 2))
        return box("moov", movie, box("trak", track, media))

    data = box("mdat", payload)
    before = len(head) + len(moov(0)) + len(data) - len(payload)
    return head + moov(before) + data


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first byte, end) of the contents of every box, depth first."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Damaged(f"{end - start} odd bytes in {path or 'the file'}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Damaged("a long size is cut off")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise Damaged(f"box {kind!r} of {size} bytes at {start} does not fit")
        name = kind.decode("latin-1")
        here = f"{path}/{name}"
        yield here, body, stop
        if name in NESTED:
            yield from walk(data, body + NESTED[name], stop, here)
        start = stop


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    sizes: list[int] = field(default_factory=list)
    deltas: list[tuple[int, int]] = field(default_factory=list)
    runs: list[tuple[int, int, int]] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    sync: list[int] | None = None
    number: int = 0
    #: (offset, size, ticks, whether it is a keyframe) of samples in fragments, and what those are by default.
    fragments: list[tuple[int, int, int, bool]] = field(default_factory=list)
    defaults: tuple[int, int, int] = (0, 0, 0)

    def samples(self) -> list[tuple[int, int]]:
        """(offset, size) of every sample, from the chunk tables."""
        out, i = [], 0
        for r, (first, per, _) in enumerate(self.runs):
            until = self.runs[r + 1][0] if r + 1 < len(self.runs) else len(self.chunks) + 1
            for chunk in range(first, until):
                if not 0 < chunk <= len(self.chunks):
                    raise Damaged("a chunk is missing")
                at = self.chunks[chunk - 1]
                for size in self.sizes[i : i + per]:
                    out.append((at, size))
                    at += size
                i += per
        if len(out) != len(self.sizes):
            raise Damaged("chunks and samples differ in number")
        return out + [f[:2] for f in self.fragments]

    def seconds(self) -> float | None:
        ticks = self.duration or sum(n * d for n, d in self.deltas)
        # a movie that goes on in fragments states no duration, or that of its beginning
        ticks = max(ticks, sum(n * d for n, d in self.deltas) + sum(f[2] for f in self.fragments))
        return ticks / self.timescale if self.timescale else None

    def keyframes(self) -> list[tuple[int, int]]:
        every = self.samples()
        whole, late = every[: len(self.sizes)], [f[:2] for f in self.fragments if f[3]]
        if self.sync is None:
            return whole + late
        if any(not 0 < s <= len(whole) for s in self.sync):
            raise Damaged("a sync sample is missing")
        return [whole[s - 1] for s in self.sync] + late


def _table(data, at: int, end: int, form: str, count: int) -> list:
    step = struct.calcsize(">" + form)
    if at + step * count > end:
        raise Damaged("a table is cut off")
    rows = list(struct.iter_unpack(">" + form, data[at : at + step * count]))
    return [r[0] for r in rows] if len(form) == 1 else rows


#: Flags of fragment boxes: which fields are there; and that a sample is no keyframe.
BASE, DESCRIPTION, TICKS, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST, RUN_TICKS, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEY = 0x10000


class Fragment:
    """Where the samples of a track fragment are, and what they are unless a run says otherwise."""

    def __init__(self, tracks: list[Track], data, at: int, moof: int) -> None:
        flags, number = struct.unpack_from(">II", data, at)
        self.track = next((t for t in tracks if t.number == number), None)
        if self.track is None:
            raise Damaged(f"a fragment of track {number}, which is not there")
        at += 8
        self.base, self.next = moof, moof
        ticks, size, kind = self.track.defaults
        if flags & BASE:
            (self.base,), at = struct.unpack_from(">Q", data, at), at + 8
            self.next = self.base
        at += 4 if flags & DESCRIPTION else 0
        values = []
        for bit, value in ((TICKS, ticks), (SIZE, size), (FLAGS, kind)):
            if flags & bit:
                (value,), at = struct.unpack_from(">I", data, at), at + 4
            values.append(value)
        self.values = values

    def run(self, data, at: int, end: int) -> None:
        flags, n = struct.unpack_from(">II", data, at)
        at += 8
        if flags & RUN_OFFSET:
            (shift,), at = struct.unpack_from(">i", data, at), at + 4
            self.next = self.base + shift
        first = None
        if flags & RUN_FIRST:
            (first,), at = struct.unpack_from(">I", data, at), at + 4
        given = [bit for bit in (RUN_TICKS, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & bit]
        rows = _table(data, at, end, "I" * len(given), n) if given else [()] * n
        for i, row in enumerate(rows):
            own = dict(zip(given, row if isinstance(row, tuple) else (row,), strict=True))
            ticks, size, kind = own.get(RUN_TICKS, self.values[0]), own.get(RUN_SIZE, self.values[1]), own.get(RUN_FLAGS, self.values[2])
            if i == 0 and first is not None:
                kind = first
            self.track.fragments.append((self.next, size, ticks, not kind & NO_KEY))
            self.next += size


def read_tracks(data: bytes | memoryview) -> list[Track]:
    """The tracks of a file."""
    tracks: list[Track] = []
    moof, fragment = 0, None
    try:
        for path, at, end in walk(data):
            kind = path[-4:]
            if path == "/moof":
                moof = at - 8
            elif path == "/moof/traf/tfhd":
                fragment = Fragment(tracks, data, at, moof)
            elif path == "/moof/traf/trun":
                if fragment is None:
                    raise Damaged("a run without its track")
                fragment.run(data, at, end)
            elif path == "/moov/mvex/trex":
                number, _, *defaults = struct.unpack_from(">5I", data, at + 4)
                for t in tracks:
                    if t.number == number:
                        t.defaults = tuple(defaults)
            if path == "/moov/trak":
                tracks.append(Track())
            elif not path.startswith("/moov/trak/"):
                continue
            t = tracks[-1]
            if kind == "tkhd":
                (t.number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
                t.width, t.height = (x >> 16 for x in struct.unpack_from(">II", data, end - 8))
            elif kind == "mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == "hdlr":
                t.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == "stsd":
                t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind in ("stts", "stss", "stsc", "stco", "co64"):
                (n,) = struct.unpack_from(">I", data, at + 4)
                rows = _table(data, at + 8, end, {"stts": "II", "stss": "I", "stsc": "III", "stco": "I", "co64": "Q"}[kind], n)
                setattr(t, {"stts": "deltas", "stss": "sync", "stsc": "runs", "stco": "chunks", "co64": "chunks"}[kind], rows)
            elif kind == "stsz":
                size, n = struct.unpack_from(">II", data, at + 4)
                t.sizes = [size] * n if size else _table(data, at + 12, end, "I", n)
    except struct.error as e:
        raise Damaged(str(e)) from e
    return tracks


def payload_of(data: bytes | memoryview, track: Track) -> bytes:
    """The samples of a track, one after another."""
    if any(at + size > len(data) for at, size in track.samples()):
        raise Damaged("a sample lies beyond the file")
    return b"".join(bytes(data[at : at + size]) for at, size in track.samples())


PARSED = (
    "codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,size:long>>, "
    "tracks array<struct<kind:string,codec:string,duration_s:double,n_samples:long,keyframes:array<struct<offset:long,size:long>>>>, error string"
)


def describe(data: bytes | memoryview | None) -> tuple:
    """One row of PARSED: the first video track, or the first of all where there is none, and each track."""
    if data is None:
        return None, None, None, None, None, None
    try:
        tracks = read_tracks(data)
        if not tracks:
            raise Damaged("no track")
        rows = [
            {"kind": t.kind, "codec": t.codec, "duration_s": t.seconds(), "n_samples": len(t.sizes) + len(t.fragments), "keyframes": [{"offset": at, "size": size} for at, size in t.keyframes()]}
            for t in tracks
        ]
        first = next((r for r in rows if r["kind"] == "vide"), rows[0])
        return first["codec"], first["duration_s"], first["n_samples"], first["keyframes"], rows, None
    except Damaged as e:
        return None, None, None, None, None, str(e)


def _added(batch: pa.RecordBatch, fields, rows: list[tuple], keep: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    index = [batch.schema.get_field_index(k) for k in keep]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in index), *(pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True))], [*keep, *(f[0] for f in fields)])


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)]))
_PARSED = [("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES), ("tracks", _TRACKS), ("error", pa.string())]


def parse(files: DataFrame, column: str = "media") -> DataFrame:
    """The columns of ``files`` without the media, and those of PARSED (which replace columns of the same names)."""
    names = [x[0] for x in _PARSED]
    keep = [c for c in files.columns if c not in names and c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(memoryview(x.as_buffer()) if x.is_valid else None) for x in batch.column(batch.schema.get_field_index(column))]
            yield _added(batch, _PARSED, rows, keep)

    return files.select(*keep, column).mapInArrow(run, common.extended(files.select(*keep), PARSED))


_WRAPPED = [("n_bytes", pa.int64()), ("media", pa.binary())]


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every document's text in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1))
            yield _added(batch, _WRAPPED, [(len(t), wrap(padded(t))) for t in texts], ["doc_id"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, common.extended(source.select("doc_id"), "n_bytes long, media binary"))


_DIGEST = [
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()),
]


def digest(data: bytes | memoryview) -> tuple:
    """What is read back from a stored file: hashes of payload and file, and a feature text."""
    t = read_tracks(data)[0]
    payload = payload_of(data, t)
    ranges = ",".join(f"{at}+{size}" for at, size in t.keyframes())
    feature = f"codec={t.codec.strip()};{t.width}x{t.height};seconds={t.duration / t.timescale:.2f};samples={len(t.sizes)};keyframes={ranges}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    files = wrapped(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _added(batch, _DIGEST, [digest(memoryview(x.as_buffer())) for x in batch.column(2)], ["doc_id", "n_bytes"])

    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.mapInArrow(run, common.extended(files.select("doc_id", "n_bytes"), ddl))
