"""Media columns in ISO base media containers: nested boxes and sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, texts, with_columns

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf")
#: Of the track that write_media() makes: gray frames of 8 x 8 samples of 8 bits.
SIDE, TIMESCALE, KEY_EVERY, FRAMES_A_CHUNK = 8, 25, 16, 64
FRAME = SIDE * SIDE


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def encode(payload: bytes) -> bytes:
    """A file with one track of uncompressed gray frames that holds payload, whose length is a multiple of 64."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_A_CHUNK)
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", struct.pack(">6xH16xHHII4xH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 1, bytes(32), 8, -1))
    spans = [(1, FRAMES_A_CHUNK)] if n >= FRAMES_A_CHUNK else []
    if n % FRAMES_A_CHUNK:
        spans.append((chunks, n % FRAMES_A_CHUNK))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")

    def moov(first: int) -> bytes:
        at = (first + np.arange(chunks, dtype=np.uint64) * (FRAME * FRAMES_A_CHUNK)).astype(">u8")
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(spans)), *(struct.pack(">III", a, b, 1) for a, b in spans)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(">I", chunks), at.tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), unity, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    size = len(moov(0))
    return head + moov(len(head) + size + 16) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start and end of the content) of every box, parents first. A box that overruns its parent ends the walk there."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head, start + size, (*path, kind))
        start += size


class Malformed(ValueError):
    """Media whose boxes contradict themselves."""


def unpack(form: str, data: bytes, at: int, end: int) -> tuple:
    """struct.unpack_from, but nothing beyond the end of a box."""
    if at + struct.calcsize(form) > end:
        raise Malformed("a box ends too early")
    return struct.unpack_from(form, data, at)


def counted(kind: str, each: int, data: bytes, at: int, end: int) -> np.ndarray:
    """A box's table: its number of rows at at + 4, then rows of each numbers."""
    (n,) = unpack(">I", data, at + 4, end)
    if n * each * np.dtype(kind).itemsize > end - at - 8:
        raise Malformed("a table is longer than its box")
    return np.frombuffer(data, kind, n * each, at + 8).astype(np.int64)


def run_of(data: bytes, at: int, stop: int, given: dict) -> tuple[int | None, np.ndarray, np.ndarray, np.ndarray]:
    """Of a trun box: its data offset if it has one, and durations, sizes and flags of its samples; given: what holds where it is silent."""
    flags, n = unpack(">II", data, at, stop)
    flags &= 0xFFFFFF
    at += 8
    offset = first = None
    if flags & 1:
        offset, at = unpack(">i", data, at, stop)[0], at + 4
    if flags & 4:
        first, at = unpack(">I", data, at, stop)[0], at + 4
    has = [k for k, bit in (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("shift", 0x800)) if flags & bit]
    if n > len(data) or 4 * n * len(has) > stop - at:
        raise Malformed("more samples than bytes")
    rows = np.frombuffer(data, ">u4", n * len(has), at).reshape(n, len(has)).astype(np.int64)
    duration, size, own = (rows[:, has.index(k)] if k in has else np.full(n, given[k], np.int64) for k in ("duration", "size", "flags"))
    if first is not None and n and "flags" not in has:
        own[0] = first
    return offset, duration, size, own


def fragments(data: bytes) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Offsets, sizes and keys (is it a keyframe) of the samples in movie fragments, and their whole duration, by track number."""
    preset: dict[int, dict] = {}
    runs: dict[int, list[tuple]] = {}
    given, number, moof, base, end = {}, 0, 0, 0, 0
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trex":
            number, _, *rest = unpack(">5I", data, a + 4, b)
            preset[number] = dict(zip(("duration", "size", "flags"), rest, strict=True))
        elif kind == b"moof":
            long = a >= 16 and data[a - 16 : a - 8] == struct.pack(">I4s", 1, b"moof")
            moof = end = a - (16 if long else 8)
        elif kind == b"tfhd":
            flags, number = unpack(">II", data, a, b)
            given, at = dict(preset.get(number, {"duration": 0, "size": 0, "flags": 0})), a + 8
            base = moof if flags & 0x20000 else end
            for bit, key, form in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
                if flags & bit:
                    given[key], at = unpack(form, data, at, b)[0], at + struct.calcsize(form)
            base = end = given.get("base", base)
        elif kind == b"trun":
            offset, duration, size, own = run_of(data, a, b, given)
            start = end if offset is None else base + offset
            end = start + int(size.sum())
            runs.setdefault(number, []).append((start + np.cumsum(size) - size, size, own & 0x10000 == 0, int(duration.sum())))
    return {k: (*(np.concatenate(x) for x in list(zip(*v, strict=True))[:3]), sum(x[3] for x in v)) for k, v in runs.items()}


def tracks(data: bytes) -> list[dict]:
    """codec, timescale, duration, sizes, offsets and keys (sample numbers from 0) of each track, from its sample tables
    and then from the movie fragments."""
    found: list[dict] = []
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"id": None, "handler": "", "codec": "", "timescale": 0, "duration": 0, "stts": [], "stsc": [], "chunks": np.empty(0, np.int64), "sizes": np.empty(0, np.int64), "keys": None})
        if b"trak" not in path or not found:
            continue
        t = found[-1]
        if kind in (b"tkhd", b"mdhd"):
            (version,) = unpack(">B", data, a, b)
            if kind == b"tkhd":
                (t["id"],) = unpack(">I", data, a + (20 if version else 12), b)
            else:
                t["timescale"], t["duration"] = unpack(">IQ" if version else ">II", data, a + (20 if version else 12), b)
        elif kind == b"hdlr":
            t["handler"] = unpack(">4s", data, a + 8, b)[0].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = unpack(">4s", data, a + 12, b)[0].decode("latin-1") if unpack(">I", data, a + 4, b)[0] else ""
        elif kind == b"stts":
            t["stts"] = counted(">u4", 2, data, a, b).reshape(-1, 2)
        elif kind == b"stsc":
            t["stsc"] = counted(">u4", 3, data, a, b).reshape(-1, 3)
        elif kind == b"stss":
            t["keys"] = counted(">u4", 1, data, a, b) - 1
        elif kind == b"stsz":
            size, n = unpack(">II", data, a + 4, b)
            if size and n > len(data):
                raise Malformed("more samples than bytes")
            t["sizes"] = np.full(n, size, np.int64) if size else counted(">u4", 1, data, a + 4, b)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = counted(">u4" if kind == b"stco" else ">u8", 1, data, a, b)
    for t in found:
        n, n_chunks = len(t["sizes"]), len(t["chunks"])
        runs = np.array(t["stsc"], np.int64).reshape(-1, 3)
        ends = np.append(runs[1:, 0], n_chunks + 1)
        each = np.zeros(n_chunks, np.int64)
        if len(runs) and n_chunks:
            if runs[0, 0] != 1 or (ends < runs[:, 0]).any() or (ends > n_chunks + 1).any():
                raise Malformed("runs of chunks that aren't in order")
            each = np.repeat(runs[:, 1], ends - runs[:, 0])
        if each.sum() > max(len(data), n) or each.sum() < n:
            raise Malformed("chunks that don't hold the samples")
        chunk = np.repeat(np.arange(n_chunks), each)[:n]
        before = np.concatenate([[0], np.cumsum(t["sizes"])])[:-1]
        first = np.concatenate([[0], np.cumsum(each)])[:-1]
        t["offsets"] = t["chunks"][chunk] + before[: len(chunk)] - before[np.minimum(first, max(len(before) - 1, 0))][chunk] if len(chunk) else np.empty(0, np.int64)
        t["keys"] = np.arange(n) if t["keys"] is None else t["keys"]
        if len(t["keys"]) and not 0 <= t["keys"].min() <= t["keys"].max() < n:
            raise Malformed("a keyframe that is no sample")
    more = fragments(data)
    for t in found:
        if t["id"] in more:
            offsets, sizes, keys, duration = more[t["id"]]
            t["duration"] = max(t["duration"], sum(int(n * d) for n, d in t["stts"]) + duration)
            t["keys"] = np.concatenate([t["keys"], len(t["sizes"]) + np.flatnonzero(keys)])
            t["offsets"], t["sizes"] = np.concatenate([t["offsets"], offsets]), np.concatenate([t["sizes"], sizes])
        left = len(data) - t["offsets"]
        if ((t["offsets"] < 0) | (t["sizes"] < 0) | (left < 0) | (t["sizes"] > left)).any():
            raise Malformed("a sample that isn't in the file")
    return found


def payload_of(data: bytes, t: dict) -> bytes:
    """All samples of a track in order; neighbours are read at once."""
    off, size = t["offsets"], t["sizes"]
    if not len(off):
        return b""
    cut = np.flatnonzero(off[1:] != off[:-1] + size[:-1]) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(off)]]) - 1
    return b"".join(data[off[i] : off[j] + size[j]] for i, j in zip(a, b, strict=True))


def columns_of(t: dict) -> dict:
    """What read_media() stores of a track: a row of its column tracks."""
    keys = t["keys"]
    ranges = zip(t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), strict=True)
    return {"codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "bytes": int(t["sizes"].sum()), "keyframes": [{"offset": o, "size": n} for o, n in ranges]}


def feature_of(c: dict) -> str:
    """Of a row of tracks: codec, duration, counts and the byte ranges of the first and last keyframe, with a checksum of all the ranges."""
    keys = c["keyframes"]
    ranges = np.array([(k["offset"], k["size"]) for k in keys], "<i8")
    seconds = c["duration"] / c["timescale"] if c["timescale"] else 0.0
    first, last = (f"{keys[i]['offset']}+{keys[i]['size']}" if keys else "-" for i in (0, -1))
    return f"codec={c['codec'].strip()};seconds={seconds:.2f};samples={c['samples']};keyframes={len(keys)};first={first};last={last};ranges={zlib.crc32(ranges.tobytes()):08x}"


def padded(text: str) -> bytes:
    """The UTF-8 bytes of a text with bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME))


def write_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes (of the text) and media (the container). A null text is empty. Columns of these names are replaced."""
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    schema = with_columns(docs.schema, added)
    docs = docs.select(*[c for c in docs.columns if c not in ("n_bytes", "media")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = texts(batch)
            yield append(batch, n_bytes=pa.array([len(x.encode("utf-8", "surrogatepass")) for x in held], pa.int64()), media=pa.array([encode(padded(x)) for x in held], pa.binary()))

    return docs.mapInArrow(write, schema)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks array<struct<codec:string,handler:string,timescale:long,duration:long,samples:long,bytes:long,keyframes:array<struct<offset:long,size:long>>>>"


def read_media(df: DataFrame, column: str = "media", payload: bool = True) -> DataFrame:
    """df without the media column, with what its tracks say.

    tracks has codec, handler, timescale, duration (in its units), numbers of samples and bytes and the byte range of
    every keyframe of every track, in sample order, movie fragments included; they come from the boxes alone. feature
    sums up the first track; with payload, that one's samples are read back and digested too. Null media, media without
    a track, and malformed ones (tables longer than their boxes, runs or keyframes of samples that aren't there) give
    nulls.
    """
    fields = T._parse_datatype_string(READ).fields
    names = [f.name for f in fields]
    rest = df.select(*[c for c in df.columns if c not in names])
    schema = T.StructType([f for f in rest.schema.fields if f.name != column] + fields)

    def look(data: bytes | None) -> tuple:
        try:
            found = tracks(data) if data else []
        except (Malformed, RecursionError):
            found = []
        if not found:
            return (None,) * len(names)
        body = payload_of(data, found[0]) if payload else None
        digest = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME:])) if payload else (int(found[0]["sizes"].sum()), None, None)
        rows = [columns_of(t) for t in found]
        return (*digest, len(data), hashlib.sha256(data).hexdigest(), feature_of(rows[0]), rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("bytes", pa.int64())]
        row.append(("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct(row))]
        for batch in batches:
            at = batch.schema.get_field_index(column)
            found = [look(x.as_py()) for x in batch.column(at)]
            bare = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=[n for n in batch.schema.names if n != column])
            yield append(bare, **{n: pa.array([r[k] for r in found], kinds[k]) for k, n in enumerate(names)})

    return rest.mapInArrow(read, schema)
