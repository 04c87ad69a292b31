"""Media columns: ISO media containers in a binary column.

:func:`mux` stores bytes losslessly as 8-bit samples in a container, :func:`probe` walks the
boxes of any container, decodes its sample tables and gives codec, duration and the byte
ranges of the key frames. Payloads are not decoded.
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
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes

UNIT = 64
RATE = 8_000
CHUNK = 4_096  # samples of a chunk
# Boxes that hold boxes, and the bytes before the first of them.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0}
CODEC = b"raw "  # unsigned 8-bit samples


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes) -> bytes:
    """One audio track whose samples are the bytes of ``payload``."""
    n = len(payload)
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK if n >= CHUNK else n, 1)]
    if chunks > 1 and n % CHUNK:
        runs.append((chunks, n % CHUNK, 1))
    entry = box(CODEC, bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    brand = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")

    def movie(first: int) -> bytes:
        table = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", 1, n)),
            full_box(b"stco", 0, struct.pack(">I", chunks), (first + np.arange(chunks, dtype=np.int64) * CHUNK).astype(">u4").tobytes()),
        )
        data = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        media = box(
            b"mdia",
            full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
            full_box(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full_box(b"smhd", 0, bytes(4)), data, table),
        )
        track = full_box(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), matrix, bytes(8))
        head = full_box(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    first = len(brand) + len(movie(0)) + 8
    return brand + movie(first) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body start and body end of each box; a box that leaves its parent is an error."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    codec: str = ""
    scale: int = 0
    duration: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray | None = None  # numbers of the key frames; None: all

    def ranges(self, only_keys: bool) -> list[tuple[int, int]]:
        """Byte ranges of the samples, ends exclusive, touching ones joined."""
        pick = slice(None) if self.keys is None or not only_keys else self.keys
        start, end = self.offsets[pick], (self.offsets + self.sizes)[pick]
        if not len(start):
            return []
        cut = np.flatnonzero(start[1:] != end[:-1]) + 1
        return list(zip(start[np.r_[0, cut]].tolist(), end[np.r_[cut - 1, -1]].tolist(), strict=True))


def _numbers(data: memoryview, at: tuple[int, int], kind: str, skip: int = 8) -> np.ndarray:
    """Values of a counted table after its header, whose last four bytes are the count."""
    (count,) = struct.unpack_from(">I", data, at[0] + skip - 4)
    wide = np.dtype(kind)
    if count * wide.itemsize > at[1] - at[0] - skip:
        raise ValueError("table is longer than its box")
    return np.frombuffer(data, dtype=wide, count=count, offset=at[0] + skip)


def _sample_tables(data: memoryview, track: Track) -> None:
    t = track.tables
    fixed, count = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    if fixed:
        if count * fixed > len(data):
            raise ValueError("samples are longer than the file")
        track.sizes = np.full(count, fixed, dtype=np.int64)
    else:
        track.sizes = _numbers(data, t[b"stsz"], ">u4", 12).astype(np.int64)
    chunks = (_numbers(data, t[b"stco"], ">u4") if b"stco" in t else _numbers(data, t[b"co64"], ">u8")).astype(np.int64)
    (entries,) = struct.unpack_from(">I", data, t[b"stsc"][0] + 4)
    runs = np.frombuffer(data, dtype=">u4", count=entries * 3, offset=t[b"stsc"][0] + 8).reshape(-1, 3).astype(np.int64)
    lasting = np.diff(np.r_[runs[:, 0], len(chunks) + 1]) if entries else np.zeros(0, np.int64)
    held = np.repeat(runs[:, 1], lasting)  # samples of each chunk
    if len(held) != len(chunks) or held.sum() != len(track.sizes):
        raise ValueError("chunks and samples disagree")
    before = np.cumsum(track.sizes) - track.sizes
    first = np.cumsum(held) - held
    in_chunk = np.repeat(before[first[held > 0]], held[held > 0]) if len(track.sizes) else before
    track.offsets = np.repeat(chunks, held) + before - in_chunk
    if len(track.sizes) and int((track.offsets + track.sizes).max()) > len(data):
        raise ValueError("samples lie beyond the file")
    if b"stss" in t:
        track.keys = _numbers(data, t[b"stss"], ">u4").astype(np.int64) - 1


def read_tracks(media: bytes) -> list[Track]:
    """Tracks of a container; raises ValueError or struct.error where it is broken."""
    data, found = memoryview(media), []
    todo = [(b"", 0, len(data))]
    while todo:
        parent, start, end = todo.pop()
        for kind, a, b in boxes(data, start, end):
            if kind in NESTED:
                if kind == b"trak":
                    found.append(Track())
                    _walk_track(data, a, b, found[-1])
                else:
                    todo.append((kind, a + NESTED[kind], b))
    return found


def _walk_track(data: memoryview, start: int, end: int, track: Track) -> None:
    todo = [(start, end)]
    while todo:
        for kind, a, b in boxes(data, *todo.pop()):
            if kind in NESTED:
                todo.append((a + NESTED[kind], b))
            elif kind == b"mdhd":
                long = data[a] == 1
                track.scale, track.duration = struct.unpack_from(">IQ" if long else ">II", data, a + (20 if long else 12))
            elif kind == b"stsd":
                track.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
            else:
                track.tables[kind] = (a, b)
    if b"stsz" in track.tables:
        _sample_tables(data, track)


def mux(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: every whole text in a container of its own.

    The text as UTF-8 (null: empty) is padded with zero bytes to a positive multiple of 64.
    Other columns are dropped; repeated rows give repeated rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "raw"):
                raw = [r or b"" for r in batch.column("raw").to_pylist()]
                media = [container(r + bytes(-len(r) % UNIT if r else UNIT)) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


PROBE = (
    "codec string, duration double, samples long, key_frames array<struct<start:long,end:long>>, payload_bytes long, "
    "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"
)


def probe(table: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Facts about the first track of each container, next to the columns ``keep``.

    key_frames are byte ranges in the file. The payload's digests are taken from the sample
    ranges of the stored bytes. A null container gives nulls; a broken one gives nulls and
    an ``error``; one without a track has no samples.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_facts(m) for m in batch.column("_media").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[*keep, *(p.split()[0] for p in PROBE.split(", "))],
            )

    kept = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*keep, F.col(media).alias("_media")).mapInArrow(read, f"{kept}, {PROBE}")


def _facts(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 10
    whole = (len(media), hashlib.sha256(media).hexdigest())
    try:
        tracks = read_tracks(media)
    except (ValueError, struct.error, KeyError, IndexError) as broken:
        return (None,) * 7 + whole + (f"{type(broken).__name__}: {broken}",)
    track = tracks[0] if tracks else Track()
    digest, size, tail = hashlib.sha256(), 0, b""
    for start, end in track.ranges(only_keys=False):
        part = media[start:end]
        digest.update(part)
        size, tail = size + len(part), (tail + part[-UNIT:])[-UNIT:]
    keys = [{"start": a, "end": b} for a, b in track.ranges(only_keys=True)]
    seconds = track.duration / track.scale if track.scale else 0.0
    return (track.codec, seconds, len(track.sizes), keys, size, digest.hexdigest(), zlib.crc32(tail), *whole, None)
