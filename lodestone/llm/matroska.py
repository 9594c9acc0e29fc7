"""Matroska media columns: a writer for one PCM track, and a parser from bytes to packet tables.

write() stores 8-bit samples in laced SimpleBlocks of clusters with cues; packets() parses any such file: variable-length
EBML numbers, elements of known and unknown size, clusters, SimpleBlocks and BlockGroups, the three lacings and cues.  Times are
ticks of the segment's TimestampScale.  Frames after the first of a lace have a time where the track's DefaultDuration or the block's
BlockDuration says how long a frame is, else none.

Rows: a null text is empty; an empty payload is padded to one frame of 576 bytes of 255; equal texts give equal values; a very long
text is one file of as many clusters as it takes, held as a whole in its task; repeated rows give repeated results; null ids stay
null; other columns are ignored.  packets() raises ValueError for a damaged file; packet_table() gives such a file's packets up to the
damage and a row with the error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, table, utf8

FRAME = 576
RATE = 8000
LACED = 8  # frames in a block
BLOCKS = 16  # blocks in a cluster

# Element ids of the EBML and Matroska formats.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, HZ, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LASTS = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
VERSION, READ_VERSION, MUXER, WRITER, EACH = 0x4287, 0x4285, 0x4D80, 0x5741, 0x23E383
CUES, POINT, CUETIME, PLACES, CUETRACK, CUEAT = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, CHAPTERS, TAGS, ATTACHED = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
BESIDE = {SEEK, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHED}
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, PLACES}
NANOS = 1_000_000_000 // RATE  # one tick is one sample


class Packet(NamedTuple):
    track: int
    time: int | None
    start: int
    end: int


def vint(value: int, width: int = 0) -> bytes:
    """A number with its length marker; all ones means unknown and is never written for a number."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """Value and the place after it; keep: with the marker, as in ids.  -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("the file ends inside a number")
    if keep:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return -1 if value == (1 << 7 * width) - 1 else value, at + width


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], how: int) -> bytes:
    """Frames of one block behind their lacing header. how: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if how == 0:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if how == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, lacing: int = 2) -> bytes:
    """The payload, of whole frames, as a file with one track of unsigned 8-bit samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, element(DOCTYPE, b"matroska") + number(VERSION, 4) + number(READ_VERSION, 2))
    body = element(INFO, number(SCALE, NANOS) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXER, b"own") + element(WRITER, b"own"))
    body += element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(EACH, FRAME * NANOS) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(HZ, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))
    parts, cues, at = [body], [], len(body)
    for c in range(0, len(frames), LACED * BLOCKS):
        blocks, stop = [], min(len(frames), c + LACED * BLOCKS)
        offset = 0  # of the block in ticks; a cluster whose ticks don't fit into 16 bits would need another
        for b in range(c, stop, LACED):
            group = frames[b : min(b + LACED, stop)]
            how = lacing if len(group) > 1 else 0
            cut = (b - c) * FRAME
            if cut - offset > 32767:
                parts, cues, at = _cluster(parts, cues, at, (c * FRAME) + offset, blocks)
                blocks, offset = [], cut
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">h", cut - offset) + bytes([0x80 | how << 1]) + laced(group, how)))
        parts, cues, at = _cluster(parts, cues, at, c * FRAME + offset, blocks)
    parts.append(element(CUES, b"".join(element(POINT, number(CUETIME, t) + element(PLACES, number(CUETRACK, 1) + number(CUEAT, p))) for t, p in cues)))
    return head + element(SEGMENT, b"".join(parts))


def _cluster(parts: list, cues: list, at: int, time: int, blocks: list[bytes]) -> tuple[list, list, int]:
    made = element(CLUSTER, number(TIME, time) + b"".join(blocks))
    return [*parts, made], [*cues, (time, at)], at + len(made)


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of each element's body, parents before their children.  A segment of unknown size reaches to the end of
    the file, a cluster of unknown size to the next element that stands beside clusters."""
    open_: list[tuple[int, int, bool]] = []  # id, end and whether that is known, of the parents of `at`
    while True:
        while open_ and at >= open_[-1][1]:
            open_.pop()
        if at >= end:
            return
        name, body = read_vint(data, at, keep=True)
        if open_ and not open_[-1][2] and open_[-1][0] == CLUSTER and name in BESIDE:
            open_.pop()
        limit = open_[-1][1] if open_ else end
        size, body = read_vint(data, body)
        stop = limit if size < 0 else body + size
        if stop > limit:
            raise ValueError(f"element {name:x} passes the end of its parent")
        yield name, body, stop
        if name in PARENTS:
            open_.append((name, stop, size >= 0))
            at = body
        else:
            at = stop


def unlaced(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if how == 0:
        return [(at, end)]
    if at >= end:
        raise ValueError("a laced block has no frame count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if how == 2:
        sizes = [(end - at) // count] * (count - 1)
    while len(sizes) < count - 1:
        if how == 1:
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise ValueError("the block ends inside its lace sizes")
            sizes.append(n + data[at])
            at += 1
        else:
            before = at
            value, at = read_vint(data, at)
            sizes.append(value if not sizes else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    out = []
    for n in sizes:
        if n < 0:
            raise ValueError("a laced frame has a size below zero")
        out.append((at, at + n))
        at += n
    if at > end:
        raise ValueError("laced frames pass the end of their block")
    return [*out, (at, end)]


class Media:
    """What packets() has read so far: packets with track, time in ticks and byte range; cues as time and the byte of their cluster;
    nanoseconds of a tick."""

    def __init__(self) -> None:
        self.packets: list[Packet] = []
        self.cues: list[tuple[int, int]] = []
        self.scale = 1_000_000
        self.each: dict[int, int] = {}  # nanoseconds of a frame, by track

    def read(self, data: bytes) -> Media:
        base, segment, cue, track, block = 0, 0, 0, {}, (0, 0)
        for name, at, end in elements(data, 0, len(data)):
            if name == SEGMENT:
                segment = at
            elif name == TRACK:
                track = {}
            elif name in (SCALE, NUMBER, EACH, TIME, CUETIME, CUEAT, LASTS):
                value = int.from_bytes(data[at:end], "big")
                if name == SCALE:
                    self.scale = value
                elif name in (NUMBER, EACH):
                    track[name] = value
                    if len(track) == 2:
                        self.each[track[NUMBER]] = track[EACH]
                elif name == TIME:
                    base = value
                elif name == CUETIME:
                    cue = value
                elif name == CUEAT:
                    self.cues.append((cue, segment + value))
                else:
                    self._spread(*block, value)
            elif name == GROUP:
                block = (len(self.packets), len(self.packets))
            elif name in (SIMPLE, BLOCK):
                number_, p = read_vint(data, at)
                if p + 3 > end:
                    raise ValueError(f"the block at byte {at} ends inside its header")
                time, how = base + struct.unpack_from(">h", data, p)[0], data[p + 2] >> 1 & 3
                each, first = self.each.get(number_), len(self.packets)
                for k, (a, b) in enumerate(unlaced(data, p + 3, end, how)):
                    known = time if not k else None if each is None else time + k * each // self.scale
                    self.packets.append(Packet(number_, known, a, b))
                block = (first, len(self.packets))
        return self

    def _spread(self, first: int, stop: int, ticks: int) -> None:
        """A block's duration over frames whose times aren't known."""
        for k in range(first + 1, stop):
            if self.packets[k].time is None:
                self.packets[k] = self.packets[k]._replace(time=self.packets[first].time + (k - first) * ticks // (stop - first))


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int]]]:
    """Packets with track, time in ticks and byte range, and cues as time and the byte of their cluster."""
    media = Media().read(data)
    return media.packets, media.cues


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (FRAME * max(1, -(-len(raw) // FRAME)) - len(raw))


def feature(samples: np.ndarray, found: list[Packet], cues: list) -> str:
    """Packets, cues, ticks, the mean distance of samples from silence (128) and how often they cross it, per mille."""
    loud, high = np.abs(samples.astype(np.int16) - 128), samples >= 128
    crossings = np.count_nonzero(high[1:] != high[:-1])
    return f"packets={len(found)};cues={len(cues)};ticks={found[-1].time + found[-1].end - found[-1].start};mean={loud.sum() * 1000 // len(samples)};cross={crossings * 1000 // len(samples)}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = utf8(b.column(1))
        rows = []
        for i in range(len(b)):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            media = write(pad(raw))
            found, cues = packets(media)
            back = b"".join([media[p.start : p.end] for p in found])
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8), found, cues)))
        yield batch(OUT, doc_id=b.column(0), **dict(zip(OUT.names[1:], zip(*rows) if rows else [[]] * 7)))


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text through write() and packets(), as digests of what was read back."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_rows, DDL)


TABLE = pa.schema([("file_id", pa.int64()), ("track", pa.int32()), ("time", pa.int64()), ("time_ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("cued", pa.bool_()), ("error", pa.string())])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            media, error = Media(), None
            try:
                media.read(data or b"")
            except ValueError as e:
                error = str(e)
            times = {t for t, _ in media.cues}
            rows = [(key, p.track, p.time, None if p.time is None else p.time * media.scale, p.start, p.end, p.time in times, None) for p in media.packets]
            rows += [(key, None, None, None, None, None, None, error)] if error else []
            yield batch(TABLE, **dict(zip(TABLE.names, zip(*rows) if rows else [[]] * len(TABLE.names))))


def packet_table(files: DataFrame) -> DataFrame:
    """(file_id, content binary) to one row a packet; a null or empty file has none; a damaged one has a last row with its error."""
    ddl = "file_id long, track int, time long, time_ns long, start long, end long, cued boolean, error string"
    return files.selectExpr("cast(file_id as bigint) file_id", "content").mapInArrow(_tables, ddl)


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
