"""MPEG audio columns: frames are written, resynchronised, checked and indexed for seeking."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, text_of

# Fixed values of the format: bit rates in kbit/s by (version 1, layer), sampling rates by version, and the CRC's polynomial.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLY = 0x8005
#: Payload bytes in a frame, the unit to which payloads are padded.
UNIT = 576
#: MPEG-1 layer III, CRC, 192 kbit/s, 44.1 kHz, mono: 626 bytes, of which 603 hold main data.
HEADER = bytes([0xFF, 0xFA, 0xB0, 0xC0])
LENGTH, SIDE = 144 * 192_000 // 44_100, 17
START = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ (CRC_POLY if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    """``side`` is the length of the side information that a CRC covers (layer III only)."""

    layer: int
    length: int
    samples: int
    rate: int
    side: int
    crc: bool


_HEADERS: dict[bytes, Header | None] = {}


def read_header(h: bytes) -> Header | None:
    """What a frame header says; None if it is none."""
    if h not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[h] = _read_header(h)
    return _HEADERS[h]


def _read_header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] >> 5 != 7:
        return None
    version, layer, bitrate, rate, pad = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3, h[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    first, mono, hz = version == 3, h[3] >> 6 == 3, RATES[version][rate]
    bits = BITRATES[first, layer][bitrate] * 1000
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(layer, length, samples, hz, side, not h[1] & 1)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_audio(payload: bytes, n_bytes: int) -> bytes:
    """ID3v2 tag with the payload's true length, a frame with a seek table, one frame for each UNIT bytes, ID3v1 tag."""
    n = len(payload) // UNIT
    notes = [b"\x00n_bytes\x00" + str(n_bytes).encode(), b"\x00unit\x00" + str(UNIT).encode()]
    frame = b"".join(b"TXXX" + struct.pack(">IH", len(x), 0) + x for x in notes)
    tag = b"ID3\x03\x00\x00" + _syncsafe(len(frame)) + frame
    side = bytes(SIDE)
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + side)) + side
    toc = bytes(min(255, 256 * i // 100) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, (n + 1) * LENGTH) + toc
    body = np.zeros((n + 1, LENGTH), np.uint8)
    body[:, :START] = np.frombuffer(head, np.uint8)
    body[0, START : START + len(xing)] = np.frombuffer(xing, np.uint8)
    body[1:, START : START + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + body.tobytes() + b"TAG" + bytes(124) + b"\xff"


@dataclass(frozen=True)
class SeekTable:
    """A variable-bitrate table: the frames and bytes that it counts, and for equal parts of the duration the byte, counted from
    its own frame, at which each starts."""

    kind: str
    frames: int
    size: int
    points: tuple[int, ...] = ()


@dataclass
class Audio:
    """What a stream holds; ``offsets`` has the byte at which each audio frame starts, ``first`` that of the table's frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: SeekTable | None = None
    table_ok: bool | None = None
    first: int = -1
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    frame_samples: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    payload: bytes = b""

    def seek(self, sample: int) -> int:
        """Byte of the frame that holds ``sample`` (the last frame beyond the end, -1 without frames)."""
        return self.offsets[min(max(0, sample) // max(1, self.frame_samples), len(self.offsets) - 1)] if self.offsets else -1

    def drift(self) -> int:
        """The largest distance in bytes between a point of the seek table and the frame that starts there by the exact offsets."""
        if not self.table or not self.table.points or not self.offsets:
            return -1
        n = len(self.table.points)
        return max(abs(self.first + at - self.seek(self.samples * i // n)) for i, at in enumerate(self.table.points))


def _syncsafe_value(b: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=False))


def _text(body: bytes) -> list[str]:
    """The parts of a text frame, by its encoding byte; wrong bytes are replaced."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(name, "replace").split("\x00")


def _tags(blob: bytes, out: Audio) -> tuple[int, int]:
    """Bytes at which the frames start and end; ID3v2.2 to 2.4 and ID3v1 are read."""
    at, end = 0, len(blob)
    if blob[:3] == b"ID3" and len(blob) >= 10:
        version, flags = blob[3], blob[5]
        at = min(end, 10 + _syncsafe_value(blob[6:10]))
        body = blob[10:at]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\x00", b"\xff")
        p = 0
        if flags & 0x40 and version >= 3 and len(body) >= 4:
            p = _syncsafe_value(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4])
        name_len, head = (3, 6) if version == 2 else (4, 10)
        while p + head <= len(body) and body[p : p + name_len].isalnum():
            name, raw = body[p : p + name_len].decode("latin-1"), body[p + name_len : p + 2 * name_len]
            n = _syncsafe_value(raw) if version == 4 else int.from_bytes(raw)
            value = body[p + head : p + head + n]
            if version == 4 and body[p + 9] & 2:
                value = value.replace(b"\xff\x00", b"\xff")
            if name in ("TXXX", "TXX"):
                key, *rest = _text(value)
                out.tags[key] = rest[0].removeprefix("\ufeff") if rest else ""
            elif name[0] == "T":
                out.tags[name] = _text(value)[0]
            p += head + n
        at = min(end, at + (10 if version == 4 and flags & 0x10 else 0))
    if end - at >= 128 and blob[end - 128 : end - 125] == b"TAG":
        end -= 128
        title = blob[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
        if title:
            out.tags.setdefault("TIT2", title)
    return at, end


def _seek_table(frame: bytes, main: int) -> SeekTable | None:
    """The table that a first frame holds, if any; None for one that is cut off."""
    kind = frame[main : main + 4]
    if kind in (b"Xing", b"Info"):
        if len(frame) < main + 8:
            return None
        flags, p, numbers = int.from_bytes(frame[main + 4 : main + 8]), main + 8, [0, 0]
        for k in (0, 1):
            if flags >> k & 1:
                numbers[k] = int.from_bytes(frame[p : p + 4])
                p += 4
        toc = frame[p : p + 100] if flags & 4 else b""
        if len(frame) < p + (100 if flags & 4 else 0):
            return None
        return SeekTable(kind.decode(), *numbers, tuple(x * numbers[1] // 256 for x in toc))
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        if width not in (1, 2, 3, 4) or len(frame) < 62 + entries * width:
            return None
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return SeekTable("VBRI", frames, size, tuple(sum(steps[:i]) for i in range(entries)))
    return None


def read_audio(blob: bytes) -> Audio:
    """Parse a stream.

    A frame that follows another is accepted by its valid header.  At the start and after anything else, the search goes on at the
    next byte 255 (a resynchronisation) until a valid header is followed by another or by the end.  Frames whose CRC is wrong are counted and
    kept.  A variable-bitrate table is held against the frames found.  The payload is each frame's data from the end of the side information to the end
    of the frame, or as many bytes of it as the tag ``unit`` says.
    """
    out, good = Audio(), {}
    at, end = _tags(blob, out)
    said = out.tags.get("unit", "")
    unit = int(said) if said.isdecimal() and len(said) < 19 else None
    parts, lost, first = [], False, True
    while at + 4 <= end:
        h = read_header(blob[at : at + 4])
        after = at + h.length if h else 0
        if h is None or after > end or ((lost or first) and after + 4 <= end and read_header(blob[after : after + 4]) is None):
            lost = True
            at = blob.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        out.resyncs += lost
        lost = False
        main = at + 4 + 2 * h.crc + h.side
        if h.crc and h.layer == 3 and main <= after:
            checked = blob[at + 2 : main]
            if checked not in good:
                if len(good) > 4096:
                    good.clear()
                good[checked] = crc16(checked[:2] + checked[4:]) == checked[2] << 8 | checked[3]
            out.crc_bad += not good[checked]
        table = _seek_table(blob[at:after], main - at) if first else None
        if table:
            out.table, out.first = table, at
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.rate, out.frame_samples = h.rate, h.samples
            parts.append(blob[main : after if unit is None else min(after, main + unit)])
        first = False
        at = after
    out.resyncs += lost
    out.payload = b"".join(parts)
    if out.table:
        size = out.offsets[-1] + read_header(blob[out.offsets[-1] : out.offsets[-1] + 4]).length - out.first if out.offsets else 0
        out.table_ok = out.table.frames in (0, len(out.offsets)) and out.table.size in (0, size)
    return out


def store_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``media``: the text's UTF-8 bytes, padded by 255 to a positive multiple of UNIT, as MPEG audio.

    A null text counts as empty; equal texts give equal bytes; repeated rows and null ids stay.
    """
    kept = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, media = batch.slice(lo, 256), []
                for t in part.column("text"):
                    raw = t.as_py().encode()
                    media.append(write_audio(raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], names=["id", "media"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


FEATURES = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "duration_samples bigint, sample_rate int, n_frames int, crc_bad int, resyncs int, seek_offsets array<bigint>"
)


def index_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Durations (exact, in samples), seek offsets, checks and digests of every stream of a media column.

    A null or empty stream has no frames; bytes that are no frames are skipped and counted as resynchronisations; a length tag that is no
    number counts as absent (all of the payload); null ids, repeated rows and very long streams are rows like others; an empty table gives an empty result.
    """
    kept = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    names = ["id", *[x.split()[0] for x in FEATURES.split(", ")]]

    def features(blob: bytes) -> tuple:
        a = read_audio(blob)
        tag = a.tags.get("n_bytes", "")
        said = int(tag) if tag.isdecimal() and len(tag) < 19 else len(a.payload)
        vbr = f"{a.table.kind},{a.table.frames},{a.table.size},{len(a.table.points)},{'ok' if a.table_ok else 'off'},{a.drift()}" if a.table else "none"
        told = f"samples={a.samples};rate={a.rate};frames={len(a.offsets)};vbr={vbr};crc_bad={a.crc_bad};resyncs={a.resyncs};first={a.offsets[0] if a.offsets else -1};middle={a.seek(a.samples // 2)}"
        return said, len(a.payload), hashlib.sha256(a.payload).hexdigest(), zlib.crc32(a.payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), told, a.samples, a.rate, len(a.offsets), a.crc_bad, a.resyncs, a.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [features(m.as_py() or b"") for m in part.column("media")]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]] if rows else [part.column("id"), *[pa.array([], t) for t in types]], names=names)

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, {FEATURES}").withColumnRenamed("id", id_col)


def op3_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_column(store_column(documents(spark, sf_dir)))
