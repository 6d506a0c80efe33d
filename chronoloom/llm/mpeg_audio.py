"""MPEG audio as a media column: carrying bytes in frames, and indexing any such stream.

``index_stream`` parses tags, finds frame headers (resynchronising over anything that is not a
frame), reads the variable-bitrate table, verifies checksums, and gives the exact duration in
samples and the byte offset of every frame.  ``carry`` stores a payload losslessly: MPEG-1 Layer III
frames, 32 kHz mono, 1440 bytes at 320 kbit/s and a last frame of the smallest sufficient bitrate,
with CRC-16 over header and (empty) side information and the payload in the data area; before them
an ID3v2 tag with the payload's length and CRC-32 and a frame with the variable-bitrate table.

Read besides: ID3v2.2 to 2.4 and ID3v1 tags, Xing, Info and VBRI tables, checksums of Layers I and III, and streams that change
their sample rate.  Not read: free-format frames (bytes without a frame); not verified: Layer II checksums (``crc_unchecked``).

Defined results: null media has status ``none``, media without a frame ``no_frames``, media without a payload's tags ``foreign``, and a
payload that is cut short or fails a checksum ``damaged``; these have no payload columns, ``ok`` has all.  A very long text is one
stream, worked on whole in its task (about ten times its bytes); ties don't arise.  Null text counts as empty; the payload is the UTF-8 text with zero bytes up to
a positive multiple of 64; null or repeated ids are rows like any other; an empty table gives an
empty result; other columns are ignored.
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

from .runtime import small_batches

# Fixed values of the format: kbit/s by version group and layer, and sample rates by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

_CRC_TABLE = np.zeros(256, np.uint16)
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ (0x8005 if _c & 0x8000 else 0)
    _CRC_TABLE[_i] = _c & 0xFFFF


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, from 0xFFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC_TABLE[(crc >> np.uint16(8)) ^ column]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    size: int
    samples: int
    side: int  # bytes of Layer III side information
    covered: int  # bytes after the checksum that it covers, -1: not known


def header(word: int) -> Header | None:
    """The frame that a 32-bit header word announces, or None."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, index, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    bitrate = BITRATES[1 if version == 3 else 2, layer][index] * 1000
    hertz, padding, mono = RATES[version][rate], word >> 9 & 1, (word >> 6 & 3) == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * bitrate // hertz + padding) * 4 if layer == 1 else samples // 8 * bitrate // hertz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32  # Layer I: 4 bits a channel and band, shared ones once
    covered = side if layer == 3 else (16 if mono else 16 + bound // 2) if layer == 1 else -1
    return Header(version, layer, not word >> 16 & 1, bitrate, hertz, size, samples, side, covered)


@dataclass
class Index:
    """What ``index_stream`` found."""

    kind: str = ""  # of the first frame
    sample_rate: int = 0
    samples: int = 0
    seconds: float = 0.0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    data_at: list[int] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    skipped: int = 0
    tags: dict[str, bytes] = field(default_factory=dict)
    table_frames: int | None = None
    table_bytes: int | None = None
    seek_table: bytes = b""


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(media: bytes) -> tuple[dict[str, bytes], int]:
    """Frames of the ID3v2 tag at the start, and where it ends."""
    if media[:3] != b"ID3" or len(media) < 10 or max(media[6:10]) > 127:
        return {}, 0
    end = min(len(media), 10 + _synchsafe(media[6:10]))
    at, tags = 10, {}
    letters, head = (3, 6) if media[3] == 2 else (4, 10)
    while at + head <= end and media[at] != 0:
        width = media[at + letters : at + 2 * letters]
        size = _synchsafe(width) if media[3] >= 4 else int.from_bytes(width, "big")
        body = media[at + head : min(end, at + head + size)]
        name = media[at : at + letters].decode("latin-1")
        if name in ("TXXX", "PRIV"):
            owner, _, body = body.lstrip(b"\x00\x03" if name == "TXXX" else b"").partition(b"\0")
            name = f"{name}:{owner.decode('latin-1')}"
        tags[name] = body
        at += head + size
    return tags, end


def index_stream(media: bytes) -> Index:
    found = Index()
    found.tags, at = _tags(media)
    end = len(media) - 128 if len(media) >= at + 128 and media[-128:-125] == b"TAG" else len(media)
    known: dict[int, Header | None] = {}
    protected: dict[int, list[int]] = {}
    by_rate: dict[int, int] = {}

    def frame(i: int) -> Header | None:
        if i + 4 > end:
            return None
        word = int.from_bytes(media[i : i + 4], "big")
        if word not in known:
            known[word] = header(word)
        h = known[word]
        return h if h and i + h.size <= end else None

    synced = False
    while at + 4 <= end:
        h = frame(at)
        if h and not synced:  # after anything else, a header counts only if another follows its frame, or the end
            follows = frame(at + h.size)
            h = h if at + h.size == end or follows and (follows.rate, follows.layer) == (h.rate, h.layer) else None
        if h is None:
            nxt = media.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            found.skipped += nxt - at
            at, synced = nxt, False
            continue
        data = at + 4 + 2 * h.protected + h.side
        if not found.offsets and found.table_frames is None and media[data : data + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(media[data + 4 : data + 8], "big"), data + 8
            found.table_frames = 0
            if flags & 1:
                found.table_frames, p = int.from_bytes(media[p : p + 4], "big"), p + 4
            if flags & 2:
                found.table_bytes, p = int.from_bytes(media[p : p + 4], "big"), p + 4
            if flags & 4:
                found.seek_table = media[p : p + 100]
        elif not found.offsets and found.table_frames is None and media[at + 36 : at + 40] == b"VBRI":
            found.table_bytes, found.table_frames = (int.from_bytes(media[p : p + 4], "big") for p in (at + 46, at + 50))
            entries, width = (int.from_bytes(media[p : p + 2], "big") for p in (at + 54, at + 58))
            found.seek_table = media[at + 62 : at + 62 + entries * width]
        else:
            found.offsets.append(at)
            found.sizes.append(h.size)
            found.data_at.append(data)
            found.samples += h.samples
            if not found.sample_rate:
                found.sample_rate, found.kind = h.rate, f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version] }-layer{h.layer}"
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
            if h.protected and h.covered < 0:
                found.crc_unchecked += 1
            elif h.protected:
                protected.setdefault(h.covered, []).append(at)
        at, synced = at + h.size, True
    found.skipped += max(0, end - at)
    found.seconds = sum(samples / rate for rate, samples in by_rate.items())
    raw = np.frombuffer(media, np.uint8)
    for side, frames in protected.items():
        where = np.array([f for f in frames if f + 6 + side <= len(raw)])
        covered = np.concatenate([raw[where[:, None] + np.array([2, 3])], raw[where[:, None] + np.arange(6, 6 + side)]], axis=1)
        stored = raw[where + 4].astype(np.uint16) << np.uint16(8) | raw[where + 5]
        good = int((crc16(covered) == stored).sum())
        found.crc_ok += good
        found.crc_bad += len(frames) - good
    return found


_SIDE, _RATE = 17, 32000
_AREA = {144 * k * 1000 // _RATE - 6 - _SIDE: i for i, k in enumerate(BITRATES[1, 3]) if i}
_FULL = max(_AREA)


def _frame_head(index: int) -> bytes:
    """Header, CRC-16 and empty side information of a frame of that bitrate index."""
    word = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    crc = crc16(np.frombuffer(word[2:] + bytes(_SIDE), np.uint8)[None])[0]
    return word + int(crc).to_bytes(2, "big") + bytes(_SIDE)


_HEADS = {i: np.frombuffer(_frame_head(i), np.uint8) for i in _AREA.values()}


def _id3(frames: list[tuple[bytes, bytes]]) -> bytes:
    safe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    body = b"".join(name + safe(len(b)) + b"\0\0" + b for name, b in frames)
    return b"ID3\x04\0\0" + safe(len(body)) + body


def carry(payload: bytes) -> bytes:
    """An MPEG stream whose frames carry the payload."""
    full, rest = divmod(len(payload), _FULL)
    tail = min((a for a in _AREA if a >= rest), default=0) if rest else 0
    grid = np.empty((full, 6 + _SIDE + _FULL), np.uint8)
    grid[:, : 6 + _SIDE] = _HEADS[_AREA[_FULL]]
    grid[:, 6 + _SIDE :] = np.frombuffer(payload[: full * _FULL], np.uint8).reshape(full, _FULL)
    last = _HEADS[_AREA[tail]].tobytes() + payload[full * _FULL :] + bytes(tail - rest) if rest else b""
    audio = grid.tobytes() + last
    frames = full + bool(rest)
    info = bytearray(_FULL + 6 + _SIDE)
    info[:4] = (0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 14 << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    total = len(info) + len(audio)
    starts = np.arange(100) * frames // 100
    seek = (len(info) + starts * grid.shape[1]) * 256 // total
    info[4 + _SIDE : 4 + _SIDE + 116] = b"Xing" + struct.pack(">III", 7, frames, total) + bytes(seek.astype(np.uint8))
    tag = _id3([(b"TXXX", b"\x03payload\0" + str(len(payload)).encode()), (b"PRIV", b"crc32\0" + zlib.crc32(payload).to_bytes(4, "big"))])
    return tag + bytes(info) + audio + b"TAG" + bytes(125)


def carried(media: bytes, index: Index) -> tuple[str, bytes | None]:
    """Status and payload of a stream from ``carry``."""
    if not index.offsets:
        return "no_frames", None
    length, check = index.tags.get("TXXX:payload", b""), index.tags.get("PRIV:crc32", b"")
    if not length.isdigit() or len(check) != 4:
        return "foreign", None
    payload = b"".join(media[d : o + s] for d, o, s in zip(index.data_at, index.offsets, index.sizes, strict=True))[: int(length)]
    good = len(payload) == int(length) and zlib.crc32(payload) == int.from_bytes(check, "big") and not index.crc_bad
    return ("ok", payload) if good else ("damaged", None)


_STORED = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done: list[tuple] = []
        size = 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            done.append((doc, len(raw), carry(raw + bytes(-len(raw) % 64 if raw else 64))))
            size += len(raw)
            if size > 4 << 20:
                yield _rows(done, _STORED)
                done, size = [], 0
        if done:
            yield _rows(done, _STORED)


_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, seconds double, n_crc_ok long, frame_offsets array<long>, status string"
)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for (_, kind), c in zip(fields, zip(*rows, strict=True), strict=True)], names=[name for name, _ in fields]
    )


def _described(doc: int | None, n: int | None, media: bytes | None) -> tuple:
    if media is None:
        return doc, n, *[None] * 9, "none"
    index = index_stream(media)
    status, payload = carried(media, index)
    told = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if payload is not None else (None, None, None)
    seek = zlib.crc32(np.array(index.offsets, ">i8").tobytes())
    feature = f"{index.kind} {index.sample_rate} Hz {len(index.offsets)} frames {index.samples} samples seek {seek:08x}" if index.offsets else None
    return doc, n, *told, len(media), hashlib.sha256(media).hexdigest(), feature, index.seconds, index.crc_ok, index.offsets, status


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _described(doc, n, cell.as_py())
            for doc, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
        ]
        if rows:
            yield _rows(rows, _FEATURES)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text stored as an MPEG stream."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_store, _STORED)


def media_features(media: DataFrame) -> DataFrame:
    """Digests, duration and seek offsets of the streams of ``media_column``."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)
