"""Media columns: MPEG audio files that carry a payload, and a parser for MPEG audio in general.

The writer makes a silent variable-bitrate Layer III file: an ID3v2 tag with the payload's length, a "Xing"
frame with the frame count and seek table, then frames whose main data is empty and whose ancillary bytes are
the payload, each with its checksum. The parser resynchronises on frame headers, reads tags and both kinds of
variable-bitrate tables, verifies checksums and gives exact durations and the offset of every frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, text_bytes

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer) and index from 1, and sample rates.
KBPS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
NAMES = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: int  # the version bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@functools.lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The frame that a four-byte header announces; None if it isn't one (free format counts as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    kbps, rate, pad = KBPS[version == 3, layer][index - 1], RATES[version][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not raw[1] & 1, kbps, rate, raw[3] >> 6 == 3, length, samples)


@functools.lru_cache(4096)
def crc16(raw: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


#: Bits of the allocation of each subband by table: (subbands, bits) runs. Fixed values of the same standards.
_ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def _layer2_bits(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer II frame."""
    if h.version != 3:
        name = "low"
    else:
        each = h.kbps if h.mono else h.kbps // 2
        name = ("c" if h.rate != 32000 else "d") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for count, bits in _ALLOCATION[name] for _ in range(count)]


def protected(frame: bytes, h: Header) -> bytes | None:
    """What the checksum of a frame covers, as a string of bits padded by nothing (``bits`` of '0' and '1'); None if cut off.

    The last two header bytes, then side information (Layer III), bit allocation (I), or that and the selection of
    scale factors (II).
    """
    body = int.from_bytes(frame[6:], "big")
    size = 8 * len(frame[6:])
    at = 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return body >> (size - at) & ((1 << n) - 1) if at <= size else 0

    channels, joint = (1 if h.mono else 2), frame[3] >> 6 == 1
    bound = 4 * (frame[3] >> 4 & 3) + 4 if joint else 32
    if h.layer == 3:
        take(8 * h.side)
    elif h.layer == 1:
        take(4 * (min(bound, 32) * channels + (32 - min(bound, 32))))
    else:
        bits, used = _layer2_bits(h), 0
        for k, n in enumerate(bits):
            own = [take(n) for _ in range(channels if k < bound else 1)]
            used += sum(map(bool, own)) if k < bound or channels == 1 else 2 * bool(own[0])
        take(2 * used)
    if at > size:
        return None
    return f"{int.from_bytes(frame[2:4], 'big'):016b}{body >> (size - at):0{at}b}".encode() if at else f"{int.from_bytes(frame[2:4], 'big'):016b}".encode()


@functools.lru_cache(4096)
def crc16_bits(bits: bytes) -> int:
    """:func:`crc16` of a string of '0' and '1', which need not fill whole bytes."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if (crc >> 15) ^ (bit & 1) else crc << 1 & 0xFFFF
    return crc


@dataclass
class Audio:
    """What :func:`parse` found; offsets are of audio frames, without the frame of the bitrate table."""

    tags: dict = field(default_factory=dict)
    table: dict | None = None
    offsets: list = field(default_factory=list)
    heads: list = field(default_factory=list)
    checked: int = 0
    broken: list = field(default_factory=list)
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly, without the delay and padding that the encoder noted."""
        of = Counter((h.samples, h.rate) for h in self.heads)
        whole = sum((Fraction(n * samples, rate) for (samples, rate), n in of.items()), Fraction(0))
        extra = (self.table or {}).get("delay", 0) + (self.table or {}).get("padding", 0)
        return max(Fraction(0), whole - Fraction(extra, self.heads[0].rate)) if extra and self.heads else whole


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes) -> tuple[int, dict]:
    """Where the tag ends and its user text frames (TXXX, Latin-1 or UTF-8) and other text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    size, tags = _synchsafe(data[6:10]), {}
    end, pos = min(len(data), 10 + size), 10
    if data[3] in (3, 4) and not data[5] & 0xC0:
        while pos + 10 <= end and data[pos : pos + 4].isalnum():
            name = data[pos : pos + 4].decode("ascii")
            raw = data[pos + 4 : pos + 8]
            n = _synchsafe(raw) if data[3] == 4 else int.from_bytes(raw, "big")
            if pos + 10 + n > end:
                break
            body = data[pos + 10 : pos + 10 + n]
            if name[0] == "T" and body[:1] in (b"\0", b"\3"):
                text = body[1:].decode("utf-8" if body[0] else "latin-1", "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            pos += 10 + n
    return min(len(data), 10 + size + (10 if data[5] & 0x10 else 0)), tags


def _table(frame: bytes, h: Header) -> dict | None:
    """The Xing/Info or VBRI table of a frame."""
    for at in {4 + h.side, 4 + h.side + 2 * h.checked}:
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, pos, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
                if flags & bit and pos + size <= len(frame):
                    raw = frame[pos : pos + size]
                    out[name] = list(raw) if name == "seek" else int.from_bytes(raw, "big")
                    pos += size
            # The encoder's own field: nine bytes of name, and at its byte 21 twelve bits each of delay and padding.
            if frame[pos : pos + 4] in (b"LAME", b"Lavf", b"Lavc") and pos + 24 <= len(frame):
                both = int.from_bytes(frame[pos + 21 : pos + 24], "big")
                out |= {"encoder": frame[pos : pos + 9].decode("latin-1").rstrip("\0 "), "delay": both >> 12, "padding": both & 4095}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        seek = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if width and 62 + entries * width <= len(frame) else []
        return {"kind": "VBRI", "bytes": size, "frames": frames, "seek": seek, "step": step}
    return None


def parse(data: bytes) -> Audio:
    """Parse MPEG audio of any layer.

    A header counts once the next frame's header follows it with the same version, layer and sample rate, or
    the data end there; after a frame that counts, a header of the same kind does at once. Anything else is skipped byte by byte and counted. Checksums of all layers are verified;
    a frame whose checksum differs stays, and is listed. Frames of free format count as none. Empty data give an empty result.
    """
    out = Audio()
    pos, out.tags = _id3v2(data)
    end = len(data)
    if end - pos >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                out.tags.setdefault(name, value)
    synced, first = None, True
    while pos + 4 <= end:
        h = header(data[pos : pos + 4])
        good = h is not None and pos + h.length <= end
        if good and (h.version, h.layer, h.rate) != synced and pos + h.length + 4 <= end:
            after = header(data[pos + h.length : pos + h.length + 4])
            good = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if not good:
            synced = None
            to = data.find(b"\xff", pos + 1, end)
            out.skipped += (to if to >= 0 else end) - pos
            pos = to if to >= 0 else end
            continue
        synced = (h.version, h.layer, h.rate)
        if first and h.layer == 3 and (table := _table(data[pos : pos + h.length], h)):
            out.table = table
        else:
            if h.checked:
                want = int.from_bytes(data[pos + 4 : pos + 6], "big")
                if h.layer == 3:
                    got = crc16(data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + h.side])
                else:
                    bits = protected(data[pos : pos + h.length], h)
                    got = None if bits is None else crc16_bits(bits)
                out.checked += 1
                if got != want:
                    out.broken.append(pos)
            out.offsets.append(pos)
            out.heads.append(h)
        first = False
        pos += h.length
    out.skipped += max(0, end - pos)
    return out


# The writer's frames: MPEG-1 Layer III, 48 kHz, mono, with checksum. At 48 kHz no frame needs padding.
_SIDE = bytes(17)
_OVER = 4 + 2 + len(_SIDE)


def _head(index: int) -> bytes:
    raw = bytes((0xFF, 0xFA, index << 4 | 0x04, 0xC0))
    return raw + crc16(raw[2:] + _SIDE).to_bytes(2, "big") + _SIDE


_HEADS = [(header(_head(i)[:4]).length, _head(i)) for i in range(1, 15)]


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def write(payload: bytes, n_bytes: int) -> bytes:
    """A file with ``payload``; the last frame has the lowest bitrate that holds the rest."""
    size, head = _HEADS[-1]
    room, parts = size - _OVER, []
    full = len(payload) // room
    for i in range(full):
        parts += (head, payload[i * room : (i + 1) * room])
    lengths = [size] * full
    if rest := payload[full * room :]:
        size, head = next(x for x in _HEADS if x[0] - _OVER >= len(rest))
        parts += (head, rest, bytes(size - _OVER - len(rest)))
        lengths.append(size)
    total = sum(lengths)
    # All frames but the last have one size.
    seek = [min(255, 256 * lengths[0] * (percent * len(lengths) // 100) // total) for percent in range(100)]
    body = struct.pack(">4sIII", b"Xing", 15, len(lengths), 192 + total) + bytes(seek) + bytes((0, 0, 0, 100))
    table = bytes((0xFF, 0xFB, 0x54, 0xC0)) + _SIDE + body
    table += bytes(192 - len(table))
    frames = b""
    for key, value in ((b"n_bytes", n_bytes), (b"payload_bytes", len(payload))):
        text = b"\3" + key + b"\0" + str(value).encode()
        frames += b"TXXX" + bytes((0, 0, len(text) >> 7, len(text) & 127, 0, 0)) + text
    tag = b"ID3\4\0\0" + bytes((0, 0, len(frames) >> 7, len(frames) & 127)) + frames
    return b"".join((tag, table, *parts))


def read(data: bytes) -> tuple[bytes, Audio]:
    """The payload of a file by :func:`write`, and what the parser found; ValueError if it is damaged."""
    audio = parse(data)
    parts = [data[p + _OVER : p + h.length] for p, h in zip(audio.offsets, audio.heads)]
    payload = b"".join(parts)[: int(audio.tags.get("payload_bytes", -1))]
    if audio.broken or audio.skipped or not audio.table or audio.table.get("frames") != len(audio.offsets) or len(payload) != int(audio.tags.get("payload_bytes", -1)):
        raise ValueError("not a whole file with a payload")
    return payload, audio


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary) for each row of ``docs``; a null text is stored as an empty one."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, media, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                ids.append(i)
                media.append(write(pad(t), len(t)))
                size += len(media[-1])
                if size >= 4 << 20:  # a batch of texts makes several batches of media
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])
                    ids, media, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, media binary")


def probe_media(media: DataFrame) -> DataFrame:
    """Tags, table, exact duration, checksums and seek offsets of each row's ``media`` column, of any origin.

    Returns doc_id, frames, samples, duration_num, duration_den (seconds as a fraction), checked, broken,
    skipped, tags (map), table_frames, frame_offsets. Null or empty media give zeros and an empty list.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                a = parse(raw or b"")
                rows.append((i, len(a.offsets), a.samples, a.duration.numerator, a.duration.denominator, a.checked, len(a.broken), a.skipped, list(a.tags.items()), (a.table or {}).get("frames"), a.offsets))
            names = ["doc_id", "frames", "samples", "duration_num", "duration_den", "checked", "broken", "skipped", "tags", "table_frames", "frame_offsets"]
            kinds = [*[pa.int64()] * 8, pa.map_(pa.string(), pa.string()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    schema = "doc_id long, frames long, samples long, duration_num long, duration_den long, checked long, broken long, skipped long, tags map<string,string>, table_frames long, frame_offsets array<long>"
    return media.select("doc_id", "media").mapInArrow(lean(run), schema)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "duration_num long, duration_den long, frame_offsets array<long>"
)


def _digest(doc_id: int | None, raw: bytes) -> tuple:
    """Read a stored payload back and digest it.

    The feature is made of version, layer, rate, frames, samples, the duration as a fraction of seconds,
    verified checksums, and a CRC-32 of all seek offsets as little-endian 64-bit integers.
    """
    import numpy as np

    payload, a = read(raw)
    h, t = a.heads[0], a.duration
    offsets = np.array(a.offsets, "<i8")
    feature = f"mpeg{NAMES[h.version]}-layer{h.layer};rate={h.rate};frames={len(a.offsets)};samples={a.samples};seconds={t.numerator}/{t.denominator};checked={a.checked - len(a.broken)};seek={zlib.crc32(offsets.tobytes()):08x}"
    return (
        doc_id, int(a.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
        len(raw), hashlib.sha256(raw).hexdigest(), feature, t.numerator, t.denominator, offsets,
    )


def _digests(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def stored_media(docs: DataFrame) -> DataFrame:
    """The media of :func:`encode_media` as a table in the shared folder, in row groups of bounded bytes."""
    return stored(encode_media(docs), "media", compression="zstd", **{"parquet.block.size": str(16 << 20)})


def digest_media(media: DataFrame) -> DataFrame:
    """Digests (:func:`_digest`) of a table of :func:`encode_media`, of which a task holds a part of a batch at a time."""

    def run(batches):
        for b in batches:
            yield _digests([_digest(i, raw) for i, raw in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist())])

    return media.mapInArrow(lean(run), DIGEST)
