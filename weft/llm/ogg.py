"""Media columns in Ogg: pages with checksums, packets in lacing values, logical streams side by side, times from granules.

The samples are cut into packets, of PACKET samples but for the last, that two logical streams take in turn, and a third
says how long the text is; packets run on over pages, which are put in the order of their times. The reader parts the
streams, puts packets together, derives each one's time from granules, and puts the samples in the order of time.

Null texts count as empty. Rows are independent: repeated rows give repeated results, an empty table an empty result,
and columns of other names are left out. The reader takes any bytes: pages that fail their checksum are left out and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, utf8

BLOCK = 576
RATE = 8000
PAD = 255
# Fixed values of the Ogg format: capture pattern, header layout, flags, segments and bytes at most.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS, SEGMENT = 255, 255
NO_GRANULE = -1

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Samples of a packet but the last: 19 segments, so that pages of 255 end within packets.
PACKET = 8 * BLOCK
_PCM = struct.Struct("<8sIIBBBB")
_SIZE = struct.Struct("<8sQ")


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04C11DB7, highest bit first, from 0): zlib's, over bytes with their bits mirrored."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(length: int) -> bytes:
    return b"\xff" * (length // SEGMENT) + bytes([length % SEGMENT])


def page(serial: int, number: int, flags: int, granule: int, laced: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(laced)) + laced
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[bytes], granules: list[int], apart: int = 0) -> list[bytes]:
    """A logical stream's pages. A packet may run over several pages; a granule counts where its packet ends.

    apart: packets at the beginning, headers, that have pages of their own.
    """
    if 0 < apart < len(packets):
        more = pages_of(serial, packets[apart:], granules[apart:])
        heads = pages_of(serial, packets[:apart], granules[:apart])
        return [*(renumbered(p, i, LAST, 0) for i, p in enumerate(heads)), *(renumbered(p, len(heads) + i, FIRST, 0) for i, p in enumerate(more))]
    segments: list[tuple[int, bytes, int]] = []
    for packet, granule in zip(packets, granules, strict=True):
        sizes, at = lacing(len(packet)), 0
        for k, n in enumerate(sizes):
            segments.append((n, packet[at : at + n], granule if k == len(sizes) - 1 else NO_GRANULE))
            at += n
    out, going = [], False
    for number, start in enumerate(range(0, len(segments), MOST_SEGMENTS)):
        part = segments[start : start + MOST_SEGMENTS]
        ends = [g for *_, g in part if g != NO_GRANULE]
        flags = CONTINUED * going | FIRST * (number == 0) | LAST * (start + MOST_SEGMENTS >= len(segments))
        out.append(page(serial, number, flags, ends[-1] if ends else NO_GRANULE, bytes(n for n, *_ in part), b"".join(b for _, b, _ in part)))
        going = part[-1][2] == NO_GRANULE
    return out


def renumbered(p: bytes, number: int, without: int, add: int) -> bytes:
    """A page with another number, without and with some flags, and its checksum anew."""
    flags = (p[5] & ~without) | add
    p = p[:5] + bytes([flags]) + p[6:18] + number.to_bytes(4, "little") + b"\0\0\0\0" + p[26:]
    return p[:22] + checksum(p).to_bytes(4, "little") + p[26:]


def write(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """Two streams of 8-bit samples, packets in turn, and one with the length without padding; pages by the time they end."""
    serial = zlib.crc32(payload)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    out = []
    for k in range(2):
        own = packets[k::2]
        ends = [min(len(payload), (2 * i + k + 1) * PACKET) for i in range(len(own))]
        head = _PCM.pack(b"\x80pcm8   ", rate, PACKET, 8, 1, k, 2)
        found = pages_of(serial ^ k, [head, *own], [0, *ends], apart=1)
        time = 0
        for p in found:
            time = max(time, HEADER.unpack_from(p)[3])  # a page in which no packet ends has the time of the one before
            out.append((time, len(out), p))
    first = [x for x in out if HEADER.unpack_from(x[2])[2] & FIRST]
    size = page(serial ^ 2, 0, FIRST | LAST, 0, bytes([_SIZE.size]), _SIZE.pack(b"\x80size   ", n_bytes))
    rest = sorted(x for x in out if not HEADER.unpack_from(x[2])[2] & FIRST)
    return b"".join([*(p for _, _, p in first), size, *(p for _, _, p in rest)])


@dataclass
class Stream:
    """A logical stream as read: packets, each with its page's granule (-1 unless it ends that page), and page ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    partial: list[bytes] | None = None
    next_number: int | None = None
    lost: int = 0
    ended: bool = False

    def times(self, rate: int) -> list[float]:
        """Seconds at which the pages' last whole packets end."""
        return [g / rate for g in self.granules if g >= 0]


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and the count of places where a page was broken; reading goes on at the next page."""
    streams: dict[int, Stream] = {}
    broken = at = 0
    while (at := media.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(media):
            broken += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        sizes = media[at + HEADER.size : body]
        end = body + sum(sizes)
        whole = media[at:end]
        if version or len(sizes) < n or end > len(media) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            broken += 1
            at += 1
            continue
        s = streams.setdefault(serial, Stream(serial))
        if s.next_number is not None and number != s.next_number:
            s.lost += 1
            s.partial = None
        s.next_number = number + 1
        if flags & CONTINUED:
            taking = s.partial is not None
            parts = s.partial or []
        else:
            taking, parts = True, []
        last = -1
        k = body
        for size in sizes:
            parts.append(media[k : k + size])
            k += size
            if size < SEGMENT:
                if taking:
                    s.packets.append(b"".join(parts))
                    s.granules.append(-1)
                    last = len(s.packets) - 1
                taking, parts = True, []
        s.partial = parts if parts and taking else None
        if last >= 0:
            s.granules[last] = granule
        s.ended |= bool(flags & LAST)
        at = end
    return streams, broken


def read_samples(media: bytes) -> tuple[bytes, int, int, float, int]:
    """Payload, length without padding, rate, duration in seconds, and places broken, of what write() made.

    A packet's time is the granule of the page that it ends, or follows from the packets next to it, as all but the last
    are of one size and streams take turns; times that do not agree with what is there count as broken.
    """
    streams, broken = demultiplex(media)
    placed, n_bytes, rate, seconds = [], 0, RATE, 0.0
    for s in streams.values():
        if s.packets and s.packets[0][:8] == b"\x80pcm8   ":
            _, rate, size, _, _, k, of = _PCM.unpack(s.packets[0])
            for i, (packet, granule) in enumerate(zip(s.packets[1:], s.granules[1:], strict=True)):
                start = (of * i + k) * size
                broken += granule >= 0 and granule != start + len(packet)
                placed.append((start, packet))
            seconds = max([seconds, *s.times(rate)])
        elif s.packets and s.packets[0][:8] == b"\x80size   ":
            n_bytes = _SIZE.unpack(s.packets[0])[1]
    return b"".join(p for _, p in sorted(placed)), n_bytes, rate, seconds, broken


def features(payload: bytes, rate: int, seconds: float) -> str:
    """Duration, mean, root mean square, crossings of the middle a second, peak, and the four quarters' energies."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    square = x * x
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    quarters = ",".join(str(int(q.sum())) for q in np.split(square, 4)) if len(x) % 4 == 0 else str(int(square.sum()))
    n = max(1, len(x))
    return f"seconds={seconds:.6f};mean={x.sum() / n:.6f};rms={np.sqrt(square.sum() / n):.6f};crossings={crossings * rate / n:.3f};peak={int(np.abs(x).max(initial=0))};quarters={quarters}"


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)


def media_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and the text's UTF-8 stored as an Ogg file (column media); null counts as empty."""

    def f(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "media": [write(padded(t), len(t)) for t in utf8(batch.column(1))]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f, f"`{key}` {kind}, media binary")


def read_media(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from column media: bytes, digests, times and features. Null media count as empty."""

    def f(batch: pa.RecordBatch) -> dict:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "broken_pages")
        out: dict = {n: [] for n in names}
        for media in batch.column(1).to_pylist():
            media = media or b""
            payload, n, rate, seconds, broken = read_samples(media)
            row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, rate, seconds), broken)
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return out | {key: batch.column(0)}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, "media"), f, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, broken_pages long")
