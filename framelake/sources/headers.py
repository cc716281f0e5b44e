"""Headers built for tests and queries: containers without payload."""

from __future__ import annotations

import struct
import zlib


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def track(kind: bytes, scale: int, length: int, entry: bytes, count: int) -> bytes:
    mdhd = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, scale, length, 0, 0))
    hdlr = box(b"hdlr", struct.pack(">II4s", 0, 0, kind), bytes(12))
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stsz", struct.pack(">III", 0, 1, count)))
    return box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))


def mp4(width: int, height: int, frames: int, scale: int, length: int, rate: int, channels: int) -> bytes:
    """One track of picture, one of sound."""
    picture = box(b"avc1", bytes(24), struct.pack(">HH", width, height), bytes(50))
    sound = box(b"mp4a", bytes(16), struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", track(b"vide", scale, length, picture, frames), track(b"soun", rate, rate * length // scale, sound, 1))


def png(width: int, height: int, rgb: bytes) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = b"".join(b"\0" + rgb[k * width * 3 : (k + 1) * width * 3] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def y4m(width: int, height: int, fps: tuple[int, int], planes: list[bytes], chroma: str = "444") -> bytes:
    head = f"YUV4MPEG2 W{width} H{height} F{fps[0]}:{fps[1]} C{chroma}\n".encode()
    return head + b"".join(b"FRAME\n" + p for p in planes)
