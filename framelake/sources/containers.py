"""Headers of containers: which streams they hold. Known by their first bytes: WAV, Y4M, PNG, BMP, PPM, FLAC, MP4."""

from __future__ import annotations

import struct
from fractions import Fraction
from functools import lru_cache

import numpy as np

from framelake.sources import flac, wav


def streams_of(content: bytes) -> list[dict]:
    if content[:4] == b"RIFF":
        h = wav.header(content)
        n = (h["end"] - h["begin"]) // (h["bits"] // 8 * h["channels"])
        return [audio(0, h["rate"], h["channels"], n)]
    if content[:9] == b"YUV4MPEG2":
        h = y4m_header(content)
        return [clip(h, y4m_count(content))]
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return [still(*struct.unpack_from(">II", content, 16))]
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack_from("<ii", content, 18)
        return [still(max(0, w), abs(h))]
    if content[:2] in (b"P5", b"P6"):
        w, h = (int(x) for x in content[2:64].split()[:2])
        return [still(w, h)]
    if content[:4] == b"fLaC":
        h = flac.header(content)
        return [audio(0, h["rate"], h["channels"], h["samples"])]
    if content[4:8] == b"ftyp":
        return mp4_streams(content)
    raise ValueError("unknown container")


def audio(index: int, rate: int, channels: int, samples: int) -> dict:
    return {"stream_index": index, "stream_type": "audio", "sample_rate": rate, "channels": channels, "nb_frames": samples, "duration_s": samples / rate if rate else None}


def clip(h: dict, frames: int) -> dict:
    return {"stream_index": 0, "stream_type": "video", "width": h["width"], "height": h["height"], "fps": float(h["fps"]), "nb_frames": frames, "duration_s": float(frames / h["fps"])}


def still(width: int, height: int) -> dict:
    """An image is one frame at a rate of one."""
    return {"stream_index": 0, "stream_type": "video", "width": width, "height": height, "fps": 1.0, "nb_frames": 1}


def boxes(data: bytes, begin: int, end: int):
    """(name, begin, end) of the boxes of a range; sizes beyond the range are cut."""
    while begin + 8 <= end:
        size, head = struct.unpack_from(">I", data, begin)[0], 8
        if size == 1 and begin + 16 <= end:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        stop = end if size == 0 else min(end, begin + max(size, head))
        yield data[begin + 4 : begin + 8], begin + head, stop
        begin = stop


def inside(data: bytes, where: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for name in path:
        where = next(((a, b) for n, a, b in boxes(data, *where) if n == name), None)
        if where is None:
            return None
    return where


def mp4_streams(data: bytes) -> list[dict]:
    """Tracks of picture and sound, by their headers; other kinds keep their place in the numbering."""
    moov = inside(data, (0, len(data)), b"moov")
    if moov is None:
        raise ValueError("no moov box")
    out = []
    for index, (_, *trak) in enumerate(b for b in boxes(data, *moov) if b[0] == b"trak"):
        trak = tuple(trak)
        head, handler, sizes = (inside(data, trak, b"mdia", b"mdhd"), inside(data, trak, b"mdia", b"hdlr"), inside(data, trak, b"mdia", b"minf", b"stbl", b"stsz"))
        if head is None or handler is None:
            continue
        wide = data[head[0]] == 1
        scale, length = struct.unpack_from(">IQ" if wide else ">II", data, head[0] + (20 if wide else 12))
        seconds = length / scale if scale else None
        count = struct.unpack_from(">I", data, sizes[0] + 8)[0] if sizes else None
        kind = data[handler[0] + 8 : handler[0] + 12]
        entry = inside(data, trak, b"mdia", b"minf", b"stbl", b"stsd")
        entry = entry and (entry[0] + 16, entry[1])  # past the count and the entry's own header
        if kind == b"vide" and entry:
            w, h = struct.unpack_from(">HH", data, entry[0] + 24)
            out.append({"stream_index": index, "stream_type": "video", "width": w, "height": h, "fps": count / seconds if count and seconds else 0.0, "nb_frames": count, "duration_s": seconds})
        elif kind == b"soun" and entry:
            channels, rate = struct.unpack_from(">H", data, entry[0] + 16)[0], struct.unpack_from(">I", data, entry[0] + 24)[0] >> 16
            out.append({"stream_index": index, "stream_type": "audio", "sample_rate": rate or scale, "channels": channels, "nb_frames": count, "duration_s": seconds})
    return out


def y4m_header(data: bytes) -> dict:
    line, _, _ = data.partition(b"\n")
    tags = {x[:1]: x[1:].decode() for x in line.split(b" ")[1:]}
    if not all(t in tags for t in (b"W", b"H", b"F")):
        raise ValueError("no size or no rate")
    num, den = tags[b"F"].split(":")
    full = "COLORRANGE=FULL" in (x[1:].decode() for x in line.split(b" ")[1:] if x[:1] == b"X")
    h = {"width": int(tags[b"W"]), "height": int(tags[b"H"]), "fps": Fraction(int(num), int(den)), "chroma": tags.get(b"C", "420"), "begin": len(line) + 1, "full": full}
    if h["width"] <= 0 or h["height"] <= 0 or h["fps"] <= 0 or b"\n" not in data[: h["begin"]]:
        raise ValueError("unusable Y4M header")
    return h


def y4m_layout(h: dict) -> tuple[int, int]:
    """Height and width of a chroma plane."""
    halves = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (1, 2), "444": (1, 1)}.get(h["chroma"])
    if halves is None:
        raise ValueError(f"chroma {h['chroma']!r} is not supported")
    return -(-h["height"] // halves[0]), -(-h["width"] // halves[1])


def y4m_frames(data: bytes, size: int, begin: int):
    """Where each whole frame's samples begin."""
    at = begin
    while True:
        end = data.find(b"\n", at, at + 4096)
        if not data.startswith(b"FRAME", at) or end < 0 or end + 1 + size > len(data):
            return
        yield end + 1
        at = end + 1 + size


def y4m_count(data: bytes) -> int:
    h = y4m_header(data)
    ch, cw = y4m_layout(h)
    return sum(1 for _ in y4m_frames(data, h["height"] * h["width"] + 2 * ch * cw, h["begin"]))


def y4m_raw(data: bytes):
    """(luma, first chroma, second chroma) of each whole frame, each at its own size."""
    h = y4m_header(data)
    height, width = h["height"], h["width"]
    ch, cw = y4m_layout(h)
    luma, chroma = height * width, ch * cw
    for begin in y4m_frames(data, luma + 2 * chroma, h["begin"]):
        raw = np.frombuffer(data, np.uint8, luma + 2 * chroma, begin)
        yield raw[:luma].reshape(height, width), raw[luma : luma + chroma].reshape(ch, cw), raw[luma + chroma :].reshape(ch, cw)


def widened(chroma: np.ndarray, height: int, width: int) -> np.ndarray:
    """A chroma plane at the size of luma: each sample for the pixels that it stands for."""
    ch, cw = chroma.shape
    if (ch, cw) == (height, width):
        return chroma
    return np.repeat(np.repeat(chroma, -(-height // ch), axis=0), -(-width // cw), axis=1)[:height, :width]


def y4m_planes(data: bytes):
    """(luma, first chroma, second chroma) of each whole frame, chroma at the size of luma."""
    for y, u, v in y4m_raw(data):
        yield y, widened(u, *y.shape), widened(v, *y.shape)


#: Bits of the fraction of the tables below: with these, all 8-bit samples give what double precision gives.
FRACTION = 20


@lru_cache(maxsize=16)
def tables(red: float, blue: float, full: bool) -> tuple[np.ndarray, ...]:
    """What each luma sample adds to all colours, and each chroma sample to red, green and blue; the half that rounds is in luma's."""
    fixed = lambda x: np.round(x * (1 << FRACTION)).astype(np.int32)
    n = np.arange(256, dtype=np.float64)
    c = (n - 128) * (1.0 if full else 255 / 224)
    green = 1 - red - blue
    return fixed((n if full else (n - 16) * (255 / 219)) + 0.5), fixed(2 * (1 - red) * c), fixed(-2 * red * (1 - red) / green * c), fixed(-2 * blue * (1 - blue) / green * c), fixed(2 * (1 - blue) * c)


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, red: float = 0.299, blue: float = 0.114, full: bool = False) -> np.ndarray:
    """8-bit planes of red, green and blue; chroma may have its own size."""
    luma, for_red, green_v, green_u, for_blue = tables(red, blue, full)
    base = luma[y]
    out = np.empty((3, *y.shape), np.uint8)
    for k, add in enumerate((for_red[v], green_v[v] + green_u[u], for_blue[u])):
        x = base + widened(add, *y.shape)
        x >>= FRACTION
        np.clip(x, 0, 255, out=x)
        out[k] = x
    return out
