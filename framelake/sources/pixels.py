"""Still images in numpy: PNG, BMP, PPM and PGM as 8-bit RGB, height by width by 3."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Pixels of an image that is decoded: a header may tell any size.
MOST_PIXELS = 1 << 28


def checked(width: int, height: int) -> tuple[int, int]:
    if not (0 < width and 0 < height and width * height <= MOST_PIXELS):
        raise ValueError("unusable image size")
    return width, height


def decode(content: bytes) -> np.ndarray:
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return png(content)
    if content[:2] == b"BM":
        return bmp(content)
    if content[:2] in (b"P5", b"P6"):
        return ppm(content)
    raise ValueError("unknown image")


def png(content: bytes) -> np.ndarray:
    """Any colour type at 8 or 16 bits (the upper 8 are kept), not interlaced; transparency is dropped."""
    at, data, palette = 8, [], None
    width = 0
    while at + 12 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if not width:
        raise ValueError("no PNG header")
    checked(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or depth not in (8, 16) or interlaced or kind == 3 and palette is None:
        raise ValueError("PNG form is not supported")
    step = channels * depth // 8
    wanted = height * (1 + width * step)
    raw = zlib.decompressobj().decompress(b"".join(data), wanted)
    if len(raw) < wanted:
        raise ValueError("cut PNG")
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    before = np.zeros(width * step, np.uint8)
    for y, (how, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        out[y] = before = unfiltered(how, line, before, step)
    x = out.reshape(height, width, channels, depth // 8)[..., 0]
    if kind == 3:
        return palette[np.minimum(x[..., 0], len(palette) - 1)]
    return np.repeat(x[..., :1], 3, axis=2) if channels < 3 else x[..., :3]


def unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if how == 0:
        return line
    if how == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if how == 2:
        return line + above
    if how not in (3, 4):
        raise ValueError("unknown PNG filter")
    out, up, raw = [0] * step, [0] * step + above.tolist(), line.tolist()
    for i, x in enumerate(raw):
        a, b, c = out[i], up[i + step], up[i]
        if how == 3:
            out.append((x + (a + b) // 2) & 255)
        else:
            near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out.append((x + (a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c)) & 255)
    return np.array(out[step:], np.uint8)


def bmp(content: bytes) -> np.ndarray:
    """24 and 32 bits a pixel, not compressed."""
    begin, (width, height, _, bits, packing) = struct.unpack_from("<I", content, 10)[0], struct.unpack_from("<iiHHI", content, 18)
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("BMP form is not supported")
    checked(width, abs(height))
    stride = (width * bits // 8 + 3) // 4 * 4
    if begin + stride * abs(height) > len(content):
        raise ValueError("cut BMP")
    rows = np.frombuffer(content, np.uint8, stride * abs(height), begin).reshape(abs(height), stride)[:, : width * bits // 8]
    out = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out if height < 0 else out[::-1]


def ppm(content: bytes) -> np.ndarray:
    """Binary, of 8 bits."""
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while content[end : end + 1].isdigit():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    width, height, top = fields
    checked(width, height)
    channels = 3 if content[1:2] == b"6" else 1
    if not 0 < top < 256:
        raise ValueError("PPM form is not supported")
    if at + 1 + width * height * channels > len(content):
        raise ValueError("cut PPM")
    x = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    x = x if top == 255 else (x.astype(np.uint32) * 255 // top).clip(0, 255).astype(np.uint8)
    return np.repeat(x, 3, axis=2) if channels == 1 else x
