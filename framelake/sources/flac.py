"""FLAC (RFC 9639): decoding of whole streams in numpy, and a small encoder for tests and queries."""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class Bits:
    """A window of bits, read from the front."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        places = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.next_one = memoryview(np.minimum.accumulate(places[::-1])[::-1].astype(np.int32))
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("cut FLAC frame")
        self.at += n
        return int("".join(map(str, self.bits[self.at - n : self.at].tolist())) or "0", 2)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        one = self.next_one[self.at] if self.at < len(self.bits) else len(self.bits)
        if one >= len(self.bits):
            raise ValueError("cut FLAC frame")
        n, self.at = one - self.at, one + 1
        return n

    def fixed(self, n: int, width: int) -> np.ndarray:
        """n signed numbers of a width."""
        if self.at + n * width > len(self.bits):
            raise ValueError("cut FLAC frame")
        if not width:
            return np.zeros(n, np.int64)
        part = self.bits[self.at : self.at + n * width].reshape(n, width).astype(np.int64)
        self.at += n * width
        x = part @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return x - (part[:, 0] << width)

    def rice(self, n: int, k: int) -> np.ndarray:
        """n signed numbers: a unary quotient and k bits each. Only the walk from one to the next goes step by step."""
        quotients, lows, at, next_one, end = [], [], self.at, self.next_one, len(self.bits)
        for _ in range(n):
            one = next_one[at] if at < end else end
            if one + k >= end:
                raise ValueError("cut FLAC frame")
            quotients.append(one - at)
            lows.append(one + 1)
            at = one + 1 + k
        self.at = at
        x = np.array(quotients, np.int64) << k
        if k and n:
            x |= self.bits[np.array(lows)[:, None] + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
        return (x >> 1) ^ -(x & 1)


def residual(b: Bits, size: int, order: int) -> np.ndarray:
    wide = {0: 4, 1: 5}.get(b.take(2))
    if wide is None:
        raise ValueError("unknown FLAC residual")
    parts = b.take(4)
    out = []
    for k in range(1 << parts):
        n = (size >> parts) - (order if k == 0 else 0)
        if n < 0:
            raise ValueError("bad FLAC partition")
        parameter = b.take(wide)
        out.append(b.fixed(n, b.take(5)) if parameter == (1 << wide) - 1 else b.rice(n, parameter))
    return np.concatenate(out)


def subframe(b: Bits, size: int, bits: int) -> np.ndarray:
    if b.take(1):
        raise ValueError("bad FLAC subframe")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bits -= wasted
    if bits < 1:
        raise ValueError("bad FLAC subframe")
    if kind == 0:
        x = np.full(size, b.signed(bits), np.int64)
    elif kind == 1:
        x = b.fixed(size, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = b.fixed(order, bits)
        x = residual(b, size, order)
        for level in range(order - 1, -1, -1):  # from differences of an order to those of the order below
            x = np.cumsum(np.concatenate([np.diff(warm, level)[:1], x]))
    elif kind >= 32:
        order = kind - 31
        warm = b.fixed(order, bits)
        precision = b.take(4) + 1
        shift = b.signed(5)
        weights = b.fixed(order, precision)[::-1].tolist()
        x = warm.tolist()
        for r in residual(b, size, order).tolist():
            x.append((sum(w * v for w, v in zip(weights, x[-order:])) >> shift) + r)
        x = np.array(x, np.int64)
    else:
        raise ValueError("reserved FLAC subframe")
    return x << wasted


def header(content: bytes) -> dict:
    """Of the stream: channels, rate, bits, samples (0: unknown), block (the largest), and where frames begin."""
    if content[:4] != b"fLaC" or len(content) < 42:
        raise ValueError("not a FLAC stream")
    info = content[8:42]
    packed = int.from_bytes(info[10:18], "big")
    at = 4
    while True:
        if at + 4 > len(content):
            raise ValueError("cut FLAC header")
        last, n = content[at] >> 7, int.from_bytes(content[at + 1 : at + 4], "big")
        at += 4 + n
        if last:
            break
    return {"block": int.from_bytes(info[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "begin": at}


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples of -1 to 1 by channel, rate, samples of a block). A cut last frame is left out."""
    h = header(content)
    at, blocks = h["begin"], []
    most = h["block"] * h["channels"] * (h["bits"] + 2) // 8 + 256
    while at + 6 < len(content):
        b = Bits(content[at : at + 2 * most])
        try:
            if b.take(15) != 0x7FFC:
                raise ValueError("no FLAC frame where one should be")
            b.take(1)
            size, rate, channels, bits = b.take(4), b.take(4), b.take(4), b.take(3)
            b.take(1)
            lead = b.take(8)
            more = 0
            while lead & 0x80 >> more and more < 7:
                more += 1
            b.take(8 * max(0, more - 1))
            size = b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else BLOCK_SIZES.get(size, 0)
            b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
            b.take(8)
            bits = SAMPLE_BITS.get(bits, h["bits"])
            if channels > 10 or not size:
                raise ValueError("reserved FLAC frame")
            side = {8: 1, 9: 0, 10: 1}.get(channels)  # the channel of differences has a bit more
            x = [subframe(b, size, bits + (k == side)) for k in range(channels + 1 if channels < 8 else 2)]
        except (IndexError, ValueError):
            if not blocks or at + 2 * most < len(content):
                raise ValueError("bad FLAC frame") from None
            break
        if channels == 8:
            x[1] = x[0] - x[1]
        elif channels == 9:
            x[0] = x[0] + x[1]
        elif channels == 10:
            left = (2 * x[0] + (x[1] & 1) + x[1]) >> 1
            x = [left, left - x[1]]
        blocks.append(np.stack(x))
        at += -(-b.at // 8) + 2
    planes = np.concatenate(blocks, axis=1) if blocks else np.zeros((h["channels"], 0))
    return planes / float(1 << (h["bits"] - 1)), h["rate"], h["block"]


def checksum(data: bytes, polynomial: int, width: int) -> int:
    out = 0
    for byte in data:
        out ^= byte << (width - 8)
        for _ in range(8):
            out = (out << 1 ^ (polynomial if out >> (width - 1) else 0)) & (1 << width) - 1
    return out


def encode(planes: np.ndarray, rate: int, block: int = 4096, k: int = 6) -> bytes:
    """16-bit samples (integers, by channel) by second differences."""
    channels, total = planes.shape
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for number, begin in enumerate(range(0, total, block)):
        part = planes[:, begin : begin + block].astype(np.int64)
        size = part.shape[1]
        head = b"\xff\xf8" + bytes([7 << 4, channels - 1 << 4 | 4 << 1]) + chr(number).encode() + (size - 1).to_bytes(2, "big")
        head += bytes([checksum(head, 0x07, 8)])
        bits = []
        for x in part:
            order = 2 if size > 2 else 0
            bits.append(f"0{8 + order:06b}0" + "".join(f"{v & 0xFFFF:016b}" for v in x[:order].tolist()) + f"00{0:04b}{k:04b}")
            for r in np.diff(x, order).tolist():
                u = r << 1 if r >= 0 else (-r << 1) - 1
                bits.append("0" * (u >> k) + "1" + f"{u & (1 << k) - 1:0{k}b}")
        body = "".join(bits)
        body += "0" * (-len(body) % 8)
        frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
        out += frame + checksum(frame, 0x8005, 16).to_bytes(2, "big")
    return out
