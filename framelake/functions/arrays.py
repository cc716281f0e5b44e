"""Layout, element types and colours of arrays, as Column expressions. Arrays are row-major; an image is height, width, channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.columns import clamp

#: Bits of a PCM sample by format; a trailing p (planar) changes the order of samples alone.
PCM_BITS = {"u8": 8, "s16": 16, "s32": 32, "s64": 64}
#: Weights of red and blue in luma by the name of a matrix (published: BT.709, BT.601, SMPTE 240M, BT.2020).
LUMA = {"bt709": (0.2126, 0.0722), "smpte170m": (0.299, 0.114), "bt470bg": (0.299, 0.114), "smpte240m": (0.212, 0.087), "bt2020nc": (0.2627, 0.0593)}


def as_double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def rearranged(a: Column, n: int, source) -> Column:
    """n elements, the i-th from place source(i) of a."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, source(i).cast("int")))


def hwc_to_chw(a: Column, height: int, width: int, channels: int = 3) -> Column:
    plane = height * width
    return rearranged(a, plane * channels, lambda i: (i % plane) * channels + F.floor(i / plane))


def chw_to_hwc(a: Column, height: int, width: int, channels: int = 3) -> Column:
    plane = height * width
    return rearranged(a, plane * channels, lambda i: (i % channels) * plane + F.floor(i / channels))


def gbr_to_rgb(a: Column, plane: int) -> Column:
    """Planes green, blue, red to red, green, blue."""
    return F.concat(F.slice(a, 2 * plane + 1, plane), F.slice(a, 1, plane), F.slice(a, plane + 1, plane))


def unpadded(a: Column, rows: int, stride: int, used: int) -> Column:
    """Rows of stride elements, of which the first used are pixels."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(a, r * stride + 1, used)))


def padded(a: Column, rows: int, used: int, stride: int) -> Column:
    """The inverse of unpadded: zeros after each row."""
    pad = F.array_repeat(F.lit(0.0), stride - used)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.concat(F.slice(a, r * used + 1, used), pad)))


def area_scaled(a: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """One plane by area: each output pixel is the mean of the source pixels below it, by the area on which they meet."""
    down, across = height / to_height, width / to_width

    def share(place: Column, scale: float, source: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least((place + 1) * scale, source + 1) - F.greatest(place * scale, source)) / scale

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / to_width).cast("double"), (i % to_width).cast("double")
        parts = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda j: F.get(a, j) * share(y, down, F.floor(j / width).cast("double")) * share(x, across, (j % width).cast("double")))
        return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)

    return F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), pixel)


def to_bytes(a: Column) -> Column:
    """Values of -1 to 1 as 0 to 255."""
    return F.transform(a, lambda x: F.floor(clamp((x.cast("double") + 1) * 127.5, 0.0, 255.0)).cast("int"))


def bytes_to_unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.lit(255.0))


def pcm_to_float(sample: Column, kind: Column) -> Column:
    """An integer sample as -1 to 1; float formats stay."""
    out = F.when(kind.isin("flt", "fltp", "dbl", "dblp"), sample.cast("double"))
    for name, bits in PCM_BITS.items():
        value = sample.cast("double") - 128 if name == "u8" else sample.cast("double")
        out = out.when(kind.isin(name, name + "p"), value / float(2 ** (bits - 1)))
    return out


def sample_bytes(kind: Column) -> Column:
    out = F.when(kind.isin("flt", "fltp"), 4).when(kind.isin("dbl", "dblp"), 8)
    for name, bits in PCM_BITS.items():
        out = out.when(kind.isin(name, name + "p"), bits // 8)
    return out.cast("int")


def yuv_to_rgb(y: Column, u: Column, v: Column, red: Column, blue: Column, full: Column) -> tuple[Column, Column, Column]:
    """8-bit samples and a matrix's weights of red and blue; full: whether luma spans 0 to 255, else 16 to 235."""
    luma = F.when(full, y.cast("double")).otherwise((y - 16) * F.lit(255.0) / F.lit(219.0))
    scale = F.when(full, F.lit(1.0)).otherwise(F.lit(255.0) / F.lit(224.0))
    cb, cr = (u - 128) * scale, (v - 128) * scale
    r = luma + (1 - red) * 2 * cr
    b = luma + (1 - blue) * 2 * cb
    g = (luma - red * r - blue * b) / (1 - red - blue)
    return tuple(clamp(F.floor(x + 0.5).cast("double"), 0.0, 255.0).cast("int") for x in (r, g, b))


def hable(x: Column) -> Column:
    """Hable's filmic curve (published constants)."""
    a, b, c, d, e, f = 0.15, 0.50, 0.10, 0.20, 0.02, 0.30
    return (x * (x * a + c * b) + d * e) / (x * (x * a + b) + d * f) - e / f


def tone_mapped(signal: Column, peak: float = 10.0) -> Column:
    """Linear light of a peak to 0 to 1."""
    return hable(signal) / hable(F.lit(peak))


def pq_to_linear(v: Column) -> Column:
    """SMPTE ST 2084, of 10,000 cd/m2 at 1."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(v, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1))


def hlg_to_linear(v: Column) -> Column:
    """ARIB STD-B67, scene light."""
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - c) / a) + b) / 12)


#: Linear light of BT.2020 primaries to BT.709 (ITU-R BT.2087).
TO_709 = ((1.6605, -0.5876, -0.0728), (-0.1246, 1.1329, -0.0083), (-0.0182, -0.1006, 1.1187))


def to_709(light: Column) -> Column:
    """The transfer curve of BT.709."""
    return F.when(light < 0.018, light * 4.5).otherwise(1.099 * F.pow(light, F.lit(0.45)) - 0.099)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= F.lit(atol) + F.lit(rtol) * F.abs(y.cast("double")))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)
