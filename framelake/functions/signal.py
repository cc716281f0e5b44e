"""Kernels on numpy arrays: resampling, loudness, spectra, and scaling of images. All by published formulas."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOBES = 16
#: Samples that a step of a kernel holds at once.
STEP = 1 << 14


def sinc_resampled(planes: np.ndarray, rate: int, to: int, lobes: int = LOBES) -> np.ndarray:
    """(channels, ceil(n * to / rate)): each output is the sum of samples around its time, weighed by a sinc under a Hann window of so many lobes to each side. The cut-off is the lower of both rates' halves, so a lower rate doesn't fold; outside the input is silence."""
    n = planes.shape[1]
    count, cut = -(-n * to // rate), min(1.0, to / rate)
    half = lobes / cut
    reach = int(np.ceil(half))
    padded = np.pad(planes.astype(np.float64), ((0, 0), (reach, reach + 1)))
    out = np.zeros((planes.shape[0], count))
    around = np.arange(-reach + 1, reach + 1)
    step = max(1, STEP * 16 // (2 * reach))
    for begin in range(0, count, step):
        m = np.arange(begin, min(count, begin + step))
        whole, rest = m * rate // to, m * rate % to / to
        t = rest[:, None] - around
        weights = np.where(np.abs(t) < half, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / half)), 0.0)
        out[:, m] = np.einsum("mk,cmk->cm", weights, padded[:, (whole[:, None] + around + reach)])
    return out


@lru_cache(maxsize=32)
def k_response(rate: int, taps: int = 8192) -> np.ndarray:
    """The first taps of the impulse response of K-weighting (ITU-R BS.1770): a high shelf, then a high pass. The poles lie so far within the unit circle that what follows is below double precision at usual rates."""
    b1, a1, b2, a2 = k_coefficients(rate)
    out, (v1, v2, y1, y2) = np.zeros(taps), (0.0, 0.0, 0.0, 0.0)
    for n in range(taps):
        v = (b1[n] if n < 3 else 0.0) - a1[0] * v1 - a1[1] * v2
        out[n] = y = b2[0] * v + b2[1] * v1 + b2[2] * v2 - a2[0] * y1 - a2[1] * y2
        v2, v1, y2, y1 = v1, v, y1, y
    return out


def k_coefficients(rate: int) -> tuple[tuple[float, ...], ...]:
    """(b, a) of the shelf and (b, a) of the high pass at a rate, from the analogue prototypes whose values at 48 kHz the standard prints."""
    f, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, high = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    mid = high**0.4996667741545416
    d = 1 + k / q + k * k
    b1 = ((high + mid * k / q + k * k) / d, 2 * (k * k - high) / d, (high - mid * k / q + k * k) / d)
    a1 = (2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
    f, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f / rate)
    d = 1 + k / q + k * k
    return b1, a1, (1.0, -2.0, 1.0), (2 * (k * k - 1) / d, (1 - k / q + k * k) / d)


def k_weighted(planes: np.ndarray, rate: int) -> np.ndarray:
    """By overlapping blocks of the Fourier transform."""
    h, n = k_response(rate), planes.shape[1]
    size = 1 << 15
    step = size - len(h) + 1
    spectrum = np.fft.rfft(h, size)
    out = np.zeros((planes.shape[0], n + size))
    for at in range(0, n, step):
        part = planes[:, at : at + step]
        out[:, at : at + size] += np.fft.irfft(np.fft.rfft(part, size, axis=1) * spectrum, size, axis=1)
    return out[:, :n]


def channel_weights(channels: int) -> np.ndarray:
    """Of the default layouts: front channels 1, the low-frequency one 0, surround 1.41."""
    return np.array({5: [1, 1, 1, 1.41, 1.41], 6: [1, 1, 1, 0, 1.41, 1.41]}.get(channels, [1] * channels), float)


def block_energies(planes: np.ndarray, rate: int, seconds: float, hop: float, weighted: bool = True) -> np.ndarray:
    """Weighted sum over the channels of the mean square of overlapping blocks; incomplete ones are left out."""
    if weighted:
        planes = k_weighted(planes, rate)
    size, step = round(seconds * rate), round(hop * rate)
    squares = np.concatenate([np.zeros((planes.shape[0], 1)), np.cumsum(planes**2, axis=1)], axis=1)
    begins = np.arange(0, planes.shape[1] - size + 1, step)
    return channel_weights(planes.shape[0]) @ (squares[:, begins + size] - squares[:, begins]) / size


def level(energy: np.ndarray | float) -> np.ndarray | float:
    with np.errstate(divide="ignore"):
        return -0.691 + 10 * np.log10(energy)


def gated(energies: np.ndarray, relative: float) -> np.ndarray:
    """Energies above the absolute gate of -70, and above the mean of these by more than relative."""
    loud = energies[level(energies) > -70]
    return loud[level(loud) > level(loud.mean()) + relative] if len(loud) else loud


def loudness(planes: np.ndarray, rate: int) -> dict[str, float]:
    """integrated (LUFS), range (LU, EBU Tech 3342), true_peak (dBTP, four times oversampled) and threshold. Silence: -inf, 0."""
    blocks = block_energies(planes, rate, 0.4, 0.1)
    kept = gated(blocks, -10)
    loud = blocks[level(blocks) > -70]
    short = level(gated(block_energies(planes, rate, 3.0, 1.0), -20))
    spread = float(np.quantile(short, 0.95) - np.quantile(short, 0.1)) if len(short) else 0.0
    peak = max((float(np.abs(sinc_resampled(planes[:, a : a + STEP * 8], rate, 4 * rate)).max(initial=0)) for a in range(0, planes.shape[1], STEP * 8)), default=0.0)
    with np.errstate(divide="ignore"):
        top = float(20 * np.log10(peak))
    return {"integrated": float(level(kept.mean())) if len(kept) else float("-inf"), "range": spread, "true_peak": top, "threshold": float(level(loud.mean())) - 10 if len(loud) else float("-inf")}


def linear_gain(target: float, measured: float, true_peak: float, most_peak: float) -> float:
    """The factor to a target loudness, as far as the peak stays below its limit; 1 for silence."""
    if not np.isfinite(measured):
        return 1.0
    return float(min(10 ** ((target - measured) / 20), 10 ** ((most_peak - true_peak) / 20)))


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def mel_points(rate: int, mels: int) -> np.ndarray:
    """Edges of the filters in hertz: evenly on the Slaney scale, linear below 1 kHz and logarithmic above."""
    step = np.log(6.4) / 27
    top = rate / 2
    high = top * 3 / 200 if top < 1000 else 15 + np.log(top / 1000) / step
    m = np.linspace(0, high, mels + 2)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))


def mel_filters(rate: int, size: int, mels: int) -> np.ndarray:
    """(mels, size // 2 + 1): triangles of area 1 in hertz."""
    edges, bins = mel_points(rate, mels), np.arange(size // 2 + 1) * rate / size
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_spectrogram(samples: np.ndarray, rate: int, size: int = 2048, hop: int = 512, mels: int = 128) -> np.ndarray:
    """(mels, frames): power in mel bands of whole frames of size samples, a hop apart, under a Hann window."""
    count = max(0, (len(samples) - size) // hop + 1)
    filters, window = mel_filters(rate, size, mels), hann(size)
    out = np.zeros((mels, count))
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop] if count else np.zeros((0, size))
    for at in range(0, count, 1024):
        out[:, at : at + 1024] = filters @ (np.abs(np.fft.rfft(frames[at : at + 1024] * window, axis=1)) ** 2).T
    return out


def log_mel(power: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(power, 1e-10))


def area_means(x: np.ndarray, to: int, axis: int) -> np.ndarray:
    """Means over equal parts of an axis, which may begin and end within an element: sums of whole elements, and the shares of those at the ends."""
    size = x.shape[axis]
    if size == to:
        return x
    kind = np.uint32 if x.dtype == np.uint8 else np.float64
    if size % to == 0:
        parts = [x[(slice(None),) * axis + (slice(k, None, size // to),)] for k in range(size // to)]
        total = parts[0].astype(kind)
        for part in parts[1:]:
            total += part
        return total * (to / size)
    ends = np.arange(to + 1) * (size / to)
    whole = np.minimum(ends.astype(np.int64), size - 1)
    shape = [1] * x.ndim
    shape[axis] = to + 1
    rest = x.take(whole, axis) * (ends - whole).reshape(shape)
    sums = np.add.reduceat(x, whole[:-1], axis=axis, dtype=kind)
    last = np.moveaxis(sums, axis, 0)  # a view: where a part has no whole element, there is no sum; the last one ends before the last element
    last[whole[:-1] == whole[1:]] = 0
    if whole[-2] < size - 1:
        last[-1] -= x.take(size - 1, axis).astype(sums.dtype)
    return (sums + np.diff(rest, axis=axis)) * (to / size)


def scaled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Planes (channels, height, width) by area."""
    if image.shape[1:] == (height, width):
        return image
    out = area_means(area_means(image, height, 1), width, 2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)
