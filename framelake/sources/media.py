"""Decoding of one asset in numpy, as a request asks: window, rate, size, element type and order of dimensions."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from framelake.functions import planning, signal
from framelake.sources import containers, flac, pixels, wav

#: What a file that can't be read may raise.
UNREADABLE = (ValueError, IndexError, KeyError, TypeError, ArithmeticError, AttributeError, MemoryError, struct.error, zlib.error)
#: Samples of each codec frame where the container doesn't tell, and of each row of audio.
CODEC_FRAME = 1024
AUDIO_ROW = 1 << 16
MATRICES = {"bt709": (0.2126, 0.0722), "bt601": (0.299, 0.114)}


def seconds_of(duration: float, start: float | None, end: float | None) -> float:
    """What a window covers of a stream; raises where it isn't valid."""
    if start is not None and end is not None and end <= start:
        raise ValueError("empty window")
    if start is not None and end is None and duration <= start:
        raise ValueError("start after end")
    if end is None:
        return duration - (start or 0.0)
    return min(duration, end - (start or 0.0))


def is_image(content: bytes) -> bool:
    return content[:8] == b"\x89PNG\r\n\x1a\n" or content[:2] in (b"BM", b"P5", b"P6")


def is_audio(content: bytes) -> bool:
    return content[:4] in (b"RIFF", b"fLaC")


def pictures(content: bytes) -> tuple[float, int, Iterator[np.ndarray]]:
    """(rate, number of frames, frames as 8-bit planes of red, green and blue) of the video stream."""
    if is_image(content):
        return 1.0, 1, iter([np.ascontiguousarray(pixels.decode(content).transpose(2, 0, 1))])
    if content[:9] == b"YUV4MPEG2":
        h = containers.y4m_header(content)
        weights = MATRICES["bt709" if h["height"] > 576 else "bt601"]
        full = h["full"]
        return float(h["fps"]), containers.y4m_count(content), (containers.to_rgb(*p, *weights, full) for p in containers.y4m_raw(content))
    if is_audio(content):
        raise ValueError("no video stream")
    raise ValueError("no decoder for this container")


def resampled(frames: Iterator[tuple[float, np.ndarray]], fps: float) -> Iterator[tuple[float, np.ndarray]]:
    """At a constant rate from the first frame on: at each time, the last frame so far."""
    first = held = None
    k = 0
    for at, x in frames:
        if first is None:
            first, held = at, x
        while first + k / fps < at - 1e-9:
            yield first + k / fps, held
            k += 1
        held = x
        last = at
    if first is not None and first + k / fps <= last + 1e-9:
        yield first + k / fps, held


def video(content: bytes, start: float | None, end: float | None, request: dict) -> Iterator[tuple[int, float, float, np.ndarray]]:
    """(frame, seconds, rate, array) of the frames that a request asks for: from start on, as many as the window has room for."""
    if request.get("index") not in (None, 0):
        raise ValueError("no such video stream")
    if request.get("device"):
        raise ValueError("no device to decode on")
    rate, count, frames = pictures(content)
    still = is_image(content)
    fps = float(request.get("fps") or rate)
    if not (fps > 0 and math.isfinite(fps)):
        raise ValueError("unknown frame rate")
    room = 1 if still else math.ceil((seconds_of(count / rate, start, end) - 0.5 / fps) * fps)
    timed = ((k / rate, x) for k, x in enumerate(frames) if still or start is None or k / rate >= start)
    if request.get("fps") and not still:
        timed = resampled(timed, fps)
    for k, (at, x) in enumerate(timed):
        if k >= room:
            return
        x = signal.scaled(x, request.get("height") or x.shape[1], request.get("width") or x.shape[2])
        if request.get("dtype") == "float32":
            x = x.astype(np.float32) / np.float32(255)
        yield k, at, fps, np.ascontiguousarray(x.transpose(1, 2, 0)) if request.get("dimension_order") == "NHWC" else x


def samples_of(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples by channel, rate, samples of a codec frame) of the audio stream."""
    if content[:4] == b"RIFF":
        return *wav.decode(content), CODEC_FRAME
    if content[:4] == b"fLaC":
        return flac.decode(content)
    if is_image(content) or content[:9] == b"YUV4MPEG2":
        raise ValueError("no audio stream")
    raise ValueError("no decoder for this container")


def audio(content: bytes, start: float | None, end: float | None, request: dict) -> tuple[int, np.ndarray]:
    """(rate, samples by channel as float32): whole codec frames from start on, as many samples as the window has room for."""
    if request.get("index") not in (None, 0):
        raise ValueError("no such audio stream")
    planes, rate, block = samples_of(content)
    seconds = seconds_of(planes.shape[1] / rate, start, end)
    if start is not None:
        planes = planes[:, max(0, -(-math.ceil(start * rate) // block) * block) :]
    if request.get("loudness"):
        planes = planes * gain_of(planes, rate, request["loudness"])
    to = request.get("sample_rate") or rate
    if to != rate:
        planes = signal.sinc_resampled(planes, rate, to)
    return to, planes[:, : max(0, math.ceil(seconds * to))].astype(np.float32)


def gain_of(planes: np.ndarray, rate: int, options: dict) -> float:
    """The linear mode of loudness normalisation: what isn't told as measured is measured here."""
    pick = lambda name, value: value if options.get(name) is None else options[name]
    known = [options.get("measured_I"), options.get("measured_TP")]
    own = signal.loudness(planes, rate) if None in known else {"integrated": 0.0, "true_peak": 0.0}
    measured = pick("measured_I", own["integrated"])
    if options.get("dual_mono") and planes.shape[0] == 1 and options.get("measured_I") is None:
        measured += 10 * math.log10(2)
    gain = signal.linear_gain(pick("I", -24.0), measured, pick("measured_TP", own["true_peak"]), pick("TP", -2.0))
    return gain * 10 ** (pick("offset", 0.0) / 20)


def first_of_each(requests: list[dict] | None) -> list[dict]:
    """Of several requests for one stream, the first wins."""
    seen: dict[int, dict] = {}
    for r in requests or []:
        seen.setdefault(r.get("index") or 0, r)
    return list(seen.values())


def rows_of(path: str, content: bytes | None, request: dict) -> Iterator[dict]:
    """The rows of one request: frames of the video stream, then blocks of each audio stream; a stream that can't be decoded is a row with its error."""
    window = request.get("start_time"), request.get("end_time")
    steps: list[tuple[str, Callable[[], Iterator[dict]]]] = []
    if request.get("video") is not None:
        steps.append(("video", lambda: video_rows(content or b"", window, request["video"])))
    for one in first_of_each(request.get("audio")):
        steps.append(("audio", lambda one=one: audio_rows(content or b"", window, one)))
    for kind, step in steps:
        try:
            for row in step():
                yield {"path": path, "stream_type": kind} | row
        except UNREADABLE as e:
            yield {"path": path, "stream_type": kind, "error": str(e) or type(e).__name__}


def video_rows(content: bytes, window: tuple, request: dict) -> Iterator[dict]:
    for k, at, fps, x in video(content, *window, request):
        yield {"stream_index": 0, "frame_index": k, "pts_seconds": at, "fps": fps, "shape": list(x.shape), "dtype": str(x.dtype), "data": x.tobytes()}


def audio_rows(content: bytes, window: tuple, request: dict) -> Iterator[dict]:
    rate, planes = audio(content, *window, request)
    for k, at in enumerate(range(0, max(1, planes.shape[1]), AUDIO_ROW)):
        part = np.ascontiguousarray(planes[:, at : at + AUDIO_ROW])
        yield {"stream_index": 0, "frame_index": k, "sample_rate": rate, "layout": layout(part.shape[0]), "shape": list(part.shape), "dtype": "float32", "data": part.tobytes()}


def layout(channels: int) -> str:
    """The default layout of a number of channels."""
    return planning.LAYOUTS[channels - 1] if 1 <= channels <= len(planning.LAYOUTS) else f"{channels} channels"
