"""WAV and PCM: encoding, decoding in memory, and a data source with a time window that is pushed down to the reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FRAME = 1024  # samples of each channel in a row


def encode(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """16-bit PCM of interleaved samples of -1 to 1."""
    data = np.floor(np.abs(samples) * 32767 + 0.5) * np.sign(samples)
    body = np.clip(data, -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


def header(content: bytes) -> dict:
    """kind (1 PCM, 3 float), channels, rate, bits, and where samples begin and end."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            if at + 24 > len(content):
                raise ValueError("cut format")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE and size >= 40 and at + 34 <= len(content):
                kind = struct.unpack_from("<H", content, at + 32)[0]
            found |= {"kind": kind, "channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            found |= {"begin": at + 8, "end": min(len(content), at + 8 + size)}
            break
        at += 8 + size + size % 2
    if "kind" not in found or "begin" not in found:
        raise ValueError("no format or no data")
    if found["kind"] not in (1, 3) or found["bits"] not in (8, 16, 24, 32, 64) or not found["channels"] or not found["rate"] or found["kind"] == 3 and found["bits"] < 32:
        raise ValueError("WAV form is not supported")
    return found


def samples_of(raw: bytes, kind: int, bits: int) -> np.ndarray:
    """As doubles of -1 to 1."""
    if kind == 3:
        return np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    return np.frombuffer(raw, f"<i{bits // 8}").astype(np.float64) / float(2 ** (bits - 1))


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(samples by channel, rate)."""
    h = header(content)
    raw = content[h["begin"] : h["end"]]
    raw = raw[: len(raw) // (h["bits"] // 8 * h["channels"]) * (h["bits"] // 8 * h["channels"])]
    return samples_of(raw, h["kind"], h["bits"]).reshape(-1, h["channels"]).T, h["rate"]


def encode_rows(assets: DataFrame, rate: int) -> DataFrame:
    """assets: (asset_id, samples). (asset_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(np.array(x, np.float64), rate) for x in b.column(1).to_pylist()], pa.binary())], ["asset_id", "content"])

    return assets.select("asset_id", "samples").mapInArrow(run, "asset_id long, content binary")


def decode_rows(assets: DataFrame) -> DataFrame:
    """assets: (asset_id, content). A row for each channel, or one with the error where content can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for asset, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    planes, rate = decode(content)
                    rows += [(asset, c, rate, plane, None) for c, plane in enumerate(planes)]
                except (ValueError, TypeError) as e:
                    rows.append((asset, None, None, None, str(e)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["asset_id", "channel", "sample_rate", "samples", "error"])

    return assets.select("asset_id", "content").mapInArrow(run, "asset_id long, channel int, sample_rate int, samples array<double>, error string")


class WavPart(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class WavReader(DataSourceReader):
    """Rows of FRAME samples a channel. Bounds on pts_seconds become byte ranges, so that what is outside isn't read; splits are ranges of bytes, and frame_index counts from the file's beginning.

    The driver lists files and their sizes alone; headers are read where the frames are. A file that can't be read is a row with its error.
    """

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split = path, split_bytes
        self.low, self.high = 0.0, float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)) and f.attribute == ("pts_seconds",):
                self.low = max(self.low, float(f.value))
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("pts_seconds",):
                self.high = min(self.high, float(f.value))
            yield f  # a bound here is a range of frames; the exact test stays above

    def partitions(self) -> list[InputPartition]:
        return [WavPart(path, a, a + self.split) for path, size in listed(self.path) for a in range(0, max(1, size), self.split)]

    def frames(self, h: dict, partition: WavPart) -> range:
        """The frames that begin within the partition's bytes and may lie in the window."""
        width = FRAME * (h["bits"] // 8 * h["channels"])
        total = -(-(h["end"] - h["begin"]) // width)
        first, last = (max(0, -(-(b - h["begin"]) // width)) for b in (partition.begin, partition.end))
        low = max(0, int(self.low * h["rate"] / FRAME) - 1)
        high = total if self.high == float("inf") else int(max(0.0, self.high) * h["rate"] / FRAME) + 2
        return range(max(first, low), min(last, high, total))

    def read(self, partition: WavPart) -> Iterator[pa.RecordBatch]:
        try:
            with opened(partition.path) as f:
                h = header_of(f)
                width = h["bits"] // 8 * h["channels"]
                wanted = self.frames(h, partition)
                for k in range(wanted.start, wanted.stop, 64):
                    yield self.batch(f, h, width, range(k, min(k + 64, wanted.stop)), partition.path)
        except (ValueError, OSError, struct.error) as e:
            if partition.begin == 0:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([partition.path, *[None] * 7, str(e)], ROWS)], schema=ROWS)

    def batch(self, f, h: dict, width: int, frames: range, path: str) -> pa.RecordBatch:
        f.seek(h["begin"] + frames.start * FRAME * width)
        raw = f.read(min(len(frames) * FRAME * width, h["end"] - h["begin"] - frames.start * FRAME * width))
        planes = samples_of(raw[: len(raw) // width * width], h["kind"], h["bits"]).reshape(-1, h["channels"]).astype(np.float32)
        parts = [(k, c, planes[i * FRAME : (i + 1) * FRAME, c]) for i, k in enumerate(frames) for c in range(h["channels"])]
        n = len(parts)
        starts = [k * FRAME for k, _, _ in parts]
        columns = [[path] * n, [k for k, _, _ in parts], starts, [x / h["rate"] for x in starts], [c for _, c, _ in parts], [len(x) for _, _, x in parts], [h["rate"]] * n, [x for _, _, x in parts], [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, ROWS)], schema=ROWS)


ROWS = pa.schema([("path", pa.string()), ("frame_index", pa.int64()), ("pts", pa.int64()), ("pts_seconds", pa.float64()), ("channel", pa.int32()), ("nb_samples", pa.int32()), ("sample_rate", pa.int32()), ("fdata", pa.list_(pa.float32())), ("error", pa.string())])


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a pattern of a local path, a folder or a uri of a store names."""
    import glob
    import os

    import pyarrow.fs as pafs

    if "://" not in path:
        found = sorted(glob.glob(path)) or [path]
        found = [f"{p}/{n}" for p in found if os.path.isdir(p) for n in sorted(os.listdir(p))] + [p for p in found if not os.path.isdir(p)]
        return [(p, os.path.getsize(p) if os.path.exists(p) else 0) for p in found]
    fs, inner = pafs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(inner)]
    info = fs.get_file_info(inner)
    files = fs.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else [info]
    return [(prefix + x.path, x.size or 0) for x in sorted(files, key=lambda x: x.path) if x.type != pafs.FileType.Directory]


def opened(path: str):
    if "://" not in path:
        return open(path, "rb")
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def header_of(f) -> dict:
    """header() of an open file, of which the first part is read: sizes are those that the header tells, cut at the file's end."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    head = f.read(1 << 16)
    if head[:4] == b"RIFF" and b"data" not in head:
        raise ValueError("no data chunk near the beginning")
    h = header(head)
    told = struct.unpack_from("<I", head, h["begin"] - 4)[0]
    return h | {"end": min(size, h["begin"] + told)}


class WavSource(DataSource):
    """spark.dataSource.register(WavSource); spark.read.format('wav_frames').load(path). Option split: bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return "path string, frame_index long, pts long, pts_seconds double, channel int, nb_samples int, sample_rate int, fdata array<float>, error string"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("split", 8 << 20)))
