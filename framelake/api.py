"""Requests and the two entry points: decode and probe. A batch of requests is a DataFrame; an asset that can't be read is a row with an error."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import KW_ONLY, asdict, dataclass, field, fields
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.functions import planning


class StreamType(Enum):
    Video = 0
    Audio = 1


@dataclass(frozen=True, kw_only=True)
class LoudnessNormalization:
    """What isn't set is left out of the options."""

    integrated_loudness_target: float | None = None
    loudness_range_target: float | None = None
    true_peak_level_target: float | None = None
    measured_integrated_loudness: float | None = None
    measured_loudness_range: float | None = None
    measured_true_peak_level: float | None = None
    measured_threshold: float | None = None
    offset_gain: float | None = None
    linear: bool | None = None
    dual_mono: bool | None = None

    def options(self) -> dict[str, float | bool | None]:
        """By the filter's names, in their fixed order."""
        return dict(zip(planning.LOUDNESS_OPTIONS, (getattr(self, f.name) for f in fields(self))))

    def spec(self) -> str:
        """Options that are set, in their fixed order."""
        text = lambda x: str(x).lower() if isinstance(x, bool) else f"{x:g}"
        return "loudnorm=" + ":".join(f"{k}={text(v)}" for k, v in self.options().items() if v is not None)


@dataclass(frozen=True, kw_only=True)
class VideoStreamRequest:
    index: int | None = None
    width: int | None = None
    height: int | None = None
    fps: float | None = None
    number_of_threads: int | None = None
    hardware_acceleration: bool | None = None
    dimension_order: str | None = None
    device: str | None = None
    dtype: str | None = None

    def __post_init__(self) -> None:
        if self.dtype not in (None, "uint8", "float32"):
            raise ValueError(f"unknown dtype {self.dtype!r}")
        if self.dimension_order not in (None, "NCHW", "NHWC"):
            raise ValueError(f"unknown dimension order {self.dimension_order!r}")
        if self.device is not None:
            kind, _, n = self.device.partition(":")
            if kind != "cuda" or ":" in self.device and not n.isdigit():
                raise ValueError(f"unknown device {self.device!r}")
            if self.hardware_acceleration is False:
                raise ValueError("device cannot be combined with hardware_acceleration=false")


@dataclass(frozen=True, kw_only=True)
class AudioStreamRequest:
    index: int | None = None
    sample_rate: int | None = None
    loudness_normalization: LoudnessNormalization | None = None


@dataclass(frozen=True)
class MediaDecodeRequest:
    input: str | bytes
    _: KW_ONLY
    start_time: float | None = None
    end_time: float | None = None
    video_stream: VideoStreamRequest | None = None
    audio_streams: list[AudioStreamRequest] | None = None


@dataclass(frozen=True, kw_only=True)
class S3Config:
    """Set fields win over the environment; secrets aren't shown."""

    endpoint_url: str | None = None
    region: str | None = None
    access_key_id: str | None = field(default=None, repr=False)
    secret_access_key: str | None = field(default=None, repr=False)
    session_token: str | None = field(default=None, repr=False)
    credentials: str | None = None
    force_path_style: bool | None = None

    def hadoop_options(self, bucket: str) -> dict[str, str]:
        """fs.s3a options of one bucket; raises where credentials contradict one another."""
        if bool(self.access_key_id) != bool(self.secret_access_key):
            raise ValueError("id and secret go together")
        if self.session_token and not self.access_key_id:
            raise ValueError("a token needs id and secret")
        if self.access_key_id and self.credentials:
            raise ValueError("static credentials or a mode")
        if self.credentials not in (None, "default", "container"):
            raise ValueError(f"unknown mode {self.credentials!r}")
        named = {"access.key": self.access_key_id, "secret.key": self.secret_access_key, "session.token": self.session_token, "endpoint.region": self.region, "endpoint": self.endpoint_url, "path.style.access": None if self.force_path_style is None else str(self.force_path_style).lower()}
        return {f"fs.s3a.bucket.{bucket}.{k}": v for k, v in named.items() if v is not None}


STREAMS = "path string, stream_index int, stream_type string, width int, height int, fps double, sample_rate int, channels int, duration_s double, nb_frames long, error string"
DECODED = "path string, request_id long, stream_index int, stream_type string, frame_index long, pts_seconds double, fps double, sample_rate int, layout string, shape array<int>, dtype string, data binary, error string"
VIDEO = "index int, width int, height int, fps double, dimension_order string, device string, dtype string"
LOUDNESS = ", ".join(f"{k}: {'boolean' if k in ('linear', 'dual_mono') else 'double'}" for k in planning.LOUDNESS_OPTIONS)
REQUESTS = f"path string, request_id long, start_time double, end_time double, video struct<{VIDEO.replace(' ', ': ').replace(',:', ',')}>, audio array<struct<index: int, sample_rate: int, loudness: struct<{LOUDNESS}>>>"
#: Bytes of decoded rows that a worker gathers before it sends them, and requests that are sent to all files: some hundred bytes each.
SENT_BYTES = 8 << 20
FEW = 10_000


def assets(spark: SparkSession, paths: str | list[str], most_bytes: int = planning.MAX_BYTES, s3_config: S3Config | None = None) -> DataFrame:
    """(path, length, content) of files; larger ones than most_bytes aren't opened (the bound reaches the scan). The built-in scan holds a file of 2 GB at most."""
    if s3_config:
        for path in [paths] if isinstance(paths, str) else paths:
            if path.startswith("s3"):
                for k, v in s3_config.hadoop_options(path.split("/")[2]).items():
                    spark.sparkContext._jsc.hadoopConfiguration().set(k, v)
    return spark.read.format("binaryFile").load(paths).where(F.col("length") <= most_bytes).select("path", "length", "content")


def fetched(uris: DataFrame, most_bytes: int = planning.MAX_BYTES, timeout: float = 30.0) -> DataFrame:
    """uris: (path). (path, length, content, error) of http and https addresses, read by the workers; other protocols, larger objects and failures are errors."""
    import urllib.request

    from framelake.sources.media import UNREADABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content, error = None, None
                try:
                    if not good:
                        raise ValueError("protocol not allowed")
                    with urllib.request.urlopen(path, timeout=timeout) as answer:
                        content = answer.read(most_bytes + 1)
                    if len(content) > most_bytes:
                        content, error = None, "too large"
                except (OSError, *UNREADABLE) as e:
                    error = str(e)
                length = None if content is None else len(content)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "length", "content", "error"])

    good = planning.allowed(F.col("path")) & planning.scheme(F.col("path")).isin("http", "https")
    return uris.select("path", good.alias("good")).mapInArrow(run, "path string, length long, content binary, error string")


def probe(files: DataFrame) -> DataFrame:
    """files: (path, content). The streams that each container's header tells of; nothing is decoded. A file that can't be read is a row with its error."""
    from framelake.sources.containers import streams_of
    from framelake.sources.media import UNREADABLE

    names = [x.split(" ")[0] for x in STREAMS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, content in zip(b.column(0), b.column(1)):
                try:
                    rows += [{"path": path.as_py()} | checked(s) for s in streams_of(content.as_py() or b"")]
                except UNREADABLE as e:
                    rows.append({"path": path.as_py(), "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    def checked(stream: dict) -> dict:
        for n, t in zip(names, types):
            pa.scalar(stream.get(n), t)  # a header may tell numbers that no column holds
        return stream

    return files.select("path", "content").mapInArrow(run, STREAMS)


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """probe() of the files of a folder, a pattern or a uri, of any size: headers alone are read."""
    from framelake.sources.streams import StreamsSource

    spark.dataSource.register(StreamsSource)
    return spark.read.format("media_streams").load(path)


def requests_of(spark: SparkSession, requests: list[MediaDecodeRequest]) -> DataFrame:
    """Requests as rows, in their order; each input is a path or the place of its bytes in the list. Up to FEW are marked to be sent to the files, whose contents then aren't moved."""
    rows = spark.createDataFrame([as_row(k, r) for k, r in enumerate(requests)], REQUESTS)
    return F.broadcast(rows) if len(requests) <= FEW else rows


def as_row(k: int, r: MediaDecodeRequest) -> tuple:
    video = None if r.video_stream is None else {n: v for n, v in asdict(r.video_stream).items() if n not in ("number_of_threads", "hardware_acceleration")}
    audio = [{"index": a.index, "sample_rate": a.sample_rate, "loudness": None if a.loudness_normalization is None else a.loudness_normalization.options()} for a in r.audio_streams or []]
    number = lambda x: None if x is None else float(x)
    if video and video["fps"] is not None:
        video["fps"] = float(video["fps"])
    for a in audio:
        a["loudness"] = a["loudness"] and {n: v if v is None or isinstance(v, bool) else float(v) for n, v in a["loudness"].items()}
    return (r.input if isinstance(r.input, str) else f"bytes:{k}", k, number(r.start_time), number(r.end_time), video, audio)


def decode(files: DataFrame, requests: DataFrame) -> DataFrame:
    """files: (path, content); requests: REQUESTS, any number for a path. Rows of DECODED: a row a frame of video, a row for each block of samples of audio, and a row with the error for a stream that can't be decoded.

    Requests are joined to files by path; where they are few, Spark sends them to the files, whose contents then aren't moved.
    """
    return answered(requests.select("path", "request_id", "start_time", "end_time", "video", "audio").join(files.select("path", "content"), "path"))


def answered(both: DataFrame) -> DataFrame:
    """both: REQUESTS with the content beside each."""
    from framelake.sources.media import rows_of

    names = [x.split(" ")[0] for x in DECODED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.binary(), pa.string()]

    def sent(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            size = 0
            for k in range(b.num_rows):
                request = {n: b.column(n)[k].as_py() for n in ("path", "content", "request_id", "start_time", "end_time", "video", "audio")}
                for row in rows_of(request["path"], request["content"], request):
                    held.append(row | {"request_id": request["request_id"]})
                    size += len(row.get("data") or b"")
                    if size > SENT_BYTES:
                        yield sent(held)
                        held, size = [], 0
            if held:
                yield sent(held)

    return both.mapInArrow(run, DECODED)


def decode_all(files: DataFrame, request: MediaDecodeRequest) -> DataFrame:
    """files: (path, content). DECODED rows of each file, by one request (whose input isn't read) for all."""
    _, k, start, end, video, audio = as_row(0, request)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(REQUESTS)}
    parsed = lambda name, x: F.lit(None) if x is None else F.from_json(F.lit(json.dumps(x)), kinds[name])
    fixed = {"request_id": F.lit(k), "start_time": F.lit(start), "end_time": F.lit(end), "video": parsed("video", video), "audio": parsed("audio", audio)}
    return answered(files.select("path", "content", *[c.cast(kinds[n]).alias(n) for n, c in fixed.items()]))


def tensors(decoded: DataFrame) -> DataFrame:
    """DECODED rows with values array<double> in the place of data, in the order of the array's dimensions."""
    kept = [c for c in decoded.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [None if d is None else np.frombuffer(d, t).astype(np.float64) for d, t in zip(b.column("data").to_pylist(), b.column("dtype").to_pylist())]
            yield b.select(kept).append_column("values", pa.array(values, pa.list_(pa.float64())))

    return decoded.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in decoded.dtypes if c != "data") + ", values array<double>")


def opened(spark: SparkSession, source: str | bytes, s3_config: S3Config | None) -> DataFrame:
    """(path, content) of one input under the name that its request has."""
    if isinstance(source, bytes):
        return spark.createDataFrame([("bytes:0", source)], "path string, content binary")
    status = spark.range(1).select(planning.uri_status(F.lit(source)).alias("status"), planning.route(F.lit(source)).alias("route"), planning.allowed(F.lit(source)).alias("allowed"), planning.scheme(F.lit(source)).alias("scheme")).first()
    if status.status != "ok" or status.route == "file" and not status.allowed:
        raise ValueError(f"can't open {source!r}: {status.status if status.status != 'ok' else 'protocol not allowed'}")
    if status.route == "file" and status.scheme in ("http", "https"):
        found = fetched(spark.createDataFrame([(source,)], "path string"))
        error = found.select("error").first().error
        if error:
            raise ValueError(error)
    else:
        found = assets(spark, "s3a" + source[2:] if status.route == "s3" else source, s3_config=s3_config)
    return found.select(F.lit(source).alias("path"), "content")


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def decode_asset(request: MediaDecodeRequest, *, s3_config: S3Config | None = None) -> list[dict]:
    """One asset's results as arrays on the driver: video first, then audio in the order of the requests. For many assets, use decode()."""
    spark = session()
    results: dict[tuple, list] = {}
    from pyspark.errors import PySparkException

    try:
        rows = decode(opened(spark, request.input, s3_config), requests_of(spark, [request])).collect()
    except PySparkException as e:
        raise ValueError(str(e)) from e
    for r in rows:
        if r.error:
            raise ValueError(r.error)
        results.setdefault((r.stream_type, r.stream_index), []).append(r)
    out = []
    for (kind, index), found in sorted(results.items(), key=lambda x: (x[0][0] != "video", x[0][1])):
        found.sort(key=lambda r: r.frame_index)
        arrays = [np.frombuffer(r.data, r.dtype).reshape(r["shape"]) for r in found]
        if kind == "video":
            out.append({"data": np.stack(arrays), "stream_type": StreamType.Video, "stream_index": index, "fps": found[0].fps, "pts": np.array([r.pts_seconds for r in found])})
        else:
            out.append({"data": np.concatenate(arrays, axis=1), "stream_type": StreamType.Audio, "stream_index": index, "sample_rate": found[0].sample_rate})
    return out


def probe_asset(input: str | bytes, *, s3_config: S3Config | None = None) -> dict:
    """The layout of one asset's streams. For many assets, use probe()."""
    from pyspark.errors import PySparkException

    try:
        rows = probe(opened(session(), input, s3_config)).collect()
    except PySparkException as e:
        raise ValueError(str(e)) from e
    if any(r.error for r in rows):
        raise ValueError(rows[0].error)
    of = lambda kind, names: [{"index": r.stream_index} | {n: r[n] for n in names} for r in rows if r.stream_type == kind]
    return {"video_streams": of("video", ("width", "height", "fps")), "audio_streams": of("audio", ("sample_rate",))}


def decode_audio(files: DataFrame, *, start_time: float | None = None, end_time: float | None = None, sample_rate: int | None = None, loudness_normalization: LoudnessNormalization | None = None) -> DataFrame:
    """files: (path, content). DECODED rows of the first audio stream of each file, by one request for all."""
    if start_time is not None and end_time is not None and end_time <= start_time:
        raise ValueError("empty window")
    request = AudioStreamRequest(sample_rate=sample_rate, loudness_normalization=loudness_normalization)
    return decode_all(files, MediaDecodeRequest("", start_time=start_time, end_time=end_time, audio_streams=[request]))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Still images as one frame each: RGB bytes, height, width. Files that can't be read are left out; the built-in source's bytes are blue first, which is turned here."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, n, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([0] * len(out), pa.int64()), pa.array([1.0] * len(out), pa.float64()), pa.array(out, pa.binary())], ["path", "height", "width", "frame_index", "fps", "data"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, height int, width int, frame_index long, fps double, data binary")
