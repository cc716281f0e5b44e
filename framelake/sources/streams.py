"""A data source of streams: the layout of each file of a folder, by its headers alone. Files may have any size; what is read is their beginning, and of MP4 the box that tells of the tracks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelake.sources import containers, wav
from framelake.sources.media import UNREADABLE

HEAD = 1 << 16
#: Bytes of a box that is read whole, and files of a partition.
MOST_BOX = 64 << 20
FILES = 64
SCHEMA = "path string, stream_index int, stream_type string, width int, height int, fps double, sample_rate int, channels int, duration_s double, nb_frames long, error string"
ROWS = pa.schema([("path", pa.string()), ("stream_index", pa.int32()), ("stream_type", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("fps", pa.float64()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("duration_s", pa.float64()), ("nb_frames", pa.int64()), ("error", pa.string())])


def streams_of_file(f, size: int) -> list[dict]:
    """As containers.streams_of, of an open file."""
    head = f.read(HEAD)
    if head[:4] == b"RIFF":
        h = wav.header_of(f)
        return [containers.audio(0, h["rate"], h["channels"], (h["end"] - h["begin"]) // (h["bits"] // 8 * h["channels"]))]
    if head[:9] == b"YUV4MPEG2":
        h = containers.y4m_header(head)
        ch, cw = containers.y4m_layout(h)
        line = head.find(b"\n", h["begin"]) + 1 - h["begin"]  # every frame's line is taken to be as long as the first one's
        n = (size - h["begin"]) // (line + h["height"] * h["width"] + 2 * ch * cw) if line > 0 and head.startswith(b"FRAME", h["begin"]) else 0
        return [containers.clip(h, n)]
    if head[4:8] == b"ftyp":
        at = 0
        while at + 8 <= size:
            f.seek(at)
            lead = f.read(16)
            long, name = struct.unpack_from(">I4s", lead)
            if long == 1 and len(lead) == 16:
                long = struct.unpack_from(">Q", lead, 8)[0]
            end = size if long == 0 else at + max(8, long)
            if name == b"moov":
                if end - at > MOST_BOX:
                    raise ValueError("moov box too large")
                f.seek(at)
                return containers.mp4_streams(f.read(end - at))
            at = end
        raise ValueError("no moov box")
    return containers.streams_of(head)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class StreamsReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        found = wav.listed(self.path)
        return [Files(found[k : k + self.files]) for k in range(0, len(found), self.files)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path, size in partition.files:
            try:
                with wav.opened(path) as f:
                    own = [{"path": path} | s for s in streams_of_file(f, size)]
                for s in own:
                    for name, kind in zip(ROWS.names, ROWS.types):
                        pa.scalar(s.get(name), kind)  # a header may tell numbers that no column holds
                rows += own
            except (OSError, *UNREADABLE) as e:
                rows.append({"path": path, "error": str(e) or type(e).__name__})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(ROWS.names, ROWS.types)], schema=ROWS)


class StreamsSource(DataSource):
    """spark.dataSource.register(StreamsSource); spark.read.format('media_streams').load(path). Option files: how many a partition."""

    @classmethod
    def name(cls) -> str:
        return "media_streams"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StreamsReader:
        return StreamsReader(self.options["path"], int(self.options.get("files", FILES)))
