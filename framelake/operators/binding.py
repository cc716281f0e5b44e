"""Binding requests to streams: probing, choosing, deduplicating and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe(frames: DataFrame) -> DataFrame:
    """A row for each stream: number of frames, first and last pts, and its rate by counting (0 where it can't be told)."""
    seconds = (F.col("last_pts") - F.col("first_pts")).cast("double") * (F.lit(1.0) / F.lit(1000000.0))
    found = frames.groupBy("asset_id", "stream_index", "stream_type").agg(F.count("*").alias("n_frames"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))
    return found.withColumn("fps", F.when(F.col("last_pts") > F.col("first_pts"), (F.col("n_frames") - 1) / seconds).otherwise(0.0))


def nested(streams: DataFrame) -> DataFrame:
    """A row for each asset with its video and audio streams as arrays, in container order."""
    fields = F.struct("stream_index", "n_frames", "fps")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("stream_type") == kind, fields)))
    return streams.groupBy("asset_id").agg(of("video").alias("video_streams"), of("audio").alias("audio_streams"))


def best(streams: DataFrame, merit: Column) -> DataFrame:
    """Of each asset and kind, the stream of most merit; the first one among equals."""
    order = Window.partitionBy("asset_id", "stream_type").orderBy(merit.desc(), "stream_index")
    return streams.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def first_requests(requests: DataFrame) -> DataFrame:
    """Each index of an asset once: the request at the first position wins, and later options are dropped."""
    order = Window.partitionBy("asset_id", "index").orderBy("position")
    return requests.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pruned(packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packets of wanted (asset_id, stream_index) alone."""
    return packets.join(wanted, ["asset_id", "stream_index"], "left_semi")


def collapsed(frames: DataFrame, capacity: int | None = None) -> DataFrame:
    """A row for each stream with its pts in order: the shape of a decode result. Only pts are gathered, never payloads; of the first capacity frames, where one is given."""
    if capacity is not None:
        first = Window.partitionBy("asset_id", "stream_index").orderBy("pts", "event_id")
        frames = frames.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= capacity).drop("_n")
    listed = F.array_sort(F.collect_list(F.struct("pts", "event_id", "pts_seconds")))
    return frames.groupBy("asset_id", "stream_index", "stream_type").agg(listed.alias("rows")).withColumn("pts_list", F.col("rows.pts_seconds")).withColumn("n_frames", F.size("rows").cast("long")).drop("rows")
