"""Frames on a time line: windows, limits, resampling, offsets and checks. Frames: (asset_id, stream_index, pts, event_id, ...), ordered by pts and event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ("asset_id", "stream_index")


def in_order() -> Window:
    return Window.partitionBy(*STREAM).orderBy("pts", "event_id")


def pts_seconds(pts: Column, num: int = 1, den: int = 1_000_000) -> Column:
    return pts.cast("double") * (F.lit(float(num)) / F.lit(float(den)))


def numbered(frames: DataFrame, name: str = "frame_index") -> DataFrame:
    """frame_index from 0 in presentation order."""
    return frames.withColumn(name, F.row_number().over(in_order()) - 1)


def capped(frames: DataFrame, start: Column | None, capacity: Column) -> DataFrame:
    """Frames from start on, at most capacity of each stream: the end is a count and not a time."""
    kept = frames if start is None else frames.where(F.col("pts_seconds") >= start)
    return numbered(kept).where(F.col("frame_index") + 1 <= capacity)


def half_open(frames: DataFrame, start: Column, end: Column) -> DataFrame:
    """start <= pts < end; a null bound doesn't bind."""
    t = F.col("pts_seconds")
    return frames.where((start.isNull() | (t >= start)) & (end.isNull() | (t < end)))


def until_passed(packets: DataFrame, end: Column) -> DataFrame:
    """Packets up to and with the first one after end, in the order in which they come. The one that follows is found by an aggregation with partial results, so no stream meets in one window."""
    later = F.col("pts_seconds") > end
    first = packets.where(later).groupBy(*STREAM).agg(F.min_by(F.struct(*packets.columns), F.struct("pts", "event_id")).alias("_first")).select("_first.*")
    return packets.where(~later).unionByName(first)


#: Steps of a grid that a row is exploded to at once.
GRID_BLOCK = 1 << 16


def grid_of(frames: DataFrame, step: int) -> DataFrame:
    """(asset_id, stream_index, low, k): the places of a grid from each stream's first pts to its last one, exploded in blocks."""
    ends = frames.groupBy(*STREAM).agg(F.min("pts").alias("low"), F.max("pts").alias("high"))
    many = F.floor((F.col("high") - F.col("low")) / step)
    blocks = ends.withColumn("many", many).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("many") / GRID_BLOCK))))
    last = F.least(F.col("many"), (F.col("block") + 1) * GRID_BLOCK - 1)
    return blocks.withColumn("k", F.explode(F.sequence(F.col("block") * GRID_BLOCK, last))).select(*STREAM, "low", "k")


def on_grid(frames: DataFrame, step: int) -> DataFrame:
    """Frames at a constant step (in units of pts): at each time, the last frame so far."""
    grid = grid_of(frames, step).select(*STREAM, (F.col("low") + F.col("k") * step).alias("pts"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("grid"), F.col("k").alias("grid_index"))
    both = frames.select(*STREAM, "pts", "event_id", F.lit(0).alias("grid"), F.lit(None).cast("long").alias("grid_index")).unionByName(grid)
    so_far = Window.partitionBy(*STREAM).orderBy("pts", "grid", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("source_id", F.last("event_id", ignorenulls=True).over(so_far)).where("grid = 1").select(*STREAM, "grid_index", "pts", "source_id")


def interpolated(frames: DataFrame, step: int, value: str = "payload") -> DataFrame:
    """Samples at a constant step, on the line between the last one so far and the next one."""
    grid = grid_of(frames, step).select(*STREAM, (F.col("low") + F.col("k") * step).alias("pts"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("grid"), F.col("k").alias("grid_index"), F.lit(None).cast("long").alias("event_id"))
    own = frames.select(*STREAM, "pts", F.col(value).cast("double").alias("v"), F.lit(0).alias("grid"), F.lit(None).cast("long").alias("grid_index"), "event_id")
    both = own.unionByName(grid).withColumn("at", F.when(F.col("grid") == 0, F.col("pts")))
    order = Window.partitionBy(*STREAM).orderBy("pts", "grid", "event_id")
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    for name, pick, over in (("0", F.last, so_far), ("1", F.first, from_here)):
        both = both.withColumn("v" + name, pick("v", ignorenulls=True).over(over)).withColumn("p" + name, pick("at", ignorenulls=True).over(over))
    share = (F.col("pts") - F.col("p0")).cast("double") / (F.col("p1") - F.col("p0")).cast("double")
    line = F.when(F.col("p1").isNull() | (F.col("p1") == F.col("p0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * share)
    return both.where("grid = 1").select(*STREAM, "grid_index", "pts", line.alias("sample"))


def spacing(frames: DataFrame) -> DataFrame:
    """Of each stream: whether pts strictly increase, and the first and least distance."""
    step = F.col("pts") - F.lag("pts").over(in_order())
    each = frames.withColumn("step", step).withColumn("n", F.row_number().over(in_order()))
    return each.groupBy(*STREAM).agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("increasing"), F.max(F.when(F.col("n") == 2, F.col("step"))).alias("first_step"), F.min("step").alias("least_step"), F.count("*").alias("n_frames"))


def start_offset(frames: DataFrame) -> DataFrame:
    """Of each asset, by how much its first audio comes after its first video."""
    first = lambda kind: F.min(F.when(F.col("stream_type") == kind, F.col("pts")))
    return frames.groupBy("asset_id").agg(first("video").alias("video_first"), first("audio").alias("audio_first")).withColumn("av_offset", F.col("audio_first") - F.col("video_first"))


def retimed(frames: DataFrame) -> DataFrame:
    """A variable rate: 75 frames at 30 a second, then 15 a second."""
    n = F.col("frame_index")
    return numbered(frames).withColumn("retimed", F.when(n < 75, n / F.lit(30.0)).otherwise(F.lit(2.5) + (n - 75) / F.lit(15.0)))


def offsets(frames: DataFrame, size: Column) -> DataFrame:
    """Where each frame's samples begin in its stream."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("n_samples", size).withColumn("offset", F.coalesce(F.sum("n_samples").over(before), F.lit(0)).cast("long"))
