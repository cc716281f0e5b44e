"""Frames that arrive as files: an extension, beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_rates(frames: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Frames and mean payload of each stream and window; frames later than late are dropped, and a window's state with them."""
    return frames.withWatermark(at, late).groupBy(F.window(at, width), "asset_id", "stream_index").agg(F.count("*").alias("n_frames"), F.avg("payload").alias("mean_payload"))


def sessions(frames: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of frames of a stream without a longer gap."""
    return frames.withWatermark(at, late).groupBy(F.session_window(at, gap), "asset_id", "stream_index").agg(F.count("*").alias("n_frames"))
