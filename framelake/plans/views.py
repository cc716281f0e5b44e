"""Views of the driver's tables as frames, requests and tensors, on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.timeline import pts_seconds

KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, start: float | None = None) -> DataFrame:
    """events as frames: an asset for each user, a stream for each type of event. With start, a bound on ts, a second early, reaches the scan; the exact test on pts_seconds stays the caller's."""
    index = F.lit(None).cast("int")
    for k, kind in enumerate(KINDS):
        index = F.when(F.col("event_type") == kind, k).otherwise(index)
    pts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    events = table(spark, sf_dir, "events")
    if start is not None:
        events = events.where(F.expr(f"ts >= timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {start - 1:.6f})"))
    return events.select(
        "event_id", F.col("user_id").alias("asset_id"), index.cast("int").alias("stream_index"), F.when(F.col("event_type").isin("error", "signup"), "audio").otherwise("video").alias("stream_type"), pts.alias("pts"), pts_seconds(pts).alias("pts_seconds"), F.col("value").alias("payload")
    )


#: The same in SQL.
FRAMES = """
f AS (
  SELECT event_id, user_id AS asset_id,
    CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS stream_index,
    CASE WHEN event_type IN ('error', 'signup') THEN 'audio' ELSE 'video' END AS stream_type,
    epoch_us(ts) - 1704067200000000 AS pts,
    CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) * (CAST(1 AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS pts_seconds,
    value AS payload
  FROM events
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as requests: sizes, rates and tags from its integers; null where a remainder says so."""
    s, k = F.col("p_size"), F.col("p_partkey")
    when = lambda c, x: F.when(c, x)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (s * 40).cast("long").alias("width"),
        (s * 30).cast("long").alias("height"),
        when(k % 3 != 0, (k % 50 * 16 + 2).cast("long")).alias("to_width"),
        when(k % 4 != 0, (k % 40 * 12 + 2).cast("long")).alias("to_height"),
        when(k % 5 < 2, (k % 60 + 1).cast("double") / 2).alias("fps"),
        when(k % 7 < 3, (8000 * (k % 6 + 1)).cast("long")).alias("rate"),
        F.when(k % 6 == 0, "float32").otherwise("uint8").alias("dtype"),
        F.when(k % 9 == 0, "smpte2084").when(k % 9 == 1, "arib-std-b67").when(k % 9 == 2, "unknown").when(k % 9 < 6, "bt709").alias("trc"),
        F.when(k % 8 == 0, "bt2020").when(k % 8 == 1, "unspecified").when(k % 8 < 5, "bt709").alias("primaries"),
        F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(False)).alias("hardware"),
    )


PARTS = """
p AS (
  SELECT p_partkey, CAST(p_size * 40 AS BIGINT) AS width, CAST(p_size * 30 AS BIGINT) AS height,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 50 * 16 + 2 END AS to_width,
    CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 40 * 12 + 2 END AS to_height,
    CASE WHEN p_partkey % 5 < 2 THEN CAST(p_partkey % 60 + 1 AS DOUBLE) / 2 END AS fps,
    CASE WHEN p_partkey % 7 < 3 THEN 8000 * (p_partkey % 6 + 1) END AS rate,
    CASE WHEN p_partkey % 6 = 0 THEN 'float32' ELSE 'uint8' END AS dtype,
    CASE WHEN p_partkey % 9 = 0 THEN 'smpte2084' WHEN p_partkey % 9 = 1 THEN 'arib-std-b67' WHEN p_partkey % 9 = 2 THEN 'unknown' WHEN p_partkey % 9 < 6 THEN 'bt709' END AS trc,
    CASE WHEN p_partkey % 8 = 0 THEN 'bt2020' WHEN p_partkey % 8 = 1 THEN 'unspecified' WHEN p_partkey % 8 < 5 THEN 'bt709' END AS primaries,
    CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN false END AS hardware
  FROM part
)"""
HDR = "(coalesce(nullif(nullif(trc, 'unknown'), 'unspecified') IN ('smpte2084', 'arib-std-b67'), false) OR coalesce(primaries = 'bt2020', false))"
