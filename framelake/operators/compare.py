"""Comparison of results, coverage of ranges, and timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Elementwise, up to the shorter length: mean and largest absolute difference, and the share of those above 2 (of 255). Within each row, so nothing is moved."""
    each = F.filter(F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x - y).cast("double")), lambda d: d.isNotNull())
    total = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d)
    above = F.aggregate("_d", F.lit(0.0), lambda s, d: s + F.when(d > 2, 1.0).otherwise(0.0))
    found = pairs.select(*keys, each.alias("_d")).withColumn("_n", F.size("_d"))
    share = lambda x: F.when(F.col("_n") > 0, x / F.col("_n"))
    return found.select(*keys, share(total).alias("mean_diff"), F.array_max("_d").alias("max_diff"), (100.0 * share(above)).alias("percent_above_2"))


def deep_share(samples: Column) -> Column:
    """Whether a unit sample has more than 8 bits: it isn't a multiple of 257 among 65535."""
    return (F.round(samples * 65535) % 257 != 0).cast("double")


def first_hole(ranges: DataFrame, key: str) -> DataFrame:
    """Of each key's byte ranges [begin, end): bytes covered, and where the first hole begins (the end, if there is none) counting from the first range."""
    order = Window.partitionBy(key).orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = ranges.withColumn("_reached", reached)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("_reached", "begin")))
    hole = F.min(F.when(F.col("begin") > F.col("_reached"), F.col("_reached")))
    return each.groupBy(key).agg(F.sum(new).cast("long").alias("covered"), F.coalesce(hole, F.max("end")).cast("long").alias("first_hole"))


def timing(runs: DataFrame, key: str, seconds: str) -> DataFrame:
    return runs.groupBy(key).agg(F.percentile(seconds, F.lit(0.5)).alias("median_s"), F.min(seconds).alias("min_s"), F.count("*").alias("n_runs"))


def regressions(runs: DataFrame, key: str, side: Column, seconds: str, limit: float = 1.25) -> DataFrame:
    """Scenarios that both sides ('base' and 'head') have run: how many times as long the head's fastest run took. One pass over the runs."""
    fastest = lambda name: F.min(F.when(side == name, F.col(seconds)))
    both = runs.groupBy(key).agg(fastest("base").alias("base_s"), fastest("head").alias("head_s")).where("base_s IS NOT NULL AND head_s IS NOT NULL")
    return both.withColumn("ratio", F.col("head_s") / F.col("base_s")).withColumn("slower", F.col("ratio") > limit)


def throughput(jobs: DataFrame, key: str, begin: str, end: str, frames: str) -> DataFrame:
    """Frames a second of jobs side by side: all frames over the time from the first begin to the last end."""
    wall = F.max(end) - F.min(begin)
    return jobs.groupBy(key).agg(F.count("*").alias("n_jobs"), F.sum(frames).alias("n_frames"), wall.cast("double").alias("wall_s")).withColumn("frames_a_second", F.when(F.col("wall_s") > 0, F.col("n_frames") / F.col("wall_s")))
