"""Audio: loudness, gain, channels and bounded appends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSOLUTE_GATE = -70.0  # LUFS, as published for programme loudness
RELATIVE_GATE = -10.0
OFFSET = -0.691


def block_loudness(energy: Column) -> Column:
    return F.lit(OFFSET) + 10 * F.log10(energy)


def gated_loudness(blocks: DataFrame, keys: list[str], energy: str = "energy") -> DataFrame:
    """Loudness of blocks of energy above both gates: an absolute one, and one relative to the mean of what passes the first. The gate is a row a key, so no key's blocks meet in one task."""
    loud = blocks.withColumn("_l", F.when(F.col(energy) > 0, block_loudness(F.col(energy)))).where(F.col("_l") > ABSOLUTE_GATE)
    gates = loud.groupBy(*keys).agg((block_loudness(F.avg(energy)) + RELATIVE_GATE).alias("_gate"))
    passed = loud.join(gates, keys).where(F.col("_l") > F.col("_gate"))
    return passed.groupBy(*keys).agg(block_loudness(F.avg(energy)).alias("loudness"), F.count("*").alias("n_blocks"))


def gain(measured: Column, target: Column, true_peak: Column, most_peak: Column) -> Column:
    """The factor to a target loudness, as far as the peak stays below its limit (dB)."""
    wanted = F.pow(F.lit(10.0), (target - measured) / 20)
    most = F.pow(F.lit(10.0), (most_peak - true_peak) / 20)
    return F.least(wanted, most)


def appended(parts: DataFrame, keys: list[str], order: list[str], samples: str, capacity: int) -> DataFrame:
    """Arrays appended in order up to a capacity of samples; the last one is cut."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("offset", F.coalesce(F.sum(F.size(samples)).over(before), F.lit(0)).cast("long"))
    room = F.greatest(F.lit(0), F.lit(capacity) - F.col("offset")).cast("int")
    return placed.where(F.col("offset") < capacity).withColumn(samples, F.slice(samples, F.lit(1), F.least(F.size(samples), room)))


def channels(samples: Column, n: int) -> Column:
    """Interleaved samples as an array of each channel's, within the row; an incomplete last group is cut."""
    count = F.floor(F.size(samples) / n).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda c: F.transform(places, lambda i: F.get(samples, i * n + c))
    return F.array(*[one(c) for c in range(n)])


def kernel_rows(rows: DataFrame, samples: str, kernel, schema: str) -> DataFrame:
    """Each row's array through a numpy kernel, which returns the other columns; Arrow batches, a row at a time."""
    key = next(c for c in rows.columns if c != samples)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kernel(np.array(x, np.float64)) for x in b.column(samples).to_pylist()]
            columns = [pa.array([f[k] if isinstance(f, tuple) else f for f in found]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], [key, *names])

    return rows.select(key, samples).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def concatenated(parts: DataFrame, keys: list[str], order: str, samples: str, capacity: int | None = None) -> DataFrame:
    """Each key's arrays as one, in order; up to a capacity of samples, where one is given, so that no array grows with the input."""
    if capacity is not None:
        parts = appended(parts, keys, [order], samples, capacity)
    listed = F.array_sort(F.collect_list(F.struct(order, samples)))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda x: x[samples])).alias(samples))


def hops(samples: Column, size: int, hop: int) -> Column:
    """Overlapping frames of size samples, a hop apart; the incomplete one at the end is left out."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(samples, k * hop + 1, F.lit(size))))
