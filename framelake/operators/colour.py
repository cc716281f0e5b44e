"""Colours of pixels as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import arrays as A
from framelake.functions.columns import clamp


def hdr_to_sdr(pixels: DataFrame, hlg: Column, channels: tuple[str, str, str] = ("r", "g", "b"), white: float = 100.0, peak: float = 10.0) -> DataFrame:
    """Signals of 0 to 1 (PQ, or HLG) with BT.2020 primaries, as signals of BT.709: linear light of which white is 1, the curve on the largest component, the other primaries, and the other transfer.

    Each step is a projection of its own, so that what several colours need is computed once.
    """
    light = {c: F.when(hlg, A.hlg_to_linear(F.col(c)) * (1000.0 / white)).otherwise(A.pq_to_linear(F.col(c)) * (10000.0 / white)) for c in channels}
    lit = pixels.withColumns({f"_{c}": x for c, x in light.items()}).withColumn("_top", F.greatest(*(F.col(f"_{c}") for c in channels), F.lit(1e-6)))
    gained = lit.withColumn("_gain", A.tone_mapped(F.col("_top"), peak) / F.col("_top"))
    mixed = [sum((F.col(f"_{c}") * w for c, w in zip(channels, row)), F.lit(0.0)) * F.col("_gain") for row in A.TO_709]
    moved = gained.withColumns({f"_{c}_709": F.greatest(F.lit(0.0), x) for c, x in zip(channels, mixed)})
    out = moved.withColumns({c: clamp(A.to_709(F.col(f"_{c}_709")), 0.0, 1.0) for c in channels})
    return out.select(*pixels.columns)
