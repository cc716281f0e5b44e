"""Each query against its SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from framelake.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    at = [expected.columns.index(c) for c in names]
    b = sorted(tuple(plain(r[k]) for k in at) for r in expected.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_window_is_pushed_to_the_scan(spark, sf_dir):
    plan = QUERIES["size_guard"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(n_chars,2000)" in plan and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_of_a_window_reach_the_scan(spark, sf_dir):
    plan = QUERIES["window_tensor"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T23:59:59)" in plan


def test_no_window_over_streams_finds_one_packet(spark, sf_dir):
    assert "Window" not in plan_of(QUERIES["window_packets"](spark, sf_dir))


@pytest.mark.parametrize("name", ["loudness_gate", "loudness_integrated", "perf_compare"])
def test_no_key_meets_in_one_window(spark, sf_dir, name):
    assert "Window" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["audio_channels", "wav_roundtrip", "flac_decode", "y4m_decode", "scale_area", "mel_spectrogram"])
def test_arrays_stay_in_their_rows(spark, sf_dir, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir))


def test_lines_are_read_once(spark, sf_dir):
    assert plan_of(QUERIES["perf_compare"](spark, sf_dir)).count("lineitem.parquet") == 1


def test_a_long_grid_is_exploded_in_blocks(spark):
    from pyspark.sql import functions as F

    from framelake.operators import timeline

    ends = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 3 * timeline.GRID_BLOCK, 2), (2, 0, 5, 3)], "asset_id long, stream_index int, pts long, event_id long")
    found = timeline.grid_of(ends, 2).groupBy("asset_id").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("asset_id").collect()
    n = 3 * timeline.GRID_BLOCK // 2 + 1
    assert [tuple(r) for r in found] == [(1, n, 0, n - 1), (2, 1, 0, 0)]


def test_dimension_orders_are_inverse(spark):
    from pyspark.sql import functions as F

    from framelake.functions import arrays

    a = F.sequence(F.lit(0), F.lit(23))
    r = spark.range(1).select(arrays.chw_to_hwc(arrays.hwc_to_chw(a, 2, 4), 2, 4).alias("x"), arrays.unpadded(arrays.padded(F.transform(a, lambda x: x.cast("double")), 4, 6, 8), 4, 8, 6).alias("y")).first()
    assert r.x == list(range(24)) and r.y == list(range(24))


def test_arrays_are_bounded_by_a_capacity(spark):
    from framelake.operators import audio, binding

    parts = spark.createDataFrame([(1, k, [float(k)] * 4) for k in range(5)], "key int, nth int, e array<double>")
    assert audio.concatenated(parts, ["key"], "nth", "e", capacity=10).first().e == [0.0] * 4 + [1.0] * 4 + [2.0] * 2
    frames = spark.createDataFrame([(1, 0, "video", k, k, float(k)) for k in range(9)], "asset_id int, stream_index int, stream_type string, event_id int, pts int, pts_seconds double")
    assert binding.collapsed(frames, capacity=3).first().pts_list == [0.0, 1.0, 2.0]
