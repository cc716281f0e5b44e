"""The queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import arrays as A
from framelake.functions import planning as P
from framelake.operators import audio, binding, colour, compare, timeline
from framelake.plans.views import FRAMES, HDR, PARTS, VECTORS, frames, parts, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400.0
START, END, RATE = 5 * DAY, 20 * DAY, 1 / 21_600.0  # a frame every six hours


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CAPACITY = "CAST(ceil((15 * 86400.0::DOUBLE - 0.5::DOUBLE / (1.0::DOUBLE / 21600.0::DOUBLE)) * (1.0::DOUBLE / 21600.0::DOUBLE)) AS BIGINT)"


@query(f"""WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset_id, stream_index ORDER BY pts, event_id) - 1 AS frame_index FROM f WHERE pts_seconds >= 432000.0)
SELECT asset_id, stream_index, stream_type, CAST(frame_index AS BIGINT) AS frame_index, event_id, pts, pts_seconds, payload FROM k WHERE frame_index + 1 <= {CAPACITY}""")
def window_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a decode result: from the start on, as many as the window has room for."""
    room = P.frame_capacity(P.effective_duration(F.lit(30 * DAY), F.lit(START), F.lit(END)), F.lit(RATE))
    return timeline.capped(frames(spark, sf_dir, START), F.lit(START), room).select("asset_id", "stream_index", "stream_type", F.col("frame_index").cast("long").alias("frame_index"), "event_id", "pts", "pts_seconds", "payload")


@query(f"""WITH {FRAMES} SELECT asset_id, stream_index, event_id, pts_seconds FROM f
WHERE (asset_id % 3 = 0 OR pts_seconds >= 432000.0) AND (asset_id % 4 = 0 OR pts_seconds < 1728000.0)""")
def window_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("asset_id")
    return timeline.half_open(frames(spark, sf_dir), F.when(a % 3 != 0, F.lit(START)), F.when(a % 4 != 0, F.lit(END))).select("asset_id", "stream_index", "event_id", "pts_seconds")


@query(f"""WITH {FRAMES}, k AS (SELECT *, coalesce(max(CASE WHEN pts_seconds > 864000.0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, stream_index ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM f)
SELECT asset_id, stream_index, event_id, pts FROM k WHERE passed = 0""")
def window_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.until_passed(frames(spark, sf_dir), F.lit(10 * DAY)).select("asset_id", "stream_index", "event_id", "pts")


PROBE = """pr AS (SELECT asset_id, stream_index, stream_type, count(*) AS n_frames, min(pts) AS first_pts, max(pts) AS last_pts,
  CASE WHEN max(pts) > min(pts) THEN (count(*) - 1) / (CAST(max(pts) - min(pts) AS DOUBLE) * (1.0::DOUBLE / 1000000.0::DOUBLE)) ELSE 0.0::DOUBLE END AS fps FROM f GROUP BY 1, 2, 3)"""


@query(f"WITH {FRAMES}, {PROBE} SELECT asset_id, stream_index, stream_type, n_frames, first_pts, last_pts, round(fps, 12) AS fps FROM pr")
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.probe(frames(spark, sf_dir)).withColumn("fps", F.round("fps", 12))


@query(f"""WITH {FRAMES}, {PROBE} SELECT asset_id, count(*) FILTER (stream_type = 'video') AS n_video, count(*) FILTER (stream_type = 'audio') AS n_audio,
  min(stream_index) FILTER (stream_type = 'video') AS first_video, CAST(coalesce(sum(n_frames) FILTER (stream_type = 'audio'), 0) AS BIGINT) AS audio_frames FROM pr GROUP BY 1""")
def probe_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = binding.nested(binding.probe(frames(spark, sf_dir)))
    total = F.aggregate("audio_streams", F.lit(0).cast("long"), lambda s, x: s + x["n_frames"])
    return n.select("asset_id", F.size("video_streams").cast("long").alias("n_video"), F.size("audio_streams").cast("long").alias("n_audio"), F.get("video_streams", F.lit(0))["stream_index"].alias("first_video"), total.alias("audio_frames"))


@query(f"WITH {FRAMES}, {PROBE} SELECT asset_id, stream_type, stream_index, n_frames FROM pr QUALIFY row_number() OVER (PARTITION BY asset_id, stream_type ORDER BY n_frames DESC, stream_index) = 1")
def best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.best(binding.probe(frames(spark, sf_dir)), F.col("n_frames")).select("asset_id", "stream_type", "stream_index", "n_frames")


@query("""SELECT l_orderkey AS asset_id, CAST(l_suppkey % 3 AS BIGINT) AS "index", l_linenumber AS position, l_partkey AS options FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def request_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A line number may stand twice in an order, so the position is made strict.
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), (F.col("l_suppkey") % 3).alias("index"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"))
    return binding.first_requests(rows).select("asset_id", "index", F.col("position.l_linenumber").alias("position"), F.col("position.l_partkey").alias("options"))


@query(f"WITH {FRAMES} SELECT asset_id, stream_index, event_id FROM f WHERE stream_index = asset_id % 5")
def stream_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    wanted = f.select("asset_id").distinct().withColumn("stream_index", (F.col("asset_id") % 5).cast("int"))
    return binding.pruned(f, wanted).select("asset_id", "stream_index", "event_id")


@query(f"WITH {FRAMES} SELECT event_id, pts, pts_seconds FROM f")
def pts_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("event_id", "pts", "pts_seconds")


ORDERS = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS duration,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 200 AS DOUBLE) END AS start, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 350 AS DOUBLE) END AS stop FROM orders),
q AS (SELECT *, CASE WHEN duration IS NULL THEN 'unknown duration' WHEN start IS NOT NULL AND stop IS NOT NULL AND stop <= start THEN 'empty window' WHEN start IS NOT NULL AND stop IS NULL AND duration <= start THEN 'start after end' ELSE 'ok' END AS status FROM o)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 11 != 0, F.col("o_totalprice") / 1000).alias("duration"), F.when(k % 3 != 0, (c % 200).cast("double")).alias("start"), F.when(k % 4 != 0, (c % 350).cast("double")).alias("stop"))


@query(f"""WITH {ORDERS} SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN CASE WHEN start IS NOT NULL AND stop IS NOT NULL THEN least(duration, stop - start) WHEN stop IS NOT NULL THEN least(duration, stop) WHEN start IS NOT NULL THEN duration - start ELSE duration END END AS seconds FROM q""")
def asset_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.col("duration"), F.col("start"), F.col("stop")
    return _orders(spark, sf_dir).select("o_orderkey", P.window_status(*window).alias("status"), P.effective_duration(*window).alias("seconds"))


_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ceil((l_extendedprice / 100 - 0.5::DOUBLE / fps) * fps) AS BIGINT) AS capacity FROM (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN l_quantity WHEN l_suppkey % 3 = 0 THEN CAST(24000 AS DOUBLE) / 1001 ELSE (l_linenumber * 100) / (l_extendedprice / 100) END AS fps FROM lineitem)""")
def frame_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("l_extendedprice") / 100
    fps = P.frame_rate(F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity")), F.when(F.col("l_suppkey") % 3 == 0, F.lit(24000.0) / 1001).otherwise(0.0), F.col("l_linenumber") * 100, seconds)
    return table(spark, sf_dir, "lineitem").select(*_LINES, P.frame_capacity(seconds, fps).alias("capacity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s >= 0 AND rate > 0 THEN CAST(ceil(s * rate) AS BIGINT) END AS samples FROM (SELECT *, l_extendedprice / 1000 - l_quantity AS s, 8000 * (l_linenumber % 6) AS rate FROM lineitem)")
def sample_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINES, P.sample_capacity(F.col("l_extendedprice") / 1000 - F.col("l_quantity"), 8000 * (F.col("l_linenumber") % 6)).alias("samples"))


@query("""SELECT p_partkey, CAST(CASE WHEN t < 0 THEN NULL ELSE t * h * w * 3 * e END AS DOUBLE) AS bytes, CASE WHEN t < 0 THEN 'negative size' WHEN t * h * w * 3 * e > 17179869184 THEN 'too large' ELSE 'ok' END AS status
FROM (SELECT p_partkey, CAST(p_partkey % 1000 - 10 AS HUGEINT) AS t, CAST(p_size * 30 AS HUGEINT) AS h, CAST(p_size * 40 AS HUGEINT) AS w, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 1 END AS e FROM part)""")
def tensor_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [F.col("p_partkey") % 1000 - 10, F.col("p_size") * 30, F.col("p_size") * 40, F.lit(3)]
    size = P.tensor_bytes(dims, F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(1))
    status = F.when(F.col("size").isNull(), "negative size").when(F.col("size") > P.MAX_BYTES, "too large").otherwise("ok")
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", F.col("size").cast("double").alias("bytes"), status.alias("status"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").where(F.col("n_chars") <= 2000)


@query(f"""WITH {PARTS}, s AS (SELECT p_partkey, width, height, to_width, to_height,
  greatest(2, coalesce(to_width, (width * to_height * 2 + height) // (height * 2)) & ~1::BIGINT) AS w, greatest(2, coalesce(to_height, (height * to_width * 2 + width) // (width * 2)) & ~1::BIGINT) AS h FROM p)
SELECT p_partkey, CASE WHEN w < width AND h < height AND (to_width IS NOT NULL OR to_height IS NOT NULL) THEN w END AS out_width, CASE WHEN w < width AND h < height AND (to_width IS NOT NULL OR to_height IS NOT NULL) THEN h END AS out_height FROM s""")
def hw_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = P.hardware_size(F.col("width"), F.col("height"), F.col("to_width"), F.col("to_height"))
    return parts(spark, sf_dir).select("p_partkey", w.alias("out_width"), h.alias("out_height"))


def _device():
    return F.when(F.col("p_partkey") % 7 == 0, "cuda").when(F.col("p_partkey") % 7 < 4, F.concat(F.lit("cuda:"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 7 == 4, F.concat(F.lit("gpu"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 7 == 5, "cuda:")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 < 4 THEN p_size WHEN p_partkey % 7 < 6 THEN -1 END AS INTEGER) AS device FROM part""")
def device_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.device_index(_device()).alias("device"))


@query(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN hardware = false THEN 'device cannot be combined with hardware_acceleration=false' WHEN fps IS NOT NULL THEN 'fps is not supported on a device' WHEN dtype <> 'uint8' THEN 'dtype must be uint8'
  WHEN (to_width IS NULL) <> (to_height IS NULL) THEN 'give both sides or none' WHEN to_width % 2 <> 0 OR to_height % 2 <> 0 THEN 'sides must be even' WHEN to_width >= width OR to_height >= height THEN 'only downscaling' ELSE 'ok' END AS status FROM p""")
def device_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("hardware", "fps", "dtype", "width", "height", "to_width", "to_height")]
    return parts(spark, sf_dir).select("p_partkey", P.device_status(*columns).alias("status"))


@query(f"""WITH {VECTORS}, b AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x + 1) * 127.5::DOUBLE))) AS INTEGER)) AS b FROM v)
SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS byte_sum, b[1] AS first_byte, round(list_sum(list_transform(b, lambda x: x / 255.0::DOUBLE)), 6) AS unit_sum FROM b""")
def dtype_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = vectors(spark, sf_dir).select("vec_id", A.to_bytes(F.col("e")).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x)
    return b.select("vec_id", total.alias("byte_sum"), F.get("b", F.lit(0)).alias("first_byte"), F.round(F.aggregate(A.bytes_to_unit(F.col("b")), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    swapped = lambda s: F.regexp_replace(u, "^https?://", s)
    uri = F.when(k % 5 == 0, swapped("s3://")).when(k % 5 == 1, swapped("gs://")).when(k % 10 == 2, F.regexp_extract(swapped("s3://"), "^s3://[^/]*", 0)).when(k % 10 == 3, F.regexp_extract(swapped("gs://"), "^gs://[^/]*", 0)).when(k % 20 == 7, F.concat(F.lit("concat:"), u)).when(k % 20 == 17, F.concat(F.lit("subfile,,start,0,end,9,,:"), u)).when(k % 20 == 8, swapped("ftp://")).when(k % 20 == 18, F.concat(F.lit("data:text/html;base64,"), u)).when(k % 10 == 9, F.concat(F.lit("crypto+"), u)).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"))


URIS = """u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?://', 's3://') WHEN page_id % 5 = 1 THEN regexp_replace(url, '^https?://', 'gs://')
  WHEN page_id % 10 = 2 THEN regexp_extract(regexp_replace(url, '^https?://', 's3://'), '^s3://[^/]*') WHEN page_id % 10 = 3 THEN regexp_extract(regexp_replace(url, '^https?://', 'gs://'), '^gs://[^/]*')
  WHEN page_id % 20 = 7 THEN 'concat:' || url WHEN page_id % 20 = 17 THEN 'subfile,,start,0,end,9,,:' || url WHEN page_id % 20 = 8 THEN regexp_replace(url, '^https?://', 'ftp://')
  WHEN page_id % 20 = 18 THEN 'data:text/html;base64,' || url WHEN page_id % 10 = 9 THEN 'crypto+' || url ELSE url END AS uri FROM pages)"""


@query(f"""WITH {URIS} SELECT page_id, CASE WHEN uri LIKE 'gs://%' THEN 'projects/_/buckets/' || regexp_extract(uri, '^gs://([^/]*)', 1) WHEN uri LIKE 's3://%' THEN regexp_extract(uri, '^s3://([^/]*)', 1) END AS bucket,
  CASE WHEN uri LIKE 'gs://%' OR uri LIKE 's3://%' THEN regexp_extract(uri, '^(?:gs|s3)://[^/]*/?(.*)$', 1) END AS object_key, CASE WHEN uri LIKE 's3://%' AND regexp_extract(uri, '^s3://[^/]*/?(.*)$', 1) = '' THEN 'no key' ELSE 'ok' END AS status FROM u""")
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("uri")
    return _uris(spark, sf_dir).select("page_id", P.bucket(u).alias("bucket"), P.object_key(u).alias("object_key"), P.uri_status(u).alias("status"))


@query(f"WITH {URIS} SELECT page_id, CASE WHEN uri LIKE 'gs://%' THEN 'gcs' WHEN uri LIKE 's3://%' THEN 's3' ELSE 'file' END AS route FROM u")
def uri_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("page_id", P.route(F.col("uri")).alias("route"))


@query(f"""WITH {URIS}, p AS (SELECT page_id, uri, strpos(uri, ':') AS colon FROM u), n AS (SELECT page_id, uri, CASE WHEN colon = 0 THEN 'file' WHEN starts_with(uri, 'subfile,') THEN 'subfile'
  WHEN length(translate(left(uri, colon - 1), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-.', '')) > 0 OR colon = 1 THEN 'file' ELSE split_part(left(uri, colon - 1), '+', 1) END AS name FROM p)
SELECT page_id, uri FROM n WHERE list_contains(['file', 'http', 'https', 'tcp', 'tls', 'crypto'], name)""")
def uri_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).where(P.allowed(F.col("uri")))


@query("""WITH c AS (SELECT p_partkey, p_size & 1 = 1 AS i, p_size & 2 = 2 AS s, p_size & 4 = 4 AS t, CASE WHEN p_size & 8 = 8 THEN CASE WHEN p_partkey % 3 = 0 THEN 'default' WHEN p_partkey % 3 = 1 THEN 'container' ELSE 'bogus' END END AS m FROM part)
SELECT p_partkey, CASE WHEN i <> s THEN 'error: id and secret go together' WHEN t AND NOT (i AND s) THEN 'error: a token needs id and secret' WHEN i AND s AND m IS NOT NULL THEN 'error: static credentials or a mode' WHEN i AND s THEN 'static'
  WHEN m IS NULL OR m = 'default' THEN 'default' WHEN m = 'container' THEN 'container' ELSE 'error: unknown mode' END AS resolved FROM c""")
def s3_config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda b: F.when(F.col("p_size").bitwiseAND(b) == b, "x")
    mode = F.when(F.col("p_size").bitwiseAND(8) == 8, F.when(F.col("p_partkey") % 3 == 0, "default").when(F.col("p_partkey") % 3 == 1, "container").otherwise("bogus"))
    return table(spark, sf_dir, "part").select("p_partkey", P.credentials(bit(1), bit(2), bit(4), mode).alias("resolved"))


PLAIN = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@query(f"""WITH {PARTS} SELECT p_partkey, concat_ws(',', 'fps=' || ({PLAIN("fps")}), CASE WHEN to_width IS NOT NULL OR to_height IS NOT NULL THEN 'scale=' || concat_ws(':', 'width=' || to_width, 'height=' || to_height) END,
  CASE WHEN {HDR} THEN '{P.TONE_MAP_CHAIN}' END, CASE WHEN dtype = 'float32' THEN 'format=pix_fmts=gbrpf32le' ELSE 'format=pix_fmts=rgb24' END) AS spec FROM p""")
def filter_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return parts(spark, sf_dir).select("p_partkey", P.video_spec(c("fps"), c("to_width"), c("to_height"), P.is_hdr(c("trc"), c("primaries")), c("dtype")).alias("spec"))


@query(f"""WITH {PARTS}, l AS (SELECT p_partkey, rate, CASE WHEN p_partkey % 5 <> 0 THEN 'loudnorm=' || concat_ws(':', CASE WHEN p_partkey % 2 = 0 THEN 'I=' || CAST(-(p_partkey % 70) AS VARCHAR) END,
  CASE WHEN p_partkey % 3 = 0 THEN 'LRA=' || ({PLAIN("(CAST(p_partkey % 40 AS DOUBLE) / 2)")}) END, CASE WHEN p_partkey % 4 = 0 THEN 'TP=-2' END, CASE WHEN p_partkey % 6 = 0 THEN 'linear=true' END) END AS l FROM p)
SELECT p_partkey, coalesce(nullif(concat_ws(',', l, 'aresample=' || rate), ''), 'anull') AS spec FROM l""")
def loudnorm_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    options = {"I": F.when(k % 2 == 0, -(k % 70)), "LRA": F.when(k % 3 == 0, (k % 40).cast("double") / 2), "TP": F.when(k % 4 == 0, F.lit(-2.0)), "linear": F.when(k % 6 == 0, F.lit(True))}
    return parts(spark, sf_dir).select("p_partkey", P.audio_spec(F.when(k % 5 != 0, P.loudness_spec(options)), F.col("rate")).alias("spec"))


@query(f"WITH {PARTS} SELECT p_partkey, {HDR} AS hdr FROM p")
def is_hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", P.is_hdr(F.col("trc"), F.col("primaries")).alias("hdr"))


@query(f"WITH {PARTS} SELECT p_partkey, fps IS NULL AND to_width IS NULL AND to_height IS NULL AND NOT {HDR} AND dtype = 'uint8' AND width % 32 = 0 AS direct, rate IS NULL AS audio_direct FROM p")
def direct_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return parts(spark, sf_dir).select("p_partkey", P.direct_path(c("fps"), c("to_width"), c("to_height"), P.is_hdr(c("trc"), c("primaries")), c("dtype"), c("width")).alias("direct"), c("rate").isNull().alias("audio_direct"))


STEP = 43_200_000_000  # half a day, in microseconds
GRID = f"g AS (SELECT asset_id, stream_index, low + k * {STEP} AS pts, k AS grid_index FROM (SELECT asset_id, stream_index, min(pts) AS low, max(pts) AS high FROM f GROUP BY 1, 2), LATERAL (SELECT unnest(range(0, (high - low) // {STEP} + 1)) AS k))"


@query(f"""WITH {FRAMES}, {GRID} SELECT g.asset_id, g.stream_index, g.grid_index, g.pts, f.event_id AS source_id FROM g ASOF JOIN f ON g.asset_id = f.asset_id AND g.stream_index = f.stream_index AND g.pts >= f.pts""")
def fps_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.on_grid(frames(spark, sf_dir), STEP)


@query(f"""WITH {FRAMES}, {GRID}, a AS (SELECT g.*, f.pts AS p0, f.payload AS v0 FROM g ASOF JOIN f ON g.asset_id = f.asset_id AND g.stream_index = f.stream_index AND g.pts >= f.pts),
b AS (SELECT a.*, f.pts AS p1, f.payload AS v1 FROM a ASOF LEFT JOIN f ON a.asset_id = f.asset_id AND a.stream_index = f.stream_index AND a.pts <= f.pts)
SELECT asset_id, stream_index, grid_index, pts, round(CASE WHEN p1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(pts - p0 AS DOUBLE) / CAST(p1 - p0 AS DOUBLE)) END, 6) AS sample FROM b""")
def audio_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.interpolated(frames(spark, sf_dir), STEP).withColumn("sample", F.round("sample", 6))


@query(f"""WITH {FRAMES}, s AS (SELECT *, pts - lag(pts) OVER w AS step, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY asset_id, stream_index ORDER BY pts, event_id))
SELECT asset_id, stream_index, coalesce(bool_and(step > 0), true) AS increasing, max(step) FILTER (n = 2) AS first_step, min(step) AS least_step, count(*) AS n_frames FROM s GROUP BY 1, 2""")
def pts_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.spacing(frames(spark, sf_dir))


@query(f"WITH {FRAMES} SELECT asset_id, min(pts) FILTER (stream_type = 'video') AS video_first, min(pts) FILTER (stream_type = 'audio') AS audio_first, min(pts) FILTER (stream_type = 'audio') - min(pts) FILTER (stream_type = 'video') AS av_offset FROM f GROUP BY 1")
def av_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.start_offset(frames(spark, sf_dir))


@query("""WITH f AS (SELECT event_id, user_id % 10 AS asset_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts), event_id) - 1 AS n FROM events)
SELECT asset_id, event_id, CASE WHEN n < 75 THEN n / 30.0::DOUBLE ELSE 2.5::DOUBLE + (n - 75) / 15.0::DOUBLE END AS retimed FROM f""")
def vfr_retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = frames(spark, sf_dir).withColumn("asset_id", F.col("asset_id") % 10).withColumn("stream_index", F.lit(0))
    return timeline.retimed(few).select("asset_id", "event_id", "retimed")


@query(f"""WITH {FRAMES} SELECT asset_id, stream_index, event_id, CAST(floor(payload) + 1 AS BIGINT) AS n_samples, CAST(coalesce(sum(floor(payload) + 1) OVER (PARTITION BY asset_id, stream_index ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def append_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.offsets(frames(spark, sf_dir), (F.floor("payload") + 1).cast("long")).select("asset_id", "stream_index", "event_id", "n_samples", "offset")


@query(f"""WITH {VECTORS}, o AS (SELECT *, 64 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS "offset" FROM v), k AS (SELECT vec_id, label, "offset", list_slice(e, 1, least(64, 1000 - "offset")) AS e FROM o WHERE "offset" < 1000)
SELECT label, vec_id, "offset", CAST(len(e) AS INTEGER) AS n, round(list_sum(e), 6) AS total FROM k""")
def audio_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audio.appended(vectors(spark, sf_dir), ["label"], ["vec_id"], "e", 1000)
    return kept.select("label", "vec_id", "offset", F.size("e").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {VECTORS}, c AS (SELECT label, flatten(list(e ORDER BY vec_id)) AS e FROM v GROUP BY 1)
SELECT label, len(e) AS n, e[1] AS first_sample, e[len(e)] AS last_sample, e[(len(e) + 1) // 2] AS middle_sample FROM c""")
def concat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = audio.concatenated(vectors(spark, sf_dir), ["label"], "vec_id", "e").withColumn("n", F.size("e"))
    pick = lambda i: F.element_at("e", i.cast("int"))
    return c.select("label", F.col("n").cast("long").alias("n"), pick(F.lit(1)).alias("first_sample"), pick(F.col("n")).alias("last_sample"), pick(F.floor((F.col("n") + 1) / 2)).alias("middle_sample"))


_PERMUTED = "list_transform(range(48), lambda i: e[(i % 16) * 3 + i // 16 + 1])"


@query(f"""WITH {VECTORS}, c AS (SELECT vec_id, {_PERMUTED} AS c FROM v) SELECT vec_id, c[2] AS second, c[17] AS first_of_plane, c[48] AS last, round(list_sum(list_transform(range(48), lambda i: c[i + 1] * (i + 1))), 6) AS weighted FROM c""")
def permute_hwc_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("vec_id", A.hwc_to_chw(F.col("e"), 4, 4).alias("c"))
    return c.select("vec_id", F.get("c", F.lit(1)).alias("second"), F.get("c", F.lit(16)).alias("first_of_plane"), F.get("c", F.lit(47)).alias("last"), _weighted("c"))


def _weighted(c: str):
    return F.round(F.aggregate(F.transform(F.col(c), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted")


@query(f"WITH {VECTORS}, c AS (SELECT vec_id, list_concat(list_concat(e[33:48], e[1:16]), e[17:32]) AS c FROM v) SELECT vec_id, c[1] AS red, c[17] AS green, c[33] AS blue, round(list_sum(list_transform(range(48), lambda i: c[i + 1] * (i + 1))), 6) AS weighted FROM c")
def gbr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("vec_id", A.gbr_to_rgb(F.col("e"), 16).alias("c"))
    return c.select("vec_id", F.get("c", F.lit(0)).alias("red"), F.get("c", F.lit(16)).alias("green"), F.get("c", F.lit(32)).alias("blue"), _weighted("c"))


@query(f"WITH {VECTORS}, c AS (SELECT vec_id, list_transform(range(48), lambda i: e[(i // 6) * 8 + i % 6 + 1]) AS c FROM v) SELECT vec_id, len(c) AS n, c[7] AS second_row, round(list_sum(list_transform(range(48), lambda i: c[i + 1] * (i + 1))), 6) AS weighted FROM c")
def rgb_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("vec_id", A.unpadded(F.col("e"), 8, 8, 6).alias("c"))
    return c.select("vec_id", F.size("c").cast("long").alias("n"), F.get("c", F.lit(6)).alias("second_row"), _weighted("c"))


@query(f"""WITH {VECTORS}, c AS (SELECT vec_id, list_transform(range(16), lambda i: (e[(i // 4) * 16 + (i % 4) * 2 + 1] + e[(i // 4) * 16 + (i % 4) * 2 + 2] + e[(i // 4) * 16 + (i % 4) * 2 + 9] + e[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4) AS c FROM v)
SELECT vec_id, len(c) AS n, round(list_sum(list_transform(range(16), lambda i: c[i + 1] * (i + 1))), 6) AS weighted FROM c""")
def scale_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("vec_id", A.area_scaled(F.col("e"), 8, 8, 4, 4).alias("c"))
    return c.select("vec_id", F.size("c").cast("long").alias("n"), _weighted("c"))


_SHARE = "greatest(0.0::DOUBLE, least(({o} + 1) * {s}, {i} + 1) - greatest({o} * {s}, {i}::DOUBLE)) / {s}"


@query(f"""WITH {VECTORS}, o AS (SELECT vec_id, e, unnest(range(0, 15)) AS k FROM v), j AS (SELECT vec_id, k, e[i + 1] * {_SHARE.format(o="(k // 3)", i="(i // 8)", s="1.6::DOUBLE")} * {_SHARE.format(o="(k % 3)", i="(i % 8)", s="(8.0::DOUBLE / 3.0::DOUBLE)")} AS part FROM o, LATERAL (SELECT unnest(range(0, 64)) AS i))
SELECT vec_id, k AS place, round(sum(part), 6) AS pixel FROM j GROUP BY 1, 2""")
def scale_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any size to any other: 8 by 8 to 5 by 3."""
    each = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.area_scaled(F.col("e"), 8, 8, 5, 3)).alias("place", "pixel"))
    return each.select("vec_id", F.col("place").cast("long").alias("place"), F.round("pixel", 6).alias("pixel"))


@query(f"WITH {VECTORS}, c AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 8 < 6 THEN e[(i // 8) * 6 + i % 8 + 1] ELSE 0.0::DOUBLE END) AS c FROM v) SELECT vec_id, len(c) AS n, c[7] AS pad, c[9] AS second_row, round(list_sum(list_transform(range(64), lambda i: c[i + 1] * (i + 1))), 6) AS weighted FROM c")
def frame_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tight rows to rows of a stride: what a frame's memory holds."""
    c = vectors(spark, sf_dir).select("vec_id", A.padded(F.col("e"), 8, 6, 8).alias("c"))
    return c.select("vec_id", F.size("c").cast("long").alias("n"), F.get("c", F.lit(6)).alias("pad"), F.get("c", F.lit(8)).alias("second_row"), _weighted("c"))


_YUV = """y AS (SELECT vec_id, label, floor((e[1] + 1) * 127.5::DOUBLE) AS y, floor((e[2] + 1) * 127.5::DOUBLE) AS u, floor((e[3] + 1) * 127.5::DOUBLE) AS v FROM v),
m AS (SELECT * FROM (VALUES (0, 0.2126::DOUBLE, 0.0722::DOUBLE), (1, 0.299::DOUBLE, 0.114::DOUBLE), (2, 0.299::DOUBLE, 0.114::DOUBLE), (3, 0.212::DOUBLE, 0.087::DOUBLE), (4, 0.2627::DOUBLE, 0.0593::DOUBLE)) AS t(k, kr, kb)),
l AS (SELECT vec_id, kr, kb, CASE WHEN label >= 5 THEN y ELSE (y - 16) * 255.0::DOUBLE / 219.0::DOUBLE END AS luma, (u - 128) * (CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 255.0::DOUBLE / 224.0::DOUBLE END) AS cb, (v - 128) * (CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 255.0::DOUBLE / 224.0::DOUBLE END) AS cr FROM y JOIN m ON label % 5 = k),
c AS (SELECT vec_id, kr, kb, luma, luma + (1 - kr) * 2 * cr AS r, luma + (1 - kb) * 2 * cb AS b FROM l),
w AS (SELECT vec_id, r, (luma - kr * r - kb * b) / (1 - kr - kb) AS g, b FROM c)"""


@query(f"WITH {VECTORS}, {_YUV} SELECT vec_id, CAST(greatest(0, least(255, floor(r + 0.5::DOUBLE))) AS INTEGER) AS r, CAST(greatest(0, least(255, floor(g + 0.5::DOUBLE))) AS INTEGER) AS g, CAST(greatest(0, least(255, floor(b + 0.5::DOUBLE))) AS INTEGER) AS b FROM w")
def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = lambda i: F.floor((F.get("e", F.lit(i)) + 1) * 127.5)
    matrices = spark.createDataFrame([(k, *w) for k, w in enumerate(A.LUMA.values())], "k int, kr double, kb double")
    each = vectors(spark, sf_dir).withColumn("k", F.col("label") % 5).join(F.broadcast(matrices), "k")
    r, g, b = A.yuv_to_rgb(sample(0), sample(1), sample(2), F.col("kr"), F.col("kb"), F.col("label") >= 5)
    return each.select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {VECTORS}, c AS (SELECT vec_id, list_transform(range(8), lambda i: e[i * 2 + 33]) AS u, list_transform(range(8), lambda i: e[i * 2 + 34]) AS w FROM v) SELECT vec_id, u[1] AS first_u, w[1] AS first_v, round(list_sum(u), 6) AS sum_u, round(list_sum(w), 6) AS sum_v FROM c")
def nv12_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: A.rearranged(F.col("e"), 8, lambda i: i * 2 + 32 + k)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    c = vectors(spark, sf_dir).select("vec_id", of(0).alias("u"), of(1).alias("w"))
    return c.select("vec_id", F.get("u", F.lit(0)).alias("first_u"), F.get("w", F.lit(0)).alias("first_v"), total(F.col("u")).alias("sum_u"), total(F.col("w")).alias("sum_v"))


_HABLE = lambda x: f"(({x} * ({x} * 0.15::DOUBLE + 0.1::DOUBLE * 0.5::DOUBLE) + 0.2::DOUBLE * 0.02::DOUBLE) / ({x} * ({x} * 0.15::DOUBLE + 0.5::DOUBLE) + 0.2::DOUBLE * 0.3::DOUBLE) - 0.02::DOUBLE / 0.3::DOUBLE)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_HABLE('(l_extendedprice / 10000)')} / {_HABLE('10.0::DOUBLE')}, 6) AS mapped FROM lineitem")
def tonemap_hable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINES, F.round(A.tone_mapped(F.col("l_extendedprice") / 10000), 6).alias("mapped"))


_PQ = "pow(greatest(pow({v}, 1 / (2523.0::DOUBLE / 32)) - 3424.0::DOUBLE / 4096, 0) / (2413.0::DOUBLE / 128 - (2392.0::DOUBLE / 128) * pow({v}, 1 / (2523.0::DOUBLE / 32))), 1 / (2610.0::DOUBLE / 16384)) * 100"
_HLG = "(CASE WHEN {v} <= 0.5 THEN {v} * {v} / 3 ELSE (exp(({v} - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END) * 10"
_OETF = "CASE WHEN {x} < 0.018 THEN {x} * 4.5 ELSE 1.099 * pow({x}, 0.45::DOUBLE) - 0.099 END"


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, label % 2 = 0 AS hlg, greatest(0, least(1, (e[1] + 1) / 2)) AS r, greatest(0, least(1, (e[2] + 1) / 2)) AS g, greatest(0, least(1, (e[3] + 1) / 2)) AS b FROM v),
l AS (SELECT vec_id, {", ".join(f"CASE WHEN hlg THEN {_HLG.format(v=c)} ELSE {_PQ.format(v=c)} END AS {c}" for c in "rgb")} FROM s), t AS (SELECT *, greatest(r, g, b, 1e-6::DOUBLE) AS top FROM l),
m AS (SELECT vec_id, {", ".join(f"{c} * ({_HABLE('top')} / {_HABLE('10.0::DOUBLE')} / top) AS {c}" for c in "rgb")} FROM t),
p AS (SELECT vec_id, greatest(0, 1.6605::DOUBLE * r - 0.5876::DOUBLE * g - 0.0728::DOUBLE * b) AS r, greatest(0, 1.1329::DOUBLE * g - 0.1246::DOUBLE * r - 0.0083::DOUBLE * b) AS g, greatest(0, 1.1187::DOUBLE * b - 0.0182::DOUBLE * r - 0.1006::DOUBLE * g) AS b FROM m)
SELECT vec_id, {", ".join(f"round(least(1, {_OETF.format(x=c)}), 6) AS {c}" for c in "rgb")} FROM p""")
def hdr_to_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on pixels: PQ or HLG to light, the tone curve, primaries, and the transfer of the target."""
    signal = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.get("e", F.lit(i)) + 1) / 2))
    pixels = vectors(spark, sf_dir).select("vec_id", "label", signal(0).alias("r"), signal(1).alias("g"), signal(2).alias("b"))
    return colour.hdr_to_sdr(pixels, F.col("label") % 2 == 0).select("vec_id", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN (CAST(l_partkey % 256 AS DOUBLE) - 128) / 128 WHEN 1 THEN CAST(l_partkey * 7 % 65536 - 32768 AS DOUBLE) / 32768 WHEN 2 THEN CAST(l_partkey * 1000003 % 4294967296 - 2147483648 AS DOUBLE) / 2147483648 ELSE CAST(l_partkey AS DOUBLE) END AS sample,
  CAST(CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 4 END AS INTEGER) AS bytes FROM lineitem""")
def pcm_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("l_linenumber") % 4, F.col("l_partkey")
    kind = F.when(n == 0, "u8").when(n == 1, "s16p").when(n == 2, "s32").otherwise("fltp")
    raw = F.when(n == 0, k % 256).when(n == 1, k * 7 % 65536 - 32768).when(n == 2, k * 1000003 % 4294967296 - 2147483648).otherwise(k)
    return table(spark, sf_dir, "lineitem").select(*_LINES, A.pcm_to_float(raw, kind).alias("sample"), A.sample_bytes(kind).alias("bytes"))


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, list_transform(e, lambda x: round(x * 32767)) AS s FROM v)
SELECT vec_id, len(s) AS n_samples, CAST(list_sum(s) AS BIGINT) AS total, s[1] / 32768 AS first_sample, s[64] / 32768 AS last_sample FROM s""")
def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.sources.wav import decode_rows, encode_rows

    wav = encode_rows(vectors(spark, sf_dir).select(F.col("vec_id").alias("asset_id"), F.col("e").alias("samples")), 16_000)
    return decode_rows(wav).select(F.col("asset_id").alias("vec_id"), *_summary("samples"))


def _summary(samples: str):
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * 32768)
    return F.size(samples).cast("long").alias("n_samples"), F.round(total).cast("long").alias("total"), F.get(samples, F.lit(0)).alias("first_sample"), F.element_at(samples, -1).alias("last_sample")


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, list_transform(e, lambda x: floor(x * 32767)) AS s FROM v) SELECT vec_id, len(s) AS n_samples, CAST(list_sum(s) AS BIGINT) AS total, s[1] / 32768 AS first_sample, s[64] / 32768 AS last_sample FROM s""")
def flac_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake import api
    from framelake.sources import flac

    content = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), "e")
    files = audio.kernel_rows(content, "e", lambda x: flac.encode(np.floor(x * 32767).astype(np.int64)[None], 16_000), "content binary")
    heard = api.tensors(api.decode_audio(files))
    return heard.select(F.col("path").cast("long").alias("vec_id"), *_summary("values"))


_CLIP = "b AS (SELECT vec_id, list_transform(e, lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x + 1) * 127.5::DOUBLE)))) AS b FROM v)"


def _clips(spark: SparkSession, sf_dir: str, width: int, height: int, frames: int) -> DataFrame:
    """Clips of 4:4:4 frames at ten a second, made of each vector's values as bytes."""
    from framelake.sources import headers

    size = width * height * 3

    def clip(x: np.ndarray) -> bytes:
        raw = np.floor(np.clip((x + 1) * 127.5, 0, 255)).astype(np.uint8).tobytes()
        return headers.y4m(width, height, (10, 1), [raw[k * size : (k + 1) * size] for k in range(frames)])

    content = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), "e")
    return audio.kernel_rows(content, "e", clip, "content binary")


@query(f"""WITH {VECTORS}, {_CLIP}, p AS (SELECT vec_id, k, i, (b[k * 24 + i + 1] - 16) * 255.0::DOUBLE / 219 AS y, (b[k * 24 + i + 9] - 128) * 255.0::DOUBLE / 224 AS u, (b[k * 24 + i + 17] - 128) * 255.0::DOUBLE / 224 AS w FROM b, LATERAL (SELECT unnest(range(0, 2)) AS k), LATERAL (SELECT unnest(range(0, 8)) AS i)),
c AS (SELECT vec_id, k, i, y + 1.402::DOUBLE * w AS r, (y - 0.299::DOUBLE * (y + 1.402::DOUBLE * w) - 0.114::DOUBLE * (y + 1.772::DOUBLE * u)) / 0.587::DOUBLE AS g, y + 1.772::DOUBLE * u AS b FROM p),
q AS (SELECT vec_id, k, i, greatest(0, least(255, floor(r + 0.5))) AS r, greatest(0, least(255, floor(g + 0.5))) AS g, greatest(0, least(255, floor(b + 0.5))) AS b FROM c)
SELECT vec_id, k AS frame_index, k / 10.0::DOUBLE AS pts_seconds, CAST(sum(r * (i + 1)) AS BIGINT) AS red, CAST(sum(g * (i + 1)) AS BIGINT) AS green, CAST(sum(b * (i + 1)) AS BIGINT) AS blue FROM q GROUP BY 1, 2""")
def y4m_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a clip as pixels, plane by plane."""
    from framelake import api

    seen = api.tensors(api.decode_all(_clips(spark, sf_dir, 4, 2, 2), api.MediaDecodeRequest("", video_stream=api.VideoStreamRequest())))
    plane = lambda k: F.aggregate(F.transform(F.slice("values", 1 + 8 * k, 8), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).cast("long")
    return seen.select(F.col("path").cast("long").alias("vec_id"), "frame_index", "pts_seconds", plane(0).alias("red"), plane(1).alias("green"), plane(2).alias("blue"))


@query(f"""WITH {VECTORS}, q AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN (vec_id % 7) / 10.0::DOUBLE END AS start, CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 11) / 10.0::DOUBLE END AS stop FROM v),
s AS (SELECT *, CASE WHEN start IS NOT NULL AND stop IS NOT NULL AND stop <= start THEN 'empty window' END AS error, CASE WHEN stop IS NULL THEN 1.0::DOUBLE - coalesce(start, 0) ELSE least(1.0::DOUBLE, stop - coalesce(start, 0)) END AS seconds FROM q),
n AS (SELECT vec_id, error, list_filter(range(0, 10), lambda k: k / 10.0::DOUBLE >= coalesce(start, 0)) AS k, CAST(ceil((seconds - 0.05::DOUBLE) * 10) AS BIGINT) AS room FROM s),
f AS (SELECT vec_id, error, CASE WHEN error IS NULL THEN list_slice(k, 1, greatest(0, room)) ELSE [] END AS k FROM n)
SELECT vec_id, CAST(len(k) AS BIGINT) AS n_frames, CASE WHEN len(k) > 0 THEN k[1] / 10.0::DOUBLE END AS first_pts, CASE WHEN len(k) > 0 THEN k[len(k)] / 10.0::DOUBLE END AS last_pts, error FROM f WHERE len(k) > 0 OR error IS NOT NULL""")
def decode_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of requests with windows of their own, each answered by frames or an error."""
    from framelake import api

    k = F.col("vec_id")
    start, end = F.when(k % 3 != 0, (k % 7) / F.lit(10.0)), F.when(k % 5 != 0, (k % 11) / F.lit(10.0))
    video = F.from_json(F.lit("{}"), "struct<index: int, width: int, height: int, fps: double, dimension_order: string, device: string, dtype: string>")
    requests = vectors(spark, sf_dir).select(k.cast("string").alias("path"), k.alias("request_id"), start.alias("start_time"), end.alias("end_time"), video.alias("video"), F.lit(None).cast("array<struct<index: int>>").alias("audio"))
    rows = api.decode(_clips(spark, sf_dir, 2, 1, 10), requests)
    return rows.groupBy(F.col("request_id").alias("vec_id")).agg(F.count("data").alias("n_frames"), F.min("pts_seconds").alias("first_pts"), F.max("pts_seconds").alias("last_pts"), F.max("error").alias("error"))


@query(f"WITH {VECTORS}, s AS (SELECT vec_id, unnest(e) AS s, generate_subscripts(e, 1) - 1 AS i FROM v) SELECT vec_id, CAST(i % 2 AS INTEGER) AS channel, count(*) AS n, round(sum(s * (i // 2 + 1)), 6) AS weighted FROM s GROUP BY 1, 2")
def audio_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = vectors(spark, sf_dir).select("vec_id", F.posexplode(audio.channels(F.col("e"), 2)).alias("channel", "c"))
    return each.select("vec_id", "channel", F.size("c").cast("long").alias("n"), _weighted("c"))


_TAPS = """h AS (WITH RECURSIVE h(n, v1, v2, y1, y2) AS (SELECT 0, b0, 0.0::DOUBLE, b0, 0.0::DOUBLE FROM k
  UNION ALL SELECT n + 1, v, v1, v - 2 * v1 + v2 - c1 * y1 - c2 * y2, y1 FROM (SELECT h.*, k.c1, k.c2, (CASE n WHEN 0 THEN b1 WHEN 1 THEN b2 ELSE 0 END) - a1 * v1 - a2 * v2 AS v FROM h, k WHERE n < 63))
  SELECT n, y1 AS tap FROM h)"""
_K48 = "k AS (SELECT 1.53512485958697::DOUBLE AS b0, -2.69169618940638::DOUBLE AS b1, 1.19839281085285::DOUBLE AS b2, -1.69065929318241::DOUBLE AS a1, 0.73248077421585::DOUBLE AS a2, -1.99004745483398::DOUBLE AS c1, 0.99007225036621::DOUBLE AS c2)"


@query(f"""WITH {VECTORS}, {_K48}, {_TAPS}, t AS (SELECT list(tap ORDER BY n) AS t FROM h), w AS (SELECT vec_id, label, i, list_sum(list_transform(range(0, i + 1), lambda j: e[j + 1] * t[i - j + 1])) AS w FROM v, t, LATERAL (SELECT unnest(range(0, 64)) AS i)),
b AS (SELECT label, vec_id, avg(w * w) AS e FROM w GROUP BY 1, 2), l AS (SELECT *, -0.691::DOUBLE + 10 * log10(e) AS l FROM b WHERE e > 0), g AS (SELECT label, -0.691::DOUBLE + 10 * log10(avg(e)) - 10 AS gate FROM l WHERE l > -70 GROUP BY 1)
SELECT l.label, round(-0.691::DOUBLE + 10 * log10(avg(e)), 4) AS loudness, count(*) AS n_blocks FROM l JOIN g USING (label) WHERE l > -70 AND l > gate GROUP BY 1""")
def loudness_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-weighting by the kernel that decoding uses, then both gates as DataFrame operations; each vector is a block at 48 kHz."""
    from framelake.functions import signal

    v = vectors(spark, sf_dir).withColumn("key", F.struct("vec_id", "label")).select("key", "e")
    blocks = audio.kernel_rows(v, "e", lambda x: float(np.mean(signal.k_weighted(x[None], 48_000) ** 2)), "energy double")
    return audio.gated_loudness(blocks.select("key.label", "energy"), ["label"]).withColumn("loudness", F.round("loudness", 4))


@query(f"""WITH {VECTORS}, o AS (SELECT vec_id, m, sum(e[n + 1] * 0.75::DOUBLE * (CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE sin(pi() * 0.75::DOUBLE * t) / (pi() * 0.75::DOUBLE * t) END) * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * t / (16.0::DOUBLE / 3)))) AS x
  FROM (SELECT vec_id, e, m, n, (m * 4.0::DOUBLE - n * 3) / 3 AS t FROM v, LATERAL (SELECT unnest(range(0, 48)) AS m), LATERAL (SELECT unnest(range(0, 64)) AS n)) WHERE abs(t) < 16.0::DOUBLE / 3 GROUP BY 1, 2)
SELECT vec_id, m AS place, round(x, 6) AS sample FROM o""")
def audio_resample_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 to 12 kHz by a windowed sinc of four lobes, cut off at the lower rate's half."""
    from framelake.functions import signal

    out = audio.kernel_rows(vectors(spark, sf_dir).select("vec_id", "e"), "e", lambda x: signal.sinc_resampled(x[None], 16_000, 12_000, lobes=4)[0], "samples array<double>")
    return out.select("vec_id", F.posexplode("samples").alias("place", "sample")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("sample", 6).alias("sample"))


_MELS = """g AS (SELECT j, CASE WHEN m < 15 THEN m * 200.0::DOUBLE / 3 ELSE 1000 * exp((ln(6.4::DOUBLE) / 27) * (m - 15)) END AS hz FROM (SELECT j, j * (15 + ln(8.0::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / 5 AS m FROM (SELECT unnest(range(0, 6)) AS j))),
w AS (SELECT a.j AS mel, k, 2 / (c.hz - a.hz) * greatest(0, least((k * 1000.0::DOUBLE - a.hz) / (b.hz - a.hz), (c.hz - k * 1000.0::DOUBLE) / (c.hz - b.hz))) AS weight FROM g a JOIN g b ON b.j = a.j + 1 JOIN g c ON c.j = a.j + 2, LATERAL (SELECT unnest(range(0, 9)) AS k))"""


@query(f"""WITH {VECTORS}, {_MELS}, s AS (SELECT vec_id, hop, i, e[hop * 8 + i + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 16)) AS x FROM v, LATERAL (SELECT unnest(range(0, 7)) AS hop), LATERAL (SELECT unnest(range(0, 16)) AS i)),
d AS (SELECT vec_id, hop, k, pow(sum(x * cos(2 * pi() * k * i / 16)), 2) + pow(sum(x * sin(2 * pi() * k * i / 16)), 2) AS p FROM s, LATERAL (SELECT unnest(range(0, 9)) AS k) GROUP BY 1, 2, 3)
SELECT vec_id, mel, hop, round(sum(p * weight) * 1000, 6) AS power FROM d JOIN w USING (k) GROUP BY 1, 2, 3""")
def mel_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands of frames of 16 samples, 8 apart."""
    from framelake.functions import signal

    out = audio.kernel_rows(vectors(spark, sf_dir).select("vec_id", "e"), "e", lambda x: signal.mel_spectrogram(x, 16_000, 16, 8, 4).tolist(), "bands array<array<double>>")
    each = out.select("vec_id", F.posexplode("bands").alias("mel", "band")).select("vec_id", F.col("mel").cast("long").alias("mel"), F.posexplode("band").alias("hop", "power"))
    return each.select("vec_id", "mel", F.col("hop").cast("long").alias("hop"), F.round(F.col("power") * 1000, 6).alias("power"))


@query("SELECT p_partkey, CASE p_size % 10 WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 3 THEN '2.1' WHEN 4 THEN '4.0' WHEN 5 THEN '5.0' WHEN 6 THEN '5.1' WHEN 7 THEN '6.1' WHEN 8 THEN '7.1' END AS layout FROM part")
def default_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.channel_layout(F.col("p_size") % 10).alias("layout"))


@query(f"""WITH {FRAMES}, b AS (SELECT stream_index, (payload / 500) * (payload / 500) * (CASE WHEN event_id % 10 = 0 THEN 1e-9::DOUBLE ELSE 1.0::DOUBLE END) AS e FROM f), l AS (SELECT *, -0.691::DOUBLE + 10 * log10(e) AS l FROM b WHERE e > 0),
g AS (SELECT stream_index, -0.691::DOUBLE + 10 * log10(avg(e)) - 10 AS gate FROM l WHERE l > -70 GROUP BY 1)
SELECT l.stream_index, round(-0.691::DOUBLE + 10 * log10(avg(e)), 6) AS loudness, count(*) AS n_blocks FROM l JOIN g USING (stream_index) WHERE l > -70 AND l > gate GROUP BY 1""")
def loudness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("payload") / 500
    blocks = frames(spark, sf_dir).select("stream_index", (level * level * F.when(F.col("event_id") % 10 == 0, F.lit(1e-9)).otherwise(F.lit(1.0))).alias("energy"))
    return audio.gated_loudness(blocks, ["stream_index"]).withColumn("loudness", F.round("loudness", 6))


@query(f"WITH {FRAMES} SELECT event_id, round(least(pow(10.0::DOUBLE, (-18 - (-(payload / 10))) / 20), pow(10.0::DOUBLE, (-2 - (payload / 100 - 4)) / 20)), 6) AS gain FROM f")
def linear_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = audio.gain(-(F.col("payload") / 10), F.lit(-18.0), F.col("payload") / 100 - 4, F.lit(-2.0))
    return frames(spark, sf_dir).select("event_id", F.round(g, 6).alias("gain"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    following = F.lead(F.struct("vec_id", "e")).over(Window.partitionBy("label").orderBy("vec_id"))
    return v.withColumn("next", following).where("next IS NOT NULL").select("vec_id", F.col("e").alias("a"), F.col("next.e").alias("b"))


_PAIRS = f"{VECTORS}, n AS (SELECT vec_id, e AS a, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v), pp AS (SELECT * FROM n WHERE b IS NOT NULL)"


@query(f"""WITH {_PAIRS}, d AS (SELECT vec_id, abs(floor((unnest(a) + 1) * 127.5::DOUBLE) - floor((unnest(b) + 1) * 127.5::DOUBLE)) AS d FROM pp)
SELECT vec_id, round(avg(d), 6) AS mean_diff, max(d) AS max_diff, round(100.0::DOUBLE * avg(CASE WHEN d > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS percent_above_2 FROM d GROUP BY 1""")
def correctness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: F.transform(c, lambda x: F.floor((x + 1) * 127.5).cast("double"))
    d = compare.difference(_pairs(spark, sf_dir).select("vec_id", level("a").alias("a"), level("b").alias("b")), "a", "b", ["vec_id"])
    return d.select("vec_id", F.round("mean_diff", 6).alias("mean_diff"), "max_diff", F.round("percent_above_2", 6).alias("percent_above_2"))


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1]))), 6) AS l1 FROM pp")
def vec_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(A.l1(F.col("a"), F.col("b")), 6).alias("l1"))


@query(f"WITH {_PAIRS} SELECT vec_id, list_bool_and(list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1]) <= 0.5::DOUBLE + 0.00001::DOUBLE * abs(b[i + 1]))) AS near FROM pp")
def allclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", A.all_close(F.col("a"), F.col("b"), 1e-5, 0.5).alias("near"))


@query(f"WITH {FRAMES} SELECT asset_id, stream_index, pts, payload FROM f EXCEPT ALL SELECT asset_id, stream_index, pts, CASE WHEN event_id % 7 = 0 THEN payload + 1 ELSE payload END FROM f")
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one result that the other one lacks: all are compared; in the other, one of seven has another payload."""
    f = frames(spark, sf_dir)
    fields = ["asset_id", "stream_index", "pts", "payload"]
    changed = f.withColumn("payload", F.when(F.col("event_id") % 7 == 0, F.col("payload") + 1).otherwise(F.col("payload")))
    return f.select(*fields).exceptAll(changed.select(*fields))


@query(f"WITH {VECTORS}, s AS (SELECT label, unnest(e) AS s FROM v) SELECT label, round(avg(CASE WHEN round(abs(s) * 65535) % 257 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS deep_share FROM s GROUP BY 1")
def depth_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = vectors(spark, sf_dir).select("label", F.explode("e").alias("s"))
    return each.groupBy("label").agg(F.round(F.avg(compare.deep_share(F.abs("s"))), 9).alias("deep_share"))


@query(f"WITH {VECTORS}, h AS (SELECT vec_id, unnest(range(0, 7)) AS hop, e FROM v) SELECT vec_id, hop, round(list_sum(list_transform(range(16), lambda i: e[hop * 8 + i + 1] * e[hop * 8 + i + 1])), 6) AS energy FROM h")
def hop_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = vectors(spark, sf_dir).select("vec_id", F.posexplode(audio.hops(F.col("e"), 16, 8)).alias("hop", "frame"))
    return each.select("vec_id", F.col("hop").cast("long").alias("hop"), F.round(F.aggregate("frame", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


@query("""WITH r AS (SELECT l_suppkey % 20 AS asset_id, l_partkey * 100 AS b, l_partkey * 100 + CAST(l_quantity AS BIGINT) * 2 AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY asset_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r)
SELECT asset_id, CAST(sum(greatest(0, e - greatest(b, coalesce(reached, b)))) AS BIGINT) AS covered, coalesce(min(CASE WHEN b > reached THEN reached END), max(e)) AS first_hole FROM m GROUP BY 1""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.col("l_partkey") * 100
    ranges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("asset_id"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long") * 2).alias("end"))
    return compare.first_hole(ranges, "asset_id")


@query("SELECT event_type, quantile_cont(value, 0.5) AS median_s, min(value) AS min_s, count(*) AS n_runs FROM events GROUP BY 1")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.timing(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


_TIMES = "SELECT p_brand, min(l_extendedprice) AS m FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = '{}' GROUP BY 1"


@query(f"SELECT p_brand, b.m AS base_s, h.m AS head_s, h.m / b.m AS ratio, h.m / b.m > 1.25 AS slower FROM ({_TIMES.format('N')}) b JOIN ({_TIMES.format('R')}) h USING (p_brand)")
def perf_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice").where(F.col("l_returnflag").isin("N", "R"))
    runs = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return compare.regressions(runs, "p_brand", F.when(F.col("l_returnflag") == "N", "base").otherwise("head"), "l_extendedprice")


@query("""SELECT l_suppkey, count(*) AS n_jobs, sum(l_quantity) AS n_frames, CAST(max(l_partkey + l_linenumber) - min(l_partkey) AS DOUBLE) AS wall_s, sum(l_quantity) / (max(l_partkey + l_linenumber) - min(l_partkey)) AS frames_a_second FROM lineitem GROUP BY 1""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concurrent jobs: frames a second of wall time."""
    jobs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("begin"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end"), "l_quantity")
    return compare.throughput(jobs, "l_suppkey", "begin", "end", "l_quantity")


@query(f"""WITH {FRAMES}, r AS (SELECT asset_id, stream_index, stream_type, list(pts_seconds ORDER BY pts, event_id) AS l FROM f GROUP BY 1, 2, 3)
SELECT asset_id, stream_index, stream_type, len(l) AS n_frames, l[1] AS first_pts, l[len(l)] AS last_pts FROM r""")
def decode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.collapsed(frames(spark, sf_dir)).select("asset_id", "stream_index", "stream_type", "n_frames", F.element_at("pts_list", 1).alias("first_pts"), F.element_at("pts_list", -1).alias("last_pts"))


@query("""WITH s AS (SELECT p_partkey, unnest([0, 1]) AS stream_index FROM part), p AS (SELECT * FROM part JOIN s USING (p_partkey))
SELECT p_partkey, CAST(stream_index AS INTEGER) AS stream_index, CASE stream_index WHEN 0 THEN 'video' ELSE 'audio' END AS stream_type, CASE stream_index WHEN 0 THEN p_size * 40 END AS width, CASE stream_index WHEN 0 THEN p_size * 30 END AS height,
  CASE stream_index WHEN 0 THEN round((p_partkey % 100 + 1) / (5000.0::DOUBLE / 1000), 9) END AS fps, CASE stream_index WHEN 1 THEN 8000 * CAST(p_partkey % 6 + 1 AS INTEGER) END AS sample_rate FROM p""")
def mp4_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers built from part, and read again."""
    import pyarrow as pa

    from framelake.api import probe
    from framelake.sources import headers

    def build(batches):
        for b in batches:
            made = [headers.mp4(s * 40, s * 30, k % 100 + 1, 1000, 5000, 8000 * (k % 6 + 1), 2) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in b.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    files = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(build, "path string, content binary")
    return probe(files).select(F.col("path").cast("long").alias("p_partkey"), "stream_index", "stream_type", "width", "height", F.round("fps", 9).alias("fps"), "sample_rate")


@query(f"""WITH {VECTORS}, {_CLIP} SELECT vec_id, 4 AS width, 2 AS height, 1.0::DOUBLE AS fps, {", ".join(f"CAST(list_sum(list_transform(range(0, 8), lambda i: b[i * 3 + {k + 1}] * (i + 1))) AS BIGINT) AS {c}" for k, c in enumerate(("red", "green", "blue")))} FROM b""")
def image_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A still image is one frame at a rate of one; its pixels are decoded."""
    from framelake import api
    from framelake.sources import headers

    content = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), "e")
    files = audio.kernel_rows(content, "e", lambda x: headers.png(4, 2, np.floor(np.clip((x[:24] + 1) * 127.5, 0, 255)).astype(np.uint8).tobytes()), "content binary")
    seen = api.tensors(api.decode_all(files, api.MediaDecodeRequest("", video_stream=api.VideoStreamRequest(dimension_order="NHWC"))))
    plane = lambda k: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("values", i * 3 + k) * (i + 1)), F.lit(0.0), lambda s, x: s + x).cast("long")
    return seen.select(F.col("path").cast("long").alias("vec_id"), F.get("shape", F.lit(1)).alias("width"), F.get("shape", F.lit(0)).alias("height"), "fps", plane(0).alias("red"), plane(1).alias("green"), plane(2).alias("blue"))
