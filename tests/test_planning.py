"""Fixed values of the planners."""

import pytest
from pyspark.sql import functions as F

from framelake.api import AudioStreamRequest, LoudnessNormalization, MediaDecodeRequest, S3Config, VideoStreamRequest
from framelake.functions import arrays, planning
from framelake.operators.timeline import pts_seconds


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


def test_seconds(spark):
    assert [value(spark, pts_seconds(lit(p, "long"), 1, 25)) for p in (0, 25, 50, 100, -25)] == [0, 1, 2, 4, -1]


@pytest.mark.parametrize(("window", "seconds"), [((10, None, None), 10), ((10, None, 5), 5), ((10, 2, 5), 3), ((10, 2, None), 8), ((10, 15, None), None), ((10, 15, 5), None), ((None, None, None), None)])
def test_duration(spark, window, seconds):
    assert value(spark, planning.effective_duration(*map(lit, window))) == seconds


@pytest.mark.parametrize(("size", "wanted", "out"), [((1920, 1080), (None, None), (None, None)), ((1920, 1080), (512, 288), (512, 288)), ((1920, 1080), (640, None), (640, 360)), ((1920, 1080), (None, 360), (640, 360)), ((1920, 1080), (511, 287), (510, 286)), ((640, 480), (1280, 960), (None, None))])
def test_hardware_size(spark, size, wanted, out):
    w, h = planning.hardware_size(*(lit(x, "long") for x in (*size, *wanted)))
    assert (value(spark, w), value(spark, h)) == out


@pytest.mark.parametrize(("transfer", "primaries", "hdr"), [("arib-std-b67", "bt2020", True), ("smpte2084", "bt2020", True), (None, "bt2020", True), ("bt709", "bt709", False), (None, None, False), ("unknown", "unspecified", False)])
def test_hdr(spark, transfer, primaries, hdr):
    assert value(spark, planning.is_hdr(lit(transfer, "string"), lit(primaries, "string"))) is hdr


def test_specs(spark):
    spec = lambda fps, w, h, hdr: value(spark, planning.video_spec(lit(fps), lit(w, "int"), lit(h, "int"), F.lit(hdr), F.lit("uint8")))
    hable = "zscale=t=linear:npl=100,format=gbrpf32le,tonemap=hable:desat=0,zscale=p=bt709:t=bt709:m=bt709:range=tv,"
    assert spec(30, 640, 480, False) == "fps=30,scale=width=640:height=480,format=pix_fmts=rgb24"
    assert spec(None, None, None, False) == "format=pix_fmts=rgb24" and spec(None, None, None, True) == hable + "format=pix_fmts=rgb24"
    assert spec(30, 640, 480, True) == "fps=30,scale=width=640:height=480," + hable + "format=pix_fmts=rgb24"
    audio = lambda loud, rate: value(spark, planning.audio_spec(lit(loud, "string"), lit(rate, "int")))
    assert (audio(None, 44100), audio(None, None), audio("loudnorm=I=-18:LRA=7:TP=-1", 44100)) == ("aresample=44100", "anull", "loudnorm=I=-18:LRA=7:TP=-1,aresample=44100")
    full = LoudnessNormalization(integrated_loudness_target=-23, loudness_range_target=5, true_peak_level_target=-2, measured_integrated_loudness=-30, measured_loudness_range=10, measured_true_peak_level=-2, measured_threshold=-40, offset_gain=0, linear=True, dual_mono=True)
    assert full.spec() == "loudnorm=I=-23:LRA=5:TP=-2:measured_I=-30:measured_LRA=10:measured_TP=-2:measured_thresh=-40:offset=0:linear=true:dual_mono=true"
    assert LoudnessNormalization().spec() == "loudnorm="


def test_uris(spark):
    parsed = lambda u: tuple(value(spark, f(F.lit(u))) for f in (planning.route, planning.bucket, planning.object_key, planning.uri_status))
    assert parsed("gs://bucket/nested/object") == ("gcs", "projects/_/buckets/bucket", "nested/object", "ok")
    assert parsed("gs://bucket")[2:] == ("", "ok") and parsed("gs://")[3] == "no bucket"
    assert parsed("s3://my_bucket/nested/object.mp4") == ("s3", "my_bucket", "nested/object.mp4", "ok")
    assert parsed("s3://bucket-without-key")[3] == "no key" and parsed("S3://b/k")[0] == "file"
    may = ("/a/b", "a b.wav", "a,b:c", "file:/a", "https://x", "crypto:https://x", "crypto+file:/a")
    not_allowed = ("concat://a", "ftp://a", "concat:https://a", "concat:/a|/b", "subfile,,start,0,end,9,,:/etc/passwd", "data:audio/wav;base64,UklG", "HTTP://x", "crypto:concat:/a", "pipe:0", "gs://b/k")
    assert [value(spark, planning.allowed(F.lit(u))) for u in may] == [True] * len(may)
    assert [value(spark, planning.allowed(F.lit(u))) for u in not_allowed] == [False] * len(not_allowed)


def test_credentials(spark):
    found = lambda *x: value(spark, planning.credentials(*(lit(v, "string") for v in x)))
    assert [found("i", "s", "t", None), found(None, None, None, None), found(None, None, None, "container")] == ["static", "default", "container"]
    assert all(found(*x).startswith("error") for x in ((None, None, None, "bogus"), ("i", None, None, None), (None, None, "t", None), ("i", "s", None, "default")))
    with pytest.raises(ValueError):
        S3Config(access_key_id="i").hadoop_options("b")
    config = S3Config(access_key_id="i", secret_access_key="hidden", endpoint_url="http://e", force_path_style=True)
    assert "hidden" not in repr(config) and config.hadoop_options("b")["fs.s3a.bucket.b.path.style.access"] == "true"


def test_capacities(spark):
    frames = lambda s, f: value(spark, planning.frame_capacity(lit(s), lit(f)))
    assert frames(2.0, 24.0) == 48 and frames(2.5, 1.0) == 2 and frames(50 * 1001 / 24000, 24000 / 1001) == 50
    assert value(spark, planning.sample_capacity(lit(2.0), lit(16000, "int"))) == 32000 and value(spark, planning.sample_capacity(lit(-1.0), lit(1, "int"))) is None


def test_requests():
    assert VideoStreamRequest(width=4) == VideoStreamRequest(width=4) and AudioStreamRequest(index=1) != AudioStreamRequest()
    assert MediaDecodeRequest("a.wav").video_stream is None
    for bad in ({"dtype": "int8"}, {"dimension_order": "CHW"}, {"device": "gpu"}, {"device": "cuda:x"}):
        with pytest.raises(ValueError):
            VideoStreamRequest(**bad)
    with pytest.raises(ValueError, match="cannot be combined with hardware_acceleration=false"):
        VideoStreamRequest(device="cuda", hardware_acceleration=False)


def test_curves(spark):
    assert abs(value(spark, arrays.pq_to_linear(lit(0.5080784))) * 10000 - 100) < 0.5  # 100 cd/m2 by the standard
    assert abs(value(spark, arrays.hlg_to_linear(lit(0.5))) - 1 / 12) < 1e-9 and abs(value(spark, arrays.hlg_to_linear(lit(1.0))) - 1) < 1e-6
    assert value(spark, arrays.hable(lit(0.0))) == pytest.approx(0) and value(spark, arrays.tone_mapped(lit(10.0))) == pytest.approx(1)
