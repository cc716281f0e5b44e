"""Sources on files that are built here."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import api
from framelake.functions import signal
from framelake.sources import containers, flac, headers, pixels, wav
from framelake.streaming.arrival import arriving, sessions, windowed_rates


def tone(rate, seconds, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    return np.repeat(np.sin(2 * np.pi * 440 * t)[:, None] * 0.5, channels, axis=1).ravel()


def test_wav_window_reaches_the_reader(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(tone(16000, 3), 16000))
    (tmp_path / "b.wav").write_bytes(b"RIFF cut")
    spark.dataSource.register(wav.WavSource)
    rows = spark.read.format("wav_frames").option("split", 8 * 2048).load(str(tmp_path / "*.wav"))
    all_ = rows.where("error IS NULL").orderBy("frame_index").collect()
    assert sum(r.nb_samples for r in all_) == 48000 and [r.frame_index for r in all_] == list(range(47))
    assert np.allclose([x for r in all_ for x in r.fdata], tone(16000, 3), atol=1e-4)
    assert [r.path.endswith("b.wav") for r in rows.where("error IS NOT NULL").collect()] == [True]
    some = rows.where("pts_seconds >= 1.0 AND pts_seconds < 2.0").orderBy("frame_index").collect()
    assert some == [r for r in all_ if 1 <= r.pts_seconds < 2]
    reader = wav.WavReader(str(tmp_path / "a.wav"), 8 * 2048)
    list(reader.pushFilters([wav.GreaterThanOrEqual(("pts_seconds",), 1.0), wav.LessThan(("pts_seconds",), 2.0)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 20
    by_uri = wav.WavReader(f"file://{tmp_path}", 1 << 20)
    assert sum(b.num_rows for p in by_uri.partitions() for b in by_uri.read(p)) == 48


def arrays(rows):
    return {(r.path, r.request_id, r.stream_type, r.frame_index): (r, None if r.error else np.frombuffer(r.data, r.dtype).reshape(r["shape"])) for r in rows}


def test_audio_of_many_assets(spark):
    files = spark.createDataFrame([("a", wav.encode(tone(48000, 2, 2), 48000, 2)), ("b", b"RIFFjunk"), ("c", None), ("f", flac.encode((tone(32000, 2) * 30000).astype(int)[None], 32000))], "path string, content binary")
    found = arrays(api.decode_audio(files, sample_rate=16000).collect())
    a = found["a", 0, "audio", 0][1]
    assert a.shape == (2, 32000) and (a[0] == a[1]).all() and found["f", 0, "audio", 0][1].shape == (1, 32000)
    assert np.abs(a[0, 1000:-1000] - tone(16000, 2)[1000:-1000]).max() < 2e-3
    assert found["b", 0, "audio", None][0].error and found["c", 0, "audio", None][0].error
    late = arrays(api.decode_audio(files.where("path = 'a'"), start_time=0.5, end_time=1.0).collect())
    assert late["a", 0, "audio", 0][1].shape == (2, 24000)
    loud = api.LoudnessNormalization(integrated_loudness_target=-18, true_peak_level_target=-2, loudness_range_target=7)
    x = arrays(api.decode_audio(files.where("path = 'a'"), sample_rate=16000, loudness_normalization=loud).collect())["a", 0, "audio", 0][1]
    assert x.shape == (2, 32000) and abs(signal.loudness(x.astype(float), 16000)["integrated"] + 18) < 0.1


def clip(frames, fps=(30, 1), height=6, width=8):
    return headers.y4m(width, height, fps, [bytes([16 + 2 * k] * (width * height) + [128] * (2 * width * height)) for k in range(frames)])


def test_requests_for_video(spark):
    V, R = api.VideoStreamRequest, api.MediaDecodeRequest
    content = {"a": clip(60), "n": clip(50, (24000, 1001)), "i": headers.png(4, 2, bytes(range(24))), "w": wav.encode(tone(8000, 1), 8000), "x": b"junk"}
    files = spark.createDataFrame(list(content.items()), "path string, content binary")
    requests = [R("a", video_stream=V()), R("a", video_stream=V(fps=24.0)), R("a", start_time=0.5, end_time=1.0, video_stream=V(width=4, height=3, dtype="float32", dimension_order="NHWC")), R("n", video_stream=V()), R("i", video_stream=V()), R("w", video_stream=V(), audio_streams=[api.AudioStreamRequest(), api.AudioStreamRequest(sample_rate=4000)]), R("x", video_stream=V()), R("a"), R("a", video_stream=V(index=3)), R("a", start_time=5.0, video_stream=V(width=4))]
    decoded = api.decode(files, api.requests_of(spark, requests))
    assert "BroadcastHashJoin" in decoded._jdf.queryExecution().executedPlan().toString()
    rows = decoded.collect()
    by = {}
    for r in rows:
        by.setdefault(r.request_id, []).append(r)
    count = {k: len(v) for k, v in by.items()}
    assert count == {0: 60, 1: 48, 2: 15, 3: 50, 4: 1, 5: 2, 6: 1, 8: 1, 9: 1}
    found = arrays(rows)
    first, x = found["a", 0, "video", 0]
    assert x.shape == (3, 6, 8) and x.dtype == np.uint8 and (x == 0).all() and first.fps == 30.0
    assert [r.pts_seconds for r in sorted(by[0], key=lambda r: r.frame_index)][:2] == [0, 1 / 30]
    r, x = found["a", 2, "video", 0]
    assert x.shape == (3, 4, 3) and x.dtype == np.float32 and r.pts_seconds == 0.5 and 0 < x.max() < 1
    assert found["i", 4, "video", 0][1].transpose(1, 2, 0).tobytes() == bytes(range(24))
    assert found["w", 5, "video", None][0].error == "no video stream" and found["w", 5, "audio", 0][1].shape == (1, 8000)
    assert by[6][0].error and by[8][0].error and by[9][0].error == "start after end"


def test_one_asset(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(clip(10))
    path = str(tmp_path / "a.y4m")
    (result,) = api.decode_asset(api.MediaDecodeRequest(path, video_stream=api.VideoStreamRequest()))
    same = api.decode_asset(api.MediaDecodeRequest(clip(10), video_stream=api.VideoStreamRequest()))[0]
    assert result["data"].shape == (10, 3, 6, 8) and (result["data"] == same["data"]).all() and result["stream_type"] is api.StreamType.Video
    assert np.allclose(np.diff(result["pts"]), 1 / 30)
    assert api.probe_asset(path) == {"video_streams": [{"index": 0, "width": 8, "height": 6, "fps": 30.0}], "audio_streams": []}
    assert api.probe_asset(wav.encode(tone(8000, 1), 8000))["audio_streams"] == [{"index": 0, "sample_rate": 8000}]
    assert api.decode_asset(api.MediaDecodeRequest(path)) == []
    for bad in (str(tmp_path / "none"), "concat:/a|/b", "gs://", "s3://b"):
        with pytest.raises(ValueError):
            api.decode_asset(api.MediaDecodeRequest(bad, video_stream=api.VideoStreamRequest()))


def test_http(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "a.wav").write_bytes(wav.encode(tone(8000, 1), 8000))
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.wav"
    found = {r.path: r for r in api.fetched(spark.createDataFrame([(url,), (url + "x",), ("concat:" + url,)], "path string")).collect()}
    assert found[url].length == 16044 and found[url + "x"].error and found["concat:" + url].error
    assert api.fetched(spark.createDataFrame([(url,)], "path string"), most_bytes=100).first().error == "too large"
    assert api.decode_asset(api.MediaDecodeRequest(url, audio_streams=[api.AudioStreamRequest()]))[0]["data"].shape == (1, 8000)
    server.shutdown()


def test_cut_files_are_errors(spark):
    whole = {"wav": wav.encode(tone(8000, 0.01), 8000), "png": headers.png(4, 2, bytes(range(24))), "mp4": headers.mp4(640, 480, 150, 1000, 5000, 44100, 2), "y4m": clip(2), "ppm": b"P6\n4 2\n255\n" + bytes(24), "flac": flac.encode(np.arange(60)[None] * 7, 8000), "bmp": b"BM" + bytes(40)}
    cut = [(f"{k}-{n}", v[:n]) for k, v in whole.items() for n in range(len(v))]
    noise = random.Random(4)
    cut += [(f"{k}~{n}", bytes(noise.randrange(256) if noise.random() < 0.05 else b for b in v)) for k, v in whole.items() for n in range(30)]
    cut += [("no rate", b"YUV4MPEG2 W4 H2\n"), ("no channels", whole["wav"][:22] + bytes(2) + whole["wav"][24:])]
    files = spark.createDataFrame(cut, "path string, content binary").repartition(4)
    assert {r.path for r in api.probe(files).select("path").collect()} >= {k for k, _ in cut if not k.startswith("mp4")}
    asked = api.requests_of(spark, [api.MediaDecodeRequest(k, video_stream=api.VideoStreamRequest(), audio_streams=[api.AudioStreamRequest()]) for k, _ in cut])
    assert {r.path for r in api.decode(files, asked).select("path").collect()} == {k for k, _ in cut}


def test_images():
    rgb = bytes(range(24))
    assert pixels.decode(headers.png(4, 2, rgb)).tobytes() == rgb and pixels.decode(b"P6 # c\n4 2\n255\n" + rgb).tobytes() == rgb
    rows = [rgb[:12], rgb[12:]]
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 24, 0, 54, 40, 4, 2, 1, 24, 0, 24, 0, 0, 0, 0) + b"".join(bytes(r[k + 2 - j] for k in range(0, 12, 3) for j in range(3)) for r in rows[::-1])
    assert pixels.decode(bmp).tobytes() == rgb
    r = np.random.default_rng(3)
    for how in range(5):
        line, above = r.integers(0, 256, 12).astype(np.uint8), r.integers(0, 256, 12).astype(np.uint8)
        out = pixels.unfiltered(how, line, above, 3).astype(int)
        for i in range(12):
            a, b, c = (out[i - 3] if i >= 3 else 0), int(above[i]), (int(above[i - 3]) if i >= 3 else 0)
            near = min((a, b, c), key=lambda v: abs(a + b - c - v))
            assert (out[i] - (0, a, b, (a + b) // 2, near)[how]) % 256 == line[i]


def test_flac_round_trip():
    r = np.random.default_rng(1)
    for shape in ((2, 9000), (1, 1), (3, 70)):
        x = np.clip(np.cumsum(r.normal(0, 300, shape), axis=1), -30000, 30000).astype(np.int64)
        planes, rate, block = flac.decode(flac.encode(x, 32000))
        assert (planes * 32768 == x).all() and rate == 32000 and block == 4096


def test_signals():
    t = np.arange(48000 * 4) / 48000
    sine = lambda f: np.sin(2 * np.pi * f * t)[None]
    assert abs(signal.loudness(sine(997.0), 48000)["integrated"] + 3.01) < 0.02  # of the standard: a full-scale sine in one channel
    assert abs(signal.loudness(0.1 * sine(997.0), 48000)["true_peak"] + 20) < 0.05 and signal.loudness(0 * sine(1.0), 48000)["integrated"] == -np.inf
    b1, a1, b2, a2 = signal.k_coefficients(48000)
    assert np.allclose(b1, (1.53512485958697, -2.69169618940638, 1.19839281085285)) and np.allclose(a1, (-1.69065929318241, 0.73248077421585)) and np.allclose(a2, (-1.99004745483398, 0.99007225036621))
    x = np.random.default_rng(2).normal(size=(1, 40000))
    direct = np.convolve(x[0, :9000], signal.k_response(48000))[:8000]
    assert np.allclose(signal.k_weighted(x, 48000)[0, :8000], direct)
    high = signal.sinc_resampled(sine(15000.0), 48000, 16000)  # above what the lower rate can hold
    assert np.abs(high[:, 200:-200]).max() < 0.01 and signal.sinc_resampled(sine(100.0), 48000, 44100).shape == (1, 176400)
    power = signal.mel_spectrogram(sine(1000.0)[0], 48000)
    assert power.shape == (128, (192000 - 2048) // 512 + 1) and abs(signal.mel_points(48000, 128)[int(power[:, 9].argmax()) + 1] - 1000) < 50
    image = np.arange(48, dtype=np.uint8).reshape(3, 4, 4)
    assert signal.scaled(image, 4, 4) is image and (signal.scaled(np.full((3, 5, 7), 9, np.uint8), 3, 4) == 9).all()
    assert (signal.scaled(image, 2, 2)[:, 0, 0] == np.floor(image[:, :2, :2].mean((1, 2)) + 0.5)).all()
    x, y = np.random.default_rng(5).normal(size=(2, 8, 8)), np.zeros((2, 5, 11))
    for i in range(5):
        for j in range(11):
            down = np.clip(np.minimum((i + 1) * 1.6, np.arange(8) + 1) - np.maximum(i * 1.6, np.arange(8)), 0, None) / 1.6
            across = np.clip(np.minimum((j + 1) * 8 / 11, np.arange(8) + 1) - np.maximum(j * 8 / 11, np.arange(8)), 0, None) * 11 / 8
            y[:, i, j] = down @ x @ across
    assert np.allclose(signal.scaled(x, 5, 11), y)


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("weights", [(0.2126, 0.0722), (0.299, 0.114)])
def test_all_samples_as_in_double_precision(weights, full):
    red, blue = weights
    n = np.arange(256, dtype=np.uint8)
    for u in range(256):
        y, v = np.meshgrid(n, n)
        luma = y.astype(float) if full else (y.astype(float) - 16) * (255 / 219)
        scale = 1.0 if full else 255 / 224
        cb, cr = (u - 128) * scale, (v.astype(float) - 128) * scale
        r, b = luma + 2 * (1 - red) * cr, luma + 2 * (1 - blue) * cb
        g = (luma - red * r - blue * b) / (1 - red - blue)
        # where double precision itself can't tell a half, either neighbour may come out
        for x, out in zip((r, g, b), containers.to_rgb(y, np.full_like(y, u), v, red, blue, full)):
            off = np.abs(np.clip(np.floor(x + 0.5), 0, 255) - out)
            assert (off[np.abs(x + 0.5 - np.round(x + 0.5)) > 1e-5] == 0).all() and off.max() <= 1


def test_pcm_formats():
    x = np.array([-1.0, -0.5, 0, 0.25, 0.75])
    assert np.allclose(wav.samples_of((x * 128 + 128).clip(0, 255).astype(np.uint8).tobytes(), 1, 8), x, atol=1e-2)
    assert np.allclose(wav.samples_of((x * 2**31).clip(-(2**31), 2**31 - 1).astype("<i4").tobytes(), 1, 32), x, atol=1e-5)
    assert np.allclose(wav.samples_of(x.astype("<f4").tobytes(), 3, 32), x) and np.allclose(wav.samples_of(x.astype("<f8").tobytes(), 3, 64), x)
    three = b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)
    assert np.allclose(wav.samples_of(three, 1, 24), x)


def test_probe(spark):
    rgb = bytes(range(24))
    content = {
        "wav": wav.encode(tone(44100, 1, 2), 44100, 2),
        "png": headers.png(4, 2, rgb),
        "mp4": headers.mp4(640, 480, 150, 1000, 5000, 44100, 2),
        "y4m": headers.y4m(4, 2, (24000, 1001), [bytes(24)] * 3),
        "ppm": b"P6\n4 2\n255\n" + rgb,
        "bad": b"nothing known",
    }
    files = spark.createDataFrame(list(content.items()), "path string, content binary")
    found = {(r.path, r.stream_type): r for r in api.probe(files).collect()}
    assert (found["mp4", "video"].width, found["mp4", "video"].fps, found["mp4", "audio"].sample_rate) == (640, 30.0, 44100)
    assert found["wav", "audio"].nb_frames == 44100 and found["png", "video"].fps == 1.0 and found["ppm", "video"].height == 2
    assert found["y4m", "video"].nb_frames == 3 and abs(found["y4m", "video"].fps - 23.976) < 1e-3 and found["bad", None].error


def test_headers_of_files(spark, tmp_path):
    mp4 = headers.mp4(640, 480, 150, 1000, 5000, 44100, 2)
    late = mp4[:16] + headers.box(b"mdat", bytes(200_000)) + mp4[16:]  # the tracks are told at the end
    whole = {"a.wav": wav.encode(tone(44100, 1, 2), 44100, 2), "b.png": headers.png(4, 2, bytes(24)), "c.mp4": mp4, "d.y4m": clip(70), "e.flac": flac.encode(np.arange(60)[None] * 7, 8000), "f.bad": b"nothing", "g.mp4": mp4[:40], "h.wav": b"RIFF"}
    for name, content in {**whole, "z.mp4": late}.items():
        (tmp_path / name).write_bytes(content)
    rows = api.probe_files(spark, str(tmp_path)).collect()
    by_content = api.probe(spark.createDataFrame([(str(tmp_path / k), v) for k, v in whole.items()], "path string, content binary")).collect()
    assert sorted(map(str, as_of_rows(rows, "z.mp4"))) == sorted(map(str, as_of_rows(by_content, "z.mp4")))
    assert {(r.stream_type, r.width, r.sample_rate) for r in rows if r.path.endswith("z.mp4")} == {("video", 640, None), ("audio", None, 44100)}


def as_of_rows(rows, without):
    return [(*tuple(r)[:-1], r.error is None) for r in rows if not r.path.endswith(without)]


def test_images_are_red_first(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(headers.png(2, 1, bytes([255, 0, 0, 1, 2, 3])))
    (tmp_path / "b.png").write_bytes(b"broken")
    assert [bytes(r.data) for r in api.images(spark, str(tmp_path)).collect()] == [bytes([255, 0, 0, 1, 2, 3])]


def test_size_guard_and_y4m(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"x")
    (tmp_path / "large").write_bytes(b"x" * 100)
    assert [r.length for r in api.assets(spark, str(tmp_path), most_bytes=10).collect()] == [1]
    gray = bytes([126] * 8 + [128] * 16)
    (planes,) = containers.y4m_planes(headers.y4m(4, 2, (30, 1), [gray]))
    assert containers.to_rgb(*planes).shape == (3, 2, 4) and (containers.to_rgb(*planes) == 128).all()
    sub = list(containers.y4m_planes(headers.y4m(4, 2, (30, 1), [bytes(12)] * 2, "420jpeg")))
    assert len(sub) == 2 and sub[0][1].shape == (2, 4)


def test_arriving_frames(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("asset_id"), F.lit(0).alias("stream_index"), F.timestamp_seconds(F.col("id") * 120).alias("ts"), F.col("id").cast("double").alias("payload"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_rates(arriving(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n_frames")).first()[0] == 100
    q = sessions(arriving(spark, str(tmp_path / "in"), rows.schema), gap="3 minutes").writeStream.format("memory").queryName("runs").outputMode("complete").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("runs").agg(F.sum("n_frames")).first()[0] == 100
