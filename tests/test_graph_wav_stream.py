"""The graph compiler, WAV files and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.functions import buffers as B
from tessitura.operators import automation as A
from tessitura.operators import effects as FX
from tessitura.operators import kernels as K
from tessitura.plans import graph as G
from tessitura.sources import wav
from tessitura.streaming import live


def ramp(spark, n=10, scale=1.0):
    return spark.range(n).select(F.col("id").alias("frame"), (F.col("id") * scale).alias("x"))


def test_graph_sums_and_moves_effects(spark):
    g = G.Graph(rate=100)
    bus = g.add_bus()
    g.add_track(ramp(spark), bus)
    g.add_track(ramp(spark), bus, options=G.TrackOptions(volume=0.5, start_frame=2, fade_out=0.0))
    a = g.add_effect(bus, "double", apply=lambda s: FX.gain(s, 20 * np.log10(2)))
    b = g.add_effect(bus, "clip", apply=lambda s: s.withColumns({c: F.least(F.col(c), F.lit(4.0)) for c in "lr"}))
    out = g.compile().orderBy("frame").toPandas()
    x = np.arange(12.0)
    raw = np.where(x < 10, x, 0) + np.where(x >= 2, (x - 2) * 0.5, 0)
    assert np.allclose(out["l"], np.minimum(2 * raw, 4)) and np.allclose(out["l"], out["r"])
    g.move_effect(b, to_start=True)
    assert np.allclose(g.compile().orderBy("frame").toPandas()["l"], 2 * np.minimum(raw, 4))
    g.remove_effect(a)
    assert [e.effect_id for e in g.effects[bus]] == [b]
    assert f"effect {b} clip" in g.dump()
    assert g.levels(0.05).count() == 6


def test_graph_with_kernels_equals_the_kernel(spark):
    g = G.Graph(rate=1000)
    g.add_track(ramp(spark, 50, 0.01))
    g.add_effect(G.ROOT, "filter", kernel=K.biquad("lowpass", 100, 1000))
    g.add_effect(G.ROOT, "dc", kernel=K.dc_block(5, 1000))
    out = g.compile().orderBy("frame").toPandas()
    x = np.repeat(np.arange(50)[:, None, None] * 0.01, 2, 2)
    y, _ = K.run(K.chain(K.biquad("lowpass", 100, 1000), K.dc_block(5, 1000)), x)
    assert np.allclose(out[["l", "r"]], y[:, 0])
    # a linear run of kernels is a scan in blocks, a gate scans of its own behind a checkpoint, any other run one fold
    plan = g.compile()._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas finish") == 1 and "MapInPandas apply" not in plan
    g.add_effect(G.ROOT, "gate", kernel=K.gate(1000))
    plan = g.compile()._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas finish") == 1 and "MapInPandas apply" not in plan
    g.add_effect(G.ROOT, "delay", kernel=K.delay(1000, 10.0))
    plan = g.compile()._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas finish") == 1 and plan.count("MapInPandas apply") == 1
    out = g.compile().orderBy("frame").toPandas()
    y, _ = K.run(K.chain(K.biquad("lowpass", 100, 1000), K.dc_block(5, 1000), K.gate(1000), K.delay(1000, 10.0)), x)
    assert np.allclose(out[["l", "r"]], y[:, 0])


def test_graph_errors_and_stops(spark):
    g = G.Graph(rate=100)
    assert g.compile().count() == 0 and g.compile().columns == ["frame", "l", "r"]
    with pytest.raises(G.UnknownNode):
        g.add_bus(9)
    with pytest.raises(G.GraphError):
        g.remove_bus(G.ROOT)
    for bad in ({"volume": -1.0}, {"pan": 2.0}, {"speed": float("inf")}, {"loop": (5, 5)}):
        with pytest.raises(G.OptionError):
            G.TrackOptions(**bad)
    g.add_track(ramp(spark), options=G.TrackOptions(fade_out=0.0))
    g.add_track(ramp(spark), options=G.TrackOptions(start_frame=50))
    g.stop_all(4)
    assert g.compile().count() == 4
    with pytest.raises(G.OptionError):
        G.parameter_value("gain", "gain", 1.5)
    assert spark.range(1).select(G.parameter_value("pan", "wdth", 0.25)).first()[0] == pytest.approx(0.5)
    assert G.parameters(spark).count() == len(G.PARAMETERS)


def one_track(spark, n, options=None, rate=100, **graph):
    g = G.Graph(rate=rate, **graph)
    k = g.add_track(ramp(spark, n), options=options or G.TrackOptions())
    return g, k


def test_repeats_and_loops(spark):
    g, _ = one_track(spark, 5, G.TrackOptions(repeat=2))
    assert g.compile().orderBy("frame").toPandas()["l"].tolist() == [0, 1, 2, 3, 4] * 3
    g, _ = one_track(spark, 6, G.TrackOptions(loop=(1, 4), repeat=2))
    assert g.compile().orderBy("frame").toPandas()["l"].tolist() == [0, 1, 2, 3, 1, 2, 3, 1, 2, 3]
    g, _ = one_track(spark, 6, G.TrackOptions(loop=(1, 4), repeat=0))
    assert g.compile().count() == 6
    g, _ = one_track(spark, 6, G.TrackOptions(loop=(1, 4), stop_frame=50, fade_out=0.0))
    assert g.compile().orderBy("frame").toPandas()["l"].tolist() == [0, *([1, 2, 3] * 17)][:50]
    g, _ = one_track(spark, 6, G.TrackOptions(loop=(1, 4)))
    with pytest.raises(G.OptionError):
        g.compile()


def test_seek_and_speed_changes(spark):
    g, k = one_track(spark, 200)
    g.seek(k, 10, 1.0)  # to frame 100
    g.set_speed(k, 20, 2.0)
    got = g.compile().orderBy("frame").toPandas()
    want = np.concatenate([np.arange(10), np.arange(100, 110), np.arange(110, 198.5, 2)])
    assert got["frame"].tolist() == list(range(len(got))) and np.allclose(got["l"][: len(want) - 1], want[: len(got)][: len(want) - 1])
    g, k = one_track(spark, 2000)
    g.set_speed(k, 5, 2.0, semitones=24.0)  # 12 semitones: about half a second
    got = g.compile().orderBy("frame").toPandas()["l"].to_numpy()
    step = np.diff(got)
    speeds = A.glide_speeds(1.0, 2.0, 24.0, 100.0)
    assert np.allclose(step[:5], 1) and np.allclose(step[6:60], speeds[0], atol=0.02) and np.allclose(step[300:500], 2, atol=1e-6)
    with pytest.raises(G.OptionError):
        g.set_speed(k, 0, -1.0)
    with pytest.raises(G.UnknownNode):
        g.seek(99, 0, 0.0)


def test_pan_parameters_and_bypass(spark):
    g = G.Graph(rate=1000)
    k = g.add_track(spark.range(4000).select(F.col("id").alias("frame"), F.lit(1.0).alias("x")))
    g.set_pan(k, 2000, 1.0)
    got = g.compile().orderBy("frame").toPandas()
    assert np.allclose(got["l"][:2000], got["r"][:2000]) and got["l"].iloc[-1] < 1e-3 and got["r"].iloc[-1] > 0.9
    g = G.Graph(rate=1000)
    g.add_track(ramp(spark, 300, 0.01))
    e = g.add_parametric(G.ROOT, "filter", lambda cutoff: K.biquad("lowpass", cutoff, 1000.0), {"cutoff": 50.0})
    still = g.compile().orderBy("frame").toPandas()["l"]
    g.set_parameters(e, 100, cutoff=400.0)
    moved = g.compile().orderBy("frame").toPandas()["l"]
    assert np.allclose(still[:100], moved[:100]) and not np.allclose(still[100:], moved[100:])
    with pytest.raises(G.UnknownNode):
        g.set_parameter(e, 0, "size", 1.0)
    g.bypass(e)
    assert np.allclose(g.compile().orderBy("frame").toPandas()["l"], np.arange(300) * 0.01)


def test_kernels_ring_through_silence(spark):
    g = G.Graph(rate=1000)
    g.add_track(ramp(spark, 3, 1.0))
    g.add_track(ramp(spark, 3, 1.0), options=G.TrackOptions(start_frame=40))
    g.add_effect(G.ROOT, "filter", kernel=K.biquad("lowpass", 100, 1000))
    x = np.zeros((43, 1, 2))
    x[:3, 0], x[40:, 0] = np.arange(3.0)[:, None], np.arange(3.0)[:, None]
    assert np.allclose(g.compile().orderBy("frame").toPandas()[["l", "r"]], K.run(K.biquad("lowpass", 100, 1000), x)[0][:, 0])


def test_generators_and_builtin_effects(spark):
    g = G.Graph(rate=100)
    notes = spark.createDataFrame([(1, 0, 0, 20, 1.0, 0.5, 0.0), (2, 0, 5, None, 2.0, 0.5, 1.0)], "note_id long, buffer_id long, on_frame long, off_frame long, speed double, volume double, pan double")
    buffers = spark.createDataFrame([(0, [float(k) for k in range(50)])], "buffer_id long, samples array<double>")
    g.add_sampler(notes, buffers)
    out = g.compile().orderBy("frame").toPandas().set_index("frame")
    assert out["l"][4] == pytest.approx(2.0) and out["r"][10] == pytest.approx(5.0 + 0.5 * 10 * np.sqrt(2)) and out["l"][10] == pytest.approx(5.0)
    one = G.Graph(rate=100)
    one.add_sampler(notes, buffers, voices=1)  # the second note takes the voice of the first
    assert one.compile().orderBy("frame").toPandas().set_index("frame")["l"][10] == pytest.approx(0.0)
    g = G.Graph(rate=100)
    g.add_synth(spark, "saw", 10.0, 0.5)
    g.add_granular(notes.filter("off_frame IS NOT NULL"), buffers, density=20.0, size=50.0)
    assert g.compile().count() == 50
    g = G.Graph(rate=1000)
    g.add_track(spark.range(300).select(F.col("id").alias("frame"), F.sin(F.col("id") / 5.0).alias("x")))
    for effect in ("gain", "filter", "eq", "compressor", "gate", "delay", "chorus", "reverb"):
        g.add_builtin(G.ROOT, effect)
    e = g.add_builtin(G.ROOT, "filter", type="bandstop", cuto=100.0)
    g.set_parameter(e, 50, "cuto", 200.0)
    d = g.add_builtin(G.ROOT, "delay", mode="Ping Pong", dlay=20.0)
    g.reset_effect(d, 100)
    assert np.isfinite(g.compile().toPandas()[["l", "r"]].to_numpy()).all()
    for bad in ({"cuto": 1.0}, {"type": 9.0}):
        with pytest.raises(G.OptionError):
            G.effect_kernel("filter", 1000, **bad)
    with pytest.raises(G.UnknownNode):
        G.effect_kernel("filter", 1000, size=1.0)
    assert spark.range(1).select(G.parameter_value("delay", "mode", 1.0)).first()[0] == "Ping Pong"
    assert spark.range(1).select(G.parameter_value("delay", "lfor", 0.5)).first()[0] == pytest.approx(0.01 + 0.25 * 9.99)


def test_buses_alone_and_master_volume(spark):
    g = G.Graph(rate=1000)
    a = g.add_bus()
    b = g.add_bus(a)
    g.add_track(ramp(spark, 20), a)
    g.add_track(ramp(spark, 20, 10.0), b)
    g.add_track(ramp(spark, 20, 100.0))
    at = lambda k: g.compile(k).orderBy("frame").toPandas()["l"][2]
    assert (at(b), at(a), at(G.ROOT)) == (20.0, 22.0, 222.0)
    g.add_effect(a, "half", apply=lambda s: FX.gain(s, 20 * np.log10(0.5)))
    assert at(b) == 20.0 and np.allclose([at(a), at(G.ROOT)], [11.0, 211.0])
    assert sorted((r["bus"], r["channel"]) for r in g.levels(1.0, [a, b]).collect()) == [(a, "l"), (a, "r"), (b, "l"), (b, "r")]
    g = G.Graph(rate=44100)
    g.add_track(spark.range(3000).select(F.col("id").alias("frame"), F.lit(1.0).alias("x")))
    g.set_master(1000, 0.0), g.set_master(2000, 0.5)
    got = g.compile().orderBy("frame").toPandas()["l"].to_numpy()
    want, now, target = [], 1.0, 1.0
    for k in range(3000):
        target = {1000: 0.0, 2000: 0.5}.get(k, target)
        want.append(now)
        now += (target - now) / 256
    assert np.allclose(got, want)


def test_wav_round_trip(spark, tmp_path):
    x = np.random.default_rng(5).uniform(-1, 1, (300, 2)).astype("f4")
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes(x, 22050, (10, 200)))
    import wave

    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    about = {r["path"].rsplit("/", 1)[1]: r for r in wav.read_info(spark, str(tmp_path)).collect()}
    assert (about["a.wav"]["rate"], about["a.wav"]["frames"], about["a.wav"]["loop_start"], about["a.wav"]["loop_end"]) == (22050, 300, 10, 200)
    signal = wav.as_signal(wav.read_frames(spark, str(tmp_path), 128))
    a = signal.filter("path LIKE '%a.wav'").orderBy("frame").toPandas()
    assert np.array_equal(a[["l", "r"]].to_numpy("f4"), x)
    assert signal.filter("path LIKE '%b.wav'").orderBy("frame").toPandas()["r"].tolist() == [0.0, 0.5, -1.0]
    back = wav.rendered(signal.filter("path LIKE '%a.wav'"), "path", 22050).first()["content"]
    assert np.array_equal(wav.samples(bytes(back))[0].astype("f4"), x)
    with pytest.raises(wav.WavError):
        wav.info(b"no wav")
    part = wav.read_frames(spark, f"{tmp_path}/a.wav", 64, 100, 150).orderBy("first_frame").collect()
    assert [r["first_frame"] for r in part] == [100, 164, 228] and sum(len(r["samples"]) for r in part) == 300
    assert np.array_equal(np.concatenate([r["samples"] for r in part]).astype("f4"), x[100:250].ravel())
    seen = []
    data = (tmp_path / "a.wav").read_bytes()
    wav.header(lambda at, n: seen.append(n) or data[at : at + n], len(data))
    assert sum(seen) < 200  # heads and small chunks alone
    two = signal.filter("path LIKE '%a.wav'").select(F.lit("left").alias("key"), "frame", "l", "r").unionByName(signal.filter("path LIKE '%b.wav'").select(F.lit("right").alias("key"), "frame", "l", "r"))
    two.repartition(2, "key").sortWithinPartitions("key", "frame").write.format("wav").option("rate", 22050).mode("append").save(f"{tmp_path}/out")
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["left.wav", "right.wav"]
    assert np.array_equal(wav.samples((tmp_path / "out" / "left.wav").read_bytes())[0].astype("f4"), x)
    assert {r["frames"] for r in wav.read_info(spark, f"{tmp_path}/out").collect()} == {300, 3}


def aiff(x: np.ndarray, bits: int, rate: int, code: bytes | None = None) -> bytes:
    """A file as its description says, byte by byte."""
    import struct

    power = rate.bit_length() - 1
    exact = struct.pack(">HQ", 16383 + power, rate << (63 - power))
    if code in (b"fl32",):
        body = x.astype(">f4").tobytes()
    else:
        whole = np.round(x * (1 << (bits - 1))).astype(np.int64)
        body = b"".join(int(v).to_bytes(bits // 8, "little" if code == b"sowt" else "big", signed=True) for v in whole.ravel())
    common = struct.pack(">HIH", x.shape[1], len(x), bits) + exact + (code + b"\0\0" if code else b"")
    parts = [b"COMM" + struct.pack(">I", len(common)) + common, b"SSND" + struct.pack(">III", len(body) + 8, 0, 0) + body]
    inner = (b"AIFC" if code else b"AIFF") + b"".join(parts)
    return b"FORM" + struct.pack(">I", len(inner)) + inner


@pytest.mark.parametrize(("bits", "code"), [(8, None), (16, None), (24, None), (32, None), (16, b"sowt"), (32, b"fl32")])
def test_aiff(spark, tmp_path, bits, code):
    x = np.array([[0.0, 0.5], [-1.0, 0.25], [-0.5, 0.125]])
    (tmp_path / "a.aiff").write_bytes(aiff(x, bits, 44100, code))
    got, about = wav.samples((tmp_path / "a.aiff").read_bytes())
    assert np.array_equal(got, x) and (about["rate"], about["frames"], about["channels"]) == (44100, 3, 2)
    if bits == 24:
        assert [r["r"] for r in wav.as_signal(wav.read_frames(spark, str(tmp_path))).orderBy("frame").collect()] == [0.5, 0.25, 0.125]
        assert wav.read_info(spark, str(tmp_path)).first()["rate"] == 44100


def test_streaming_fold_equals_batch(spark, tmp_path):
    x = np.random.default_rng(6).normal(0, 1, 60)
    kernel = K.biquad("lowpass", 20, 100)
    for k in range(3):
        pd.DataFrame({"track_id": 7, "frame": np.arange(20 * k, 20 * k + 20), "x": x[20 * k : 20 * k + 20]}).sample(frac=1, random_state=k).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("track_id long, frame long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = live.fold(stream, "track_id", kernel, ["x"]).writeStream.format("memory").queryName("folded").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    got = spark.table("folded").orderBy("frame").toPandas()
    assert not got["late"].any() and np.allclose(got["x"], K.run(kernel, x[:, None, None])[0][:, 0, 0])


def test_late_frames_are_passed_on(spark, tmp_path):
    kernel = K.biquad("lowpass", 20, 100)
    for k, frames in enumerate(([0, 1, 4], [2, 5])):
        pd.DataFrame({"track_id": 7, "frame": np.array(frames), "x": [10.0 * f for f in frames]}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("track_id long, frame long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = live.fold(stream, "track_id", kernel, ["x"]).writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    got = {r["frame"]: r for r in spark.table("late").collect()}
    assert sorted(got) == [0, 1, 2, 4, 5] and [f for f, r in got.items() if r["late"]] == [2] and got[2]["x"] == 20.0
    want = K.run(kernel, np.array([0.0, 10, 40, 50])[:, None, None])[0][:, 0, 0]
    assert np.allclose([got[f]["x"] for f in (0, 1, 4, 5)], want)


def test_streaming_meter_and_late_events(spark, tmp_path):
    t = pd.date_range("2024-01-01", periods=40, freq="1s", tz="UTC")
    pd.DataFrame({"track_id": 1, "ts": t.astype("datetime64[us, UTC]"), "x": np.arange(40.0)}).to_parquet(tmp_path / "a.parquet")
    stream = spark.readStream.schema("track_id long, ts timestamp, x double").parquet(str(tmp_path))
    for name, df in (("levels", live.meter(stream, "track_id", "10 seconds", "1 second")), ("active", live.activity(stream, "track_id", "5 seconds", "1 second"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "levels" else "append").start()
        q.processAllAvailable()
        if name == "active":
            assert spark.table("active").count() == 0  # the session is open until the watermark passes
            later = pd.date_range("2024-01-01 00:05", periods=1, freq="1s", tz="UTC")
            pd.DataFrame({"track_id": 2, "ts": later.astype("datetime64[us, UTC]"), "x": [0.0]}).to_parquet(tmp_path / "b.parquet")
            q.processAllAvailable()
        q.stop()
    assert sorted(r["peak"] for r in spark.table("levels").collect()) == [9.0, 19.0, 29.0, 39.0]
    closed = spark.table("active").collect()
    assert [(r["track_id"], r["n"], (r["end"] - r["start"]).total_seconds()) for r in closed] == [(1, 40, 44.0)]
    late = spark.createDataFrame([(5, 64), (100, 64)], "sample_time long, block_start long")
    assert [r["effective_time"] for r in live.effective(late).collect()] == [64, 100]


def test_blocks_of_odd_length_are_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "s array<double>")
    with pytest.raises(Exception, match="channels"):
        df.select(B.plane(F.col("s"), 0, 2)).collect()
    with pytest.raises(Exception, match="length"):
        df.select(B.added(F.col("s"), F.array(F.lit(1.0)))).collect()
    empty = spark.createDataFrame([([],)], "s array<double>")
    assert empty.select(B.max_abs(F.col("s"))).first()[0] == 0.0
