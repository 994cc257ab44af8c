"""Properties of recursive kernels, folds and scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessitura.operators import folds as FO
from tessitura.operators import kernels as K
from tessitura.operators import synthesis as Y

RATE = 8000.0
KERNELS = {
    "biquad": K.biquad("lowpass", 500, RATE), "svf": K.svf("bandpass", 500, RATE, 0.3), "dc": K.dc_block(5, RATE), "eq": K.eq5((3, -3, 1, 2, -2), (100, 300, 900, 1500, 3000), rate=RATE),
    "compressor": K.compressor(RATE, look=0.002), "limiter": K.compressor(RATE, ratio=20, knee=0, look=0.002), "gate": K.gate(RATE), "delay": K.delay(RATE, 5.0, 0.5, 0.3, 800.0, lfo_hz=2, to_time=0.05),
    "ping": K.delay(RATE, 5.0, 0.5, ping_pong=True, cutoff=3000.0), "chorus": K.chorus(RATE), "reverb": K.reverb(RATE), "feedback": K.feedback_delay(7.5, 0.6), "allpass": K.allpass(5),
}


@pytest.mark.parametrize("name", KERNELS)
def test_blocks_dont_matter(name):
    x = np.random.default_rng(1).normal(0, 0.3, (200, 3, 2))
    whole, _ = K.run(KERNELS[name], x)
    state, parts = None, []
    for part in (x[:1], x[1:64], x[64:65], x[65:]):
        y, state = K.run(KERNELS[name], part, state)
        parts.append(y)
    assert np.allclose(whole, np.concatenate(parts), atol=1e-12)


@pytest.mark.parametrize("name", KERNELS)
def test_silence_and_bounds(name):
    y, _ = K.run(KERNELS[name], np.zeros((50, 1, 2)))
    assert np.abs(y).max() < 1e-9
    y, _ = K.run(KERNELS[name], np.random.default_rng(2).uniform(-1, 1, (2000, 1, 2)))
    assert np.isfinite(y).all() and np.abs(y).max() < 50


def test_filters_on_a_constant():
    x = np.full((4000, 1, 1), 0.5)
    assert abs(K.run(K.biquad("lowpass", 500, RATE), x)[0][-1, 0, 0] - 0.5) < 1e-6
    for kernel in (K.biquad("highpass", 500, RATE), K.svf("highpass", 500, RATE), K.dc_block(20, RATE)):
        assert abs(K.run(kernel, x)[0][-1, 0, 0]) < 1e-3
    with pytest.raises(ValueError):
        K.biquad("lowpass", RATE, RATE)


def test_symmetric_effects_commute_with_a_channel_swap():
    x = np.random.default_rng(3).normal(0, 0.3, (300, 1, 2))
    for name in ("biquad", "compressor", "gate", "feedback"):
        y, z = K.run(KERNELS[name], x)[0], K.run(KERNELS[name], x[:, :, ::-1])[0]
        assert np.allclose(y, z[:, :, ::-1])


def test_lookahead_of_a_spike():
    x = np.zeros((40, 1, 2))
    x[10] = 1.0
    y, _ = K.run(K.compressor(1000.0, threshold=-6.0, ratio=20, knee=0, attack=0.0, release=0.0, makeup=0.0, look=0.008), x)
    assert np.flatnonzero(np.abs(y[:, 0, 0]) > 1e-9).tolist() == [18]
    assert y[18, 0, 0] == pytest.approx(1.0, abs=0.01) or y[18, 0, 0] == pytest.approx(10 ** (-6 / 20), abs=0.01)


def test_reverb_depends_on_its_seed_alone():
    x = np.zeros((5000, 1, 2))
    x[0] = 1.0
    a, b, c = (K.run(K.reverb(RATE, seed=s), x)[0] for s in (1, 1, 2))
    assert np.array_equal(a, b) and not np.array_equal(a, c)
    assert np.abs(a[1000:]).max() > 1e-6


def test_fold_and_scan_agree_on_a_long_track(spark):
    x = np.random.default_rng(4).normal(0, 1, 5000)
    signal = spark.createDataFrame(pd.DataFrame({"track_id": 1, "frame": np.arange(5000), "x": x}))
    direct, _ = K.run(K.biquad("bell", 700, RATE, 0.8, 6), x[:, None, None])
    fold = FO.fold(signal, "track_id", K.biquad("bell", 700, RATE, 0.8, 6), ["x"]).orderBy("frame").toPandas()
    scan = FO.affine_scan(signal, "track_id", K.biquad("bell", 700, RATE, 0.8, 6).system).orderBy("frame").toPandas()
    assert np.allclose(fold["x"], direct[:, 0, 0]) and np.allclose(scan["x"], direct[:, 0, 0], atol=1e-9)


def test_voices_are_stolen_in_order(spark):
    notes = pd.DataFrame({"track_id": 1, "note_id": [1, 2, 3, 4, 5], "on_frame": [0, 1, 2, 10, 30], "off_frame": [5, None, None, None, None]}).astype({"off_frame": "Int64"})
    out = Y.with_voices(spark.createDataFrame(notes), "track_id", 2, 20).orderBy("note_id").toPandas()
    # 3 takes the smallest note's voice; 4 takes note 2's, as none is released; 5 takes the older of 3 and 4
    assert out["voice"].tolist() == [0, 1, 0, 1, 0]
    assert out["until"].tolist()[:3] == [2, 10, 30]


def test_scan_of_a_long_memory(spark):
    """A DC block of 1 Hz at 8 kHz remembers thousands of blocks of 16 frames."""
    n = 100_000
    x = np.random.default_rng(5).normal(0.5, 1, n)
    signal = spark.createDataFrame(pd.DataFrame({"track_id": 1, "frame": np.arange(n), "x": x}))
    kernel, r, y, was = K.dc_block(1.0, RATE), 1 - 2 * np.pi / RATE, np.empty(n), (0.0, 0.0)
    for k, v in enumerate(x):
        was = v, v - was[0] + r * was[1]
        y[k] = was[1]
    got = FO.affine_scan(signal, "track_id", kernel.system, block=16).orderBy("frame").toPandas()["x"]
    assert np.abs(got - y).max() < 1e-9


def test_scan_of_several_tracks_channels_and_gaps(spark):
    kernel = K.chain(K.biquad("lowpass", 500, RATE), K.dc_block(20, RATE))
    r = np.random.default_rng(6)
    rows, want = [], {}
    for track, n in ((1, 5), (2, 700), (None, 300), (3, 64)):
        x = r.normal(0, 1, (n, 2))
        if track == 2:
            x[100:400] = 0  # left out below: silence
        want[track] = K.run(kernel, x[:, None])[0][:, 0]
        rows += [(track, k, float(x[k, 0]), float(x[k, 1])) for k in range(n) if not (track == 2 and 100 <= k < 400)]
    out = FO.affine_scan(spark.createDataFrame(rows, "track_id int, frame long, l double, r double"), "track_id", kernel.system, ["l", "r"], block=32).collect()
    assert len(out) == len(rows)
    for row in out:
        assert np.allclose([row["l"], row["r"]], want[row["track_id"]][row["frame"]], atol=1e-9)


def test_fold_carries_long_tracks_through_stretches(spark, monkeypatch):
    monkeypatch.setattr(FO, "ROWS", 100)
    kernel = K.gate(RATE)
    r = np.random.default_rng(7)
    frames = {1: 40, 2: 950, 3: 10, 4: 100, 5: 101, None: 30, 6: 1}
    rows, want = [], {}
    for track, n in frames.items():
        x = r.normal(0, 0.2, n)
        want[track] = K.run(kernel, x[:, None, None])[0][:, 0, 0]
        rows += [(track, k, float(v)) for k, v in enumerate(x)]
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = FO.fold(spark.createDataFrame(rows, "track_id int, frame long, x double"), "track_id", kernel, ["x"], partitions=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    assert len(out) == len(rows)
    for row in out:
        assert row["x"] == pytest.approx(want[row["track_id"]][row["frame"]], abs=1e-12)


def plain_reverb(x, room, wet, phases, rate):
    """The reverb frame by frame, with rings as lists: written from the description of the reference, not from the kernel."""
    size = room**2 * 75 + 25
    kept = 1 - (1 - (0.82 - ((1 - room) * 0.7 + size * 0.002))) ** 4
    cut, blend, regen = 10000 - room * wet * 3000, 0.955 - size * 0.007, kept * 0.5

    def low(q):
        g = np.tan(np.pi * min(cut, rate / 2 - 1) / rate)
        a1 = 1 / (1 + g * (g + 1 / q))
        state = [0.0, 0.0]

        def run(v):
            v3 = v - state[1]
            v1 = a1 * state[0] + g * a1 * v3
            v2 = state[1] + g * a1 * state[0] + g * g * a1 * v3
            state[0], state[1] = 2 * v1 - state[0], 2 * v2 - state[1]
            return v2

        return run

    out = np.empty_like(x)
    units = dict(a=79, b=73, c=71, d=67, e=61, f=59, g=53, h=47)
    speeds = dict(a=0.003251, b=0.002999, c=0.002917, d=0.002749, e=0.002503, f=0.002423, g=0.002146, h=0.002088)
    feeds = dict(a="l", b="k", c="j", d="i", e="i", f="j", g="k", h="l")
    for ch in range(2):
        first, second, third = low(1.618034), low(0.618034), low(0.5)
        ahead = int(29 * size)
        pre = [0.0] * (ahead + 1)
        at = 0
        rings = {n: [0.0] * (int(u * size) + 1) for n, u in units.items()}
        count, back = dict.fromkeys(units, 1), dict.fromkeys(units, 0.0)
        phase = {n: phases[k, ch] for k, n in enumerate(units)}
        passes = {n: [[0.0] * (int(u * size) + 1), 0] for n, u in dict(i=43, j=41, k=37, l=31).items()}
        for t, dry in enumerate(x[:, ch]):
            pre[at] = dry
            at = (at + 1) % len(pre)
            v = np.sin(first(pre[at]) * wet)
            fed = {}
            for n, held in passes.items():
                ring, w = held
                delayed = ring[(w + 1) % len(ring)]
                ring[w] = v - delayed * 0.5
                v = ring[w] * 0.5 + delayed
                held[1] = (w + 1) % len(ring)
                fed[n] = v
            got = {}
            for n, ring in rings.items():
                ring[count[n]] = fed[feeds[n]] + back[n]
                count[n] = (count[n] + 1) % len(ring)
                phase[n] += speeds[n] * 0.1
                place = count[n] + (np.sin(phase[n]) + 1) * 7.0
                k = int(place)
                one, two = ring[k % len(ring)], ring[(k + 1) % len(ring)]
                got[n] = (1 - blend) * (one * (1 - (place - k)) + two * (place - k)) + one * blend
            for group in ("abcd", "efgh"):
                for n in group:
                    back[n] = (got[n] - sum(got[m] for m in group if m != n)) * regen
            v = np.arcsin(min(1.0, max(-1.0, second(sum(got.values()) / 8))))
            out[t, ch] = third(v) + dry * (1 - wet)
    return out


def test_reverb_is_the_plain_loop():
    x = np.random.default_rng(8).normal(0, 0.3, (4200, 2))
    phases = np.random.default_rng(3).random((8, 2)) * 2 * np.pi
    got = K.run(K.reverb(RATE, 0.0, 0.5, seed=3), x[:, None])[0][:, 0]
    want = plain_reverb(x, 0.0, 0.5, phases, RATE)
    assert np.abs(got - want).max() < 1e-9 and np.abs(want[2500:] - x[2500:] * 0.5).max() > 1e-4


def test_the_first_echo_is_filtered():
    x = np.zeros((60, 1, 2))
    x[0] = 1.0
    y = K.run(K.delay(1000.0, 20.0, 0.0, 0.0, 100.0, mix=1.0), x)[0][:, 0, 0]
    assert np.abs(y[:20]).max() == 0 and 0 < y[20] < 0.3


def test_tails():
    from tessitura.operators.effects import tail_frames

    assert tail_frames("delay", 1000, ms=100, feedback=0.0) == 150 and tail_frames("delay", 1000, ms=100, drive=0.5) is None and tail_frames("delay", 1000, ms=100, feedback=1.0) is None
    assert tail_frames("delay", 1000, ms=100, feedback=0.5) == np.ceil(150 + 150 * np.log10(0.001) / np.log10(0.5))
    assert tail_frames("chorus", 44100, ms=12, feedback=0.0) == np.ceil(12 * 44.1 + 256) and tail_frames("chorus", 44100, ms=12, feedback=1) is None
    assert tail_frames("reverb", 44100, room=0.0) == 1975 + int(1975 * np.log10(0.001) / np.log10(1 - (1 - (0.82 - 0.75)) ** 4))


def test_sequential_grains_follow_their_window():
    assert Y.sequential_starts(100, "tukey", 3) == [0, 50, 100] and Y.sequential_starts(101, "hann", 3) == [0, 51, 102] and Y.sequential_starts(100, "exponential", 3) == [0, 80, 160] and Y.sequential_starts(100, "trapezoid", 2) == [0, 90]


def test_automated_parameters():
    make = lambda cutoff: K.biquad("lowpass", cutoff, RATE)
    x = np.random.default_rng(9).normal(0, 1, (300, 1, 2))
    got = K.run(K.automated(make, {"cutoff": 300.0}, [(100, "cutoff", 2000.0)]), x)[0]
    state, parts = None, []
    for kernel, part in ((make(300.0), x[:100]), (make(2000.0), x[100:])):
        y, state = K.run(kernel, part, state)
        parts.append(y)
    assert np.allclose(got, np.concatenate(parts))
    slow = K.run(K.automated(make, {"cutoff": 300.0}, [(100, "cutoff", 2000.0)], 0.01, RATE), x)[0]
    assert np.allclose(slow[:100], got[:100]) and not np.allclose(slow[100:110], got[100:110])


def test_a_reset_silences_an_effect():
    make = lambda feedback: K.delay(1000.0, 5.0, feedback, cutoff=400.0)
    x = np.zeros((60, 1, 2))
    x[0] = 1.0
    kept = K.run(K.automated(make, {"feedback": 0.9}, []), x)[0]
    got = K.run(K.automated(make, {"feedback": 0.9}, [(20, K.RESET, 0.0)]), x)[0]
    assert np.allclose(kept[:20], got[:20]) and np.abs(kept[20:]).max() > 1e-3 and np.abs(got[20:]).max() == 0


def test_a_full_pool_plays_no_more_grains(spark):
    rows = [(1, 1, k, k, 10) for k in range(30)] + [(1, 2, k, 5 * k, 10) for k in range(4)]
    grains = spark.createDataFrame(rows, "track_id int, note_id int, grain int, start long, length long")
    kept = sorted((r["note_id"], r["grain"]) for r in Y.pooled(grains, "track_id", 3).collect())
    assert kept == [(1, k) for k in range(30) if k % 10 < 3] + [(2, k) for k in range(4)]


def test_reverb_of_tracks_in_step_reads_whole_stretches(monkeypatch):
    """Tracks at one place of their lines look up no frame one by one, and sound as step by step, over many blocks and around the lines' ends."""
    kernel = K.reverb(8000.0, 0.0)
    x = np.random.default_rng(3).normal(0, 0.3, (4 * kernel.span + 50, 3, 2))
    state = kernel.init(3, 2)
    want = np.stack([kernel.step(state, f) for f in x])
    monkeypatch.setattr(K, "_read_many", None)
    monkeypatch.setattr(K, "NEAR", 2)
    monkeypatch.setattr(K, "_write_many", None)
    found, _ = K.run(kernel, x)
    assert np.abs(found - want).max() < 1e-12


def test_reverb_of_tracks_out_of_step():
    kernel = K.reverb(8000.0, 0.0)
    x = np.random.default_rng(4).normal(0, 0.3, (2 * kernel.span, 2, 2))
    states = [kernel.init(2, 2) for _ in range(2)]
    for state in states:
        state["phase"][1] += 0.5
    found, _ = K.run(kernel, x, states[0])
    assert np.abs(found - np.stack([kernel.step(states[1], f) for f in x])).max() < 1e-12


def test_one_long_track_does_not_widen_all_others(monkeypatch):
    """Tracks side by side are filled up to the longest of them: together they stay within CELLS."""
    seen = []
    monkeypatch.setattr(FO, "run", lambda kernel, x: (seen.append(x.shape[:2]), (x * 2, None))[1])
    sizes = np.append(np.full(300, 10), [40_000, 7])
    values = np.random.default_rng(1).normal(0, 1, (sizes.sum(), 2))
    assert (FO._side_by_side(values, np.repeat(np.arange(len(sizes)), sizes), None) == values * 2).all()
    assert sum(tracks for _, tracks in seen) == len(sizes) and all(tracks == 1 or frames * tracks <= FO.CELLS for frames, tracks in seen)


@pytest.mark.parametrize("kind", ["string", "double", "long"])
def test_fold_keeps_tracks_apart_whatever_their_key(spark, monkeypatch, kind):
    """Null, nan and text as keys; stretches that end within tracks; nulls among the samples stay nulls."""
    monkeypatch.setattr(FO, "ROWS", 7)
    keys = {"string": [None, "a", "b", ""], "double": [None, float("nan"), 1.5, -0.5], "long": [None, 1, 2, 3]}[kind]
    rows = [(k, f, float(f + n)) for n, k in enumerate(keys) for f in range(3 + 5 * n)]
    df = spark.createDataFrame(rows, f"key {kind}, frame long, x double")
    kernel = K.Kernel(lambda tracks, channels: {"s": np.zeros((tracks, channels))}, lambda state, x: state.__setitem__("s", state["s"] + x) or state["s"])
    got = FO.fold(df, "key", kernel, ["x"], 2).collect()
    found = {(repr(r["key"]), r["frame"]): r["x"] for r in got}
    want, sums = {}, {}
    for k, f, x in rows:
        sums[repr(k)] = sums.get(repr(k), 0.0) + x
        want[repr(k), f] = sums[repr(k)]
    assert found == want and len(got) == len(rows)
    silent = FO.fold(spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], "key long, frame long, x double"), "key", K.Kernel(lambda t, c: {}, lambda state, x: x), ["x"], 1)
    assert [r["x"] for r in silent.orderBy("frame").collect()] == [None, 2.0]
