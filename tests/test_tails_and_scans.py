"""Kernels in blocks of frames, dynamics as scans over blocks, tails of effects, and the size of plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import effects as FX
from tessitura.operators import folds as FO
from tessitura.operators import kernels as K
from tessitura.plans import graph as G

DYNAMICS = {
    "compressor": K.compressor(1000.0, -12.0, 4.0, 3.0, 0.02, 0.2, 6.0, 0.03), "hard knee": K.compressor(1000.0, -20.0, 2.0, 0.0, 0.2, 0.01, 0.0, 0.005),
    "limiter": K.compressor(1000.0, -10.0, 20.0, 0.0, 0.002, 0.1, 0.0, 0.25), "gate": K.gate(1000.0, -14.0, 0.02, 0.03, 0.1), "slow gate": K.gate(1000.0, -30.0, 0.3, 0.0, 0.01, -20.0), "holding gate": K.gate(1000.0, -3.0, 0.001, 2.0, 0.5),
}
BLOCKS = DYNAMICS | {
    "biquad": K.biquad("bell", 100, 1000, 0.5, 9.0), "eq": K.eq5((3, -4, 2, -1, 5), (10, 80, 160, 240, 320), (0.7, 1, 1.2, 0.9, 0.8), 1000.0), "gained": K.gained(1000, 1.5, "slow"), "follower": K.follower(0.02, 0.2, 1000.0),
    "feedback": K.feedback_delay(40.5, 0.9), "allpass": K.allpass(30), "delay": K.delay(1000, 60.0, 0.5, 0.3, 300.0), "bent delay": K.delay(1000, 60.0, 0.5, 0.0, 300.0, "bandpass", ping_pong=True, lfo_hz=5, to_time=0.1, to_feedback=0.4),
    "held delay": K.delay(1000, 60.0, lfo_hz=7, to_time=0.5, lfo_shape="random"), "moved filter": K.delay(1000, 60.0, lfo_hz=7, to_cutoff=0.5, cutoff=200, lfo_shape="smooth_random"), "chorus": K.chorus(1000.0), "reverb": K.reverb(8000.0, 0.0),
    "chain": K.chain(K.biquad("lowpass", 100, 1000), K.compressor(1000), K.delay(1000, 60.0)),
    "automated": K.automated(lambda cutoff: K.filtered(1000, "lowpass", cutoff), {"cutoff": 80.0}, [(100, "cutoff", 300.0), (500, K.RESET, 0.0), (501, "cutoff", 50.0)]),
    "ramped": K.automated(lambda gain: K.gained(1000, gain), {"gain": 1.0}, [(20, "gain", 3.0), (700, "gain", 0.5)], 1 / 256, 1000.0),
}


def bursts(n, tracks=1, seed=1):
    loud = np.where(np.arange(n) // 200 % 2, 1.0, 0.02)[:, None, None]
    return np.random.default_rng(seed).normal(0, 0.3, (n, tracks, 2)) * loud


@pytest.mark.parametrize("name", BLOCKS)
@pytest.mark.parametrize("tracks", [1, 20])
def test_blocks_of_frames_equal_single_steps(name, tracks):
    kernel, x = BLOCKS[name], bursts(2500, tracks)
    state = kernel.init(tracks, 2)
    want = np.stack([kernel.step(state, f) for f in x])
    first, state = K.run(kernel, x[:777])
    second, state = K.run(kernel, x[777:778], state)
    third, _ = K.run(kernel, x[778:], state)
    assert np.allclose(np.concatenate([first, second, third]), want, rtol=0, atol=1e-9)


def as_table(spark, x):
    rows = [(k, n, float(v[0]), float(v[1])) for k in range(x.shape[1]) for n, v in enumerate(x[:, k])]
    return spark.createDataFrame(rows, "track long, frame long, l double, r double").repartition(4)


@pytest.mark.parametrize("name", DYNAMICS)
def test_dynamics_by_scan_equal_the_fold(spark, monkeypatch, name):
    """Over many blocks of several tracks, silent ones included; windows look back over a block's edge."""
    monkeypatch.setattr(FO, "BACK", 300)
    x = np.concatenate([bursts(3001, 2), np.zeros((3001, 1, 2))], 1)
    found = FO.dynamics(as_table(spark, x), "track", DYNAMICS[name]).orderBy("track", "frame").toPandas()
    want, _ = K.run(DYNAMICS[name], x)
    assert np.allclose(found[["l", "r"]].to_numpy().reshape(3, 3001, 2), want.transpose(1, 0, 2), rtol=0, atol=1e-9)


@pytest.mark.parametrize("up, down", [(0.9, 0.99), (0.99, 0.9), (0.0, 0.5), (0.7, 0.7), (0.9999, 0.999)])
def test_follower_scan(spark, up, down):
    x = np.random.default_rng(3).normal(0, 40, 5000).cumsum() % 200 - 120
    df = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate(x)], "track long, frame long, x double")
    found = FO.follower_scan(df, "track", up, down, -50.0, -120.0, 80.0, block=100).orderBy("frame").toPandas()
    assert np.allclose(found["x"], K.followed(x[:, None], np.array([-50.0]), up, down)[:, 0], rtol=0, atol=1e-9)


def test_a_long_bus_keeps_several_tasks_busy(spark):
    """Many frames of one track: blocks are dealt to tasks, and equal the kernel that runs along them."""
    n, kernel = 300_000, K.compressor(1000.0, -12.0, 4.0, 3.0, 0.02, 0.2, 6.0, 0.03)
    wave = F.sin(F.col("id") / 7) * F.when(F.col("id") % 9000 < 4000, 0.9).otherwise(0.05)
    df = spark.range(n).select(F.lit(0).alias("track"), F.col("id").alias("frame"), wave.alias("l"), (wave / 2).alias("r"))
    out = FO.dynamics(df, "track", kernel)
    t = np.arange(n)
    x = np.sin(t / 7) * np.where(t % 9000 < 4000, 0.9, 0.05)
    want, _ = K.run(kernel, np.stack([x, x / 2], 1)[:, None, :])
    found = out.toPandas().sort_values("frame")
    assert np.allclose(found[["l", "r"]], want[:, 0], rtol=0, atol=1e-8)
    assert out.groupBy(F.spark_partition_id()).count().count() == 4


def ramp(spark, n, scale=0.01):
    return spark.range(n).select(F.col("id").alias("frame"), (F.col("id") * scale + 0.1).alias("x"))


def test_an_echo_sounds_after_its_track(spark):
    g = G.Graph(rate=1000)
    g.add_track(ramp(spark, 100))
    g.add_builtin(G.ROOT, "delay", dlay=200.0, fdbk=0.5, lfor=1.0)
    out = g.compile().orderBy("frame").toPandas()
    tail = FX.tail_frames("delay", 1000, ms=200.0, feedback=0.5, drive=0.0)
    assert (out["frame"] == np.arange(100 + tail)).all()
    x = np.zeros((100 + tail, 1, 2))
    x[:100] = (np.arange(100) * 0.01 + 0.1)[:, None, None]
    want, _ = K.run(G.effect_kernel("delay", 1000, dlay=200.0, fdbk=0.5, lfor=1.0), x)
    assert np.allclose(out[["l", "r"]], want[:, 0]) and out["l"][200:320].abs().max() > 0.1


def test_a_bus_rings_until_it_is_silent(spark):
    """An effect of unknown tail ends by itself, and what is above it hears all of it."""
    g = G.Graph(rate=100)
    bus = g.add_bus()
    g.add_track(ramp(spark, 50), bus)
    g.add_builtin(bus, "delay", dlay=100.0, fdbk=0.4, driv=0.5)
    g.add_builtin(G.ROOT, "filter", cuto=30.0)
    assert G.effect_tail("delay", 100, driv=0.5) is None
    out = g.compile().orderBy("frame").toPandas()
    x = np.zeros((4000, 1, 2))
    x[:50] = (np.arange(50) * 0.01 + 0.1)[:, None, None]
    own, _ = K.run(G.effect_kernel("delay", 100, dlay=100.0, fdbk=0.4, driv=0.5), x)
    loud = int(np.flatnonzero(np.abs(own).max((1, 2)) > FO.QUIET)[-1])
    want, _ = K.run(G.effect_kernel("filter", 100, cuto=30.0), np.where(np.arange(4000)[:, None, None] <= loud, own, 0))
    assert 60 < loud < 3000 and len(out) == loud + 1 + FX.tail_frames("filter", 100)
    assert np.allclose(out[["l", "r"]], want[: len(out), 0], atol=1e-12)


def test_a_tail_that_never_ends_is_cut(spark):
    """A driven loop gains more than it loses."""
    df = as_table(spark, bursts(50))
    out = FO.fold_until_silent(df, "track", K.delay(100.0, 100.0, 0.9, 1.0), ["l", "r"], 100.0, longest=20.0)
    assert out.count() == 50 + 2000


def test_several_tracks_ring_out_each_for_itself(spark):
    x = bursts(700, 3)
    kernel = K.feedback_delay(30.0, 0.8)
    df = as_table(spark, x).filter("track <> 1 OR frame < 200")
    found = FO.fold_until_silent(df, "track", kernel, ["l", "r"], 50.0, 1e-3).orderBy("track", "frame").toPandas()
    for k, n in ((0, 700), (1, 200), (2, 700)):
        own = np.zeros((4000, 1, 2))
        own[:n] = x[:n, k : k + 1]
        want, _ = K.run(kernel, own)
        last = max(n - 1, int(np.flatnonzero(np.abs(want).max((1, 2)) > 1e-3)[-1]))
        got = found[found.track == k]
        assert (got["frame"] == np.arange(last + 1)).all() and np.allclose(got[["l", "r"]], want[: last + 1, 0])


def test_tails_follow_scheduled_parameters(spark):
    g = G.Graph(rate=100)
    g.add_track(ramp(spark, 10))
    k = g.add_builtin(G.ROOT, "delay", dlay=100.0, fdbk=0.1)
    short = g._effect(k)[0][0].tail()
    g.set_parameter(k, 5, "fdbk", 0.5)
    assert g._effect(k)[0][0].tail() > short
    g.add_effect(G.ROOT, "own", kernel=K.feedback_delay(4.0, 0.5), tail=7)
    assert g.compile().count() == 10 + g._effect(k)[0][0].tail() + 7
    g.set_parameter(k, 6, "fdbk", 1.0)
    assert g._effect(k)[0][0].tail() is None


@pytest.mark.parametrize("effect", ["delay", "filter"])
def test_plans_grow_with_the_graph_and_no_faster(spark, effect):
    def plan(depth):
        g, bus = G.Graph(rate=100), G.ROOT
        for _ in range(depth):
            bus = g.add_bus(bus)
            g.add_builtin(bus, effect, **({"dlay": 20.0, "fdbk": 0.0} if effect == "delay" else {}))
            g.add_track(ramp(spark, 10), bus)
        return g.compile()._jdf.queryExecution().analyzed().toString()

    sizes = {d: plan(d) for d in (2, 4, 8)}
    nodes = {d: len(p.splitlines()) for d, p in sizes.items()}
    assert nodes[8] - nodes[4] <= 2 * (nodes[4] - nodes[2]) + 4
    assert sizes[8].count("MapInPandas") <= (8 if effect == "delay" else 3)


def test_a_tree_with_many_effects_reads_a_level_once_for_each(spark):
    """Six effect buses under each of two others, which have effects as well: sums and plan."""
    from tessitura.operators import mixing as M

    parents = spark.createDataFrame([(0, None), (1, 0), (2, 0), *[(10 + k, 1 + k % 2) for k in range(12)]], "mixer_id long, parent_id long")
    signal = spark.range(12).select((F.col("id") + 10).alias("mixer_id"), F.lit(0).cast("long").alias("frame"), (F.col("id") + 1.0).alias("x"))
    half = lambda s: s.withColumn("x", F.col("x") / 2)
    out = M.mix_tree(signal, parents, 2, ["x"], {k: half for k in (1, 2, *range(10, 22))})
    found = {r["mixer_id"]: r["x"] for r in out.collect()}
    assert found == {**{10 + k: (k + 1) / 2 for k in range(12)}, 1: 36 / 4, 2: 42 / 4, 0: 78 / 4}
    lowest, middle = 12 + 1, (2 + 1) * (1 + 12 + 1)  # reads of the signal: for each effect and for the rest, own sources and the level below
    assert out._jdf.queryExecution().analyzed().toString().count("Range") == lowest + middle + (1 + middle)
