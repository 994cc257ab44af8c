"""User synth graphs against plain loops."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessitura.operators import patches as P
from tessitura.plans import graph as G

RATE = 1000.0
NOTES = [(1, 0, 40, 50.0, 1.0, 0.0), (2, 10, 90, 75.0, 0.5, -1.0), (3, 20, None, 100.0, 1.0, 1.0), (4, 30, 30, 20.0, 1.0, 0.0), (5, 60, 61, 300.0, 0.25, 0.5)]


def notes(spark, rows=NOTES, key=0):
    return spark.createDataFrame([(key, *r) for r in rows], "key long, note_id long, on_frame long, off_frame long, hz double, volume double, pan double")


def played(df) -> dict:
    return {(r["note_id"], r["frame"]): (r["l"], r["r"]) for r in df.collect()}


def close(found: dict, want: dict) -> None:
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=1e-9)


def svf(x, cutoffs, kind, k):
    s1 = s2 = 0.0
    out = []
    for v, c in zip(x, cutoffs):
        g = math.tan(math.pi * c / RATE)
        v1 = (s1 + g * (v - s2)) / (1 + g * (g + k))
        v2 = s2 + g * v1
        s1, s2 = 2 * v1 - s1, 2 * v2 - s2
        out.append({"lowpass": v2, "bandpass": v1, "highpass": v - k * v1 - v2}[kind])
    return out


def test_filters_in_series_and_side_by_side_against_a_plain_loop(spark):
    gated = P.Osc("saw") * P.Gate()
    low = P.Filter(gated, "lowpass", P.Pitch() * 2.0 + P.Gate() * 40.0, 0.3, lowest=50.0)
    band = P.Filter(low, "bandpass", P.node(120.0), 0.0, lowest=100.0)
    patch = P.Patch(low * low + P.Drive(gated), band - 0.5 * low)
    frames = patch.ring(RATE)
    want = {}
    for note, on, off, hz, _, _ in NOTES:
        count = 70 if off is None else off - on + frames if off > on else 0
        gate = [1.0 if off is None or t < off - on else 0.0 for t in range(count)]
        dry = [(2 * (t * hz / RATE % 1) - 1) * e for t, e in enumerate(gate)]
        a = svf(dry, [min(max(2 * hz + 40 * e, 50), 490) for e in gate], "lowpass", 2 * (1 - 0.97 * 0.3))
        b = svf(a, [120.0] * count, "bandpass", 2.0)
        want |= {(note, on + t): (a[t] ** 2 + math.tanh(dry[t]), b[t] - 0.5 * a[t]) for t in range(count)}
    found = played(P.patched(notes(spark), patch, RATE, "key", 70))
    close(found, want)
    for note, on, off, *_ in NOTES[:2]:  # the filters have rung out
        assert max(map(abs, found[note, off + frames - 1])) < 1e-5


def test_a_moving_pitch_and_its_filter(spark):
    wobble = P.Osc("sine", P.Pitch() * (1.0 + P.Lfo(20.0, "square") * 0.25))
    patch = P.Patch(P.Filter(wobble * P.Gate(), "highpass", P.node(200.0), lowest=100.0))
    found = played(P.patched(notes(spark, NOTES[1:2]), patch, RATE, "key", 1))
    turns, dry = 0.0, []
    for t in range(80 + patch.ring(RATE)):
        dry.append(math.sin(2 * math.pi * turns) if t < 80 else 0.0)
        turns += 75.0 * (1.25 if t * 20 / RATE % 1 < 0.5 else 0.75) / RATE
    out = svf(dry, [200.0] * len(dry), "highpass", 2.0)
    close(found, {(2, 10 + t): (math.sqrt(2) * v, 0.0) for t, v in enumerate(out)})


def test_parameters(spark):
    level = P.Param("level", 0.5, 0.0, 0.8)
    some = notes(spark, NOTES[:2]).withColumn("p_level", F.when(F.col("note_id") == 1, 3.0))
    found = played(P.patched(some, P.Patch(level * P.Gate(), level), RATE, "key", 1))
    assert found[1, 5] == (0.8, 0.8) and found[2, 20] == (0.5, 0.5)
    assert played(P.patched(notes(spark, NOTES[:1]), P.Patch(level, level), RATE, "key", 1))[1, 0] == (0.5, 0.5)
    with pytest.raises(ValueError, match="level"):
        P.Patch(level + P.Param("level", 0.1))
    with pytest.raises(ValueError, match="filter"):
        P.Patch(P.Osc("saw", P.Filter(P.Osc("sine"), "lowpass", P.node(100.0))))
    with pytest.raises(ValueError, match="lowpass"):
        P.Filter(P.Osc("sine"), "comb", P.node(100.0))


def test_a_voice_that_is_taken_ends_at_once(spark):
    patch = P.Patch(P.Gate() + 1.0, P.Filter(P.Gate(), "lowpass", P.node(300.0), lowest=200.0))
    found = played(P.patched(notes(spark), patch, RATE, "key", 1000, voices=1))
    ends = {n: max(f for m, f in found if m == n) for n in (1, 2, 3, 5)}
    assert ends == {1: 9, 2: 19, 3: 59, 5: 60 + patch.ring(RATE)}
    assert {n for n, _ in found} == {1, 2, 3, 5}  # a note of no frames takes none


def test_voices_of_many_tracks_and_null_keys(spark):
    some = notes(spark, NOTES[:1], 7).unionAll(notes(spark, NOTES[:1], None)).unionAll(notes(spark, NOTES[:1], 8))
    patch = P.Patch(P.Filter(P.Gate(), "lowpass", P.node(300.0), lowest=200.0))
    out = P.patched(some, patch, RATE, "key", 1)
    rows = out.groupBy("key").agg(F.count("*").alias("n"), F.sum("l").alias("l")).collect()
    assert {r["key"] for r in rows} == {7, 8, None} and len({(r["n"], round(r["l"], 9)) for r in rows}) == 1
    assert P.patched(some.limit(0), patch, RATE, "key", 1).count() == 0


def test_notes_are_shuffled_and_frames_are_not(spark):
    patch = P.Patch(P.Filter(P.Osc("saw", P.Pitch() + P.Lfo(5.0)) * P.Gate(), "lowpass", P.node(300.0)))
    plan = P.patched(notes(spark), patch, RATE, "key", 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_a_source_ends_after_silence(spark):
    tracks = spark.createDataFrame([(1, 50.0), (2, 80.0)], "track_id long, hz double")
    rung = P.Patch(P.Filter(P.Envelope(0.0, 0.01, 0.02, 0.0, 0.0), "lowpass", P.Pitch(), lowest=20.0))
    ends = {r["track_id"]: r["n"] for r in P.patch_source(tracks, rung, RATE, "track_id", 5000, hush=0.1).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    for track, hz in ((1, 50.0), (2, 80.0)):
        dry = [1.0 if t + 1 <= 10 else 1 - min((t + 1 - 10) / 20, 1) for t in range(5000)]
        loud = [t for t, v in enumerate(svf(dry, [hz] * 5000, "lowpass", 2.0)) if abs(v) >= 1e-6]
        assert ends[track] == max(loud) + 1 + 100
    held = P.patch_source(tracks, P.Patch(P.Osc("sine")), RATE, "track_id", 300)
    assert held.count() == 600


def test_in_a_graph(spark):
    patch = P.Patch(P.Osc("saw") * P.Gate() * P.Velocity())
    g = G.Graph(rate=int(RATE))
    own = notes(spark, NOTES[:2]).drop("key")
    g.add_patch(own, patch, 1.0)
    found = {r["frame"]: (r["l"], r["r"]) for r in g.compile().collect()}
    want: dict = {}
    for (_, frame), (left, right) in played(P.patched(notes(spark, NOTES[:2]), patch, RATE, "key", 1)).items():
        a, b = want.get(frame, (0.0, 0.0))
        want[frame] = (a + left, b + right)
    close(found, want)
    buffers = spark.createDataFrame([(1, [1.0] * 9)], "buffer_id long, samples array<double>")
    changed = spark.createDataFrame([(1, 4, 0, "volume", 0.25)], "note_id long, frame long, seq long, what string, value double")
    g = G.Graph(rate=int(RATE))
    g.add_handled(spark.createDataFrame([(1, 1, 0, 1.0, 1.0, 0.0)], "note_id long, buffer_id long, on_frame long, speed double, volume double, pan double"), changed, buffers)
    assert [r["l"] for r in g.compile().orderBy("frame").collect()] == [1.0] * 4 + [0.25] * 4
