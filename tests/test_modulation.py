"""Modulation of voices and grains of changing density against plain loops."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessitura.operators import modulation as MO
from tessitura.operators import synthesis as Y

RATE = 1000.0


def notes(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "key long, note_id long, on_frame long, off_frame long, note int, velocity double")


NOTES = [(1, 0, 1000, 60, 1.0), (2, 37, 38, 0, 0.5), (3, 100, 100, 60, 0.5), (4, 5, 2000, 127, 0.0), (5, 7, 7 + 128, 64, 2.0)]


def test_a_density_that_stays_gives_the_plain_triggers(spark):
    for density in (1.0, 7.0, 33.3, 100.0, 250.0):
        steps = MO.voice_steps(notes(spark, NOTES), RATE, [])
        found = {(r["note_id"], r["grain"]): r["start"] for r in MO.modulated_triggers(steps, "key", density, RATE).collect()}
        want = {(r["note_id"], r["grain"]): r["start"] for r in Y.cloud_triggers(notes(spark, NOTES), density, RATE).collect()}
        assert found == want


@pytest.mark.parametrize("shape", ["triangle", "random", "square"])
def test_triggers_against_a_running_phase(spark, shape):
    routes = [MO.Route("lfo1", "density", 1.0, True), MO.Route("velocity", "density", -0.4, False)]
    steps = MO.voice_steps(notes(spark, NOTES), RATE, routes, ((3.7, shape), (1.0, "sine"))).cache()
    pace = {(r["note_id"], r["step"]): min(max(50.0 * (1 + r["mod_density"]), 1.0), 100.0) / RATE for r in steps.collect()}
    want = []
    for note, on, off, *_ in NOTES:
        phase, done = 0.0, 0
        for frame in range(on, off):
            phase += pace[note, (frame - on) // MO.BLOCK]
            if frame == on:
                want.append((note, 0, on))
            while math.floor(phase + 1e-9) > done:
                done += 1
                want.append((note, done, frame))
    found = [(r["note_id"], r["grain"], r["start"]) for r in MO.modulated_triggers(steps, "key", 50.0, RATE).collect()]
    assert sorted(found) == sorted(want) and len(want) > 50


def test_routes_and_polarities(spark):
    routes = [MO.Route("keytrack", "pan", 0.5, True), MO.Route("keytrack", "size", 0.5, False), MO.Route("lfo1", "volume", 0.2, True), MO.Route("lfo1", "speed", 0.2, False), MO.Route("velocity", "position", 0.0005, False)]
    rows = MO.voice_steps(notes(spark, NOTES), RATE, routes, ((0.0, "square"), (1.0, "sine"))).filter("note_id = 4 AND step = 3").collect()
    assert len(rows) == 1
    r = rows[0]
    assert [r[f"mod_{c}"] for c in MO.TARGETS] == pytest.approx([0.2, 0.5, 0.2, 0.5, 0.0, 0.0])
    assert MO.voice_steps(notes(spark, NOTES), RATE, []).agg(F.sum("frames")).first()[0] == 1000 + 1 + 1995 + 128
    with pytest.raises(ValueError):
        MO.Route("lfo3", "pan", 0.5, True)
    with pytest.raises(ValueError):
        MO.Route("lfo1", "pan", 1.5, True)


def test_handled_notes_against_a_plain_loop(spark):
    """Changes before the note, several at one frame, at its last frame and behind it; a note without any."""
    samples = [math.sin(k / 3) for k in range(50)]
    buffers = spark.createDataFrame([(0, samples)], "buffer_id long, samples array<double>")
    notes_ = [(1, 10, 1.0, 0.5, 0.0), (2, 0, 0.5, 1.0, 0.25), (3, 5, 3.0, 1.0, -0.5)]
    log = {1: [(3, 1, "volume", 0.25), (12, 5, "speed", 2.0), (12, 2, "speed", 9.0), (20, 3, "pan", 0.5), (500, 4, "volume", 9.0)], 2: [(40, 1, "speed", 0.25), (60, 2, "volume", 0.0), (62, 3, "volume", 1.0)]}
    n = spark.createDataFrame([(0, k, 0, on, s, v, p) for k, on, s, v, p in notes_], "key long, note_id long, buffer_id long, on_frame long, speed double, volume double, pan double")
    c = spark.createDataFrame([(0, k, *x) for k, own in log.items() for x in own], "key long, note_id long, frame long, seq long, what string, value double")
    found = {(r["note_id"], r["frame"]): (r["l"], r["r"]) for r in MO.handled(n, c, buffers, "key").collect()}
    want = {}
    for note, on, speed, volume, pan in notes_:
        now, place, frame = {"speed": speed, "volume": volume, "pan": pan}, 0.0, on
        todo = sorted(log.get(note, []))
        while place <= 48:
            while todo and todo[0][0] <= frame:
                _, _, what, value = todo.pop(0)
                now[what] = value
            low = int(place)
            x = (samples[low] * (1 - place + low) + samples[low + 1] * (place - low)) * now["volume"]
            want[note, frame] = (x * math.sqrt(1 - now["pan"]), x * math.sqrt(1 + now["pan"]))
            place, frame = place + now["speed"], frame + 1
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_handled_notes_are_summed_where_their_frames_arise(spark):
    """Stretches that notes cross, and a change in each: the sums are those of the notes' own frames, which no shuffle moves."""
    buffers = spark.createDataFrame([(b, [math.sin(k / 3 + b) for k in range(50)]) for b in range(3)], "buffer_id long, samples array<double>")
    notes = spark.createDataFrame([(k % 2 or None, k, k % 3, 7 * k, 0.25 + k % 4, 0.5, 0.0) for k in range(20)], "key long, note_id long, buffer_id long, on_frame long, speed double, volume double, pan double")
    changes = spark.createDataFrame([(k % 2 or None, k, 7 * k + 3 * n, n, what, 0.5) for k in range(12) for n, what in enumerate(("pan", "speed", "volume", "speed"))], "key long, note_id long, frame long, seq long, what string, value double")
    want = {}
    for row in MO.handled(notes, changes, buffers, "key").collect():
        l, r = want.get((row["key"], row["frame"]), (0.0, 0.0))
        want[row["key"], row["frame"]] = l + row["l"], r + row["r"]
    for stretch in (1, 16, MO.STRETCH):
        mixed = MO.handled_mix(notes, changes, buffers, "key", stretch)
        rows = mixed.collect()
        found = {(row["key"], row["frame"]): (row["l"], row["r"]) for row in rows}
        assert len(rows) == len(found) and found.keys() == want.keys()
        assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    plan = mixed._jdf.queryExecution().sparkPlan().toString()
    prepared = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(" in plan and "Exchange" not in prepared[: prepared.index("Generate explode(sequence(")]
