"""Playheads in loops against a plain loop: both directions, loops that change while they play, steps over short loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessitura.operators import playheads as PL


def fold(x, low, high):
    return low + (x - low) % (high - low) if high > low else low


def plain(position, pace, changes, frames):
    """Places frame by frame; sums are of 64ths, hence exact."""
    at, inside, loop, out = position, False, None, []
    for t in range(frames):
        loop = next(((lo, hi) for f, lo, hi in sorted(changes, key=lambda c: c[0], reverse=True) if f <= t), None)
        loop = None if loop is None or loop[0] is None else loop
        out.append(fold(at, *loop) % 1.0 if loop and inside else at % 1.0)
        if pace:
            at += pace
            if loop and inside:
                at = fold(at, *loop)
            else:
                at %= 1.0
                inside = inside or bool(loop) and loop[0] <= at < loop[1]
    return out


def test_against_a_plain_loop(spark):
    draw, notes, loops, want = random.Random(4), [], [], {}
    for note in range(300):
        position, pace = draw.randrange(64) / 64, draw.randrange(-40, 41) / 64 / draw.choice([1, 4, 8])
        own = []
        for frame in sorted(draw.sample(range(60), draw.randrange(4))):
            low = draw.randrange(60) / 64
            own.append((frame, None, None) if draw.random() < 0.2 else (frame, low, min(1.0, low + draw.choice([0, 1, 2, 8, 30]) / 64)))
        notes.append((note, position, pace))
        loops += [(note, *c) for c in own]
        want[note] = plain(position, pace, own, 100)
    n = spark.createDataFrame(notes, "note long, position double, pace double")
    held = PL.with_loops(n, spark.createDataFrame(loops, "note long, frame long, low double, high double"), ["note"], F.col("position"), F.col("pace"))
    frames = held.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    found = {}
    for r in PL.with_playhead(frames, F.col("t")).select("note", "t", "place").orderBy("note", "t").collect():
        found.setdefault(r["note"], []).append(r["place"])
    assert found == want


def test_modulation_is_folded_into_the_loop(spark):
    n = spark.createDataFrame([(1,)], "note long")
    held = PL.with_loops(n, spark.createDataFrame([(1, 0, 0.25, 0.5)], "note long, frame long, low double, high double"), ["note"], 0.25, 1 / 64)
    out = PL.with_playhead(held.withColumn("t", F.explode(F.array(F.lit(0), F.lit(4)))), F.col("t"), shift=0.25).select("t", "place").orderBy("t").collect()
    assert [r["place"] for r in out] == [0.5, 0.3125]  # not yet in the loop at its first frame; then 0.3125 + 0.25, folded
    assert PL.with_playhead(held.withColumn("t", F.lit(0)), F.col("t"), shift=0.25).columns[-1] == "place"
