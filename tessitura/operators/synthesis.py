"""Sound from notes: matching note events, voices, envelopes, sampled and granular playback."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators.automation import ahdsr


def notes_of(events: DataFrame, key: str, on: str, off: list[str]) -> DataFrame:
    """(key, note_id, on_frame, off_frame) from events(key, frame, seq, type): a note sounds from each `on` event to the next
    event of a type in `off` or the next note; off_frame is null for a note that is never ended."""
    order = Window.partitionBy(key).orderBy(F.desc("frame"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.last(F.when(F.col("type").isin([on, *off]), F.col("frame")), True).over(order)
    return events.withColumn("off_frame", ends).filter(F.col("type") == on).select(key, F.col("seq").alias("note_id"), F.col("frame").alias("on_frame"), "off_frame")


def with_voices(notes: DataFrame, key: str, voices: int, release: int) -> DataFrame:
    """notes with `voice` and `until`: a free voice if there is one; else that released first; else that of the smallest note.

    A note holds its voice until `release` frames after its end, or until the voice is taken (`until`). A task reads its sorted
    notes in batches and remembers one note a voice, however long a track is.
    """
    names = [*notes.columns, "voice", "until"]

    def framed(rows):
        whole = {"off_frame": "Int64", "until": "Int64", "voice": "int32"}
        return pd.DataFrame(rows, columns=names).astype(whole)

    def assign(batches):
        track, held, rows = None, [], []  # held: the notes that have a voice, as [row, on, off, id]

        def give_back(v, until):
            rows.append((*held[v][0], v, until))
            held[v] = None

        def close():
            for v, note in enumerate(held):
                if note is not None:
                    give_back(v, None if pd.isna(note[2]) else int(note[2]) + release)

        for part in batches:
            off_at, on_at, id_at, key_at = (part.columns.get_loc(c) for c in ("off_frame", "on_frame", "note_id", key))
            for row in part.astype({"off_frame": object}).itertuples(index=False, name=None):
                if track is None or row[key_at] != track[0]:
                    close()
                    track, held = (row[key_at],), [None] * voices
                now, off = int(row[on_at]), row[off_at]
                for v, note in enumerate(held):
                    if note is not None and not pd.isna(note[2]) and note[2] + release <= now:
                        give_back(v, int(note[2]) + release)
                if None in held:
                    v = held.index(None)
                else:
                    released = [(note[2], v) for v, note in enumerate(held) if not pd.isna(note[2]) and note[2] <= now]
                    v = min(released)[1] if released else min((note[3], v) for v, note in enumerate(held))[1]
                    give_back(v, now)
                held[v] = [row, now, off, row[id_at]]
            yield framed(rows)
            rows = []
        close()
        yield framed(rows)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema)
    sorted_notes = notes.repartition(key).sortWithinPartitions(key, "on_frame", "note_id")
    return sorted_notes.mapInPandas(assign, f"{schema}, voice int, until long")


def sampled(notes: DataFrame, buffers: DataFrame, envelope: dict | None, rate: float, key: str) -> DataFrame:
    """(key, note_id, frame, x): every note plays its buffer (buffers(buffer_id, samples)) at `speed` with linear
    interpolation, times its envelope and volume, until the buffer ends or the envelope is silent. With a column `pan` of notes
    the result has l and r by the pan law in place of x.

    notes(key, note_id, buffer_id, on_frame, off_frame, speed, volume). A note makes its own frames from the block it is joined
    with; the join is on buffer_id, and the mix-down that follows is a sum with partial sums.
    """
    last = F.floor((F.size("samples") - 2) / F.col("speed"))
    frames = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"))
    spread = notes.join(buffers, "buffer_id").filter("size(samples) > 1").withColumn("t", F.explode(frames))
    place = F.col("t") * F.col("speed")
    low = F.floor(place).cast("int")
    part = place - low
    x = F.get("samples", low) * (1 - part) + F.get("samples", low + 1) * part
    gain = F.col("volume")
    if envelope:
        gain = gain * ahdsr(F.col("t"), F.col("off_frame") - F.col("on_frame"), rate, **envelope)
    out = spread.withColumn("x", x * gain).withColumn("frame", F.col("on_frame") + F.col("t"))
    if envelope:
        out = out.filter(F.col("off_frame").isNull() | (F.col("frame") < F.col("off_frame")) | (F.col("x") != 0))
    if "pan" in notes.columns:
        return out.select(key, "note_id", "frame", (F.col("x") * S.pan_left(F.col("pan"))).alias("l"), (F.col("x") * S.pan_right(F.col("pan"))).alias("r"))
    return out.select(key, "note_id", "frame", "x")


def cloud_triggers(notes: DataFrame, density: float, rate: float) -> DataFrame:
    """(note columns, grain, start): a phase that runs `density` times a second triggers grains while a note sounds; it starts full, so
    that the first grain sounds at once."""
    step = rate / min(max(density, 1.0), 100.0)
    count = F.floor((F.col("off_frame") - F.col("on_frame")) / step).cast("long")
    grains = notes.filter("off_frame > on_frame").withColumn("grain", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    start = F.col("on_frame") + F.greatest(F.ceil(F.col("grain") * step).cast("long") - 1, F.lit(0).cast("long"))
    return grains.withColumn("start", start).filter("start < off_frame")


def cloud_grains(notes: DataFrame, density: float, size: float, rate: float, spray: float, seed: int) -> DataFrame:
    """(note columns, grain, start, length, jitter): triggered grains of a fixed size in seconds; jitter is a repeatable offset in
    -spray..spray frames."""
    return cloud_triggers(notes, density, rate).withColumns(
        {
            "length": F.lit(int(size * rate)).cast("long"),
            "jitter": F.round(S.noise(F.col("note_id") * 131 + F.col("grain"), seed) * spray).cast("long"),
        }
    )


def _draw(k: int, seed: int) -> Column:
    """A grain's k-th number in -1..1."""
    return S.noise(F.col("note_id") * 131 + F.col("grain"), seed + k)


def grain_length(rate: float, size: float, variation: float, seed: int) -> Column:
    """Frames of a grain."""
    scale = (1 - 0.75 * variation) + 2.75 * variation * (_draw(1, seed) + 1) / 2
    return F.greatest((size * scale * rate / 1000).cast("long"), F.lit(2).cast("long"))


def varied_grains(grains: DataFrame, buffers: DataFrame, rate: float, size: float = 100.0, variation: float = 0.0, spray: float = 0.0, spread: float = 0.0, direction: str = "forward", position: float = 0.5, step: float = 0.0, seed: int = 0) -> DataFrame:
    """Triggered grains with what each of them draws, joined with its buffer (samples).

    grains(note_id, grain, on_frame, start, buffer_id, speed, volume, pan). size in milliseconds; at a variation of 1 a grain's size
    varies from a quarter to three times, its volume from nothing to all, and its pitch by a semitone; spray moves its place by up to a second, spread
    its pan. A grain stands at `position` (0..1), or, with a step, at a playhead that starts there and moves `step` frames a frame.
    Draws are repeatable functions of note, grain and seed. direction is forward, backward or random.
    """
    if not (1 <= size <= 1000 and all(0 <= v <= 1 for v in (variation, spray, spread, position)) and -4 <= step <= 4):
        raise ValueError("a grain parameter is outside its range")
    if direction not in ("forward", "backward", "random"):
        raise ValueError(f"unknown direction {direction}")
    draw = lambda k: _draw(k, seed)
    frames = F.size("samples")
    playhead = F.lit(position) + (F.col("start") - F.col("on_frame")) * step / frames if step else F.lit(position)
    back = F.lit(direction == "backward") if direction != "random" else draw(6) < 0
    return grains.join(buffers, "buffer_id").filter("size(samples) > 0").withColumns(
        {
            "length": grain_length(rate, size, variation, seed),
            "volume": F.col("volume") * (1 - variation * (draw(2) + 1) / 2),
            "turn": F.col("speed") * F.pow(F.lit(2.0), variation * (draw(3) / 2 + draw(4) / 2) / 12) * F.when(back, -1).otherwise(1),
            "place": F.pmod(playhead + spray * draw(5) * rate / frames, F.lit(1.0)),
            "pan": S.clamp(F.col("pan") + spread * draw(7), -1.0, 1.0),
        }
    )


def played_grains(grains: DataFrame, window: str, key: str) -> DataFrame:
    """(key, frame, l, r): grains of varied_grains under a window, panned linearly and summed. Samples are read at places between
    frames by a cubic through four, around the end to the beginning."""
    spread = grains.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    last = F.size("samples") - 1
    at = F.pmod(F.col("place") + F.col("t") * F.col("turn") / F.size("samples"), F.lit(1.0)) * last
    low = F.floor(at).cast("int")
    tap = lambda d: F.get("samples", F.pmod(low + d, last + 1).cast("int"))
    f, (y0, y1, y2, y3) = at - low, (tap(d) for d in (-1, 0, 1, 2))
    x = ((1.5 * (y1 - y2) + 0.5 * (y3 - y0)) * f + (y0 - 2.5 * y1 + 2.0 * y2 - 0.5 * y3)) * f * f + 0.5 * (y2 - y0) * f + y1
    # the window is a table of 2048 entries, which a phase of 1 does not quite reach
    weight = S.grain_window(F.col("t") / F.col("length") * (2047 / 2048), window) * F.col("volume")
    loud = spread.withColumn("_w", weight).filter("_w > 0.001").withColumn("_x", x * F.col("_w"))
    parts = loud.select(key, (F.col("start") + F.col("t")).alias("frame"), (F.col("_x") * (1 - F.col("pan")) / 2).alias("l"), (F.col("_x") * (1 + F.col("pan")) / 2).alias("r"))
    return parts.groupBy(key, "frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def pooled(grains: DataFrame, key: str, pool: int = 100) -> DataFrame:
    """Grains of varied_grains that find a free place in a pool: one that starts while `pool` earlier ones sound is not played.

    That is a recurrence over a note's grains in their order; a task reads its sorted grains and remembers the ends of those that
    sound. Where a note's longest grain and its density rule out more than `pool`, nothing needs to be decided.
    """

    def free(batches):
        note, ends = None, []
        for part in batches:
            keep = np.zeros(len(part), bool)
            for n, (own, start, length) in enumerate(zip(zip(part[key], part["note_id"]), part["start"], part["length"])):
                if own != note:
                    note, ends = own, []
                ends = [e for e in ends if e > start]
                if len(ends) < pool:
                    ends.append(start + length)
                    keep[n] = True
            yield part[keep]

    return grains.repartition(key, "note_id").sortWithinPartitions(key, "note_id", "start", "grain").mapInPandas(free, grains.schema)


#: How much of a grain has sounded when the next one starts in sequential playback, by window: fixed values.
CROSSFADE = {"hann": 0.5, "blackman": 0.5, "triangle": 0.5, "tukey": 0.5, "trapezoid": 0.9, "exponential": 0.8, "ramp_up": 0.8, "ramp_down": 0.8}


def sequential_triggers(notes: DataFrame, rate: float, window: str, size: float = 100.0, variation: float = 0.0, seed: int = 0) -> DataFrame:
    """(note columns, grain, start): each grain of a note starts when the one before has reached the crossfade point of its window.
    Grains may differ in length: a running sum over a note's grains, of which there are at most as many as its shortest ones."""
    share = CROSSFADE[window]
    shortest = max(1, math.ceil(share * max(2, int(size * (1 - 0.75 * variation) * rate / 1000))))
    count = F.floor((F.col("off_frame") - F.col("on_frame") - 1) / shortest).cast("long")
    grains = notes.filter("off_frame > on_frame").withColumn("grain", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    step = F.ceil(grain_length(rate, size, variation, seed) * share)
    before = Window.partitionBy(*[c for c in notes.columns if c in ("track_id", "_key")], "note_id").orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)
    return grains.withColumn("start", F.col("on_frame") + F.coalesce(F.sum(step).over(before), F.lit(0))).filter("start < off_frame")


def sequential_starts(length: int, window: str, count: int) -> list[int]:
    """Starts of grains that follow at the crossfade point of their window."""
    return [k * math.ceil(length * CROSSFADE[window]) for k in range(count)]


def granular(grains: DataFrame, buffers: DataFrame, window: str, key: str, place: Column | None = None) -> DataFrame:
    """(key, frame, l, r): grains(key, buffer_id, start, length, jitter, pan) of a looped buffer under a window, summed.

    A grain makes its own frames; grains are panned linearly.
    """
    spread = grains.join(buffers, "buffer_id").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    base = place if place is not None else F.lit(0)
    at = F.pmod(base + F.col("jitter") + F.col("t"), F.size("samples")).cast("int")
    x = F.get("samples", at) * S.grain_window(F.col("t") / F.col("length"), window)
    parts = spread.select(key, (F.col("start") + F.col("t")).alias("frame"), (x * (1 - F.col("pan")) / 2).alias("l"), (x * (1 + F.col("pan")) / 2).alias("r"))
    return parts.groupBy(key, "frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def polyphonic(notes: DataFrame, key: str, shape: str, rate: float, envelope: dict, longest: int, width: float = 0.5, bandlimited: bool = False) -> DataFrame:
    """(key, note_id, frame, l, r): a voice for each of notes(key, note_id, on_frame, off_frame, hz, volume, pan): an oscillator under an
    envelope, until that is silent. A note that is never ended sounds for `longest` frames. Every note makes its own frames."""
    ring = math.ceil(envelope["release"] * rate)
    held = F.coalesce(F.col("off_frame") - F.col("on_frame") + ring, F.lit(longest))
    spread = notes.filter(held > 0).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), (held - 1).cast("long"))))
    phase = F.pmod(F.col("t") * F.col("hz") / rate, F.lit(1.0))
    wave = S.bandlimited(phase, F.col("hz"), rate, shape, width) if bandlimited else S.oscillator(phase, shape, width)
    x = wave * ahdsr(F.col("t"), F.col("off_frame") - F.col("on_frame"), rate, **envelope) * F.col("volume")
    return spread.select(key, "note_id", (F.col("on_frame") + F.col("t")).alias("frame"), (x * S.pan_left(F.col("pan"))).alias("l"), (x * S.pan_right(F.col("pan"))).alias("r"))


def tone(tracks: DataFrame, frames: int, rate: float, shape: str, width: float = 0.5, bandlimited: bool = False) -> DataFrame:
    """(track_id, frame, x): an oscillator for each of tracks(track_id, hz), naive or band-limited."""
    spread = tracks.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    phase = F.pmod(F.col("frame") * F.col("hz") / rate, F.lit(1.0))
    x = S.bandlimited(phase, F.col("hz"), rate, shape, width) if bandlimited else S.oscillator(phase, shape, width)
    return spread.select("track_id", "frame", x.alias("x"))
