"""Changing the rate of a signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.automation import glide_speeds


def hermite(ym1: Column, y0: Column, y1: Column, y2: Column, f: Column) -> Column:
    """Four-point, third-order Hermite interpolation between y0 and y1."""
    c1 = (y1 - ym1) / 2
    c2 = ym1 - 2.5 * y0 + 2 * y1 - 0.5 * y2
    c3 = (y2 - ym1) / 2 + 1.5 * (y0 - y1)
    return ((c3 * f + c2) * f + c1) * f + y0


def rate_ratio(rate_in: int, rate_out: int, speed: float = 1.0) -> float:
    """Input frames per output frame; a speed is quantised by whole rates."""
    return rate_in / float(max(1, int(rate_out / speed)))


def cubic(signal: DataFrame, key: str, ratio: float, channels: list[str]) -> DataFrame:
    """(key, frame, channels) on a grid of `ratio` input frames a frame.

    Output n stands at n x ratio, or at 1 + ratio (n + 1) when there are fewer frames out than in; a frame needs two input
    frames behind it. Every input frame takes its neighbours from one window and makes its own outputs: no join.
    """
    if abs(ratio - 1) < 1e-6:
        return signal.select(key, "frame", *channels)
    order = Window.partitionBy(key).orderBy("frame")
    shift = 0.0 if ratio < 1 else 1.0 + ratio
    taps = signal.select(
        key, "frame", *[t.alias(f"{c}_{k}") for c in channels for k, t in (("a", F.coalesce(F.lag(c, 1).over(order), F.lit(0.0))), ("b", F.col(c)), ("c", F.lead(c, 1).over(order)), ("d", F.lead(c, 2).over(order)))]
    )
    first = F.ceil((F.col("frame") - shift) / ratio)
    last = F.ceil((F.col("frame") + 1 - shift) / ratio) - 1
    first, last = F.greatest(first, F.lit(0)), last
    spread = taps.filter(last >= first).withColumn("n", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    f = F.col("n") * ratio + shift - F.col("frame")
    value = lambda c: hermite(F.col(f"{c}_a"), F.col(f"{c}_b"), F.col(f"{c}_c"), F.coalesce(F.col(f"{c}_d"), F.when(f == 0, F.lit(0.0))), f)
    out = spread.select(key, F.col("n").alias("frame"), *[value(c).alias(c) for c in channels])
    return out.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in channels))


def speed_segments(speed: float, changes: list[tuple], rate: int, glide_block: int = 64) -> list[tuple[int, int | None, float, float]]:
    """(first frame, frame behind, position, speed) of the stretches of constant speed of a track.

    changes: (frame, "speed", speed, semitones a second or 0) and (frame, "seek", position), in any order; those of a frame
    apply as they stand. A glide's blocks are stretches of their own; the last stretch has no end.
    """
    marks: list[tuple[int, float | None, float | None]] = [(0, 0.0, speed)]
    now, gliding = speed, []

    def until(frame):
        nonlocal gliding, now
        while gliding and gliding[0][0] < frame:
            at, now = gliding.pop(0)
            marks.append((at, None, now))
        gliding = [g for g in gliding if g[0] >= frame]

    for frame, kind, *values in sorted(changes, key=lambda c: c[0]):
        until(frame)
        if kind == "seek":
            marks.append((frame, float(values[0]), None))
            continue
        target, semitones = (*values, 0.0)[:2]
        gliding = [(frame + k * glide_block, v) for k, v in enumerate(glide_speeds(now, target, semitones, rate, glide_block))]
    until(math.inf)
    out: list[list] = []
    for frame, place, s in marks:
        if out:
            out[-1][1] = frame
        here = out[-1][2] + (frame - out[-1][0]) * out[-1][3] if out else 0.0
        out.append([frame, None, here if place is None else place, out[-1][3] if s is None else s])
    return [tuple(x) for x in out if x[1] is None or x[1] > x[0]]


def varispeed(signal: DataFrame, key: str, segments: list[tuple[int, int | None, float, float]], channels: list[str]) -> DataFrame:
    """(key, frame, channels) of a track that is read along stretches of constant speed (see speed_segments), cubically. A track ends
    where its last stretch runs out of frames; a seek beyond the end leaves silence until the next stretch. Every input frame
    makes the outputs that each stretch has of it: no join."""
    order = Window.partitionBy(key).orderBy("frame")
    taps = signal.select(
        key, "frame", *[t.alias(f"{c}_{k}") for c in channels for k, t in (("a", F.coalesce(F.lag(c, 1).over(order), F.lit(0.0))), ("b", F.col(c)), ("c", F.lead(c, 1).over(order)), ("d", F.coalesce(F.lead(c, 2).over(order), F.lit(0.0))))]
    )

    def outputs(first, behind, place, speed):
        low = F.greatest(F.ceil((F.col("frame") - place) / speed), F.lit(0)) + first
        high = F.ceil((F.col("frame") + 1 - place) / speed) - 1 + first
        high = high if behind is None else F.least(high, F.lit(behind - 1))
        each = F.transform(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")), lambda n: F.struct(n.alias("n"), ((n - first) * speed + place).alias("at")))
        return F.when(high >= low, each).otherwise(F.array().cast("array<struct<n:bigint,at:double>>"))

    spread = taps.filter(F.col(f"{channels[0]}_c").isNotNull()).select("*", F.inline(F.flatten(F.array(*[outputs(*s) for s in segments]))))
    f = F.col("at") - F.col("frame")
    return spread.select(key, F.col("n").alias("frame"), *[hermite(F.col(f"{c}_a"), F.col(f"{c}_b"), F.col(f"{c}_c"), F.col(f"{c}_d"), f).alias(c) for c in channels])


def sinc(signal: DataFrame, key: str, ratio: float, channels: list[str], taps: int = 32, cutoff: float = 0.95) -> DataFrame:
    """The same grid through a windowed sinc (Blackman-Harris, 2 x taps wide), as a sum of each input frame's parts.

    Every input frame knows the outputs that it reaches; a grouped sum with map-side partial sums puts them together.
    """
    wide = taps * max(1.0, ratio)
    low = F.greatest(F.ceil((F.col("frame") - wide) / ratio), F.lit(0)).cast("long")
    high = F.floor((F.col("frame") + wide) / ratio).cast("long")
    total = signal.groupBy(key).agg(F.max("frame").alias("_last"))
    spread = signal.join(total, key).withColumn("n", F.explode(F.sequence(low, high))).filter(F.col("n") * ratio <= F.col("_last"))
    x = F.col("n") * ratio - F.col("frame")
    w = cutoff / max(1.0, ratio)
    p = (x / wide + 1) * math.pi
    window = 0.35875 - 0.48829 * F.cos(p) + 0.14128 * F.cos(2 * p) - 0.01168 * F.cos(3 * p)
    weight = F.when(x == 0, F.lit(w)).otherwise(F.sin(math.pi * w * x) / (math.pi * x)) * window
    return spread.withColumn("_w", weight).groupBy(key, F.col("n").alias("frame")).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in channels])
