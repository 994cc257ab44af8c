"""Memoryless effects, as expressions of a stereo frame; catalyst fuses a chain of them into one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators.kernels import LINES, reverb_shape

SHAPES = ("soft", "hard", "diode", "fuzz", "fold")
#: Partials (frequency, amplitude) of the tone that distortion is levelled with: fixed values.
PARTIALS = ((1.0, 0.60), (2.7, 0.25), (5.3, 0.10), (9.1, 0.03), (14.6, 0.02))
#: Scale and ideality of the diode: fixed values.
DIODE = 0.1 / (0.0253 * 1.68)


def gain(signal: DataFrame, db: float) -> DataFrame:
    g = S._db(db)
    return signal if g == 1.0 else signal.withColumns({"l": F.col("l") * g, "r": F.col("r") * g})


def panning(signal: DataFrame, place: float = 0.0, width: float = 1.0, invert_left: bool = False, invert_right: bool = False) -> DataFrame:
    """Inversion, then mid/side width, then the pan law."""
    l, r = (F.col(c) * (-1.0 if flip else 1.0) for c, flip in (("l", invert_left), ("r", invert_right)))
    if width != 1.0:
        m, s = (l + r) / 2, (l - r) / 2
        l, r = m + s * width, m - s * width
    if place != 0.0:
        l, r = l * S.pan_left(F.lit(place)), r * S.pan_right(F.lit(place))
    return signal.withColumns({"l": l, "r": r})


def shaped(x: Column, shape: str, drive: Column) -> Column:
    """A distortion curve at a drive of 0..4."""
    t = drive / 4
    if shape == "soft":
        g = 1 + 14 * t * t
        v = x * g
        return F.when(v >= 1, F.lit(1.0)).when(v <= -1, F.lit(-1.0)).when(g <= 1, x).otherwise(1.5 * (v - v * v * v / 3))
    if shape == "hard":
        g = 1 + 24 * t * t
        return F.greatest(F.least(x, 1 / g), -1 / g) * g
    if shape == "diode":
        g = 1 + 19 * (0.6 * t * t + 0.4 * t)
        return F.atan((F.exp(DIODE * x) - 1) * g) * (2 / math.pi)
    if shape == "fuzz":
        v = x * (1 + 29 * (1 - F.exp(-3 * t)))
        q = F.signum(v) * (1 - F.exp(-F.abs(v)))
        return 1.5 * (q + F.abs(q))
    if shape == "fold":
        g = 1 + 3 * t * t
        v, h = x * g, 1 / g
        return F.when(F.abs(v) <= h, v).otherwise(F.abs(F.abs(v - h) % (4 * h) - 2 * h) - h)
    raise ValueError(f"unknown shape {shape}")


def compensation(spark: SparkSession, shape: str, points: int = 256) -> DataFrame:
    """(drive, factor): RMS of a test tone before and after the curve, for `points` drives; 1 where nothing comes out."""
    total = sum(a for _, a in PARTIALS)
    angle = (F.col("i") + 0.5) * (2 * math.pi / 256)
    tone = sum((F.sin(angle * f) * a for f, a in PARTIALS[1:]), F.sin(angle * PARTIALS[0][0]) * PARTIALS[0][1]) / total
    grid = spark.range(points).select((F.col("id") * (4.0 / (points - 1))).alias("drive")).crossJoin(spark.range(256).withColumnRenamed("id", "i"))
    rms = grid.withColumn("t", tone).groupBy("drive").agg(F.sqrt(F.avg(F.col("t") * F.col("t"))).alias("a"), F.sqrt(F.avg(F.pow(shaped(F.col("t"), shape, F.col("drive")), 2))).alias("b"))
    return rms.select("drive", F.when(F.col("b") > 1e-10, F.col("a") / F.col("b")).otherwise(F.lit(1.0)).alias("factor"))


def distortion(signal: DataFrame, shape: str, drive: float, mix: float = 1.0, factor: Column | None = None) -> DataFrame:
    """A curve at a drive, times its levelling factor (a Column or 1), mixed with the dry signal."""
    if mix == 0:
        return signal
    f = factor if factor is not None else F.lit(1.0)
    return signal.withColumns({c: F.col(c) * (1 - mix) + shaped(F.col(c), shape, F.lit(float(drive))) * f * mix for c in ("l", "r")})


def levelled_distortion(signal: DataFrame, shape: str, drive: float, mix: float = 1.0) -> DataFrame:
    """distortion with the factor between the two nearest drives of the table of 256, which is broadcast."""
    place = drive / 4 * 255
    low = min(254, int(place))
    near = compensation(signal.sparkSession, shape).withColumn("k", F.round(F.col("drive") / 4 * 255).cast("int")).filter(F.col("k").isin(low, low + 1))
    factor = near.agg(F.sum(F.when(F.col("k") == low, F.col("factor") * (1 - (place - low))).otherwise(F.col("factor") * (place - low))).alias("_factor"))
    return distortion(signal.crossJoin(F.broadcast(factor)), shape, drive, mix, F.col("_factor")).drop("_factor")


#: Milliseconds that a delay's LFO adds at most, and frames of a chorus's sweep: fixed values.
DELAY_SWING, CHORUS_SWING = 50.0, 256.0
SILENCE = 0.001


def _ringing(frames: float, feedback: float, endless: float = 1.0) -> int | None:
    """Frames until a loop of so many frames has decayed to SILENCE."""
    if feedback >= endless:
        return None
    if feedback < 0.001:
        return math.ceil(frames)
    return max(1, math.ceil(frames + frames * math.log10(SILENCE) / math.log10(feedback)))


def tail_frames(effect: str, rate: float, **p) -> int | None:
    """Frames that an effect rings on after its input ends; None if it may do so for ever."""
    if effect in ("pan", "distortion"):
        return 0
    if effect == "gain":
        return int(rate / p["hz"]) if p.get("hz") else 0
    if effect == "filter":
        return int(rate / 10)
    if effect == "eq":
        return int(rate / 5)
    if effect == "compressor":
        return int((p["look"] + p["release"]) * rate)
    if effect == "gate":
        return int((p["hold"] + p["release"]) * rate)
    if effect == "delay":
        return None if p.get("drive", 0.0) > 0 else _ringing((p["ms"] + DELAY_SWING) * rate / 1000, abs(p.get("feedback", 0.0)), 0.9999)
    if effect == "chorus":
        return _ringing(p["ms"] * rate / 1000 + CHORUS_SWING, abs(p.get("feedback", 0.0)))
    if effect == "reverb":
        size, kept = reverb_shape(p["room"])
        longest = int(size * max(units for units, _, _ in LINES.values()))
        if kept >= 1:
            return None
        return longest + (int(longest * math.log10(SILENCE) / math.log10(kept)) if kept > 0 else 0)
    raise ValueError(f"unknown effect {effect}")
