"""Playheads of granular notes: they move through a buffer, find their way into a loop from either side, and follow its changes while they play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "array<struct<frame:bigint,low:double,high:double,at:double,inside:boolean>>"


def _wrapped(x: Column) -> Column:
    return x - F.floor(x)


def _folded(x: Column, low: Column, high: Column) -> Column:
    length = high - low
    return F.when(length > 0, low + (x - low) - F.floor((x - low) / length) * length).otherwise(low)


def _entry(at: Column, pace: Column, low: Column, high: Column, frames: Column) -> Column:
    """The first of the frames 1 to `frames` that has the playhead within low..high; null for none. A crossing a time around the buffer is
    looked at, not a frame each: a loop that is shorter than the pace may be stepped over."""
    first, last = F.floor(at + pace), F.floor(at + pace * frames)

    def of(turn: Column) -> Column:
        up = F.ceil((low + turn - at) / pace)
        down = F.floor((at - high - turn) / -pace) + 1
        t = F.greatest(F.when(pace > 0, up).otherwise(down), F.lit(1)).cast("long")
        place = at + pace * t - turn
        return F.when((t <= frames) & (place >= low) & (place < high), t)

    return F.array_min(F.transform(F.sequence(first, last), of))


def _moved(at: Column, inside: Column, pace: Column, low: Column, high: Column, frames: Column) -> Column:
    """(at, inside): the place, and whether the loop was entered, `frames` frames on, with one loop or, if `low` is null, none."""
    end = at + pace * frames
    entry = F.when(~inside & low.isNotNull() & (frames > 0) & (pace != 0), _entry(at, pace, low, high, frames))

    def after(e: Column) -> Column:
        first = F.when(inside, end).otherwise(_wrapped(at + pace * e) + pace * (frames - e))
        place = F.when((frames == 0) | (pace == 0), at).when(low.isNotNull() & (inside | e.isNotNull()), _folded(first, low, high)).otherwise(_wrapped(end))
        return F.struct(place.alias("at"), (inside | e.isNotNull()).alias("inside"))

    return F.transform(F.array(entry), after)[0]  # the entry is found once


def with_loops(notes: DataFrame, loops: DataFrame, keys: list[str], position: float | Column = 0.0, pace: float | Column = 0.0) -> DataFrame:
    """notes with `_pace` and `_loops`, what with_playhead needs: loops(keys, frame, low, high) are the loop ranges (parts of the buffer; null: none) that a
    note gets at frames after its start. `pace` is the part of the buffer that it moves in a frame.

    A playhead that has not met its loop yet wraps around the buffer; from the frame at which it first stands in the loop on it
    stays in it, and in each range that takes its place. A note's changes are folded over in their order, each from the
    place that the one before leads to, in closed form; of changes at one frame the greatest range counts.
    """
    log = F.sort_array(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))))
    column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    notes = notes.join(loops.groupBy(*keys).agg(log.alias("_log")), keys, "left").withColumns({"_pace": column(pace).cast("double"), "_at": column(position).cast("double")})
    fields = ("frame", "low", "high", "at", "inside")
    state = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, fields)])
    none = F.lit(None).cast("double")
    first = state(F.lit(0).cast("long"), none, none, F.col("_at"), F.lit(False))
    begin = F.struct(first.alias("now"), F.array(first).alias("all"))

    def change(done: Column, new: Column) -> Column:
        now = done["now"]
        moved = _moved(now["at"], now["inside"], F.col("_pace"), now["low"], now["high"], new["frame"] - now["frame"])
        return F.transform(F.array(moved), lambda m: state(new["frame"], new["low"], new["high"], m["at"], m["inside"]))[0]

    def both(done: Column, new: Column) -> Column:
        return F.transform(F.array(change(done, new)), lambda n: F.struct(n.alias("now"), F.concat(done["all"], F.array(n)).cast(_STATE).alias("all")))[0]

    kinds = f"struct<now:{_STATE[6:-1]},all:{_STATE}>"
    log = F.coalesce("_log", F.array().cast("array<struct<frame:bigint,low:double,high:double>>"))
    folded = F.aggregate(log, begin.cast(kinds), lambda done, new: both(done, new).cast(kinds), lambda done: done["all"])
    return notes.withColumn("_loops", folded).drop("_log", "_at")


def with_playhead(frames: DataFrame, t: Column, name: str = "place", shift: float | Column = 0.0) -> DataFrame:
    """frames of notes of with_loops with `name`, the place (0..1) of the playhead `t` frames after its note's start; with modulation, `shift`
    is added, and what leaves the loop is folded into it."""
    now = F.element_at(F.filter("_loops", lambda s: s["frame"] <= t), -1)
    found = frames.withColumn("_now", now)
    now = F.col("_now")
    found = found.withColumn("_moved", _moved(now["at"], now["inside"], F.col("_pace"), now["low"], now["high"], t - now["frame"]))
    place = F.col("_moved.at") + shift
    held = F.when(F.col("_moved.inside") & now["low"].isNotNull(), _folded(place, now["low"], now["high"])).otherwise(place)
    return found.withColumn(name, _wrapped(held)).drop("_now", "_moved")
