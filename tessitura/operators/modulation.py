"""Modulation of voices: each note's own LFOs and envelope in steps of a block of frames, and what they do to the grains that it plays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators.automation import ahdsr

#: Frames of a step, and where a route's amount begins to count: fixed values.
BLOCK, LEAST = 64, 0.001
#: What can move a voice; the first two swing around 0, the others go from 0 to 1.
SOURCES = ("lfo1", "lfo2", "envelope", "velocity", "keytrack")
TARGETS = ("volume", "pan", "speed", "size", "density", "position")
#: Digits of the running phase of grains, so that a whole number is one whatever its sum's rounding.
DIGITS = 9


@dataclass(frozen=True)
class Route:
    """A source's part in a target: `amount` of -1..1 of it, around 0 (bipolar) or from 0 to 1."""

    source: str
    target: str
    amount: float
    bipolar: bool

    def __post_init__(self):
        if self.source not in SOURCES or self.target not in TARGETS:
            raise ValueError(f"no route from {self.source!r} to {self.target!r}")
        if not abs(self.amount) <= 1:
            raise ValueError("a route's amount must be in -1..1")


def _routed(routes: list[Route], values: dict[str, Column]) -> dict[str, Column]:
    """Each target's sum. Of several routes of one pair the last counts."""
    last = {(r.source, r.target): r for r in routes}
    out = {t: F.lit(0.0) for t in TARGETS}
    for r in last.values():
        if abs(r.amount) >= LEAST:
            swings, x = r.source.startswith("lfo"), values[r.source]
            own = x if swings == r.bipolar else S.to_unipolar(x) if swings else S.to_bipolar(x)
            out[r.target] = out[r.target] + own * r.amount
    return out


def voice_steps(notes: DataFrame, rate: float, routes: list[Route], lfos=((1.0, "sine"), (2.0, "triangle")), envelope: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(note columns, step, frames, mod_<target>): the modulation of each note at the first frame of every `block` frames that it sounds.

    notes(note_id, note, velocity, on_frame, off_frame): sources start with the note. A held LFO's values follow the note's id. The
    routes are expressions of one projection: the matrix costs no join.
    """
    count = F.ceil((F.col("off_frame") - F.col("on_frame")) / block).cast("long")
    steps = notes.filter("off_frame > on_frame").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    t, off = F.col("step") * block, F.col("off_frame") - F.col("on_frame")
    values = {}
    for n, (hz, shape) in enumerate(lfos, 1):
        turns = t * hz / rate
        cycle, phase = F.floor(turns), turns - F.floor(turns)
        own = cycle + F.col("note_id") * 131
        values[f"lfo{n}"] = S.lfo_held(own, n) if shape == "random" else S.lfo_smooth(own, phase, n) if shape == "smooth_random" else S.lfo(phase, shape)
    values["envelope"] = ahdsr(t, off, rate, **envelope) if envelope else F.lit(0.0)
    values["velocity"], values["keytrack"] = S.velocity(F.col("velocity")), S.keytracked(F.col("note"))
    out = _routed(routes, values)
    return steps.select(*notes.columns, "step", F.least(F.lit(block).cast("long"), off - t).alias("frames"), *[out[c].alias(f"mod_{c}") for c in TARGETS])


def modulated_triggers(steps: DataFrame, key: str, density: float, rate: float, block: int = BLOCK) -> DataFrame:
    """(steps' columns, grain, start) of voice_steps: a phase runs `density` times a second, more or less as each step's modulation has it, and triggers a
    grain whenever it passes a whole number; it starts full, so that the first grain sounds at once.

    The phase at a step's start is a running sum over the steps before; the frame of a grain within a step is the inverse
    of a line. With a density that doesn't change this is cloud_triggers.
    """
    pace = F.least(F.greatest(density * (1 + F.col("mod_density")), F.lit(1.0)), F.lit(100.0)) / rate
    before = Window.partitionBy(key, "note_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    timed = steps.withColumn("_pace", pace)
    timed = timed.withColumn("_from", F.round(F.coalesce(F.sum(F.col("_pace") * F.col("frames")).over(before), F.lit(0.0)), DIGITS))
    first = F.when(F.col("step") == 0, F.lit(0).cast("long")).otherwise(F.floor("_from").cast("long") + 1)
    last = F.floor(F.round(F.col("_from") + F.col("_pace") * F.col("frames"), DIGITS)).cast("long")
    grains = timed.filter(first <= last).withColumn("grain", F.explode(F.sequence(first, last)))
    within = F.greatest(F.ceil(F.round((F.col("grain") - F.col("_from")) / F.col("_pace"), DIGITS)).cast("long") - 1, F.lit(0).cast("long"))
    found = grains.withColumn("start", F.col("on_frame") + F.col("step") * block + within)
    return found.filter("start < off_frame").drop("_pace", "_from")


def modulated_grains(grains: DataFrame, buffers: DataFrame, rate: float, size: float = 100.0, position: float = 0.5) -> DataFrame:
    """Grains of modulated_triggers as played_grains takes them, with size (ms), speed and volume times, position and pan plus the modulation of
    the step that they start in; all held within their ranges."""
    held = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    length = (held(size * (1 + F.col("mod_size")), 1.0, 1000.0) * rate / 1000).cast("long")
    return grains.join(buffers, "buffer_id").filter("size(samples) > 0").withColumns(
        {
            "length": F.greatest(length, F.lit(2).cast("long")),
            "volume": F.col("volume") * F.greatest(1 + F.col("mod_volume"), F.lit(0.0)),
            "turn": F.col("speed") * F.greatest(1 + F.col("mod_speed"), F.lit(0.0)),
            "place": held(position + F.col("mod_position"), 0.0, 1.0),
            "pan": held(F.col("pan") + F.col("mod_pan"), -1.0, 1.0),
        }
    )


_NOTE = "struct<frame:bigint,place:double,speed:double,volume:double,pan:double>"


#: Frames of a track that are summed in one task: more than most notes last.
STRETCH = 1 << 14


def handled(notes: DataFrame, changes: DataFrame, buffers: DataFrame, key: str) -> DataFrame:
    """(key, note_id, frame, l, r): notes that play their buffers to the end, as for synthesis.sampled, with changes of speed, volume and pan while they sound.

    notes(key, note_id, buffer_id, on_frame, speed, volume, pan); changes(key, note_id, frame, seq, what, value) take effect at their frame, those before the
    note at its first; what is speed, volume or pan, and of several at one frame the last `seq` counts. A note's changes are folded over in their
    order, which gives the place in the buffer at each of them; between two of them it moves along a line, which makes its own
    frames. One row of changes a note, no join a frame.
    """
    return _handled(_handles(notes, changes, buffers, key), key).select(key, "note_id", "frame", "l", "r")


def handled_mix(notes: DataFrame, changes: DataFrame, buffers: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """(key, frame, l, r): what handled gives, summed. Notes with their buffers are dealt out by track and stretch of frames, one that sounds in several
    stretches to each of them, so that frames are summed where they arise; a long track is many tasks."""
    own = _handles(notes, changes, buffers, key)
    reach = lambda t: F.floor((F.col("on_frame") + t) / stretch).cast("long")
    own = own.withColumn("_stretch", F.explode(F.sequence(reach(0), reach(F.col("_last")))))
    # a stated number: a note's frames cost more than its bytes tell
    own = own.repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "_stretch")
    first = F.col("_stretch") * stretch - F.col("on_frame")
    out = _handled(own, key, first, first + stretch - 1)
    return out.groupBy(key, "_stretch", "frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).drop("_stretch")


def _handles(notes: DataFrame, changes: DataFrame, buffers: DataFrame, key: str) -> DataFrame:
    """Notes that sound, with their samples, their states in order (_all) and their last frame (_last), counted from on_frame."""
    order = F.struct(F.col("frame").cast("long").alias("frame"), F.col("seq").cast("long").alias("seq"), "what", F.col("value").cast("double").alias("value"))
    log = changes.groupBy(key, "note_id").agg(F.sort_array(F.collect_list(order)).alias("_log"))
    own = notes.select(key, "note_id", "buffer_id", F.col("on_frame").cast("long").alias("on_frame"), *[F.col(c).cast("double").alias(c) for c in ("speed", "volume", "pan")])
    own = own.join(log, [key, "note_id"], "left").join(buffers, "buffer_id").filter("size(samples) > 1")
    state = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("frame", "place", "speed", "volume", "pan"))])
    first = state(F.lit(0).cast("long"), F.lit(0.0), F.col("speed"), F.col("volume"), F.col("pan"))

    def change(done: Column, new: Column) -> Column:
        now, t = done["now"], F.greatest(new["frame"] - F.col("on_frame"), F.lit(0).cast("long"))
        to = lambda what: F.when(new["what"] == what, new["value"]).otherwise(now[what])
        after = state(t, now["place"] + now["speed"] * (t - now["frame"]), to("speed"), to("volume"), to("pan"))
        return F.transform(F.array(after), lambda n: F.struct(n.alias("now"), F.concat(done["all"], F.array(n)).alias("all")))[0]

    kinds = f"struct<now:{_NOTE},all:array<{_NOTE}>>"
    begin = F.struct(first.alias("now"), F.array(first).alias("all")).cast(kinds)
    empty = F.array().cast("array<struct<frame:bigint,seq:bigint,what:string,value:double>>")
    own = own.withColumn("_all", F.aggregate(F.coalesce("_log", empty), begin, lambda done, new: change(done, new).cast(kinds), lambda done: done["all"]))
    end = F.size("samples") - 2

    def reached(s: Column, i: Column) -> Column:
        last, following = s["frame"] + F.floor((end - s["place"]) / s["speed"]).cast("long"), F.get("_all", i + 1)["frame"]
        return F.when(following.isNull() | (last < following), last)

    return own.withColumn("_last", F.array_min(F.transform("_all", reached))).filter("_last >= 0").select(key, "note_id", "on_frame", "samples", "_all", "_last")


def _handled(own: DataFrame, key: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Frames of notes of _handles, or those from `first` to `last` of each, which count from on_frame: a row for each state that holds for a while, then
    its frames, so that what is done a frame is arithmetic."""
    bound = F.col("_last") if last is None else F.least("_last", last)

    def held(s: Column, i: Column) -> Column:
        since = s["frame"] if first is None else F.greatest(s["frame"], first)
        return F.struct(since.alias("_since"), F.least(bound, F.get("_all", i + 1)["frame"] - 1).alias("_until"), *[s[c].alias(f"_{c}") for c in ("frame", "place", "speed", "volume", "pan")])

    spans = own.select("*", F.inline(F.filter(F.transform("_all", held), lambda s: s["_since"] <= s["_until"]))).drop("_all")
    rows = spans.withColumn("t", F.explode(F.sequence("_since", "_until")))
    rows = rows.withColumn("_at", F.col("_place") + F.col("_speed") * (F.col("t") - F.col("_frame")))
    low = F.floor("_at").cast("int")
    part = F.col("_at") - low
    rows = rows.withColumn("_x", (F.get("samples", low) * (1 - part) + F.coalesce(F.get("samples", low + 1), F.lit(0.0)) * part) * F.col("_volume"))
    side = lambda law: F.col("_x") * law(F.col("_pan"))
    kept = [c for c in ("_stretch",) if c in own.columns]
    return rows.select(key, "note_id", *kept, (F.col("on_frame") + F.col("t")).alias("frame"), side(S.pan_left).alias("l"), side(S.pan_right).alias("r"))
