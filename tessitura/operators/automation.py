"""Values over time: scheduled events as of each frame, smoothers, faders, envelopes, gates, loops and glides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S


def as_of(signal: DataFrame, events: DataFrame, keys: list[str], time: str, values: dict[str, str], seq: str | None = None) -> DataFrame:
    """signal with, for each (event column -> name) of values, the value of the last event at or before its time.

    Events of one time apply in the order of `seq`. One shuffle by keys and one sort: both sides are laid in one order, an
    event ahead of the frames of its time, and the last value is carried. No event before a frame gives null.
    """
    null = F.lit(None)
    own = signal.select(*signal.columns, F.lit(1).alias("_side"), null.cast("long").alias("_seq"), *[null.cast(events.schema[c].dataType).alias(f"_{n}") for c, n in values.items()])
    log = events.select(
        *[F.col(c) if c in [*keys, time] else null.cast(signal.schema[c].dataType).alias(c) for c in signal.columns],
        F.lit(0).alias("_side"), (F.col(seq).cast("long") if seq else null.cast("long")).alias("_seq"), *[F.col(c).alias(f"_{n}") for c, n in values.items()],
    )
    order = Window.partitionBy(*keys).orderBy(time, "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = own.unionByName(log).withColumns({n: F.last(f"_{n}", True).over(order) for n in values.values()})
    return carried.filter("_side = 1").select(*signal.columns, *values.values())


def frames_since(signal: DataFrame, keys: list[str], changed: Column) -> Column:
    """Frames since the last one on which `changed` held; null before it."""
    order = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return F.col("frame") - F.last(F.when(changed, F.col("frame")), True).over(order)


def exponential(start: Column, target: Column, frames: Column, inertia: float, rate: float = 44100.0) -> Column:
    """Where an exponential smoother is after `frames` steps: each covers inertia x 44100 / rate of what is left."""
    return target - (target - start) * F.pow(F.lit(1 - inertia * 44100.0 / rate), frames)


def linear(start: Column, target: Column, frames: Column, step: float, rate: float = 44100.0) -> Column:
    """Where a linear smoother is after `frames` steps of a fixed size; it stops at the target."""
    size = step * 44100.0 / rate
    count = F.greatest(F.round(F.abs(target - start) / size), F.lit(1.0))
    return F.when(frames >= count, target).otherwise(start + F.signum(target - start) * size * frames)


def linear_over(start: Column, target: Column, frames: Column, duration: int) -> Column:
    """Where a linear smoother of a fixed duration in frames is."""
    return F.when(frames >= duration, target).otherwise(start + (target - start) * frames / float(duration))


def spring(start: Column, target: Column, frames: Column, duration: float, rate: float = 44100.0) -> Column:
    """Where a critically damped spring is after `frames` steps from rest.

    The step v += (t - c) w^2 - 2 w v; c += v is linear with two real eigenvalues, hence a closed form.
    """
    w = 5.5 / duration * 44100.0 / rate
    trace, root = 2 - 2 * w - w * w, w * math.sqrt(w * w + 4 * w)
    p, q = (trace + root) / 2, (trace - root) / 2
    a = (1 - w * w - q) / (p - q)
    return target - (target - start) * (a * F.pow(F.lit(p), frames) + (1 - a) * F.pow(F.lit(q), frames))


def smoothed_events(events: DataFrame, keys: list[str], inertia: float, start: float, rate: float = 44100.0) -> DataFrame:
    """events(keys, frame, target) with `from`: the value of an exponential smoother where each event takes over.

    A retarget in mid-ramp starts from where the ramp stands: from' = target + (from - target) q^gap with the target before.
    With q^frame divided out, that is a running sum: from_k = q^f_k (start + sum over j < k of target_j (q^-f_(j+1) - q^-f_j)).
    Powers of q relative to a stretch of the track keep the sum in range: stretches of `reach` frames are summed on
    their own, and an earlier one is scaled down by q^reach for each stretch between. Windows only, linear in the events.
    """
    q = 1 - inertia * 44100.0 / rate
    if q <= 0:
        order = Window.partitionBy(*keys).orderBy("frame", "target")
        return events.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("target").cast("double").alias("target")).withColumn("from", F.coalesce(F.lag("target").over(order), F.lit(float(start))))
    reach = max(1, int(200 / -math.log(q)))
    order = Window.partitionBy(*keys).orderBy("frame", "target")
    own = events.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("target").cast("double").alias("target"))
    before, since = F.coalesce(F.lag("target").over(order), F.lit(float(start))), F.coalesce(F.lag("frame").over(order), F.lit(0))
    # what the ramp to the target before has covered when this event takes over, seen from the event
    own = own.withColumns({"_old": before, "_gap": F.col("frame") - since, "_part": F.floor(F.col("frame") / reach)})
    own = own.withColumn("_own", F.col("_old") * (1 - F.pow(F.lit(q), F.col("_gap"))))
    inside = F.col("frame") - F.col("_part") * reach
    grown = F.sum(F.col("_own") * F.pow(F.lit(q), -inside)).over(Window.partitionBy(*keys, "_part").orderBy("frame", "target").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_sum", grown * F.pow(F.lit(q), inside))
    # a stretch's sum at its end; what is two stretches back has lost 170 decimal powers and is nothing
    last = own.groupBy(*keys, "_part").agg(F.max(F.struct("frame", "target", "_sum")).alias("_l")).select(*keys, (F.col("_part") + 1).alias("_part"), F.col("_l.frame").alias("_at"), F.col("_l._sum").alias("_carry"))
    out = own.join(last, [*keys, "_part"], "left")
    carried = F.coalesce(F.col("_carry") * F.pow(F.lit(q), F.col("frame") - F.col("_at")), F.lit(0.0))
    return out.select(*keys, "frame", "target", (F.lit(float(start)) * F.pow(F.lit(q), F.col("frame")) + F.col("_sum") + carried).alias("from"))


def automated(signal: DataFrame, events: DataFrame, keys: list[str], inertia: float, start: float, rate: float = 44100.0, name: str = "value") -> DataFrame:
    """signal with `name`: an exponentially smoothed parameter whose targets are events(keys, frame, target)."""
    segments = smoothed_events(events, keys, inertia, start, rate).withColumn("at", F.col("frame"))
    found = as_of(signal, segments, keys, "frame", {"target": "_t", "from": "_f", "at": "_a"})
    value = exponential(F.col("_f"), F.col("_t"), F.col("frame") - F.col("_a"), inertia, rate)
    return found.withColumn(name, F.coalesce(value, F.lit(float(start)))).drop("_t", "_f", "_a")


def fader(frames: Column, start: float, target: float, seconds: float, rate: float) -> Column:
    """A volume fade: 99 % of the way after `seconds`; the value of a frame includes its own step."""
    step = 1 - math.exp(-4.605 / (rate * seconds))
    return target + (start - target) * F.pow(F.lit(1 - step), frames + 1)


def gated(signal: DataFrame, tracks: DataFrame, keys: list[str], seconds: float, rate: float, channels=("x",)) -> DataFrame:
    """Tracks between their start and stop: tracks(keys, start_frame, stop_frame or null). After the stop a fade to silence
    of `seconds`, until it is under 1e-4; the frame filter comes before any effect."""
    step = 1 - math.exp(-4.605 / (rate * seconds))
    ring = math.ceil(math.log(1e-4) / math.log(1 - step)) - 1
    placed = signal.join(tracks, keys).filter("frame >= start_frame").filter(F.coalesce(F.col("frame") < F.col("stop_frame") + ring, F.lit(True)))
    faded = F.when(F.col("frame") >= F.col("stop_frame"), fader(F.col("frame") - F.col("stop_frame"), 1.0, 0.0, seconds, rate)).otherwise(F.lit(1.0))
    return placed.withColumns({c: F.col(c) * faded for c in channels}).drop("start_frame", "stop_frame")


def ahdsr(t: Column, off: Column, rate: float, attack: float, hold: float, decay: float, sustain: float, release: float, bend: float = 0.0) -> Column:
    """Level of an envelope t frames after note-on; off: the frame of note-off (null: held). Linear segments; the attack may
    be bent; the release starts from the level at note-off and ends at 0.001."""
    a, h, d, r = (x * rate for x in (attack, hold, decay, release))

    def held(n: Column) -> Column:
        rise = S.bend(F.least((n + 1) / a, F.lit(1.0)), bend) if a > 0 else F.lit(1.0)
        fall = 1 - (1 - sustain) * F.least(F.greatest((n + 1 - a - h) / d, F.lit(0.0)), F.lit(1.0)) if d > 0 else F.lit(sustain)
        return F.when(n + 1 <= a + h, rise).otherwise(fall)

    level = held(off - 1)
    gone = level * (1 - (t - off + 1) / r) if r > 0 else F.lit(0.0)
    return F.when(off.isNull() | (t < off), held(t)).otherwise(F.when(gone <= 0.001, F.lit(0.0)).otherwise(gone))


def looped(signal: DataFrame, keys: list[str], first: int | None, last: int | None, repeats: int) -> DataFrame:
    """A track up to the end of its loop, and the loop's frames first..last-1 `repeats` times more; what is behind the loop is
    never reached. Without repeats the whole track plays once; without a loop (None) the whole track repeats.

    Each frame states where it sounds, so that no frame looks for its source: an explode, without a join. Only a loop of
    the whole track asks for its length: a window.
    """
    f = F.col("frame")
    out = signal.withColumn("source_frame", f)
    if not repeats:
        return out
    if first is None:
        n = F.max("frame").over(Window.partitionBy(*keys)) + 1
        at = F.transform(F.sequence(F.lit(0), F.lit(repeats)), lambda k: f + k * F.col("_n"))
        return out.withColumn("_n", n).withColumn("frame", F.explode(at.cast("array<bigint>"))).drop("_n")
    n = last - first
    if n <= 0:
        raise ValueError("an empty loop")
    inside = F.transform(F.sequence(F.lit(0), F.lit(repeats)), lambda k: f + k * n)
    at = F.when(f < first, F.array(f)).otherwise(inside)
    return out.filter(f < last).withColumn("frame", F.explode(at.cast("array<bigint>")))


def due(tracks: DataFrame, first: int, behind: int) -> DataFrame:
    """tracks(track_id, start_frame, stop_frame or null) that sound in the frames first..behind-1, in the order of their start. The
    filter on the start reaches the scan: of a table sorted by it, later tracks are not read."""
    own = tracks.filter((F.col("start_frame") < behind) & (F.col("stop_frame").isNull() | (F.col("stop_frame") > first)))
    return own.orderBy("start_frame", "track_id")


def sought(signal: DataFrame, keys: list[str], offset: Column) -> DataFrame:
    """A track from `offset` on; an offset beyond its end leaves nothing."""
    return signal.withColumn("frame", F.col("frame") - offset).filter("frame >= 0")


def glide_speeds(start: float, target: float, semitones: float, rate: float, block: int = 64) -> list[float]:
    """The speeds of a glide's blocks, from its first on, until it is there. At every block the way that is left, in semitones,
    says how long it still takes at `semitones` a second, and the speed goes a block's share of that way, linearly."""
    out, now = [], float(start)
    while not out or now != target:
        left = target - now
        if semitones <= 0 or abs(left) <= 0.0001:
            now = target
        else:
            seconds = abs(12 * math.log2(target / now)) / semitones
            step = left / (seconds * rate) * block
            now = target if abs(left) < abs(step) else now + step
        out.append(now)
    return out


def glide(frames: Column, start: float, target: float, semitones: float, rate: float, block: int = 64) -> Column:
    """Speed while it glides, `frames` after the change; the steps follow from the parameters alone and are a literal."""
    speeds = F.array(*[F.lit(v) for v in glide_speeds(start, target, semitones, rate, block)])
    return F.get(speeds, F.least(F.floor(frames / block), F.size(speeds) - 1).cast("int"))


def frequency_glide(frames: Column, start: float, target: float, semitones: float, rate: float) -> Column:
    """Frequency `frames` after it was set: linear for as long as its distance takes at `semitones` a second, or at once."""
    distance = abs(12 * math.log2(target / start))
    duration = int(distance / semitones * rate) if semitones > 0 else 0
    return linear_over(F.lit(float(start)), F.lit(float(target)), frames, duration) if duration else F.when(frames.isNotNull(), F.lit(float(target)))


def gate_level(signal: DataFrame, keys: list[str], opened: Column, attack: float) -> DataFrame:
    """signal with `level`: an envelope that rises over `attack` frames from where the gate opens, and is 0 while it is closed."""
    order = Window.partitionBy(*keys).orderBy("frame")
    marked = signal.withColumn("_open", opened)
    rise = F.col("_open") & ~F.coalesce(F.lag("_open").over(order), F.lit(False))
    marked = marked.withColumn("_rise", rise)
    since = marked.withColumn("_t", frames_since(marked, keys, F.col("_rise")))
    level = F.when(F.col("_open"), F.least((F.col("_t") + 1) / attack, F.lit(1.0))).otherwise(F.lit(0.0))
    return since.withColumn("level", level).drop("_open", "_rise", "_t")


def ordered(events: DataFrame, keys: list[str], block: int) -> DataFrame:
    """events(keys, frame, seq) with `rank`: the order in which they take effect; those of a block of frames in the order of `seq`."""
    order = Window.partitionBy(*keys).orderBy(F.floor(F.col("frame") / block), "seq")
    return events.withColumn("rank", F.row_number().over(order))


def routed(values: DataFrame, routes: DataFrame) -> DataFrame:
    """Sums of modulation: values(key, source, frame, value, bipolar) over routes(source, target, amount, bipolar): mapped to the
    route's polarity, times its amount. Of several routes between a pair the last `seq` counts; under 0.001 there is none."""
    order = Window.partitionBy("source", "target").orderBy(F.desc("seq"))
    live = routes.withColumn("rank", F.row_number().over(order)).filter("rank = 1 AND abs(amount) >= 0.001").select("source", "target", "amount", F.col("bipolar").alias("wants"))
    own = F.when(F.col("wants") & ~F.col("bipolar"), S.to_bipolar(F.col("value"))).when(~F.col("wants") & F.col("bipolar"), S.to_unipolar(F.col("value"))).otherwise(F.col("value"))
    return values.join(live, "source").groupBy("key", "target", "frame").agg(F.sum(own * F.col("amount")).alias("value"))


def without_cancelled(events: DataFrame, cancels: DataFrame, keys: list[str]) -> DataFrame:
    """Events but for those that are still due when their key is cancelled: cancels(keys, at, seq) reach events(sample_time, seq) of
    a smaller seq that are due at `at` or later.

    The earliest `at` of all later cancels decides: one sort by seq and a running minimum, no pairs within a key.
    """
    names = [c for c in events.columns if c not in ("sample_time", "seq", *keys)]
    null = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    own = events.select(*keys, "seq", "sample_time", *names, F.lit(None).cast("long").alias("_at"), F.lit(1).alias("_event"))
    c = cancels.select(*keys, "seq", null("sample_time"), *[null(n) for n in names], F.col("at").cast("long").alias("_at"), F.lit(0).alias("_event"))
    later = Window.partitionBy(*keys).orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(c).withColumn("_first", F.min("_at").over(later))
    return both.filter("_event = 1 AND (_first IS NULL OR sample_time < _first)").select(*events.columns)
