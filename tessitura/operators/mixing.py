"""Combining signals: gain, pan, buses, meters, waveforms, silence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S


def amplify(signal: DataFrame, gain: Column, channels=("l", "r")) -> DataFrame:
    return signal.withColumns({c: F.col(c) * gain for c in channels})


def pan(signal: DataFrame, place: Column) -> DataFrame:
    """Constant-power panning of l and r."""
    return signal.withColumns({"l": F.col("l") * S.pan_left(place), "r": F.col("r") * S.pan_right(place)})


def to_mono(signal: DataFrame) -> DataFrame:
    return signal.withColumn("x", (F.col("l") + F.col("r")) / 2).drop("l", "r")


def to_stereo(signal: DataFrame) -> DataFrame:
    return signal.withColumns({"l": F.col("x"), "r": F.col("x")}).drop("x")


def mix(signals: list[DataFrame], keys: list[str], channels: list[str]) -> DataFrame:
    """The sum of signals by keys; a frame that a signal lacks counts as silence. Partial sums go ahead of the one shuffle."""
    cut = [s.select(*keys, *channels) for s in signals]
    return mixdown(reduce(DataFrame.unionByName, cut), keys, channels)


def mixdown(signal: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    return signal.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in channels])


def mix_tree(signal: DataFrame, parents: DataFrame, depth: int, channels: list[str], effects=None) -> DataFrame:
    """(mixer_id, frame, channels): every bus of a tree, with its children's sums in it.

    signal(mixer_id, frame, channels...) holds the own sources of buses; parents(mixer_id, parent_id) is the tree, of `depth`
    levels below the root. effects maps mixer_id to a function of a bus's DataFrame, applied to what it passes on; a level is read once for each of
    its buses with one, and once for the others. Buses
    without effects are sums of sums: the signal is shuffled once, by frame and ancestor, and not once a level.
    """
    if not effects:
        up = parents.filter("parent_id IS NOT NULL")
        chain = parents.select("mixer_id", F.col("mixer_id").alias("bus"))
        step = chain
        for _ in range(depth):
            step = step.join(up.select(F.col("mixer_id").alias("bus"), F.col("parent_id").alias("next")), "bus").select("mixer_id", F.col("next").alias("bus"))
            chain = chain.unionAll(step)
        every = signal.join(chain, "mixer_id").drop("mixer_id").withColumnRenamed("bus", "mixer_id")
        return mixdown(every, ["mixer_id", "frame"], channels)
    levels = _levels(parents, depth)
    out = carried = None
    for ids in levels:  # deepest first
        own = signal.filter(F.col("mixer_id").isin(ids)).select("mixer_id", "frame", *channels)
        if carried is not None:
            own = own.unionByName(carried)
        level = mixdown(own, ["mixer_id", "frame"], channels)
        touched = [k for k in ids if k in effects]
        if touched:
            plain = level.filter(~F.col("mixer_id").isin(touched))
            level = reduce(DataFrame.unionByName, [effects[k](level.filter(F.col("mixer_id") == k)).select(level.columns) for k in touched], plain)
        out = level if out is None else out.unionByName(level)
        # the children of a level's buses are the whole level below it
        carried = level.join(parents.filter("parent_id IS NOT NULL"), "mixer_id").select(F.col("parent_id").alias("mixer_id"), "frame", *channels)
    return out


def _levels(parents: DataFrame, depth: int) -> list[list[int]]:
    """Mixer ids by level, deepest first; a graph has as many rows as buses."""
    up = {r[0]: r[1] for r in parents.collect()}

    def level(k):
        n = 0
        while up.get(k) is not None:
            k, n = up[k], n + 1
        return n

    found: dict[int, list[int]] = {}
    for k in up:
        found.setdefault(level(k), []).append(k)
    if max(found, default=0) > depth:
        raise ValueError("the tree is deeper than stated")
    return [sorted(found[n]) for n in sorted(found, reverse=True)]


def tree_paths(spark, view: str = "mixer") -> DataFrame:
    """(mixer_id, depth, path) of a registered view mixer(mixer_id, parent_id), by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE t(mixer_id, depth, path) AS (
          SELECT mixer_id, 0, CAST(mixer_id AS STRING) FROM {view} WHERE parent_id IS NULL
          UNION ALL
          SELECT m.mixer_id, t.depth + 1, concat(t.path, '/', m.mixer_id) FROM {view} m JOIN t ON m.parent_id = t.mixer_id)
        SELECT mixer_id, depth, path FROM t""")


def meter(signal: DataFrame, keys: list[str], size: int, channels: list[str]) -> DataFrame:
    """Peak and RMS of each channel over tumbling windows of `size` frames: keys, window_start, channel, peak, rms and both in
    dB (null for silence)."""
    window = (F.floor(F.col("frame") / size) * size).cast("long")
    sums = signal.groupBy(*keys, window.alias("window_start")).agg(
        *[f.alias(f"{n}_{c}") for c in channels for n, f in (("peak", F.max(F.abs(c))), ("rms", F.sqrt(F.avg(F.col(c) * F.col(c)))))]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"peak_{c}").alias("peak"), F.col(f"rms_{c}").alias("rms")) for c in channels])
    level = sums.select(*keys, "window_start", F.inline(rows))
    db = lambda x: F.when(F.col(x) > 0, 20 * F.log10(F.col(x)))
    return level.withColumns({"peak_db": db("peak"), "rms_db": db("rms")})


def meter_in_time(samples: DataFrame, keys: list[str], window: str, x: str = "x") -> DataFrame:
    """Peak and RMS of samples(keys, ts, x) over tumbling windows of time: keys, start, peak, rms."""
    levels = samples.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"))
    return levels.select(*keys, F.col("w.start").alias("start"), "peak", "rms")


def waveform(signal: DataFrame, keys: list[str], points: int, x: str, rate: float) -> DataFrame:
    """(keys, bucket, time, low, high) of at most `points` buckets of a track; a shorter track has a point per frame.

    Bucket i covers the frames from floor(i step) on, with step = frames / points.
    """
    spans = signal.groupBy(*keys).agg((F.max("frame") + 1).alias("total"))
    step = F.greatest(F.lit(1.0), F.col("total") / float(points))
    guess = F.floor(F.col("frame") / step)
    # floor(i step) is the bucket's first frame: the guess may be one short
    bucket = F.when(F.floor((guess + 1) * step) <= F.col("frame"), guess + 1).otherwise(guess).cast("long")
    placed = signal.join(spans, keys).withColumn("bucket", bucket)
    return placed.groupBy(*keys, "bucket").agg((F.min("frame") / rate).alias("time"), F.min(x).alias("low"), F.max(x).alias("high"))


def silences(signal: DataFrame, keys: list[str], level: float, least: int, x: str = "x") -> DataFrame:
    """(keys, start, frames): stretches of at least `least` frames whose magnitude stays under `level`."""
    order = Window.partitionBy(*keys).orderBy("frame")
    quiet = signal.withColumn("quiet", F.abs(x) < level)
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "quiet").orderBy("frame"))
    runs = quiet.withColumn("island", island).filter("quiet").groupBy(*keys, "island")
    return runs.agg(F.min("frame").alias("start"), F.count("*").alias("frames")).filter(F.col("frames") >= least).drop("island")


def until_silent(signal: DataFrame, keys: list[str], level: float, least: int, x: str = "x") -> DataFrame:
    """A track up to the end of its first silence of `least` frames; later frames are dropped."""
    order = Window.partitionBy(*keys).orderBy("frame")
    loud = F.max((F.abs(x) >= level).cast("int")).over(order.rowsBetween(-(least - 1), 0))
    full = F.row_number().over(order) >= least
    dead = signal.withColumn("dead", (full & (loud == 0)).cast("int"))
    before = F.coalesce(F.max("dead").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dead.withColumn("before", before).filter("before = 0").drop("dead", "before")


def statuses(signal: DataFrame, keys: list[str], every: int, rate: float) -> DataFrame:
    """(keys, frame, kind, position): a position at every `every` frames, the first included, and one `stopped` at the end."""
    last = signal.groupBy(*keys).agg(F.max("frame").alias("frame")).select(*keys, (F.col("frame") + 1).alias("frame"), F.lit("stopped").alias("kind"))
    found = signal.filter(F.col("frame") % every == 0).select(*keys, "frame", F.lit("position").alias("kind")).unionByName(last)
    return found.withColumn("position", F.col("frame") / rate)
