"""Structured Streaming forms: windowed meters, sessions of silence, folds with carried state, and late control events."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.operators.folds import HUSH, QUIET
from tessitura.operators.kernels import Kernel, automated, run


def meter(samples: DataFrame, key: str, window: str, late: str) -> DataFrame:
    """(key, start, peak, rms) per tumbling window of samples(key, ts, x); ts is an instant, `late` bounds the state."""
    levels = samples.withWatermark("ts", late).groupBy(key, F.window("ts", window).alias("w")).agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))
    return levels.select(key, F.col("w.start").alias("start"), "peak", "rms", "n")


def activity(samples: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): stretches of samples with no pause of `gap`; a tail that ends is a session that closes."""
    found = samples.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold(samples: DataFrame, key: str, kernel: Kernel, channels: list[str], kind: str = "long") -> DataFrame:
    """(key, frame, channels, late): a kernel over a stream, with its state carried from batch to batch.

    Frames of a key are put in order within a batch. A frame at or before the last one folded can't be folded any more, as its
    successor has already sounded: it is passed on as it came, marked `late`. The output is the batch fold's for input in
    order, however it is cut.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, inner = (-1, None) if not state.exists else (state.get[0], pickle.loads(state.get[1]))
        own = pd.concat(list(parts)).sort_values("frame", kind="stable")
        late, own = own[own["frame"] <= last], own[own["frame"] > last]
        if len(late):
            yield pd.DataFrame({key: k[0], "frame": late["frame"].to_numpy(), **{c: late[c].to_numpy(float) for c in channels}, "late": True})
        if len(own):
            x = own[channels].to_numpy(float)[:, None, :]
            y, inner = run(kernel, x, inner if inner is not None else kernel.init(1, len(channels)))
            state.update((int(own["frame"].iloc[-1]), pickle.dumps(inner)))
            yield pd.DataFrame({key: k[0], "frame": own["frame"].to_numpy(), **{c: y[:, 0, n] for n, c in enumerate(channels)}, "late": False})

    schema = f"`{key}` {kind}, frame long, " + ", ".join(f"`{c}` double" for c in channels) + ", late boolean"
    cut = samples.select(key, "frame", *channels)
    return cut.groupBy(key).applyInPandasWithState(step, schema, "last long, inner binary", "append", GroupStateTimeout.NoTimeout)


def controlled(
    samples: DataFrame, events: DataFrame, key: str, make: Callable[..., Kernel], start: dict[str, float], channels: list[str], rate: float, inertia: float = 0.0,
    every: int = 0, quiet: float = QUIET, hush: float = HUSH, idle: float | None = None, kind: str = "long",
) -> DataFrame:
    """(key, what, frame, channels, late): a kernel over a stream of samples(key, frame, channels) while a stream of events(key, frame, seq, name, value) sets its
    parameters. make(**values) gives the kernel and start the first values; a value moves as in kernels.automated, by `inertia`.

    A key's state holds its kernel's memory, the values with their targets, and the events that are not due yet. An event takes effect at the first
    frame at or after its own that has not sounded: one that comes late at the start of the block that it comes with; of several at one frame the last `seq` counts.
    As long as events come no later than their frames, the sound is the batch kernel's, however the stream is cut. Rows of `what`: sound;
    position, at each `every` frames; silent, where the sound has stayed within `quiet` for `hush` seconds, once for each silence; stopped, behind
    the last frame of a key that got nothing for `idle` seconds, whose state is dropped then. Frames that come late are passed on as in fold.
    """
    patience = max(1, int(hush * rate))
    names = [key, "what", "frame", *channels, "late"]

    def status(k, what, frames):
        return pd.DataFrame({key: k, "what": what, "frame": frames, **{c: np.nan for c in channels}, "late": False})[names]

    def sound(k, part, values, late):
        return pd.DataFrame({key: k, "what": "sound", "frame": part["frame"].to_numpy(), **{c: values[:, n] for n, c in enumerate(channels)}, "late": late})[names]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            if last >= 0:
                yield status(k[0], "stopped", [last + 1])
            return
        if state.exists:
            last, held = state.get[0], pickle.loads(state.get[1])
        else:
            last, held = -1, {"inner": None, "value": dict(start), "target": dict(start), "due": [], "silent": 0}
        own = pd.concat(list(parts))
        new = own[own["name"].notna()]
        due = sorted([*held["due"], *zip(new["frame"].tolist(), new["seq"].tolist(), new["name"].tolist(), new["value"].tolist())], key=lambda e: e[:2])
        own = own[own["name"].isna()].sort_values("frame", kind="stable")
        late, own = own[own["frame"] <= last], own[own["frame"] > last]
        if len(late):
            yield sound(k[0], late, late[channels].to_numpy(float), True)
        if len(own):
            frames, x = own["frame"].to_numpy(), own[channels].to_numpy(float)[:, None, :]
            at = np.searchsorted(frames, [e[0] for e in due]).tolist()
            kernel = automated(make, start, [(n, e[2], e[3]) for n, e in zip(at, due) if n < len(frames)], inertia, rate)
            now = kernel.init(1, len(channels)) | {"value": held["value"], "target": held["target"], "kernel": make(**held["value"])}
            if held["inner"] is not None:
                now["inner"] = held["inner"]
            y = run(kernel, x, now)[0][:, 0]
            yield sound(k[0], own, y, False)
            if every:
                yield status(k[0], "position", frames[frames % every == 0])
            loud = np.abs(y).max(1) > quiet
            since = np.arange(len(y)) - np.maximum.accumulate(np.where(loud, np.arange(len(y)), -1 - held["silent"]))
            yield status(k[0], "silent", frames[since == patience])
            last, due = int(frames[-1]), [e for n, e in zip(at, due) if n == len(frames)]
            held |= {"inner": now["inner"], "value": now["value"], "target": now["target"], "silent": int(since[-1])}
        state.update((last, pickle.dumps(held | {"due": due})))
        if idle is not None:
            state.setTimeoutDuration(int(idle * 1000))

    schema = f"`{key}` {kind}, what string, frame long, " + ", ".join(f"`{c}` double" for c in channels) + ", late boolean"
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    frames = samples.select(key, F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in channels], none("seq", "long"), none("name", "string"), none("value", "double"))
    changes = events.select(key, F.col("frame").cast("long").alias("frame"), *[none(c, "double") for c in channels], F.col("seq").cast("long").alias("seq"), "name", F.col("value").cast("double").alias("value"))
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.unionByName(changes).groupBy(key).applyInPandasWithState(step, schema, "last long, memory binary", "append", timeout)


def effective(events: DataFrame, block_start: str = "block_start") -> DataFrame:
    """Control events are never dropped: one that is due before the block it arrives in takes effect at the block's start."""
    return events.withColumn("effective_time", F.greatest("sample_time", block_start))

