"""Synth graphs of the user: a patch of nodes, played by the notes of a track or run as a source of its own.

Nodes without memory are Column expressions of a voice's frames; an oscillator whose pitch moves takes its phase from a running sum; filters,
and what is behind them, are one fold over the frames of a voice, in which voices are stepped side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators.automation import ahdsr
from tessitura.operators.folds import QUIET, HUSH, fold
from tessitura.operators.kernels import Kernel
from tessitura.operators.mixing import until_silent
from tessitura.operators.synthesis import with_voices


@dataclass(frozen=True)
class Node:
    """A signal; nodes are values, so that a node used twice is computed once. Sums and products with numbers and nodes are nodes."""

    def __add__(self, other):
        return Sum((self, node(other)))

    def __mul__(self, other):
        return Product((self, node(other)))

    def __sub__(self, other):
        return self + node(other) * -1.0

    __radd__, __rmul__ = __add__, __mul__

    def inputs(self) -> tuple[Node, ...]:
        own = [getattr(self, f.name) for f in fields(self)]
        return tuple(n for v in own for n in (v if isinstance(v, tuple) else (v,)) if isinstance(n, Node))


def node(value: Node | float) -> Node:
    return value if isinstance(value, Node) else Const(float(value))


@dataclass(frozen=True)
class Const(Node):
    value: float


@dataclass(frozen=True)
class Pitch(Node):
    """The note's frequency, column `hz`."""


@dataclass(frozen=True)
class Velocity(Node):
    """The note's column `volume`."""


@dataclass(frozen=True)
class Gate(Node):
    """1 while the note is held, then 0."""


@dataclass(frozen=True)
class Param(Node):
    """A parameter of the patch: a note's column p_<name>, held within low..high, or the default where there is none or it is null."""

    name: str
    default: float
    low: float = 0.0
    high: float = 1.0


@dataclass(frozen=True)
class Envelope(Node):
    attack: float
    hold: float
    decay: float
    sustain: float
    release: float
    bend: float = 0.0


@dataclass(frozen=True)
class Lfo(Node):
    hz: float
    shape: str = "sine"


@dataclass(frozen=True)
class Osc(Node):
    shape: str
    hz: Node = Pitch()
    width: float = 0.5


@dataclass(frozen=True)
class Sum(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Product(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Drive(Node):
    """A soft clip: tanh."""

    source: Node


@dataclass(frozen=True)
class Filter(Node):
    """A state-variable filter (lowpass, bandpass, highpass) whose cutoff, any node, is held within `lowest` and 0.49 of the rate."""

    source: Node
    kind: str
    cutoff: Node
    resonance: float = 0.0
    lowest: float = 20.0

    def __post_init__(self):
        if self.kind not in _TAPS or not 0 <= self.resonance <= 1 or self.lowest <= 0:
            raise ValueError("a filter is a lowpass, bandpass or highpass of a resonance in 0..1, with a lowest cutoff above 0")

    @property
    def damping(self) -> float:
        return max(2 * (1 - 0.97 * self.resonance), 0.03)


_TAPS = {"lowpass": lambda k: (0.0, 0.0, 1.0), "bandpass": lambda k: (0.0, 1.0, 0.0), "highpass": lambda k: (1.0, -k, -1.0)}


class Patch:
    """One output node, which a note's pan places by the pan law, or a left and a right one."""

    def __init__(self, left: Node | float, right: Node | float | None = None):
        self.outputs = (node(left),) if right is None else (node(left), node(right))
        self.nodes: list[Node] = []  # each once, inputs first

        def visit(n: Node, seen: set):
            if n not in seen:
                seen.add(n)
                for below in n.inputs():
                    visit(below, seen)
                self.nodes.append(n)

        done: set[Node] = set()
        for n in self.outputs:
            visit(n, done)
        names = [n.name for n in self.nodes if isinstance(n, Param)]
        if len(names) != len(set(names)):
            raise ValueError(f"two parameters of one name: {sorted({n for n in names if names.count(n) > 1})}")
        self.recursive = {n for n in self.nodes if isinstance(n, Filter)}
        for n in self.nodes:  # and all that hear a filter
            if any(below in self.recursive for below in n.inputs()):
                self.recursive.add(n)
        for n in self.recursive:
            if isinstance(n, Osc):
                raise ValueError("an oscillator's pitch can't come from a filter")
        self.steady = set()
        for n in self.nodes:  # values that don't change while a note sounds
            if isinstance(n, (Const, Pitch, Velocity, Param)) or isinstance(n, (Sum, Product, Drive)) and all(below in self.steady for below in n.inputs()):
                self.steady.add(n)

    def release(self, rate: float) -> int:
        return max([0, *[math.ceil(n.release * rate) for n in self.nodes if isinstance(n, Envelope)]])

    def ring(self, rate: float) -> int:
        """Frames until the filters, one behind the other, have fallen to a millionth after their input has ended."""

        def below(n: Node) -> int:
            own = math.ceil(1.2 * math.log(1 / QUIET) * rate / (math.pi * n.damping * n.lowest)) if isinstance(n, Filter) else 0
            return own + max([0, *map(below, n.inputs())])

        return max(map(below, self.outputs))


def _columns(voices: DataFrame, patch: Patch, rate: float) -> tuple[DataFrame, dict[Node, Column]]:
    """Voices' frames (_voice, t, off, hz, volume) with the phases of moving oscillators, and each memoryless node's expression."""
    t, found = F.col("t"), {}
    for k, n in enumerate(patch.nodes):
        if n in patch.recursive:
            continue
        if isinstance(n, Const):
            found[n] = F.lit(n.value)
        elif isinstance(n, (Pitch, Velocity)):
            found[n] = F.col("hz" if isinstance(n, Pitch) else "volume").cast("double")
        elif isinstance(n, Param):
            given = F.coalesce(F.col(f"p_{n.name}").cast("double"), F.lit(n.default)) if f"p_{n.name}" in voices.columns else F.lit(n.default)
            found[n] = S.clamp(given, n.low, n.high)
        elif isinstance(n, Gate):
            found[n] = F.when(F.col("off").isNull() | (t < F.col("off")), 1.0).otherwise(0.0)
        elif isinstance(n, Envelope):
            found[n] = ahdsr(t, F.col("off"), rate, n.attack, n.hold, n.decay, n.sustain, n.release, n.bend)
        elif isinstance(n, Lfo):
            found[n] = S.lfo(F.pmod(t * n.hz / rate, F.lit(1.0)), n.shape)
        elif isinstance(n, Osc):
            turns = t * found[n.hz] / rate
            if n.hz not in patch.steady:
                before = Window.partitionBy("_voice").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
                voices = voices.withColumn(f"_pace{k}", found[n.hz] / rate)
                voices = voices.withColumn(f"_turns{k}", F.coalesce(F.sum(f"_pace{k}").over(before), F.lit(0.0))).drop(f"_pace{k}")
                turns = F.col(f"_turns{k}")
            found[n] = S.oscillator(F.pmod(turns, F.lit(1.0)), n.shape, n.width)
        elif isinstance(n, Drive):
            found[n] = F.tanh(found[n.source])
        else:
            values = [found[p] for p in n.parts]
            out = values[0]
            for v in values[1:]:
                out = out + v if isinstance(n, Sum) else out * v
            found[n] = out
    return voices, found


def _kernel(patch: Patch, channels: dict[Node, int], rate: float) -> Kernel:
    """The patch behind its channels (frames, voices, channels); the outputs are the first channels of the result."""
    filters = [n for n in patch.nodes if isinstance(n, Filter)]

    def filtered(n: Filter, x: np.ndarray, cutoff: np.ndarray, s: np.ndarray) -> np.ndarray:
        k, out = n.damping, np.empty_like(x)
        g = np.tan(np.pi * np.clip(cutoff, n.lowest, 0.49 * rate) / rate)
        a1 = 1 / (1 + g * (g + k))
        a2 = g * a1
        a3 = g * a2
        m0, m1, m2 = _TAPS[n.kind](k)
        s1, s2 = s[:, 0], s[:, 1]
        for t in range(len(x)):
            v3 = x[t] - s2
            v1 = a1[t] * s1 + a2[t] * v3
            v2 = s2 + a2[t] * s1 + a3[t] * v3
            s1, s2 = 2 * v1 - s1, 2 * v2 - s2
            out[t] = m0 * x[t] + m1 * v1 + m2 * v2
        s[:, 0], s[:, 1] = s1, s2
        return out

    def block(state, x):
        values = {n: x[:, :, c] for n, c in channels.items()}
        for n in patch.nodes:
            if n not in patch.recursive:
                continue
            own = [values[p] for p in n.inputs()]
            if isinstance(n, Filter):
                values[n] = filtered(n, own[0], own[1], state["s"][filters.index(n)])
            elif isinstance(n, Drive):
                values[n] = np.tanh(own[0])
            else:  # a part used twice is twice among the inputs
                values[n] = np.sum(own, axis=0) if isinstance(n, Sum) else np.prod(own, axis=0)
        out = np.zeros_like(x)
        for c, n in enumerate(patch.outputs):
            out[:, :, c] = values[n]
        return out

    def init(tracks, _):
        return {"s": np.zeros((len(filters), tracks, 2))}

    return Kernel(init, lambda state, x: block(state, x[None])[0], None, block)


def _rendered(voices: DataFrame, patch: Patch, rate: float, kept: list[str]) -> DataFrame:
    """(kept, frame, o0[, o1]): the outputs of voices(_voice, on_frame, off, count, hz, volume, p_...), dealt out by _voice, of `count` frames each."""
    frames = voices.filter("count > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    frames, found = _columns(frames, patch, rate)
    names = [f"o{k}" for k in range(len(patch.outputs))]
    place = (F.col("on_frame") + F.col("t")).alias("frame")
    if not patch.recursive:
        return frames.select(*kept, place, *[found[n].alias(c) for n, c in zip(patch.outputs, names)])
    heard = [n for n in patch.nodes if n not in patch.recursive and (n in patch.outputs or any(n in r.inputs() for r in patch.recursive))]
    wide = [f"o{k}" for k in range(max(len(heard), len(names)))]
    fed = frames.select("_voice", place, *[found[heard[k]].alias(c) if k < len(heard) else F.lit(0.0).alias(c) for k, c in enumerate(wide)])
    played = fold(fed, "_voice", _kernel(patch, {n: k for k, n in enumerate(heard)}, rate), wide, dealt=True)
    kinds = ", ".join(f"`{c}` {voices.schema[c].dataType.simpleString()}" for c in kept)
    return played.withColumn("_own", F.from_json("_voice", kinds)).select(*[F.col(f"_own.{c}").alias(c) for c in kept], "frame", *names)


def _dealt(voices: DataFrame, kept: list[str]) -> DataFrame:
    """Voices, not their frames, are shuffled; a voice's frames arise where it is."""
    parts = int(voices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return voices.withColumn("_voice", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})).repartition(parts, "_voice")


def patched(notes: DataFrame, patch: Patch, rate: float, key: str, longest: int, voices: int | None = None) -> DataFrame:
    """(key, note_id, frame, l, r): a voice of the patch for each of notes(key, note_id, on_frame, off_frame, hz, volume, pan, p_<name>...).

    A voice sounds until its gate has closed, the longest of its envelopes is released and its filters have rung out to a millionth; a note that is never
    ended (off_frame null) has its gate open for `longest` frames and ends there. With `voices`, a track has so many at once, and a
    voice that is taken by another note ends at once. A mono patch is placed by the note's pan; a stereo one has its own sides. Volume enters by
    Velocity() alone. Notes of no frames make no sound; rows with one (key, note_id) have to be one note.
    """
    after = patch.release(rate) + patch.ring(rate)
    own = notes.filter("off_frame IS NULL OR off_frame > on_frame")
    if voices:
        own = with_voices(own, key, voices, after)
    off = (F.col("off_frame") - F.col("on_frame")).cast("long")
    own = own.withColumns({"off": off, "count": F.coalesce(off + after, F.lit(longest).cast("long"))})
    if voices:
        own = own.withColumn("count", F.least("count", F.col("until") - F.col("on_frame")))
    kept = [key, "note_id", "pan"]
    out = _rendered(_dealt(own, kept), patch, rate, kept)
    if len(patch.outputs) == 2:
        return out.select(key, "note_id", "frame", F.col("o0").alias("l"), F.col("o1").alias("r"))
    return out.select(key, "note_id", "frame", (F.col("o0") * S.pan_left(F.col("pan"))).alias("l"), (F.col("o0") * S.pan_right(F.col("pan"))).alias("r"))


def patch_source(tracks: DataFrame, patch: Patch, rate: float, key: str, longest: int, quiet: float = QUIET, hush: float = HUSH) -> DataFrame:
    """(key, frame, l, r): the patch as a source of each of tracks(key, hz, p_<name>...), without notes: its gate is open from the first frame. A source ends
    when it has stayed under `quiet` for `hush` seconds, or after `longest` frames. A mono patch is the same on both sides."""
    own = tracks.withColumns({"on_frame": F.lit(0).cast("long"), "off": F.lit(None).cast("long"), "count": F.lit(longest).cast("long"), "volume": F.lit(1.0)})
    out = _rendered(_dealt(own, [key]), patch, rate, [key])
    sides = out.select(key, "frame", F.col("o0").alias("l"), F.col("o1" if len(patch.outputs) == 2 else "o0").alias("r"))
    heard = sides.withColumn("_level", F.greatest(F.abs("l"), F.abs("r")))
    return until_silent(heard, [key], quiet, max(1, int(hush * rate)), "_level").drop("_level")
