"""Signal graphs as data: tracks, buses, effects and events, compiled to one lazy DataFrame plan.

The compiler drops what does nothing (unity gain, centred pan, a dry mix), merges buses without effects into their parents,
keeps memoryless effects as expressions, and joins runs of recursive effects of a bus: linear ones in a scan, compressors and gates in scans of
their own, all others in one fold. A bus sounds on for the tails of its effects. Where its last frame is known from its tracks, silence is filled in
by a join with a range, so that a plan grows with the graph and no faster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators import automation as A
from tessitura.operators import effects as FX
from tessitura.operators import folds as FO
from tessitura.operators import kernels as K
from tessitura.operators import mixing as M
from tessitura.operators import modulation, patches
from tessitura.operators import resampling as R
from tessitura.operators import synthesis as Y
from tessitura.operators.kernels import Kernel, chain

ROOT = 0


class GraphError(ValueError):
    """A graph that can't be rendered."""


class UnknownNode(GraphError):
    """An id that no track, bus or effect has."""


class OptionError(GraphError):
    """An option outside its range."""


@dataclass(frozen=True)
class TrackOptions:
    """volume is linear, pan -1..1, speed over 0; `repeat` plays the loop (or, without one, all) again so often; without a number a
    loop goes on until the track is stopped, and a track without one plays once. Times are frames and seconds."""

    volume: float = 1.0
    pan: float = 0.0
    speed: float = 1.0
    repeat: int | None = None
    loop: tuple[int, int] | None = None
    start_frame: int = 0
    stop_frame: int | None = None
    fade_in: float = 0.0
    fade_out: float = 0.05

    def __post_init__(self):
        if not self.volume >= 0:
            raise OptionError("volume must not be negative")
        if not abs(self.pan) <= 1:
            raise OptionError("pan must be in -1..1")
        if not (self.speed > 0 and math.isfinite(self.speed)):
            raise OptionError("speed must be positive")
        if (self.repeat or 0) < 0 or self.loop and not 0 <= self.loop[0] < self.loop[1]:
            raise OptionError("a loop needs frames, and a repeat must not be negative")


@dataclass
class Effect:
    """`apply` is a memoryless effect on l and r; `kernel` a recursive one."""

    effect_id: int
    name: str
    apply: Callable[[DataFrame], DataFrame] | None = None
    kernel: Kernel | None = None
    make: Callable[..., Kernel] | None = None
    values: dict[str, float] = field(default_factory=dict)
    changes: list[tuple[int, str, float]] = field(default_factory=list)
    inertia: float = 0.0
    bypassed: bool = False
    #: Frames that it rings on after its input at given parameters; None: until it is silent.
    ring: Callable[..., int | None] = lambda **values: 0

    def tail(self) -> int | None:
        """The longest of its tails at its parameters and at those that are scheduled."""
        values, found = dict(self.values), [self.ring(**self.values)]
        for _, name, target in sorted(self.changes, key=lambda c: c[0]):
            if name in values:
                values[name] = target
                found.append(self.ring(**values))
        return None if None in found else max(found)

    def current(self, rate: float) -> Kernel | None:
        """The kernel at its parameters, or one that follows their changes."""
        if self.make is None:
            return self.kernel
        return K.automated(self.make, self.values, self.changes, self.inertia, rate) if self.changes else self.make(**self.values)


@dataclass
class Track:
    track_id: int
    signal: DataFrame
    rate: int
    bus: int
    options: TrackOptions
    name: str


@dataclass
class Graph:
    """A render at a rate; ids are counted from 1 and the root bus is 0."""

    rate: int = 44100
    volume: float = 1.0
    buses: dict[int, int | None] = field(default_factory=lambda: {ROOT: None})
    effects: dict[int, list[Effect]] = field(default_factory=lambda: {ROOT: []})
    tracks: dict[int, Track] = field(default_factory=dict)
    volumes: list[tuple[int, int, float]] = field(default_factory=list)
    pans: list[tuple[int, int, float]] = field(default_factory=list)
    motions: list[tuple] = field(default_factory=list)
    masters: list[tuple[int, int, float]] = field(default_factory=list)
    _next: int = 0

    def _id(self) -> int:
        self._next += 1
        return self._next

    # --- building ---------------------------------------------------------------------------------------------------

    def add_bus(self, parent: int = ROOT) -> int:
        self._bus(parent)
        k = self._id()
        self.buses[k], self.effects[k] = parent, []
        return k

    def remove_bus(self, bus: int) -> None:
        """Removes a bus with what is below it; the root stays."""
        self._bus(bus)
        if bus == ROOT:
            raise GraphError("the root bus can't be removed")
        for child in [k for k, p in self.buses.items() if p == bus]:
            self.remove_bus(child)
        self.tracks = {k: t for k, t in self.tracks.items() if t.bus != bus}
        del self.buses[bus], self.effects[bus]

    def remove_all_buses(self) -> None:
        for k in [k for k, p in self.buses.items() if p == ROOT]:
            self.remove_bus(k)

    def add_track(self, signal: DataFrame, bus: int = ROOT, rate: int | None = None, options: TrackOptions | None = None, name: str = "") -> int:
        """signal(frame, x) or signal(frame, l, r); another rate is converted."""
        self._bus(bus)
        k = self._id()
        self.tracks[k] = Track(k, signal, rate or self.rate, bus, options or TrackOptions(), name or f"track {k}")
        return k

    def add_synth(self, spark: SparkSession, shape: str, hz: float, seconds: float, bus: int = ROOT, options: TrackOptions | None = None, width: float = 0.5) -> int:
        """An oscillator as a track."""
        tracks = spark.range(1).select(F.col("id").alias("track_id"), F.lit(float(hz)).alias("hz"))
        return self.add_track(Y.tone(tracks, int(seconds * self.rate), self.rate, shape, width).select("frame", "x"), bus, options=options, name=f"synth {shape}")

    def add_sampler(self, notes: DataFrame, buffers: DataFrame, envelope: dict | None = None, voices: int = 16, bus: int = ROOT, options: TrackOptions | None = None) -> int:
        """A sampler as a track: notes(note_id, buffer_id, on_frame, off_frame, speed, volume, pan) play buffers(buffer_id, samples)
        on at most `voices` at a time; a note that loses its voice ends there."""
        own = notes.withColumn("_key", F.lit(0))
        release = int(envelope["release"] * self.rate) if envelope else 0
        held = Y.with_voices(own, "_key", voices, release).filter("until IS NULL OR until > on_frame")
        played = Y.sampled(held, buffers, envelope, self.rate, "_key").join(held.select("note_id", "until"), "note_id").filter("until IS NULL OR frame < until")
        return self.add_track(M.mixdown(played, ["frame"], ["l", "r"]), bus, options=options, name="sampler")

    def add_polyphonic(self, notes: DataFrame, shape: str, envelope: dict, seconds: float, bus: int = ROOT, options: TrackOptions | None = None, **more) -> int:
        """Oscillator voices as a track: notes as for synthesis.polyphonic; a note that is never ended sounds for `seconds`."""
        played = Y.polyphonic(notes.withColumn("_key", F.lit(0)), "_key", shape, self.rate, envelope, int(seconds * self.rate), **more)
        return self.add_track(M.mixdown(played, ["frame"], ["l", "r"]), bus, options=options, name=f"voices {shape}")

    def add_patch(self, notes: DataFrame, patch: patches.Patch, seconds: float, voices: int | None = None, bus: int = ROOT, options: TrackOptions | None = None) -> int:
        """Voices of a user's patch as a track: notes as for patches.patched; a note that is never ended sounds for `seconds`."""
        played = patches.patched(notes.withColumn("_key", F.lit(0)), patch, self.rate, "_key", int(seconds * self.rate), voices)
        return self.add_track(M.mixdown(played, ["frame"], ["l", "r"]), bus, options=options, name="patch")

    def add_handled(self, notes: DataFrame, changes: DataFrame, buffers: DataFrame, bus: int = ROOT, options: TrackOptions | None = None) -> int:
        """Notes that play their buffers and are changed while they sound, as a track: as for modulation.handled, without a key."""
        played = modulation.handled(notes.withColumn("_key", F.lit(0)), changes.withColumn("_key", F.lit(0)), buffers, "_key")
        return self.add_track(M.mixdown(played, ["frame"], ["l", "r"]), bus, options=options, name="notes")

    def add_granular(self, notes: DataFrame, buffers: DataFrame, density: float = 10.0, window: str = "triangle", bus: int = ROOT, options: TrackOptions | None = None, **grain) -> int:
        """A granular sampler as a track: notes as for add_sampler, grain parameters as for varied_grains."""
        triggers = Y.cloud_triggers(notes.withColumn("_key", F.lit(0)), density, self.rate)
        grains = Y.pooled(Y.varied_grains(triggers, buffers, self.rate, **grain), "_key")
        return self.add_track(Y.played_grains(grains, window, "_key").select("frame", "l", "r"), bus, options=options, name="granular")

    def remove_track(self, track: int) -> None:
        if self.tracks.pop(track, None) is None:
            raise UnknownNode(f"no track {track}")

    def add_effect(self, bus: int, name: str, apply=None, kernel: Kernel | None = None, at: int | None = None, tail: int | None = 0) -> int:
        """A memoryless effect, or a kernel that rings on for `tail` frames after its input; with None until it is silent."""
        self._bus(bus)
        if (apply is None) == (kernel is None):
            raise GraphError("an effect is either an expression or a kernel")
        k = self._id()
        own = self.effects[bus]
        own.insert(len(own) if at is None else max(0, min(len(own), at)), Effect(k, name, apply, kernel, ring=lambda **values: tail))
        return k

    def add_parametric(self, bus: int, name: str, make: Callable[..., Kernel], values: dict[str, float], inertia: float = 0.0, at: int | None = None, tail=lambda **values: 0) -> int:
        """An effect whose parameters can be set while it plays: make(**values) gives its kernel, tail(**values) the frames that it rings
        on (None: until it is silent); a value moves to a new target with `inertia`."""
        k = self.add_effect(bus, name, kernel=make(**values), at=at)
        own, n = self._effect(k)
        own[n].make, own[n].values, own[n].inertia, own[n].ring = make, dict(values), inertia, tail
        return k

    def add_builtin(self, bus: int, effect: str, inertia: float = 0.0, at: int | None = None, **values) -> int:
        """One of the built-in effects that are kernels, with values of its parameters by id; those given can be set later."""
        rate = self.rate
        return self.add_parametric(bus, effect, lambda **v: effect_kernel(effect, rate, **v), values, inertia, at, lambda **v: effect_tail(effect, rate, **v))

    def reset_effect(self, effect: int, frame: int) -> None:
        """Silences what an effect remembers at a frame."""
        own, n = self._effect(effect)
        if own[n].make is None:
            raise OptionError("only an effect with parameters can be reset")
        own[n].changes.append((frame, K.RESET, 0.0))

    def set_parameter(self, effect: int, frame: int, name: str, value: float) -> None:
        """Schedules a parameter of an effect."""
        own, n = self._effect(effect)
        if name not in own[n].values:
            raise UnknownNode(f"effect {effect} has no parameter {name!r}")
        own[n].changes.append((frame, name, float(value)))

    def set_parameters(self, effect: int, frame: int, **values: float) -> None:
        """Schedules several parameters of an effect for one frame; a name that it doesn't have changes nothing at all."""
        own, n = self._effect(effect)
        for name in values:
            if name not in own[n].values:
                raise UnknownNode(f"effect {effect} has no parameter {name!r}")
        for name, value in values.items():
            self.set_parameter(effect, frame, name, value)

    def bypass(self, effect: int, on: bool = True) -> None:
        """Takes an effect out of its chain, or puts it back, without removing it."""
        own, n = self._effect(effect)
        own[n].bypassed = on

    def _effect(self, effect: int) -> tuple[list[Effect], int]:
        for own in self.effects.values():
            for n, e in enumerate(own):
                if e.effect_id == effect:
                    return own, n
        raise UnknownNode(f"no effect {effect}")

    def move_effect(self, effect: int, by: int | None = None, to_start: bool = False, to_end: bool = False) -> None:
        """Moves an effect in its chain: by some places (clamped), to the start or to the end."""
        own, n = self._effect(effect)
        e = own.pop(n)
        own.insert(0 if to_start else len(own) if to_end else max(0, min(len(own), n + (by or 0))), e)

    def remove_effect(self, effect: int) -> None:
        own, n = self._effect(effect)
        own.pop(n)

    def remove_all_effects(self, bus: int) -> None:
        self._bus(bus)
        self.effects[bus].clear()

    def set_volume(self, track: int, frame: int, volume: float) -> None:
        """Schedules a volume, smoothed from where it stands."""
        if track not in self.tracks:
            raise UnknownNode(f"no track {track}")
        if not volume >= 0:
            raise OptionError("volume must not be negative")
        self.volumes.append((track, frame, float(volume)))

    def set_pan(self, track: int, frame: int, pan: float) -> None:
        """Schedules a place, smoothed from where it stands."""
        if track not in self.tracks:
            raise UnknownNode(f"no track {track}")
        if not abs(pan) <= 1:
            raise OptionError("pan must be in -1..1")
        self.pans.append((track, frame, float(pan)))

    def set_speed(self, track: int, frame: int, speed: float, semitones: float = 0.0) -> None:
        """Schedules a speed; with `semitones` a second it glides there."""
        if track not in self.tracks:
            raise UnknownNode(f"no track {track}")
        if not (speed > 0 and math.isfinite(speed)) or semitones < 0:
            raise OptionError("speed must be positive, and a glide must not be negative")
        self.motions.append((track, frame, "speed", float(speed), float(semitones)))

    def seek(self, track: int, frame: int, seconds: float) -> None:
        """Schedules a jump to a place of the track's source."""
        if track not in self.tracks:
            raise UnknownNode(f"no track {track}")
        if not seconds >= 0:
            raise OptionError("a place must not be negative")
        self.motions.append((track, frame, "seek", seconds * self.tracks[track].rate))

    def stop_all(self, frame: int) -> None:
        """Stops every track at a frame, unless it stops before; tracks that have not begun by then are cancelled."""
        kept = {}
        for k, t in self.tracks.items():
            if t.options.start_frame < frame:
                stop = frame if t.options.stop_frame is None else min(frame, t.options.stop_frame)
                kept[k] = Track(t.track_id, t.signal, t.rate, t.bus, TrackOptions(**(t.options.__dict__ | {"stop_frame": stop})), t.name)
        self.tracks = kept

    def _bus(self, bus: int) -> None:
        if bus not in self.buses:
            raise UnknownNode(f"no bus {bus}")

    def dump(self) -> str:
        """The tree of buses with their effects and tracks."""

        def lines(bus: int, depth: int):
            pad = "  " * depth
            yield f"{pad}bus {bus}"
            for e in self.effects[bus]:
                yield f"{pad}  effect {e.effect_id} {e.name}"
            for t in sorted((t for t in self.tracks.values() if t.bus == bus), key=lambda t: (t.name, t.track_id)):
                yield f"{pad}  track {t.track_id} {t.name}"
            for child in sorted(k for k, p in self.buses.items() if p == bus):
                yield from lines(child, depth + 1)

        return "\n".join(lines(ROOT, 0))

    # --- compiling --------------------------------------------------------------------------------------------------

    def _track(self, t: Track) -> DataFrame:
        o, s = t.options, t.signal
        if "x" in s.columns:
            s = M.to_stereo(s)
        s = s.select(F.lit(t.track_id).cast("long").alias("track_id"), F.col("frame").cast("long").alias("frame"), F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
        ratio = R.rate_ratio(t.rate, self.rate, o.speed)
        motions = [(frame - o.start_frame, *rest) for k, frame, *rest in self.motions if k == t.track_id]
        repeats = o.repeat or 0
        if o.loop and o.repeat is None:
            if o.stop_frame is None:
                raise OptionError("an endless loop needs a stop_frame or a number of repeats")
            longest = max([ratio, *(R.rate_ratio(t.rate, self.rate, m[2]) for m in motions if m[1] == "speed")])
            frames = (o.stop_frame - o.start_frame) + self.rate * (o.fade_out + 1)
            repeats = math.ceil(frames * longest / (o.loop[1] - o.loop[0]))
        if repeats:
            s = A.looped(s, ["track_id"], *(o.loop or (None, None)), repeats).drop("source_frame")
        if motions:
            scaled = [(f, k, v[0] * t.rate / self.rate, *v[1:]) if k == "speed" else (f, k, *v) for f, k, *v in motions]
            s = R.varispeed(s, "track_id", R.speed_segments(o.speed * t.rate / self.rate, scaled, self.rate), ["l", "r"])
        elif ratio != 1:
            s = R.cubic(s, "track_id", ratio, ["l", "r"])
        f = F.col("frame")
        gain: Column | None = None
        if o.fade_in > 0:
            gain = A.fader(f, 0.0, 1.0, o.fade_in, self.rate)
        scheduled = [(frame, v) for k, frame, v in self.volumes if k == t.track_id]
        if scheduled:
            events = s.sparkSession.createDataFrame([(t.track_id, frame - o.start_frame, v) for frame, v in scheduled], "track_id long, frame long, target double")
            s = A.automated(s, events, ["track_id"], 1 / 256, o.volume, self.rate, "_volume")
            gain = F.col("_volume") if gain is None else gain * F.col("_volume")
        elif o.volume != 1:
            gain = F.lit(o.volume) if gain is None else gain * o.volume
        if gain is not None:
            s = M.amplify(s, gain).select("track_id", "frame", "l", "r")
        places = [(t.track_id, frame - o.start_frame, v) for k, frame, v in self.pans if k == t.track_id]
        if places:
            events = s.sparkSession.createDataFrame(places, "track_id long, frame long, target double")
            s = M.pan(A.automated(s, events, ["track_id"], 1 / 256, o.pan, self.rate, "_pan"), F.col("_pan")).select("track_id", "frame", "l", "r")
        elif o.pan:
            s = M.pan(s, F.lit(o.pan))
        if o.start_frame:
            s = s.withColumn("frame", f + o.start_frame)
        if o.stop_frame is not None:
            n = max(1, math.ceil(-math.log(1e-4) * self.rate * o.fade_out / 4.605)) if o.fade_out > 0 else 0
            s = s.filter(f < o.stop_frame + n)
            if n:
                tail = F.when(f >= o.stop_frame, A.fader(f - o.stop_frame, 1.0, 0.0, o.fade_out, self.rate)).otherwise(F.lit(1.0))
                s = M.amplify(s, tail)
        return s.select("frame", "l", "r")

    def _merged(self) -> dict[int, int]:
        """The bus that each bus's tracks are summed on: itself if it has effects, else its parent's."""

        def home(k):
            return k if k == ROOT or any(not e.bypassed for e in self.effects[k]) else home(self.buses[k])

        return {k: home(k) for k in self.buses}

    def _through(self, s: DataFrame, chain_: list[Effect], last: int | None, deep: bool) -> tuple[DataFrame, int | None, bool]:
        """A bus through its effects, its last frame, where it is known, and whether kernels are below (`deep`)."""
        run: list[Effect] = []

        def folded(s: DataFrame, last: int | None) -> tuple[DataFrame, int | None]:
            """The kernels that wait. A bus is one track: linear kernels and dynamics go block by block on all machines, any other along
            the frames in one task. A scan reads its input twice, so kernels below it are cut off."""
            nonlocal deep
            while run:
                kernels = [e.current(self.rate) for e in run]
                n = 1 if kernels[0].dynamics else next((k for k, kernel in enumerate(kernels) if kernel.dynamics), len(run))
                tails, own = [e.tail() for e in run[:n]], kernels[0] if n == 1 else chain(*kernels[:n])
                del run[:n]
                if last is None or deep and None not in tails and (own.system or own.dynamics):
                    s = FO.cut(s)
                deep = True
                if last is None:
                    last = s.agg(F.max("frame")).first()[0]
                    last = -1 if last is None else last
                endless, more = None in tails, sum(t or 0 for t in tails)
                one = _gapless(s, last + (0 if endless else more)).withColumn("_bus", F.lit(0).cast("long"))
                if endless:
                    s, last = FO.fold_until_silent(one, "_bus", own, ["l", "r"], self.rate), None
                elif own.system:
                    s, last = FO.affine_scan(one, "_bus", own.system, ["l", "r"]), last + more
                elif own.dynamics:
                    s, last = FO.dynamics(one, "_bus", own), last + more
                else:
                    s, last = FO.fold(one, "_bus", own, ["l", "r"]), last + more
                s = s.select("frame", "l", "r")
            return s, last

        for e in chain_:
            if e.bypassed:
                continue
            if e.kernel:
                run.append(e)
            else:
                s, last = folded(s, last)
                s = e.apply(s).select("frame", "l", "r")
        return *folded(s, last), deep

    def _ends(self, tracks: list[DataFrame]) -> int:
        """The last frame of several tracks; -1 without any. A job of its own, which reads no more than the tracks' frames."""
        each = [t.agg(F.max("frame").alias("last")) for t in tracks]
        found = reduce(DataFrame.unionByName, each).agg(F.max("last")).first()[0] if each else None
        return -1 if found is None else found

    def set_master(self, frame: int, volume: float) -> None:
        """Schedules the volume of all that is heard, smoothed from where it stands."""
        if not volume >= 0:
            raise OptionError("volume must not be negative")
        self.masters.append((0, frame, float(volume)))

    def compile(self, of: int = ROOT) -> DataFrame:
        """(frame, l, r) of a bus, the root by default, to which the graph's volume applies; without tracks there are no frames. A bus
        that is merged into its parent has what its own tracks and buses give."""
        self._bus(of)
        home = self._merged() | {of: of}
        inside = [k for k in self.buses if self._below(k, of)]
        for k in inside:  # what was merged into a bus above stays within this one
            if home[k] not in inside:
                home[k] = of

        def bus(k: int, heard: bool) -> tuple[DataFrame | None, int | None, bool]:
            """The frames of a bus, the last of them where a kernel on or above it (`heard`) needs it and it is known, and whether it has
            kernels below."""
            heard = heard or any(e.kernel and not e.bypassed for e in self.effects[k])
            tracks = [self._track(t) for t in self.tracks.values() if t.bus in inside and home[t.bus] == k]
            below = [bus(c, heard) for c in inside if c != of and home[c] == c and home[self.buses[c]] == k]
            below = [b for b in below if b[0] is not None]
            parts = tracks + [b[0] for b in below]
            if not parts:
                return None, None, False
            ends = [end for _, end, _ in below]
            last = max([self._ends(tracks), *ends]) if heard and None not in ends else None
            return self._through(M.mixdown(reduce(DataFrame.unionByName, parts), ["frame"], ["l", "r"]), self.effects[k], last, any(b[2] for b in below))

        out, *_ = bus(of, False)
        if out is None:
            return SparkSession.active().createDataFrame([], "frame long, l double, r double")
        if of == ROOT and self.masters:
            return self._mastered(out)
        return out if of != ROOT or self.volume == 1 else M.amplify(out, F.lit(self.volume))

    def _mastered(self, out: DataFrame) -> DataFrame:
        """The volume as a literal of its few ramps, so that no frame is sorted for it."""
        now, target, since, cases = self.volume, self.volume, 0, []
        for _, frame, volume in sorted(self.masters, key=lambda m: m[1]):
            share = 44100.0 / self.rate / 256
            now = target - (target - now) * (1 - share) ** (frame - since)
            since, target = frame, volume
            cases.append((frame, now, volume))
        f, gain = F.col("frame"), F.lit(self.volume)
        for frame, begin, volume in cases:
            gain = F.when(f >= frame, A.exponential(F.lit(begin), F.lit(volume), f - frame, 1 / 256, self.rate)).otherwise(gain)
        return M.amplify(out, gain)

    def _below(self, bus: int, top: int) -> bool:
        while bus is not None and bus != top:
            bus = self.buses[bus]
        return bus == top

    def levels(self, interval: float = 0.25, buses: list[int] | None = None) -> DataFrame:
        """Peak and RMS per interval of seconds and channel, of the root or of several buses."""
        size = max(1, int(interval * self.rate))
        every = [self.compile(k).withColumn("bus", F.lit(k)) for k in buses or [ROOT]]
        return M.meter(reduce(DataFrame.unionByName, every), ["bus"], size, ["l", "r"])


#: Frames of a task that fills in silence.
GRID = 1 << 20


def _gapless(s: DataFrame, last: int) -> DataFrame:
    """Frames 0 to `last` of a bus, silent where nothing plays: what a kernel hears, and what its ringing needs."""
    grid = s.sparkSession.range(0, last + 1, 1, max(1, math.ceil((last + 1) / GRID))).withColumnRenamed("id", "frame")
    return grid.join(s, "frame", "left").select("frame", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("l", "r")])


#: Parameters of the built-in effects: (effect, id, name, low, high, default, curve, style). Ids have four characters; an exponential
#: curve has its power; a choice lists its names, of which the default is one: fixed values.
CHOICES = {
    ("gain", "dcfm"): ("Off", "Slow", "Default", "Fast"),
    ("distortion", "type"): ("Soft Clip", "Hard Clip", "Diode", "Fuzz", "Fold"),
    ("filter", "type"): ("Lowpass", "Bandpass", "Bandstop", "Highpass"),
    ("delay", "mode"): ("Stereo", "Ping Pong"),
    ("delay", "ftyp"): ("Lowpass", "Bandpass", "Highpass"),
    ("delay", "lfos"): ("Sine", "Triangle", "Ramp Up", "Ramp Down", "Square", "Random", "Smooth Random"),
    ("chorus", "fltt"): ("Lowpass", "Bandpass", "Highpass"),
    ("pan", "invl"): ("Off", "On"),
    ("pan", "invr"): ("Off", "On"),
    ("sampler", "GOVM"): ("Cloud", "Sequential"),
    ("sampler", "GWND"): ("Hann", "Blackman", "Triangle", "Tukey", "Trapezoid", "Exponential", "Ramp Up", "Ramp Down"),
    ("sampler", "GDIR"): ("Forward", "Backward", "Random"),
    ("sampler", "ML1W"): ("Sine", "Triangle", "Ramp Up", "Ramp Down", "Square", "Random", "Smooth Random"),
    ("sampler", "ML2W"): ("Sine", "Triangle", "Ramp Up", "Ramp Down", "Square", "Random", "Smooth Random"),
}
PARAMETERS = (
    ("gain", "gain", "Gain", 0.000001, 15.848932, 1.0, "decibel", "gain"),
    ("gain", "dcfm", "DC Filter", 0.0, 3.0, 0.0, "choice", "choice"),
    ("pan", "pan ", "Pan", -1.0, 1.0, 0.0, "linear", "pan"),
    ("pan", "wdth", "Width", 0.0, 2.0, 1.0, "linear", "percent"),
    ("pan", "invl", "Invert L", 0.0, 1.0, 0.0, "choice", "choice"),
    ("pan", "invr", "Invert R", 0.0, 1.0, 0.0, "choice", "choice"),
    ("distortion", "type", "Type", 0.0, 4.0, 2.0, "choice", "choice"),
    ("distortion", "driv", "Drive", 0.0, 4.0, 0.0, "linear", "plain"),
    ("distortion", "mix ", "Mix", 0.0, 1.0, 1.0, "linear", "percent"),
    ("filter", "type", "Type", 0.0, 3.0, 0.0, "choice", "choice"),
    ("filter", "cuto", "Cutoff", 20.0, 20000.0, 20000.0, "exponential 2.5", "plain"),
    ("filter", "fltq", "Resonance", 0.001, 4.0, 0.707, "linear", "plain"),
    *((("eq", f"gan{n}", f"Gain {n}", -20.0, 20.0, 0.0, "linear", "plain")) for n in range(1, 6)),
    *((("eq", f"frq{n}", f"Frequency {n}", 20.0, 20000.0, hz, "exponential 2.5", "plain")) for n, hz in enumerate((100.0, 1000.0, 4000.0, 8000.0, 12000.0), 1)),
    *((("eq", f"bw_{n}", f"Bandwidth {n}", 0.0001, top, top, "linear", "plain")) for n, top in enumerate((1.0, 4.0, 4.0, 4.0, 1.0), 1)),
    ("compressor", "thrs", "Threshold", -60.0, 0.0, -12.0, "linear", "plain"),
    ("compressor", "rato", "Ratio", 1.0, 20.0, 8.0, "linear", "ratio"),
    ("compressor", "knee", "Knee", 0.0, 12.0, 3.0, "linear", "plain"),
    ("compressor", "attk", "Attack", 0.001, 0.5, 0.02, "linear", "plain"),
    ("compressor", "rels", "Release", 0.1, 2.0, 2.0, "linear", "plain"),
    ("compressor", "gain", "Makeup Gain", -24.0, 24.0, 6.0, "linear", "plain"),
    ("compressor", "look", "Lookahead", 0.001, 0.2, 0.04, "linear", "plain"),
    ("gate", "thrs", "Threshold", -60.0, 0.0, -30.0, "linear", "plain"),
    ("gate", "attk", "Attack", 0.001, 0.5, 0.005, "linear", "plain"),
    ("gate", "hold", "Hold", 0.0, 2.0, 0.1, "linear", "plain"),
    ("gate", "rels", "Release", 0.01, 2.0, 0.2, "linear", "plain"),
    ("gate", "rnge", "Range", -60.0, 0.0, -60.0, "linear", "decibels"),
    ("delay", "mode", "Mode", 0.0, 1.0, 0.0, "choice", "choice"),
    ("delay", "dlay", "Delay", 1.0, 4000.0, 375.0, "linear", "plain"),
    ("delay", "fdbk", "Feedback", 0.0, 1.0, 0.5, "linear", "percent"),
    ("delay", "ftyp", "Filter Type", 0.0, 2.0, 0.0, "choice", "choice"),
    ("delay", "cuto", "Filter Cutoff", 20.0, 20000.0, 6000.0, "exponential 2.5", "plain"),
    ("delay", "driv", "Drive", 0.0, 1.0, 0.0, "linear", "percent"),
    ("delay", "wet_", "Wet", 0.0, 1.0, 0.5, "linear", "percent"),
    ("delay", "wdth", "Width", 0.0, 1.0, 0.5, "linear", "percent"),
    ("delay", "lfor", "LFO Rate", 0.01, 10.0, 1.0, "exponential 2", "plain"),
    ("delay", "lfos", "LFO Shape", 0.0, 6.0, 0.0, "choice", "choice"),
    ("delay", "lfdt", "LFO -> Time", -1.0, 1.0, 0.0, "linear", "percent"),
    ("delay", "ldfb", "LFO -> Feedback", -1.0, 1.0, 0.0, "linear", "percent"),
    ("delay", "lfdf", "LFO -> Filter", -1.0, 1.0, 0.0, "linear", "percent"),
    ("chorus", "rate", "Rate", 0.01, 10.0, 1.0, "exponential 2", "plain"),
    ("chorus", "phas", "Phase", 0.0, math.pi, math.pi / 2, "linear", "degrees"),
    ("chorus", "dpth", "Depth", 0.0, 1.0, 0.25, "linear", "percent"),
    ("chorus", "fdbk", "Feedback", -1.0, 1.0, 0.5, "linear", "percent"),
    ("chorus", "dlay", "Delay", 0.0, 100.0, 12.0, "linear", "plain"),
    ("chorus", "wet_", "Wet", 0.0, 1.0, 0.5, "linear", "percent"),
    ("chorus", "fltt", "Filter Type", 0.0, 2.0, 0.0, "choice", "choice"),
    ("chorus", "fltf", "Filter Freq", 20.0, 20000.0, 20000.0, "exponential 2.5", "plain"),
    ("chorus", "fltq", "Filter Resonance", 0.0, 1.0, 0.0, "linear", "plain"),
    ("sampler", "STRN", "Transpose", -48.0, 48.0, 0.0, "linear", "plain"),
    ("sampler", "SFTN", "Finetune", -100.0, 100.0, 0.0, "linear", "plain"),
    ("sampler", "SVOL", "Volume", 0.000001, 15.848932, 1.0, "decibel", "gain"),
    ("sampler", "SPAN", "Panning", -1.0, 1.0, 0.0, "linear", "pan"),
    ("sampler", "AATK", "Attack", 0.0, 10.0, 0.001, "exponential 2", "plain"),
    ("sampler", "AHLD", "Hold", 0.0, 10.0, 0.75, "exponential 2", "plain"),
    ("sampler", "ADCY", "Decay", 0.0, 10.0, 0.5, "exponential 2", "plain"),
    ("sampler", "ASTN", "Sustain", 0.0, 1.0, 0.75, "linear", "plain"),
    ("sampler", "AREL", "Release", 0.0, 10.0, 1.0, "exponential 2", "plain"),
    ("sampler", "GOVM", "Overlap Mode", 0.0, 1.0, 0.0, "choice", "choice"),
    ("sampler", "GWND", "Window", 0.0, 7.0, 0.0, "choice", "choice"),
    ("sampler", "GSIZ", "Grain Size", 1.0, 1000.0, 100.0, "exponential 2", "plain"),
    ("sampler", "GDEN", "Density", 1.0, 100.0, 10.0, "exponential 2", "plain"),
    ("sampler", "GVAR", "Variation", 0.0, 1.0, 0.0, "linear", "percent"),
    ("sampler", "GSPY", "Spray", 0.0, 1.0, 0.0, "linear", "percent"),
    ("sampler", "GPAN", "Pan Spread", 0.0, 1.0, 0.0, "linear", "percent"),
    ("sampler", "GDIR", "Direction", 0.0, 2.0, 0.0, "choice", "choice"),
    ("sampler", "GPOS", "Position", 0.0, 1.0, 0.5, "linear", "percent"),
    ("sampler", "GSTP", "Step", -4.0, 4.0, 0.0, "linear", "plain"),
    ("sampler", "ML1R", "LFO 1 Rate", 0.01, 20.0, 1.0, "exponential 2", "plain"),
    ("sampler", "ML1W", "LFO 1 Waveform", 0.0, 6.0, 0.0, "choice", "choice"),
    ("sampler", "ML2R", "LFO 2 Rate", 0.01, 20.0, 2.0, "exponential 2", "plain"),
    ("sampler", "ML2W", "LFO 2 Waveform", 0.0, 6.0, 1.0, "choice", "choice"),
    ("reverb", "room", "Room Size", 0.0, 1.0, 0.6, "linear", "percent"),
    ("reverb", "wet ", "Wet", 0.0, 1.0, 0.35, "linear", "percent"),
)


def parameters(spark) -> DataFrame:
    """The catalogue of parameters as a table."""
    return spark.createDataFrame(list(PARAMETERS), "owner string, fourcc string, name string, low double, high double, standard double, curve string, style string")


def _parameter(effect: str, fourcc: str) -> tuple:
    for p in PARAMETERS:
        if p[:2] == (effect, fourcc):
            return p
    raise UnknownNode(f"{effect} has no parameter {fourcc!r}")


def parameter_value(effect: str, fourcc: str, normalised: float) -> Column:
    """A normalised parameter in its own range, a choice by its name; out of 0..1 is an error."""
    if not 0 <= normalised <= 1:
        raise OptionError("a normalised value must be in 0..1")
    *_, low, high, _, curve, _ = _parameter(effect, fourcc)
    if curve == "choice":
        return S.denormalise_enum(F.lit(float(normalised)), list(CHOICES[effect, fourcc]))
    kind, *power = curve.split()
    extra = (float(power[0]),) if power else (-60.0, 24.0) if kind == "decibel" else ()
    return S.denormalise(F.lit(float(normalised)), low, high, kind, *extra)


def _shape(name: str) -> str:
    return name.lower().replace(" ", "_")


def _values(effect: str, values: dict) -> dict:
    """All parameters of an effect by id (blanks left out); what is not given is at its default, a choice is a name or its number."""
    v = {p[1].strip(): p[5] for p in PARAMETERS if p[0] == effect}
    if not v:
        raise UnknownNode(f"no effect {effect!r}")
    for name, value in values.items():
        if name not in v:
            raise UnknownNode(f"{effect} has no parameter {name!r}")
        names = next((c for (owner, code), c in CHOICES.items() if (owner, code.strip()) == (effect, name)), None)
        if names and isinstance(value, str):
            value = float([_shape(n) for n in names].index(_shape(value)))
        low, high = next(p[3:5] for p in PARAMETERS if (p[0], p[1].strip()) == (effect, name))
        if not low <= value <= high:
            raise OptionError(f"{effect} {name} must be in {low}..{high}")
        v[name] = value
    return v


def effect_tail(effect: str, rate: float, **values) -> int | None:
    """Frames that a built-in effect rings on after its input at values of its parameters; None: until it is silent."""
    v = _values(effect, values)
    match effect:
        case "gain":
            return FX.tail_frames(effect, rate, hz=K.DC_MODES.get(_shape(CHOICES["gain", "dcfm"][int(v["dcfm"])])))
        case "compressor":
            return FX.tail_frames(effect, rate, look=v["look"], release=v["rels"])
        case "gate":
            return FX.tail_frames(effect, rate, hold=v["hold"], release=v["rels"])
        case "delay":
            return FX.tail_frames(effect, rate, ms=v["dlay"], feedback=v["fdbk"], drive=v["driv"])
        case "chorus":
            return FX.tail_frames(effect, rate, ms=v["dlay"], feedback=v["fdbk"])
        case "reverb":
            return FX.tail_frames(effect, rate, room=v["room"])
    return FX.tail_frames(effect, rate)


def effect_kernel(effect: str, rate: float, **values) -> Kernel:
    """The kernel of a built-in effect at values of its parameters. Values outside their range are errors."""
    v = _values(effect, values)
    chosen = lambda code: _shape(CHOICES[effect, code][int(v[code])])
    match effect:
        case "gain":
            return K.gained(rate, v["gain"], chosen("dcfm"))
        case "filter":
            return K.filtered(rate, chosen("type"), v["cuto"], v["fltq"])
        case "eq":
            five = lambda code: [v[f"{code}{n}"] for n in range(1, 6)]
            return K.eq5(five("gan"), [min(f, rate / 2 - 1) for f in five("frq")], five("bw_"), rate)
        case "compressor":
            return K.compressor(rate, v["thrs"], v["rato"], v["knee"], v["attk"], v["rels"], v["gain"], v["look"])
        case "gate":
            return K.gate(rate, v["thrs"], v["attk"], v["hold"], v["rels"], v["rnge"])
        case "delay":
            return K.delay(rate, v["dlay"], v["fdbk"], v["driv"], v["cuto"], chosen("ftyp"), v["wet_"], v["wdth"], chosen("mode") == "ping_pong", v["lfor"], v["lfdt"], v["ldfb"], v["lfdf"], chosen("lfos"))
        case "chorus":
            return K.chorus(rate, v["rate"], v["dpth"], v["fdbk"], v["dlay"], v["wet_"], v["phas"], v["fltf"], v["fltq"], chosen("fltt"))
        case "reverb":
            return K.reverb(rate, v["room"], v["wet"])
    raise OptionError(f"{effect} is an expression, not a kernel")
