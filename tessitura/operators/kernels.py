"""Recursive kernels: each is an initial state and a step over one frame, for many tracks at once (numpy).

The batch fold and the streaming fold share these steps. A state is a dict of arrays whose first axis is the track; a frame is an
array (tracks, channels). Results don't depend on how a track is cut into blocks, since the state is carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np

TAU = 2 * math.pi


#: (M, B, C, D) of a linear recurrence s' = M s + B x, y = C s + D x, the same for every channel.
System = tuple[np.ndarray, np.ndarray, np.ndarray, float]


class Kernel(NamedTuple):
    """`system` is given where the kernel is linear and does not change over time: then a scan can take the fold's place. `block` steps over
    (frames, tracks, channels) of at most `span` frames with numpy alone, on the same state: a delay line's frames don't depend on
    each other within its shortest delay. `dynamics` names a compressor or gate with its values, for their scan."""

    init: Callable[[int, int], dict]
    step: Callable[[dict, np.ndarray], np.ndarray]
    system: System | None = None
    block: Callable[[dict, np.ndarray], np.ndarray] | None = None
    span: int = 1 << 14
    dynamics: tuple[str, dict] | None = None


#: Frames that a linear system steps over with one product.
STRETCH = 64


def stretched(system: System):
    """(x, state) -> (y, state) of a linear system over (frames, tracks, channels) and states (tracks, n, channels)."""
    m, b, c = (np.asarray(v, float) for v in system[:3])
    powers = [np.eye(len(m))]
    for _ in range(STRETCH):
        powers.append(powers[-1] @ m)
    response = np.array([c @ p @ b for p in powers[: STRETCH - 1]])
    toeplitz = np.zeros((STRETCH, STRETCH))  # [to, from]
    for k in range(STRETCH):
        toeplitz[k, k], toeplitz[k + 1 :, k] = system[3], response[: STRETCH - k - 1]
    into = np.stack([p @ b for p in powers[STRETCH - 1 :: -1]])
    answers = np.stack([c @ p for p in powers[:STRETCH]])

    def over(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty_like(x)
        for a in range(0, len(x), STRETCH):
            own = x[a : a + STRETCH]
            n = len(own)
            out[a : a + n] = np.tensordot(toeplitz[:n, :n], own, 1) + np.tensordot(answers[:n], state, (1, 1))
            state = np.einsum("mn,tnc->tmc", powers[n], state) + np.tensordot(into[STRETCH - n :], own, (0, 0)).transpose(1, 0, 2)
        return out, state

    return over


def biquad_system(coefficients: tuple[float, ...]) -> System:
    a1, a2, a3, m0, m1, m2 = coefficients
    # v1 = a1 s1 + a2 (x - s2); v2 = s2 + a2 s1 + a3 (x - s2)
    v1, v2 = np.array([a1, -a2]), np.array([a2, 1 - a3])
    m = np.stack([2 * v1 - [1, 0], 2 * v2 - [0, 1]])
    return m, np.array([2 * a2, 2 * a3]), m1 * v1 + m2 * v2, m0 + m1 * a2 + m2 * a3


def dc_system(hz: float, rate: float) -> System:
    """The state is r y - x."""
    r = 1 - 2 * np.pi * hz / rate
    return np.array([[r]]), np.array([r - 1]), np.array([1.0]), 1.0


def in_series(first: System, then: System) -> System:
    """The system of one behind the other."""
    (m1, b1, c1, d1), (m2, b2, c2, d2) = first, then
    m = np.block([[m1, np.zeros((len(m1), len(m2)))], [np.outer(b2, c1), m2]])
    return m, np.concatenate([b1, b2 * d1]), np.concatenate([c1 * d2, c2]), d1 * d2


BIQUADS = ("lowpass", "highpass", "bandpass", "notch", "peak", "allpass", "bell", "lowshelf", "highshelf")


def biquad_coefficients(kind: str, cutoff: float, rate: float, q: float = 0.707, gain: float = 0.0) -> tuple[float, ...]:
    """(a1, a2, a3, m0, m1, m2) of a state-variable biquad."""
    if rate <= 0 or q <= 0 or cutoff > rate / 2:
        raise ValueError("a biquad needs a rate, a positive q and a cutoff under half the rate")
    g, k, a = math.tan(math.pi * cutoff / rate), 1 / q, 10 ** (gain / 40)
    if kind == "bell":
        k = 1 / (q * a)
    elif kind == "lowshelf":
        g /= math.sqrt(a)
    elif kind == "highshelf":
        g *= math.sqrt(a)
    m = {
        "lowpass": (0, 0, 1), "highpass": (1, -k, -1), "bandpass": (0, 1, 0), "notch": (1, -k, 0), "peak": (1, -k, -2), "allpass": (1, -2 * k, 0),
        "bell": (1, k * (a * a - 1), 0), "lowshelf": (1, k * (a - 1), a * a - 1), "highshelf": (a * a, k * (1 - a) * a, 1 - a * a),
    }[kind]
    a1 = 1 / (1 + g * (g + k))
    return a1, g * a1, g * g * a1, *map(float, m)


def _sections(coefficients: list[tuple[float, ...]]) -> Kernel:
    def init(tracks, channels):
        return {"s": np.zeros((tracks, len(coefficients), 2, channels))}

    def step(state, x):
        for n, (a1, a2, a3, m0, m1, m2) in enumerate(coefficients):
            s1, s2 = state["s"][:, n, 0], state["s"][:, n, 1]
            v3 = x - s2
            v1 = a1 * s1 + a2 * v3
            v2 = s2 + a2 * s1 + a3 * v3
            state["s"][:, n, 0], state["s"][:, n, 1] = 2 * v1 - s1, 2 * v2 - s2
            x = m0 * x + m1 * v1 + m2 * v2
        return x

    system = reduce(in_series, map(biquad_system, coefficients))
    over = stretched(system)

    def block(state, x):
        held = state["s"]
        y, after = over(x, held.reshape(len(held), -1, held.shape[3]))
        state["s"] = after.reshape(held.shape)
        return y

    return Kernel(init, step, system, block)


def biquad(kind: str, cutoff: float, rate: float, q: float = 0.707, gain: float = 0.0) -> Kernel:
    return _sections([biquad_coefficients(kind, cutoff, rate, q, gain)])


def svf_coefficients(kind: str, cutoff: float, rate: float, resonance: float = 0.0) -> tuple[float, ...]:
    g, k = math.tan(math.pi * cutoff / rate), max(2 * (1 - 0.97 * resonance), 0.03)
    a1 = 1 / (1 + g * (g + k))
    m = {"lowpass": (0, 0, 1), "bandpass": (0, 1, 0), "highpass": (1, -k, -1)}[kind]
    return a1, g * a1, g * g * a1, *map(float, m)


def svf(kind: str, cutoff: float, rate: float, resonance: float = 0.0) -> Kernel:
    return _sections([svf_coefficients(kind, cutoff, rate, resonance)])


def eq5(gains, frequencies=(100.0, 1000.0, 4000.0, 8000.0, 12000.0), bandwidths=(1.0,) * 5, rate: float = 44100.0) -> Kernel:
    """Low shelf, three bells and a high shelf in series; a bandwidth is a q."""
    kinds = ("lowshelf", "bell", "bell", "bell", "highshelf")
    return _sections([biquad_coefficients(k, f, rate, b, g) for k, f, b, g in zip(kinds, frequencies, bandwidths, gains)])


#: Cutoffs of the DC block's modes in Hz, and the filter effect's types as biquads: fixed values.
DC_MODES = {"slow": 1.0, "default": 5.0, "fast": 20.0}
FILTERS = {"lowpass": "lowpass", "bandpass": "bandpass", "bandstop": "notch", "highpass": "highpass"}


def gained(rate: float, gain: float = 1.0, dc: str = "off") -> Kernel:
    """A linear gain behind a DC block of a mode, or none."""
    scale = Kernel(lambda tracks, channels: {}, lambda state, x: x * gain, (np.zeros((1, 1)), np.zeros(1), np.zeros(1), gain), lambda state, x: x * gain)
    return scale if dc == "off" else chain(dc_block(DC_MODES[dc], rate), scale)


def filtered(rate: float, kind: str = "lowpass", cutoff: float = 20000.0, q: float = 0.707) -> Kernel:
    """The filter effect; a cutoff over half the rate is held under it."""
    return biquad(FILTERS[kind], min(cutoff, rate / 2 - 1), rate, q)


def dc_block(hz: float, rate: float) -> Kernel:
    r = 1 - TAU * hz / rate

    def init(tracks, channels):
        return {"x": np.zeros((tracks, channels)), "y": np.zeros((tracks, channels))}

    def step(state, x):
        y = x - state["x"] + r * state["y"]
        state["x"], state["y"] = x, y
        return y

    over = stretched(dc_system(hz, rate))

    def block(state, x):
        y, _ = over(x, (r * state["y"] - state["x"])[:, None])
        state["x"], state["y"] = x[-1].copy(), y[-1].copy()
        return y

    return Kernel(init, step, dc_system(hz, rate), block)


def coefficient(seconds: float, rate: float) -> float:
    return math.exp(-1 / (seconds * rate)) if seconds > 0 else 0.0


def followed(x: np.ndarray, y: np.ndarray, up: float, down: float) -> np.ndarray:
    """(frames, lanes) that follow x from y on. Each frame needs the one before: many lanes are stepped side by side, few one by one as
    plain numbers."""
    out = np.empty_like(x)
    if x.shape[1] > 16:
        for k, target in enumerate(x):
            y = target + np.where(target > y, up, down) * (y - target)
            out[k] = y
        return out
    for lane in range(x.shape[1]):
        now, own = float(y[lane]), []
        for target in x[:, lane].tolist():
            now = target + (up if target > now else down) * (now - target)
            own.append(now)
        out[:, lane] = own
    return out


def follower(attack: float, release: float, rate: float, start: float = 0.0) -> Kernel:
    up, down = coefficient(attack, rate), coefficient(release, rate)

    def init(tracks, channels):
        return {"y": np.full((tracks, channels), start)}

    def step(state, x):
        y = state["y"]
        state["y"] = x + np.where(x > y, up, down) * (y - x)
        return state["y"]

    def block(state, x):
        y = followed(x.reshape(len(x), -1), state["y"].ravel(), up, down).reshape(x.shape)
        state["y"] = y[-1].copy()
        return y

    return Kernel(init, step, None, block)


def spring(duration: float, rate: float) -> Kernel:
    """Follows its input as a critically damped spring that keeps its velocity when the target moves."""
    w = 5.5 / duration * 44100.0 / rate

    def init(tracks, channels):
        return {"v": np.zeros((tracks, channels)), "c": np.zeros((tracks, channels))}

    def step(state, x):
        state["v"] = state["v"] + (x - state["c"]) * w * w - 2 * w * state["v"]
        state["c"] = state["c"] + state["v"]
        return state["c"]

    return Kernel(init, step)


def _line(length: int) -> Callable[[int, int], dict]:
    # a track's frames of one channel are side by side
    return lambda tracks, channels: {"line": np.zeros((channels, tracks, length)).transpose(1, 2, 0), "at": np.zeros(tracks, np.int64)}


def _read(state, delay, name="line"):
    """Samples `delay` frames (an array of tracks x channels, fractions allowed) before the next write."""
    line, length = state[name], state[name].shape[1]
    d = np.broadcast_to(np.asarray(delay, float), (line.shape[0], line.shape[2]))
    low = np.floor(d).astype(np.int64)
    part = d - low
    rows, cols = np.arange(line.shape[0])[:, None], np.arange(line.shape[2])[None, :]
    at = state["at"][:, None]
    return (1 - part) * line[rows, (at - low) % length, cols] + part * line[rows, (at - low - 1) % length, cols]


def _write(state, x, name="line"):
    state[name][np.arange(len(x)), state["at"] % state[name].shape[1]] = x


def _read_many(state, delay):
    """(frames, tracks, channels) that _read gives frame by frame, as long as none of them is written meanwhile."""
    line, length = state["line"], state["line"].shape[1]
    n = len(delay)
    low = np.floor(delay).astype(np.int64)
    part = delay - low
    rows, cols = np.arange(line.shape[0])[None, :, None], np.arange(line.shape[2])[None, None, :]
    at = state["at"][None, :, None] + np.arange(n)[:, None, None] - low
    return (1 - part) * line[rows, at % length, cols] + part * line[rows, (at - 1) % length, cols]


def _write_many(state, x):
    """Writes (frames, tracks, channels) and goes on."""
    line, at = state["line"], state["at"][None, :] + np.arange(len(x))[:, None]
    line[np.arange(line.shape[0])[None, :], at % line.shape[1]] = x
    state["at"] = state["at"] + len(x)


def _piece(line: np.ndarray, at: int, n: int) -> np.ndarray:
    """n frames from place `at` of the lines (tracks, length) of one channel: a view, or a copy where they go around the end."""
    at, length = at % line.shape[1], line.shape[1]
    return line[:, at : at + n] if at + n <= length else np.concatenate([line[:, at:], line[:, : at + n - length]], 1)


def _put(line: np.ndarray, at: int, x: np.ndarray) -> None:
    at, length = at % line.shape[1], line.shape[1]
    ahead = min(x.shape[1], length - at)
    line[:, at : at + ahead] = x[:, :ahead]
    line[:, : x.shape[1] - ahead] = x[:, ahead:]


def _all(delay, x):
    """A delay for each frame, track and channel of x."""
    return np.broadcast_to(np.asarray(delay, float), x.shape)


def feedback_delay(delay: float, feedback: float, longest: int | None = None) -> Kernel:
    """An interpolated delay line; reads, then writes input + feedback x output. A delay is 1 frame at least."""
    length = (longest or math.ceil(delay)) + 2

    def step(state, x):
        y = _read(state, max(1.0, delay))
        _write(state, x + feedback * y)
        state["at"] = state["at"] + 1
        return y

    def block(state, x):
        y = _read_many(state, _all(max(1.0, delay), x))
        _write_many(state, x + feedback * y)
        return y

    return Kernel(_line(length), step, None, block, int(max(1.0, delay)))


def allpass(delay: int, g: float = 0.5) -> Kernel:
    def step(state, x):
        held = _read(state, delay)
        into = x - g * held
        _write(state, into)
        state["at"] = state["at"] + 1
        return held + g * into

    def block(state, x):
        held = _read_many(state, _all(delay, x))
        into = x - g * held
        _write_many(state, into)
        return held + g * into

    return Kernel(_line(delay + 2), step, None, block, max(1, delay))


def _db(x):
    return np.where(x <= 1e-6, -120.0, 20 * np.log10(np.maximum(x, 1e-12)))


def compressor(rate: float, threshold=-12.0, ratio=8.0, knee=3.0, attack=0.02, release=2.0, makeup=6.0, look=0.04) -> Kernel:
    """Stereo compressor; with a ratio of 20 or more a limiter, whose peak is that of the lookahead. Times are seconds."""
    limit, n = ratio >= 20, max(1, math.ceil(look * rate))
    slope = 1.0 if limit else 1 - 1 / ratio
    up, down = coefficient(attack, rate), coefficient(release, rate)

    def init(tracks, channels):
        return _line(n + 1)(tracks, channels) | {"env": np.full(tracks, -120.0 if limit else 0.0), "peaks": np.zeros((tracks, n))}

    def step(state, x):
        peak = np.abs(x).max(1)
        rows = np.arange(len(x))
        state["peaks"][rows, state["at"] % n] = peak
        level = _db(state["peaks"].max(1) if limit else peak)
        env = level + np.where(level > state["env"], up, down) * (state["env"] - level)
        state["env"] = env
        reduced = reduction(env, threshold, slope, knee)
        _write(state, x)
        out = _read(state, n) if n else x
        state["at"] = state["at"] + 1
        return out * (10 ** ((makeup - reduced) / 20))[:, None]

    def block(state, x):
        level = np.abs(x).max(2)
        if limit:  # what the last n frames had at most; the ring holds them by their place
            order = (state["at"][:, None] + np.arange(n)) % n
            before = np.take_along_axis(state["peaks"], order, 1).T
            every = np.concatenate([before, level])
            state["peaks"] = np.take_along_axis(every[-n:].T, np.argsort((state["at"][:, None] + len(x) + np.arange(n)) % n, 1), 1)
            level = _highest(every, n)[-len(x) :]
        env = followed(_db(level), state["env"], up, down)
        state["env"] = env[-1].copy()
        # the line gives what was written n frames ago, which may be within these frames
        whole = np.concatenate([_read_many(state, _all(float(n), x[: min(n, len(x))])), x])[: len(x)]
        _write_many(state, x)
        return whole * (10 ** ((makeup - reduction(env, threshold, slope, knee)) / 20))[:, :, None]

    values = {"rate": rate, "threshold": threshold, "slope": slope, "knee": knee, "attack": attack, "release": release, "makeup": makeup, "frames": n, "limit": limit}
    return Kernel(init, step, None, block, n + 1, ("compressor", values))


def _highest(x: np.ndarray, n: int) -> np.ndarray:
    """The greatest of each row and the n - 1 before it, by running maxima from the ends of pieces of n rows."""
    if n == 1:
        return x
    padded = np.concatenate([np.full((n - 1 + (-(len(x) + n - 1)) % n, *x.shape[1:]), -np.inf), x])
    pieces = padded.reshape(-1, n, *x.shape[1:])
    ahead = np.maximum.accumulate(pieces, 1).reshape(padded.shape)
    behind = np.maximum.accumulate(pieces[:, ::-1], 1)[:, ::-1].reshape(padded.shape)
    return np.maximum(ahead[n - 1 :], behind[: len(padded) - n + 1])[-len(x) :]


def reduction(env: np.ndarray, threshold: float, slope: float, knee: float) -> np.ndarray:
    """Decibels that a level loses over the threshold, with a soft knee."""
    over = env - threshold
    if knee <= 0:
        return np.where(over > 0, over * slope, 0.0)
    t = (over + knee / 2) / knee
    return np.where(np.abs(over) < knee / 2, t * t * slope * knee / 2, np.where(over >= knee / 2, over * slope, 0.0))


#: Decibels at which a gate is silent; a little over -60, which a gain nears without an end, so that rounding doesn't decide.
CLOSED = -60 + 1e-9


def gate(rate: float, threshold=-30.0, attack=0.005, hold=0.1, release=0.2, floor=-60.0) -> Kernel:
    up, down = coefficient(attack, rate), coefficient(release, rate)

    def init(tracks, channels):
        return {"env": np.full(tracks, -120.0), "hold": np.zeros(tracks, np.int64), "gain": np.full(tracks, floor)}

    def step(state, x):
        level = _db(np.abs(x).max(1))
        state["env"] = level + np.where(level > state["env"], up, down) * (state["env"] - level)
        is_open = state["env"] >= threshold
        held = ~is_open & (state["hold"] > 0)
        state["hold"] = np.where(is_open, int(hold * rate), np.where(held, state["hold"] - 1, 0))
        target = np.where(is_open | held, 0.0, floor)
        c = np.where(target > state["gain"], up, down)
        state["gain"] = c * state["gain"] + (1 - c) * target
        return x * np.where(state["gain"] <= CLOSED, 0.0, 10 ** (state["gain"] / 20))[:, None]

    def block(state, x):
        env = followed(_db(np.abs(x).max(2)), state["env"], up, down)
        is_open, place, wait = env >= threshold, np.arange(len(x))[:, None], int(hold * rate)
        # frames since it was open, by the last open one; before these frames it was so long ago as the counter says
        last = np.maximum.accumulate(np.where(is_open, place, state["hold"] - wait - 1), 0)
        since = place - last
        gain = followed(np.where(since <= wait, 0.0, floor), state["gain"], up, down)
        state["env"], state["gain"], state["hold"] = env[-1].copy(), gain[-1].copy(), np.maximum(wait - since[-1], 0)
        return x * np.where(gain <= CLOSED, 0.0, 10 ** (gain / 20))[:, :, None]

    values = {"rate": rate, "threshold": threshold, "attack": attack, "release": release, "hold": int(hold * rate), "floor": floor}
    return Kernel(init, step, None, block, dynamics=("gate", values))


def _sine(phase):
    """The parabola sine of a phase in 0..1."""
    a = np.where(phase < 0.5, phase, phase - 1) * TAU
    y = a * (4 / math.pi) - a * np.abs(a) * (4 / math.pi**2)
    return 0.225 * (y * np.abs(y) - y) + y


def _held(cycle, seed: int):
    """functions.scalar.noise of a cycle's number."""
    a = (np.asarray(cycle).astype(np.int64) % 65536 * 25173 + (13849 + 7919 * seed)) % 65536
    return (a * 25173 + 13849) % 65536 / 32768.0 - 1


LFO_SHAPES = ("sine", "triangle", "ramp_up", "ramp_down", "square", "random", "smooth_random")


def lfo(turns, shape: str, seed: int = 0):
    """A low-frequency oscillator after so many turns, in -1..1."""
    phase = turns % 1.0
    match shape:
        case "sine":
            return _sine(phase)
        case "triangle":
            return np.where(phase < 0.25, 4 * phase, np.where(phase < 0.75, 2 - 4 * phase, 4 * phase - 4))
        case "ramp_up":
            return 2 * phase - 1
        case "ramp_down":
            return 1 - 2 * phase
        case "square":
            return np.where(phase < 0.5, 1.0, -1.0)
        case "random":
            return _held(np.floor(turns), seed)
        case "smooth_random":
            a, b = _held(np.floor(turns), seed), _held(np.floor(turns) + 1, seed)
            return a + (b - a) * (1 - np.cos(math.pi * phase)) / 2
    raise ValueError(f"unknown shape {shape}")


def _turned(state, step: float, frames: int):
    """Turns of each of so many frames and track, added up as single steps are."""
    every = np.add.accumulate(np.concatenate([state["phase"][None], np.full((frames, len(state["phase"])), step)]), 0)
    state["phase"] = every[-1].copy()
    return every[:-1]


def delay(rate: float, ms=375.0, feedback=0.5, drive=0.0, cutoff=20000.0, filter_kind="lowpass", mix=0.5, width=1.0, ping_pong=False, lfo_hz=0.0, to_time=0.0, to_feedback=0.0, to_cutoff=0.0, lfo_shape="sine", seed=0) -> Kernel:
    """Stereo or ping-pong delay; what comes out of the lines goes through a filter, saturation, a DC block and a clamp, and is both
    the wet signal and what is fed back."""
    length = int(4 * rate) + 4
    straight = dc_block(5.0, rate)

    def init(tracks, channels):
        return _line(length)(tracks, channels) | {"phase": np.zeros(tracks), "back": np.zeros((tracks, channels)), "s": np.zeros((2, tracks, channels))} | straight.init(tracks, channels)

    def step(state, x):
        wave = lfo(_turned(state, lfo_hz / rate, 1)[0], lfo_shape, seed)[:, None]
        frames = np.minimum(np.maximum(1.0, ms + wave * to_time * 50) * rate / 1000, length - 2)
        fb = np.clip(feedback + wave * to_feedback * (1 - abs(feedback)), 0, 0.999)
        cut = np.clip(cutoff * 2 ** (2 * wave * to_cutoff), 20, rate / 2 - 1)
        g = np.tan(math.pi * cut / rate)
        k = max(2 * (1 - 0.97 * 0.302), 0.03)
        y = _read(state, np.maximum(1.0, frames))
        if ping_pong:
            into = np.stack([(x[:, 0] + x[:, 1]) / 2 + (state["back"] * fb)[:, 1], (state["back"] * fb)[:, 0]], 1)
        else:
            into = x + fb * state["back"]
        _write(state, into)
        state["at"] = state["at"] + 1
        a1 = 1 / (1 + g * (g + k))
        s1, s2 = state["s"]
        v3 = y - s2
        v1 = a1 * s1 + g * a1 * v3
        v2 = s2 + g * a1 * s1 + g * g * a1 * v3
        state["s"] = np.stack([2 * v1 - s1, 2 * v2 - s2])
        v = {"lowpass": v2, "bandpass": v1, "highpass": y - k * v1 - v2}[filter_kind]
        if drive >= 0.001:
            gain = 1 + 4 * drive
            v = v * gain
            v = v * (27 + v * v) / (27 + 9 * v * v) / math.sqrt(gain)
        state["back"] = np.clip(straight.step(state, v), -4, 4)
        out = min(2 * (1 - mix), 1) * x + min(2 * mix, 1) * state["back"]
        m, s = (out[:, :1] + out[:, 1:]) / 2, (out[:, :1] - out[:, 1:]) / 2 * width
        return np.concatenate([m + s, m - s], 1)

    low = {"lowpass": (0.0, 0.0, 1.0), "bandpass": (0.0, 1.0, 0.0), "highpass": None}[filter_kind]
    held_g, held_k = math.tan(math.pi * min(max(cutoff, 20), rate / 2 - 1) / rate), max(2 * (1 - 0.97 * 0.302), 0.03)
    held_a = 1 / (1 + held_g * (held_g + held_k))
    over = stretched(biquad_system((held_a, held_g * held_a, held_g * held_g * held_a, *(low or (1.0, -held_k, -1.0)))))

    def block(state, x):
        wave = lfo(_turned(state, lfo_hz / rate, len(x)), lfo_shape, seed)[:, :, None]
        frames = np.minimum(np.maximum(1.0, ms + wave * to_time * 50) * rate / 1000, length - 2)
        fb = np.clip(feedback + wave * to_feedback * (1 - abs(feedback)), 0, 0.999)
        v, after = over(_read_many(state, np.maximum(1.0, np.broadcast_to(frames, x.shape))), state["s"].transpose(1, 0, 2))
        state["s"] = after.transpose(1, 0, 2)
        if drive >= 0.001:
            gain = 1 + 4 * drive
            v = v * gain
            v = v * (27 + v * v) / (27 + 9 * v * v) / math.sqrt(gain)
        back = np.clip(straight.block(state, v), -4, 4)
        fed = np.concatenate([state["back"][None], back[:-1]]) * fb
        into = np.stack([(x[:, :, 0] + x[:, :, 1]) / 2 + fed[:, :, 1], fed[:, :, 0]], 2) if ping_pong else x + fed
        _write_many(state, into)
        state["back"] = back[-1].copy()
        out = min(2 * (1 - mix), 1) * x + min(2 * mix, 1) * back
        m, s = (out[:, :, :1] + out[:, :, 1:]) / 2, (out[:, :, :1] - out[:, :, 1:]) / 2 * width
        return np.concatenate([m + s, m - s], 2)

    shortest = int(max(1.0, max(1.0, ms - abs(to_time) * 50) * rate / 1000))
    return Kernel(init, step, None, None if to_cutoff else block, min(shortest, length - 4))


def chorus(rate: float, lfo_hz=1.0, depth=0.25, feedback=0.5, ms=12.0, wet=0.5, offset=math.pi / 2, cutoff=20000.0, resonance=0.0, filter_kind="lowpass") -> Kernel:
    """Two delay lines whose times swing with LFOs, the right one ahead by `offset` radians; the filter is before the lines."""
    span = 256 * rate / 44100
    first = svf(filter_kind, min(cutoff, rate / 2 - 1), rate, resonance)
    length = int(2 + ms * rate / 1000 + 2 * span) + 4

    def init(tracks, channels):
        return _line(length)(tracks, channels) | first.init(tracks, channels) | {"phase": np.tile([0.0, (offset / TAU) % 1.0], (tracks, 1))}

    def step(state, x):
        y = _read(state, 2 + ms * rate / 1000 + (1 + _sine(state["phase"])) * span * depth)
        _write(state, first.step(state, x) + np.clip(feedback, -0.999, 0.999) * y)
        state["at"] = state["at"] + 1
        state["phase"] = (state["phase"] + lfo_hz / rate) % 1.0
        return (1 - wet) * x + wet * y

    def block(state, x):
        phase = (state["phase"][None] + lfo_hz / rate * np.arange(len(x))[:, None, None]) % 1.0
        y = _read_many(state, 2 + ms * rate / 1000 + (1 + _sine(phase)) * span * depth)
        _write_many(state, first.block(state, x) + np.clip(feedback, -0.999, 0.999) * y)
        state["phase"] = (state["phase"] + lfo_hz / rate * len(x)) % 1.0
        return (1 - wet) * x + wet * y

    return Kernel(init, step, None, block, int(2 + ms * rate / 1000))


#: The reverb's feedback lines: length in units of its size, the step of the vibrato's phase, and the allpass that feeds it; the
#: allpasses' lengths, and that of the line ahead: fixed values.
LINES = {
    "A": (79, 0.003251, "L"), "B": (73, 0.002999, "K"), "C": (71, 0.002917, "J"), "D": (67, 0.002749, "I"),
    "E": (61, 0.002503, "I"), "F": (59, 0.002423, "J"), "G": (53, 0.002146, "K"), "H": (47, 0.002088, "L"),
}
ALLPASSES = {"I": 43, "J": 41, "K": 37, "L": 31}
PREDELAY, PASSED = 29, 0.5
#: Tracks whose lines go through the reverb at a time, so that they stay in a core's cache.
NEAR = 16
#: Frames that a vibrato shortens a line by at most, halved; and its speed.
SWING, SPEED = 7.0, 0.1


def reverb_shape(room: float) -> tuple[float, float]:
    """(size, what the lines keep of their energy) of a room of 0..1."""
    size = 75 * room * room + 25
    return size, 1 - (1 - (0.82 - ((1 - room) * 0.7 + 0.002 * size))) ** 4


def reverb(rate: float, room=0.6, wet=0.35, seed=0) -> Kernel:
    """Eight feedback lines in two groups; each returns what it gives less what the other three of its group give. A line is read up to
    2 x SWING frames early as its vibrato goes; `blend` weighs the whole-frame tap against the interpolated one. Phases follow
    the seed."""
    size, kept = reverb_shape(room)
    cut = min(10000 - 3000 * room * wet, rate / 2 - 1)
    blend, regen = 0.955 - 0.007 * size, kept / 2
    filters = {n: biquad("lowpass", cut, rate, q) for n, q in (("fa", 1.618034), ("fb", 0.618034), ("fc", 0.5))}
    lengths = [int(size * units) for units, _, _ in LINES.values()]
    turns = np.array([turn for _, turn, _ in LINES.values()])[:, None] * SPEED
    sources = [list(ALLPASSES).index(source) for _, _, source in LINES.values()]
    passes = {n: allpass(max(1, int(size * v)), PASSED) for n, v in ALLPASSES.items()}
    ahead = max(1, int(size * PREDELAY))
    phases = np.random.default_rng(seed).random((len(LINES), 2)) * TAU

    def init(tracks, channels):
        state = {"pre": _line(ahead + 2)(tracks, channels), "phase": np.tile(phases[:, :channels], (tracks, 1, 1)), "back": np.zeros((tracks, len(LINES), channels))}
        state |= {n: _line(k + 2)(tracks, channels) for n, k in zip(LINES, lengths)}
        state |= {n: k.init(tracks, channels) for n, k in (filters | passes).items()}
        return state

    def step(state, x):
        v = _read(state["pre"], ahead)
        _write(state["pre"], x)
        state["pre"]["at"] = state["pre"]["at"] + 1
        v = np.sin(filters["fa"].step(state["fa"], v) * wet)
        taps = []
        for n in ALLPASSES:
            v = passes[n].step(state[n], v)
            taps.append(v)
        state["phase"] = state["phase"] + turns
        early = (1 + np.sin(state["phase"])) * SWING
        whole = np.floor(early)
        out = np.empty_like(state["back"])
        for k, n in enumerate(LINES):
            own = state[n]
            _write(own, taps[sources[k]] + state["back"][:, k])
            own["at"] = own["at"] + 1
            first, second = (_read(own, lengths[k] + 1 - whole[:, k] - more) for more in (0, 1))
            part = early[:, k] - whole[:, k]
            out[:, k] = (1 - blend) * (first * (1 - part) + second * part) + blend * first
        for group in (slice(0, 4), slice(4, 8)):
            own = out[:, group]
            state["back"][:, group] = (2 * own - own.sum(1, keepdims=True)) * regen
        v = np.clip(filters["fb"].step(state["fb"], out.mean(1)), -1, 1)
        return filters["fc"].step(state["fc"], np.arcsin(v)) + x * (1 - wet)

    def together(state, x):
        """What block does, for tracks that are at one place of their lines and their vibrato: all then read the same stretches of their lines."""
        n, tracks, channels = x.shape
        at = int(state["pre"]["at"][0])
        pre = state["pre"]["line"]
        v = np.stack([_piece(pre[:, :, c], at - ahead, n).T for c in range(channels)], 2)
        for c in range(channels):
            _put(pre[:, :, c], at, x[:, :, c].T)
        fed = np.ascontiguousarray(np.sin(filters["fa"].block(state["fa"], v) * wet).transpose(2, 1, 0))
        phase = state["phase"][0] + turns * np.arange(1, n + 1)[:, None, None]
        early = (1 + np.sin(phase)) * SWING
        whole = np.floor(early).astype(np.int64)
        second = (1 - blend) * (early - whole)
        first = 1 - second
        mixed = np.empty((channels, tracks, n))
        for c in range(channels):
            stays = [np.append(np.flatnonzero(np.append(True, np.diff(whole[:, k, c]) != 0)), n) for k in range(len(LINES))]
            for a in range(0, tracks, NEAR):
                b = min(tracks, a + NEAR)
                lines = {name: state[name]["line"][a:b, :, c] for name in (*ALLPASSES, *LINES)}
                u, taps = fed[c, a:b], []
                for name, kernel in passes.items():
                    held = _piece(lines[name], at - kernel.span, n)
                    into = u - PASSED * held
                    u = held + PASSED * into
                    _put(lines[name], at, into)
                    taps.append(u)
                out = np.empty((len(LINES), b - a, n))
                for k, name in enumerate(LINES):
                    for i, j in zip(stays[k], stays[k][1:]):
                        own = _piece(lines[name], int(at + i - lengths[k] + whole[i, k, c]), int(j - i) + 1)
                        out[k, :, i:j] = own[:, :-1] * first[i:j, k, c] + own[:, 1:] * second[i:j, k, c]
                mixed[c, a:b] = out.mean(0)
                for group in (slice(0, 4), slice(4, 8)):
                    own = out[group]
                    total = own.sum(0)
                    own *= 2
                    own -= total
                    own *= regen
                for k, name in enumerate(LINES):
                    into = taps[sources[k]].copy()
                    into[:, 0] += state["back"][a:b, k, c]
                    into[:, 1:] += out[k, :, :-1]
                    _put(lines[name], at, into)
                    state["back"][a:b, k, c] = out[k, :, -1]
        state["phase"] = np.tile(phase[-1], (tracks, 1, 1))
        for name in ("pre", *ALLPASSES, *LINES):
            state[name]["at"] = state[name]["at"] + n
        v = np.clip(filters["fb"].block(state["fb"], mixed.transpose(2, 1, 0)), -1, 1)
        return filters["fc"].block(state["fc"], np.arcsin(v)) + x * (1 - wet)

    def block(state, x):
        n = len(x)
        if n and all((state[name]["at"] == state["pre"]["at"][0]).all() for name in ("pre", *ALLPASSES, *LINES)) and (state["phase"] == state["phase"][0]).all():
            return together(state, x)
        v = _read_many(state["pre"], _all(ahead, x))
        _write_many(state["pre"], x)
        v = np.sin(filters["fa"].block(state["fa"], v) * wet)
        taps = []
        for name in ALLPASSES:
            v = passes[name].block(state[name], v)
            taps.append(v)
        phase = state["phase"][None] + turns * np.arange(1, n + 1)[:, None, None, None]
        state["phase"] = phase[-1]
        early = (1 + np.sin(phase)) * SWING
        whole = np.floor(early)
        out = np.empty((n, *state["back"].shape))
        for k, name in enumerate(LINES):
            # behind the write of the same frame, hence a frame nearer
            first, second = (_read_many(state[name], lengths[k] - whole[:, :, k] - more) for more in (0, 1))
            part = early[:, :, k] - whole[:, :, k]
            out[:, :, k] = (1 - blend) * (first * (1 - part) + second * part) + blend * first
        back = np.empty_like(out)
        for group in (slice(0, 4), slice(4, 8)):
            own = out[:, :, group]
            back[:, :, group] = (2 * own - own.sum(2, keepdims=True)) * regen
        fed = np.concatenate([state["back"][None], back[:-1]])
        for k, name in enumerate(LINES):
            _write_many(state[name], taps[sources[k]] + fed[:, :, k])
        state["back"] = back[-1].copy()
        v = np.clip(filters["fb"].block(state["fb"], out.mean(2)), -1, 1)
        return filters["fc"].block(state["fc"], np.arcsin(v)) + x * (1 - wet)

    shortest = min(ahead, *(p.span for p in passes.values()), min(lengths) - int(2 * SWING) - 2)
    return Kernel(init, step, None, block if shortest > 8 else None, max(1, shortest))


def chain(*kernels: Kernel) -> Kernel:
    """Kernels one after the other in a single fold."""

    def init(tracks, channels):
        return {str(k): kernel.init(tracks, channels) for k, kernel in enumerate(kernels)}

    def step(state, x):
        for k, kernel in enumerate(kernels):
            x = kernel.step(state[str(k)], x)
        return x

    def block(state, x):
        for k, kernel in enumerate(kernels):
            x = kernel.block(state[str(k)], x)
        return x

    systems, blocks = [k.system for k in kernels], kernels and all(k.block for k in kernels)
    return Kernel(init, step, reduce(in_series, systems) if systems and all(systems) else None, block if blocks else None, min([k.span for k in kernels], default=1))


RESET = "reset"


def automated(make: Callable[..., Kernel], start: dict[str, float], changes: list[tuple[int, str, float]], inertia: float = 0.0, rate: float = 44100.0) -> Kernel:
    """A kernel whose parameters move: make(**values) at the values of each frame. changes: (frame, parameter, target); a value goes
    towards its target by inertia x 44100 / rate of the way a frame, or at once. The kernels share one state, whose shape must
    not depend on a parameter that moves; the parameter RESET silences it. Frames count from the kernel's first."""
    first, share = make(**start), min(1.0, inertia * 44100.0 / rate) if inertia else 1.0
    log = sorted((c for c in changes if c[0] >= 0), key=lambda c: c[0])

    def init(tracks, channels):
        return {"inner": first.init(tracks, channels), "frame": 0, "next": 0, "value": dict(start), "target": dict(start), "kernel": make(**start)}

    def due(state, x):
        """Takes up the changes of this frame; true if a value moves."""
        while state["next"] < len(log) and log[state["next"]][0] <= state["frame"]:
            _, name, target = log[state["next"]]
            state["next"] += 1
            if name == RESET:
                state["inner"] = first.init(x.shape[-2], x.shape[-1])
            else:
                state["target"][name] = target
        moved = [n for n, target in state["target"].items() if state["value"][n] != target]
        for name in moved:
            value, target = state["value"][name], state["target"][name]
            value += (target - value) * share
            state["value"][name] = target if abs(target - value) < 1e-6 * max(1.0, abs(target)) else value
        if moved:
            state["kernel"] = make(**state["value"])
        return any(state["value"][n] != target for n, target in state["target"].items())

    def step(state, x):
        due(state, x)
        state["frame"] += 1
        return state["kernel"].step(state["inner"], x)

    def block(state, x):
        out, at = np.empty_like(x), 0
        while at < len(x):
            moving = due(state, x)
            until = log[state["next"]][0] - state["frame"] if state["next"] < len(log) else len(x) - at
            n = 1 if moving else min(len(x) - at, until)
            out[at : at + n], _ = run(state["kernel"], x[at : at + n], state["inner"])
            state["frame"] += n
            at += n
        return out

    return Kernel(init, step, None, block)


def run(kernel: Kernel, x: np.ndarray, state: dict | None = None) -> tuple[np.ndarray, dict]:
    """(frames, tracks, channels) through a kernel; the state carries on."""
    state = kernel.init(x.shape[1], x.shape[2]) if state is None else state
    if kernel.block and kernel.span >= 4:  # shorter ones cost more than single steps
        parts = [kernel.block(state, x[a : a + kernel.span]) for a in range(0, len(x), kernel.span)]
        return np.concatenate(parts) if parts else x, state
    return np.stack([kernel.step(state, f) for f in x]) if len(x) else x, state
