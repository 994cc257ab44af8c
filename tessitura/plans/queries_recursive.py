"""Filters, dynamics and feedback: folds over tracks, held against recursive queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessitura.operators import automation as A
from tessitura.operators import folds as FO
from tessitura.operators import kernels as K
from tessitura.plans import graph as G
from tessitura.plans.helpers import EMBED, EVENTS, r, sr
from tessitura.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATE = 100.0


def mono(name, kernel, state, steps, y, tables=""):
    """A mono fold against a recursion. state: name -> start; steps: nested (name, expression) over x and the old state as
    o.name, the new states as n_name; y: the output's expression."""

    def query(spark, sf):
        return FO.fold(T.event_signal(spark, sf), "track_id", kernel, ["x"]).select("track_id", "frame", r("x"))

    inner = f"SELECT s.track_id, s.frame, s.x, {', '.join(f'o.{k} AS o_{k}' for k in state)} FROM rec o JOIN sig s ON s.track_id = o.track_id AND s.frame = o.frame + 1"
    for k, e in steps:
        inner = f"SELECT *, {e} AS {k} FROM ({inner})"
    QUERIES[name] = query
    ORACLES[name] = (
        f"WITH RECURSIVE {EVENTS}, rec AS (SELECT track_id, CAST(-1 AS BIGINT) AS frame, {', '.join(f'CAST({v!r} AS DOUBLE) AS {k}' for k, v in state.items())}, CAST(0 AS DOUBLE) AS y FROM sig WHERE frame = 0"
        f" UNION ALL SELECT track_id, frame, {', '.join(f'n_{k}' for k in state)}, {y} FROM ({inner})) SELECT track_id, frame, {sr('y', 'x')} FROM rec WHERE frame >= 0"
    )


def section(c, x="x", p=""):
    a1, a2, a3, m0, m1, m2 = map(repr, c)
    return [
        (f"{p}v3", f"{x} - o_{p}s2"), (f"{p}v1", f"{a1} * o_{p}s1 + {a2} * {p}v3"), (f"{p}v2", f"o_{p}s2 + {a2} * o_{p}s1 + {a3} * {p}v3"),
        (f"n_{p}s1", f"2 * {p}v1 - o_{p}s1"), (f"n_{p}s2", f"2 * {p}v2 - o_{p}s2"), (f"{p}out", f"{m0} * {x} + {m1} * {p}v1 + {m2} * {p}v2"),
    ]


def _tangent(cutoff):
    return math.tan(math.pi * cutoff / RATE)


def oracle_biquad(kind, cutoff, q, gain):
    """The coefficients of a type, straight from its definition: low and high pass, band, notch, peak and allpass have k = 1 / q; a bell
    divides k by the gain's root, and shelves move g by its fourth root."""
    a = math.sqrt(10 ** (gain / 20))
    g = _tangent(cutoff) * {"lowshelf": a**-0.5, "highshelf": a**0.5}.get(kind, 1.0)
    k = 1 / (q * (a if kind == "bell" else 1))
    d = 1 / (1 + g * (g + k))
    dry = {"highpass": 1, "notch": 1, "peak": 1, "allpass": 1, "bell": 1, "lowshelf": 1, "highshelf": a * a}.get(kind, 0)
    band = {"highpass": -k, "bandpass": 1, "notch": -k, "peak": -k, "allpass": -2 * k, "bell": k * (a * a - 1), "lowshelf": k * (a - 1), "highshelf": k * (1 - a) * a}.get(kind, 0)
    low = {"lowpass": 1, "highpass": -1, "peak": -2, "lowshelf": a * a - 1, "highshelf": 1 - a * a}.get(kind, 0)
    return d, g * d, g * g * d, float(dry), float(band), float(low)


for _kind in K.BIQUADS:
    mono(f"biquad_{_kind}", K.biquad(_kind, 12.0, RATE, 0.9, 6.0), {"s1": 0.0, "s2": 0.0}, section(oracle_biquad(_kind, 12.0, 0.9, 6.0)), "out")
for _kind, _m in {"lowpass": (0.0, 0.0, 1.0), "bandpass": (0.0, 1.0, 0.0), "highpass": None}.items():
    _g, _k = _tangent(15.0), max(2 * (1 - 0.97 * 0.4), 0.03)
    _d = 1 + _g * (_g + _k)
    mono(f"svf_{_kind}", K.svf(_kind, 15.0, RATE, 0.4), {"s1": 0.0, "s2": 0.0}, section((1 / _d, _g / _d, _g * _g / _d, *(_m or (1.0, -_k, -1.0)))), "out")
_r = 1 - 2 * math.pi * 1.0 / RATE
_dc = ({"x1": 0.0, "y1": 0.0}, [("n_y1", f"x - o_x1 + {_r!r} * o_y1"), ("n_x1", "x")], "n_y1")
mono("dc_block", K.dc_block(1.0, RATE), *_dc)
_up, _down = math.exp(-1 / (0.02 * RATE)), math.exp(-1 / (0.2 * RATE))
mono("envelope_follower", K.follower(0.02, 0.2, RATE), {"y1": 0.0}, [("n_y1", f"x + CASE WHEN x > o_y1 THEN {_up!r} ELSE {_down!r} END * (o_y1 - x)")], "n_y1")
_w = 5.5 / 60 * 441
_w2 = 5.5 / 60000 * 441
mono("spring_follow", K.spring(60000.0, RATE), {"v": 0.0, "c": 0.0}, [("n_v", f"o_v + (x - o_c) * {_w2 * _w2!r} - {2 * _w2!r} * o_v"), ("n_c", "o_c + n_v")], "n_c")
_line = {f"l{k}": 0.0 for k in range(1, 6)}
mono("feedback_delay", K.feedback_delay(4.25, 0.5), _line, [("out", "0.75 * o_l4 + 0.25 * o_l5"), ("n_l1", "x + 0.5 * out"), *[(f"n_l{k}", f"o_l{k - 1}") for k in range(2, 6)]], "out")
mono("allpass_delay", K.allpass(3), {f"l{k}": 0.0 for k in range(1, 4)}, [("n_l1", "x - 0.5 * o_l3"), ("out", "o_l3 + 0.5 * n_l1"), ("n_l2", "o_l1"), ("n_l3", "o_l2")], "out")
_eq = (3.0, -4.0, 2.0, -1.0, 5.0), (4.0, 8.0, 16.0, 24.0, 32.0), (0.7, 1.0, 1.2, 0.9, 0.8)
_steps, _in = [], "x"
for _n, (_kind, _gain, _hz, _q) in enumerate(zip(("lowshelf", "bell", "bell", "bell", "highshelf"), *_eq)):
    _steps += section(oracle_biquad(_kind, _hz, _q, _gain), _in, f"b{_n}")
    _in = f"b{_n}out"
mono("fx_eq5", K.eq5(_eq[0], _eq[1], _eq[2], RATE), {f"b{n}{s}": 0.0 for n in range(5) for s in ("s1", "s2")}, _steps, _in)
mono("fx_filter_dc_chain", K.chain(K.biquad("bandpass", 10.0, RATE), K.dc_block(1.0, RATE)), {"as1": 0.0, "as2": 0.0, "x1": 0.0, "y1": 0.0},
     [*section(oracle_biquad("bandpass", 10.0, 0.707, 0.0), "x", "a"), ("n_y1", f"aout - o_x1 + {_r!r} * o_y1"), ("n_x1", "aout")], "n_y1")

mono("fx_filter_bandstop", K.filtered(RATE, "bandstop", 14.0, 0.8), {"s1": 0.0, "s2": 0.0}, section(oracle_biquad("notch", 14.0, 0.8, 0.0)), "out")
mono("fx_gain_dc", K.gained(RATE, 1.5, "slow"), _dc[0], _dc[1], "1.5 * n_y1")
# a cutoff that jumps from 8 to 30 Hz at frame 20: the state stays, the coefficients change
_before, _after = section(oracle_biquad("lowpass", 8.0, 0.707, 0.0), p="a"), section(oracle_biquad("lowpass", 30.0, 0.707, 0.0), p="b")
mono("fx_filter_automated", K.automated(lambda cutoff: K.filtered(RATE, "lowpass", cutoff), {"cutoff": 8.0}, [(20, "cutoff", 30.0)]), {"s1": 0.0, "s2": 0.0},
     [*[(k.replace("n_as", "m_as"), e.replace("o_as", "o_s")) for k, e in _before], *[(k.replace("n_bs", "m_bs"), e.replace("o_bs", "o_s")) for k, e in _after],
      *[(f"n_{k}", f"CASE WHEN frame < 20 THEN m_a{k} ELSE m_b{k} END") for k in ("s1", "s2")], ("out", "CASE WHEN frame < 20 THEN aout ELSE bout END")], "out")

# --- the parallel scan ------------------------------------------------------------------------------------------------


def scan_dc(spark, sf):
    return FO.affine_scan(T.event_signal(spark, sf), "track_id", K.dc_system(1.0, RATE), block=16).select("track_id", "frame", r("x"))


def scan_biquad(spark, sf):
    return FO.affine_scan(T.event_signal(spark, sf), "track_id", K.biquad("lowpass", 12.0, RATE, 0.9, 6.0).system, block=16).select("track_id", "frame", r("x"))


QUERIES |= {"scan_dc": scan_dc, "scan_biquad": scan_biquad}
ORACLES |= {"scan_dc": ORACLES["dc_block"], "scan_biquad": ORACLES["biquad_lowpass"]}

# --- stereo dynamics --------------------------------------------------------------------------------------------------


def recursion(source, state, steps, l, rr, table="sig"):
    """SQL of a stereo recursion over one of the tables of `source`: state, steps and outputs as for mono."""
    inner = f"SELECT s.*, {', '.join(f'o.{k} AS o_{k}' for k in state)} FROM rec o JOIN {table} s ON s.track_id = o.track_id AND s.frame = o.frame + 1"
    for k, e in steps:
        inner = f"SELECT *, {e} AS {k} FROM ({inner})"
    return (
        f"WITH RECURSIVE {source},"
        f" rec AS (SELECT track_id, CAST(-1 AS BIGINT) AS frame, {', '.join(f'CAST({v!r} AS {"DOUBLE[]" if isinstance(v, list) else "DOUBLE"}) AS {k}' for k, v in state.items())}, CAST(0 AS DOUBLE) AS yl, CAST(0 AS DOUBLE) AS yr FROM {table} WHERE frame = 0"
        f" UNION ALL SELECT track_id, frame, {', '.join(f'n_{k}' for k in state)}, {l}, {rr} FROM ({inner})) SELECT track_id, frame, {sr('yl', 'l')}, {sr('yr', 'r')} FROM rec WHERE frame >= 0"
    )


_STEREO = f"{EMBED}, sig AS (SELECT track_id, frame, l, r, greatest(abs(l), abs(r)) AS pk, max(greatest(abs(l), abs(r))) OVER w AS pk3, coalesce(lag(l, 3) OVER (PARTITION BY track_id ORDER BY frame), 0) AS l3, coalesce(lag(r, 3) OVER (PARTITION BY track_id ORDER BY frame), 0) AS r3 FROM emb WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


def stereo(name, kernel, state, steps, l, rr):
    def query(spark, sf):
        return FO.fold(T.embedding_signal(spark, sf), "track_id", kernel, ["l", "r"]).select("track_id", "frame", r("l"), r("r"))

    QUERIES[name] = query
    ORACLES[name] = recursion(_STEREO, state, steps, l, rr)


def _db(p):
    return f"CASE WHEN {p} <= 1e-6 THEN -120.0 ELSE 20 * log10({p}) END"


_a, _b = math.exp(-1 / (0.02 * RATE)), math.exp(-1 / (0.1 * RATE))
_follow = lambda d: f"{d} + CASE WHEN {d} > o_env THEN {_a!r} ELSE {_b!r} END * (o_env - {d})"
_gain = "pow(10.0, (6.0 - red) / 20)"
stereo("fx_compressor", K.compressor(RATE, -12.0, 8.0, 3.0, 0.02, 0.1, 6.0, 0.03), {"env": 0.0},
       [("d", _db("pk")), ("n_env", _follow("d")), ("red", "CASE WHEN n_env > -13.5 AND n_env < -10.5 THEN pow((n_env + 13.5) / 3, 2) * 0.875 * 1.5 WHEN n_env >= -10.5 THEN (n_env + 12) * 0.875 ELSE 0 END")],
       f"l3 * {_gain}", f"r3 * {_gain}")
stereo("fx_limiter", K.compressor(RATE, -10.0, 20.0, 0.0, 0.02, 0.1, 0.0, 0.03), {"env": -120.0},
       [("d", _db("pk3")), ("n_env", _follow("d")), ("red", "greatest(n_env + 10, 0)")], "l3 * pow(10.0, -red / 20)", "r3 * pow(10.0, -red / 20)")
_g = "CASE WHEN n_gain <= -60 THEN 0 ELSE pow(10.0, n_gain / 20) END"
stereo("fx_gate", K.gate(RATE, -14.0, 0.02, 0.03, 0.1, -60.0), {"env": -120.0, "hold": 0.0, "gain": -60.0},
       [("d", _db("pk")), ("n_env", _follow("d")), ("is_open", "n_env >= -14"), ("n_hold", "CASE WHEN is_open THEN 3 WHEN o_hold > 0 THEN o_hold - 1 ELSE 0 END"), ("target", "CASE WHEN is_open OR o_hold > 0 THEN 0.0 ELSE -60.0 END"),
        ("n_gain", f"CASE WHEN target > o_gain THEN {_a!r} ELSE {_b!r} END * o_gain + (1 - CASE WHEN target > o_gain THEN {_a!r} ELSE {_b!r} END) * target")],
       f"l * {_g}", f"r * {_g}")

# --- the same by scans over blocks ------------------------------------------------------------------------------------


def by_scan(kernel):
    return lambda spark, sf: FO.dynamics(T.embedding_signal(spark, sf), "track_id", kernel).select("track_id", "frame", r("l"), r("r"))


QUERIES |= {
    "scan_compressor": by_scan(K.compressor(RATE, -12.0, 8.0, 3.0, 0.02, 0.1, 6.0, 0.03)), "scan_limiter": by_scan(K.compressor(RATE, -10.0, 20.0, 0.0, 0.02, 0.1, 0.0, 0.03)),
    "scan_gate": by_scan(K.gate(RATE, -14.0, 0.02, 0.03, 0.1, -60.0)),
    "scan_follower": lambda spark, sf: FO.follower_scan(T.event_signal(spark, sf), "track_id", _up, _down, 0.0, -1e6, 1e6, block=16).select("track_id", "frame", r("x")),
}
ORACLES |= {"scan_compressor": ORACLES["fx_compressor"], "scan_limiter": ORACLES["fx_limiter"], "scan_gate": ORACLES["fx_gate"], "scan_follower": ORACLES["envelope_follower"]}

# --- delays: the lines are lists, the newest frame first --------------------------------------------------------------


def line(name, longest):
    return {name: [0.0] * longest}


def into(name, longest, value):
    """A line after a frame was written."""
    return (f"n_{name}", f"list_prepend({value}, o_{name}[1:{longest - 1}])")


def tap(name, frames):
    """What was written `frames` (an expression) before, between two frames linearly."""
    low = f"CAST(floor({frames}) AS INT)"
    return f"(o_{name}[{low}] + ({frames} - floor({frames})) * (o_{name}[{low} + 1] - o_{name}[{low}]))"


def parabola(phase):
    """The LFO's sine of a phase in 0..1: a parabola, and one step towards the sine."""
    a = f"(CASE WHEN {phase} < 0.5 THEN {phase} ELSE {phase} - 1 END * 2 * pi())"
    y = f"({a} * 4 / pi() - {a} * abs({a}) * 4 / (pi() * pi()))"
    return f"(0.225 * ({y} * abs({y}) - {y}) + {y})"


_DELAY_RATE, _DC = 1000.0, 1 - 2 * math.pi * 5 / 1000.0


def delay_steps(longest, frames, drive, inputs):
    """Line, filter (low pass at 300 Hz, resonance 0.302), saturation, DC block and clamp of both channels; out is what is fed back."""
    g, k = math.tan(math.pi * 300.0 / _DELAY_RATE), 2 * (1 - 0.97 * 0.302)
    d = 1 / (1 + g * (g + k))
    steps = []
    for c, x in inputs.items():
        steps += [(f"{c}in", x), into(f"{c}line", longest, f"{c}in"), (f"{c}tap", tap(f"{c}line", frames))]
        steps += section((d, g * d, g * g * d, 0.0, 0.0, 1.0), f"{c}tap", c)
        driven = f"({c}out * {1 + 4 * drive!r})"
        shaped = f"{driven} * (27 + {driven} * {driven}) / (27 + 9 * {driven} * {driven}) / {math.sqrt(1 + 4 * drive)!r}" if drive else f"{c}out"
        steps += [(f"n_{c}x", shaped), (f"n_{c}y", f"n_{c}x - o_{c}x + {_DC!r} * o_{c}y"), (f"n_{c}back", f"greatest(least(n_{c}y, 4), -4)")]
    return steps


def delay_state(longest):
    return {k: v for c in "ab" for k, v in (line(f"{c}line", longest) | {f"{c}{n}": 0.0 for n in ("s1", "s2", "x", "y", "back")}).items()}


stereo("fx_delay", K.delay(_DELAY_RATE, 6.0, 0.5, 0.3, 300.0), delay_state(8),
       delay_steps(8, "6.0", 0.3, {"a": "l + 0.5 * o_aback", "b": "r + 0.5 * o_bback"}), "l + n_aback", "r + n_bback")
stereo("fx_delay_ping_pong", K.delay(_DELAY_RATE, 6.0, 0.5, 0.0, 300.0, ping_pong=True, lfo_hz=5.0, to_time=0.1), {"phase": 0.0} | delay_state(14),
       [("frames", f"greatest(1.0, 6 + 5 * {parabola('o_phase')})"), ("n_phase", "fmod(o_phase + 0.005, 1.0)"),
        *delay_steps(14, "frames", 0.0, {"a": "(l + r) / 2 + 0.5 * o_bback", "b": "0.5 * o_aback"})], "l + n_aback", "r + n_bback")
# the LFO's other shapes, over turns that are added up frame by frame
_turns, _phase = ("n_turns", "o_turns + 0.05"), "(o_turns - floor(o_turns))"
_noise = lambda c: f"((((({c}) % 65536 * 25173 + 13849) % 65536) * 25173 + 13849) % 65536 / 32768.0 - 1)"
for _shape, _wave in {
    "triangle": f"CASE WHEN {_phase} < 0.25 THEN 4 * {_phase} WHEN {_phase} < 0.75 THEN 2 - 4 * {_phase} ELSE 4 * {_phase} - 4 END",
    "ramp_down": f"1 - 2 * {_phase}",
    "random": _noise("CAST(floor(o_turns) AS BIGINT)"),
    "smooth_random": f"{_noise('CAST(floor(o_turns) AS BIGINT)')} + ({_noise('CAST(floor(o_turns) AS BIGINT) + 1')} - {_noise('CAST(floor(o_turns) AS BIGINT)')}) * (1 - cos(pi() * {_phase})) / 2",
}.items():
    stereo(f"fx_delay_{_shape}", K.delay(_DELAY_RATE, 6.0, 0.5, 0.3, 300.0, lfo_hz=50.0, to_time=0.05, lfo_shape=_shape), {"turns": 0.0} | delay_state(12),
           [("frames", f"greatest(1.0, 6 + 2.5 * ({_wave}))"), _turns, *delay_steps(12, "frames", 0.3, {"a": "l + 0.5 * o_aback", "b": "r + 0.5 * o_bback"})], "l + n_aback", "r + n_bback")


def tail_delay(spark, sf):
    """All tracks as one, through a delay: its echoes sound on after the last frame."""
    g = G.Graph(rate=int(_DELAY_RATE))
    g.add_track(T.event_signal(spark, sf).groupBy("frame").agg((F.sum("x") / 100).alias("x")))
    g.add_builtin(G.ROOT, "delay", **_ECHO)
    return g.compile().select(F.lit(0).alias("track_id"), "frame", r("l"), r("r"))


_ECHO = {"dlay": 6.0, "fdbk": 0.5, "driv": 0.0, "cuto": 300.0, "wet_": 0.5, "wdth": 1.0}
QUERIES["tail_delay"] = tail_delay
ORACLES["tail_delay"] = recursion(
    f"{EVENTS}, mix AS (SELECT frame, sum(x) / 100 AS x FROM sig GROUP BY frame), whole AS (SELECT 0 AS track_id, g.frame, coalesce(mix.x, 0) AS l, coalesce(mix.x, 0) AS r"
    f" FROM range(0, (SELECT max(frame) FROM mix) + 1 + {G.effect_tail('delay', _DELAY_RATE, **_ECHO)}) g(frame) LEFT JOIN mix ON mix.frame = g.frame)",
    delay_state(8), delay_steps(8, "6.0", 0.0, {"a": "l + 0.5 * o_aback", "b": "r + 0.5 * o_bback"}), "l + n_aback", "r + n_bback", "whole",
)

_g, _k, _span = math.tan(math.pi * 499.0 / 1000.0), 2.0, 256000.0 / 44100
_d = 1 / (1 + _g * (_g + _k))
_chorus = []
for _c, _x in (("a", "l"), ("b", "r")):
    _chorus += [*section((_d, _g * _d, _g * _g * _d, 0.0, 0.0, 1.0), _x, _c), (f"{_c}far", f"14 + (1 + {parabola(f'o_{_c}phase')}) * {_span * 0.25!r}"), (f"{_c}tap", tap(f"{_c}line", f"{_c}far"))]
    _chorus += [into(f"{_c}line", 20, f"{_c}out + 0.5 * {_c}tap"), (f"n_{_c}phase", f"fmod(o_{_c}phase + 0.001, 1.0)")]
stereo("fx_chorus", K.chorus(1000.0), {"aphase": 0.0, "bphase": 0.25} | {k: v for c in "ab" for k, v in (line(f"{c}line", 20) | {f"{c}s1": 0.0, f"{c}s2": 0.0}).items()},
       _chorus, "0.5 * l + 0.5 * atap", "0.5 * r + 0.5 * btap")


def fx_reverb(spark, sf):
    """Each vector 65 times over, so that what comes back from the lines is heard; a test has the same as a plain loop."""
    long = A.looped(T.embedding_signal(spark, sf, dealt=True), ["track_id"], 0, 32, 64)
    return FO.fold(long, "track_id", K.reverb(8000.0, 0.0), ["l", "r"], dealt=True).select("track_id", "frame", r("l"), r("r"))


QUERIES["fx_reverb"] = fx_reverb
