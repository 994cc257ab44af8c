"""Automation, smoothers, envelopes, loops, delays, LFOs, resampling, notes and modulation."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.functions import scalar as S
from tessitura.operators import automation as A
from tessitura.operators import folds as FO
from tessitura.operators import mixing as M
from tessitura.operators import modulation as MO
from tessitura.operators import playheads as PL
from tessitura.operators import resampling as R
from tessitura.operators import synthesis as Y
from tessitura.plans.helpers import EMBED, EVENTS, FLAT, LOG, r, rounded, sr
from tessitura.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _log(spark, sf):
    """(track_id, frame, seq, type, x): the events as a control log on the frames of their track."""
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return T.read(spark, sf, "events").select(F.col("user_id").alias("track_id"), frame.alias("frame"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), (F.col("value") / 500.0).alias("x"))


# --- events as of frames ----------------------------------------------------------------------------------------------


def automation_asof(spark, sf):
    e = T.timed_events(spark, sf)
    own = e.filter("type = 'view'").select("track_id", "ts", "event_id", "x")
    log = e.filter("type = 'purchase'").select("track_id", "ts", F.col("event_id").alias("seq"), F.col("x").alias("gain"))
    out = A.as_of(own, log, ["track_id"], "ts", {"gain": "gain"}, "seq")
    return out.select("track_id", "event_id", r(F.col("x") * F.coalesce("gain", F.lit(1.0)), "x"))


add("automation_asof", automation_asof, f"""WITH v AS (SELECT user_id, ts, event_id, value / 500.0 AS x FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, value / 500.0 AS g FROM events WHERE event_type = 'purchase')
SELECT v.user_id AS track_id, v.event_id, {sr('v.x * coalesce(p.g, 1.0)', 'x')} FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts""")
_Q = 1 - 0.25


def automation_smoothed(spark, sf):
    log = _log(spark, sf)
    targets = log.filter("type = 'purchase'").select("track_id", "frame", F.col("x").alias("target"))
    return A.automated(log.select("track_id", "frame", "x"), targets, ["track_id"], 0.25, 1.0).select("track_id", "frame", r("value"))


add("automation_smoothed", automation_smoothed, f"""WITH RECURSIVE {LOG}, s AS (
SELECT track_id, frame, 1.0::DOUBLE AS value, CASE WHEN type = 'purchase' THEN x ELSE 1.0 END AS target FROM log WHERE frame = 0
UNION ALL SELECT l.track_id, l.frame, s.target - (s.target - s.value) * {_Q}, CASE WHEN l.type = 'purchase' THEN l.x ELSE s.target END FROM s JOIN log l ON l.track_id = s.track_id AND l.frame = s.frame + 1)
SELECT track_id, frame, {sr('value', 'value')} FROM s""")


def cancelled(spark, sf):
    log = _log(spark, sf).withColumn("sample_time", F.col("frame") + 5)
    stops = log.filter("type = 'error'").select("track_id", F.col("frame").alias("at"), "seq")
    kept = A.without_cancelled(log.filter("type = 'click'").select("track_id", "sample_time", "seq"), stops, ["track_id"])
    return kept.select("track_id", "sample_time", "seq")


add("cancel_pending", cancelled, f"""WITH {LOG} SELECT c.track_id, c.frame + 5 AS sample_time, c.seq FROM log c WHERE c.type = 'click' AND NOT EXISTS (SELECT 1 FROM log e WHERE e.type = 'error' AND e.track_id = c.track_id AND c.frame + 5 >= e.frame AND c.seq < e.seq)""")
add("event_order", lambda spark, sf: A.ordered(_log(spark, sf), ["track_id"], 4).select("track_id", "rank", "seq"),
    f"WITH {LOG} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY frame // 4, seq) AS INT) AS rank, seq FROM log")

# --- smoothers, faders, envelopes over the frames of tracks -----------------------------------------------------------


def by_frame(name, columns, sql):
    def query(spark, sf):
        return T.event_signal(spark, sf).select("track_id", "frame", *[r(c, n) for n, c in columns(F.col("frame"), F.col("x")).items()])

    add(name, query, f"WITH {EVENTS} SELECT track_id, frame, {', '.join(sr(e, n) for n, e in sql.items())} FROM sig")


by_frame("smooth_exponential", lambda f, x: {"y": A.exponential(F.lit(0.0), x, f, 0.1)}, {"y": "x - x * pow(0.9, frame)"})
by_frame("smooth_linear", lambda f, x: {"y": A.linear(F.lit(0.2), x, f, 0.01), "z": A.linear_over(F.lit(0.2), x, f, 20)},
         {"y": "CASE WHEN frame >= greatest(round(abs(x - 0.2) / 0.01), 1) THEN x ELSE 0.2 + sign(x - 0.2) * 0.01 * frame END", "z": "CASE WHEN frame >= 20 THEN x ELSE 0.2 + (x - 0.2) * frame / 20.0 END"})
_w = 5.5 / 100


def smooth_spring(spark, sf):
    return T.event_signal(spark, sf).select("track_id", "frame", r(A.spring(F.lit(0.0), F.lit(1.0), F.col("frame") + 1, 100.0), "y"))


add("smooth_spring", smooth_spring, f"""WITH RECURSIVE {EVENTS}, s AS (SELECT 0 AS frame, {_w * _w!r}::DOUBLE AS v, {_w * _w!r}::DOUBLE AS c UNION ALL
SELECT frame + 1, v + (1 - c) * {_w * _w!r} - {2 * _w!r} * v, c + v + (1 - c) * {_w * _w!r} - {2 * _w!r} * v FROM s WHERE frame < (SELECT max(frame) FROM sig)) SELECT sig.track_id, sig.frame, {sr('s.c', 'y')} FROM sig JOIN s ON s.frame = sig.frame""")
by_frame("fade_out", lambda f, x: {"y": x * A.fader(f, 1.0, 0.0, 0.5, 100.0)}, {"y": "x * exp(-4.605 * (frame + 1) / 50.0)"})
by_frame("fade_in", lambda f, x: {"y": x * A.fader(f, 0.0, 1.0, 0.2, 100.0)}, {"y": "x * (1 - exp(-4.605 * (frame + 1) / 20.0))"})
_LEFT, _STEP = "1.5 - v", "(1.5 - v) / (abs(12 * log2(1.5 / v)) / 24 * 100) * 4"
add("speed_glide", lambda spark, sf: T.event_signal(spark, sf).select("track_id", "frame", r(A.glide(F.col("frame"), 1.0, 1.5, 24.0, 100.0, 4), "y")),
    f"""WITH RECURSIVE {EVENTS}, g AS (SELECT CAST(-1 AS BIGINT) AS k, CAST(1.0 AS DOUBLE) AS v UNION ALL
SELECT k + 1, CASE WHEN abs({_LEFT}) <= 0.0001 THEN 1.5 WHEN abs({_LEFT}) < abs({_STEP}) THEN 1.5 ELSE v + {_STEP} END FROM g WHERE k < (SELECT max(frame) // 4 FROM sig))
SELECT sig.track_id, sig.frame, {sr('g.v', 'y')} FROM sig JOIN g ON g.k = sig.frame // 4""")  # fmt: skip
_H = "CASE WHEN {n} + 1 <= 10 THEN least(({n} + 1) / 5.0, 1) ELSE 1 - 0.4 * least(greatest(({n} + 1 - 10) / 8.0, 0), 1) END"
_G = f"({_H.format(n=39)}) * (1 - (frame - 40 + 1) / 12.0)"
by_frame("ahdsr_level", lambda f, x: {"y": A.ahdsr(f, F.lit(40), 100.0, 0.05, 0.05, 0.08, 0.6, 0.12)}, {"y": f"CASE WHEN frame < 40 THEN {_H.format(n='frame')} WHEN {_G} <= 0.001 THEN 0 ELSE {_G} END"})


def gated(spark, sf):
    s = T.event_signal(spark, sf)
    tracks = s.select("track_id").distinct().select("track_id", (F.col("track_id") % 7).alias("start_frame"), (F.col("track_id") % 7 + 20).alias("stop_frame"))
    return A.gated(s, tracks, ["track_id"], 0.05, 100.0).select("track_id", "frame", r("x"))


_RING = math.ceil(math.log(1e-4) / (-4.605 / 5)) - 1
add("start_stop_gate", gated, f"WITH {EVENTS} SELECT track_id, frame, {sr('CASE WHEN frame >= track_id % 7 + 20 THEN x * exp(-4.605 * (frame - track_id % 7 - 20 + 1) / 5.0) ELSE x END', 'x')} FROM sig WHERE frame >= track_id % 7 AND frame < track_id % 7 + 20 + {_RING}")
add("loop_repeat", lambda spark, sf: A.looped(T.event_signal(spark, sf), ["track_id"], 8, 20, 3).select("track_id", "frame", r("x")),
    f"WITH {EVENTS}, k AS (SELECT i FROM range(0, 4) t(i)) SELECT track_id, frame, {sr('x', 'x')} FROM sig WHERE frame < 8 UNION ALL SELECT track_id, frame + 12 * i, {rounded('x')} FROM sig, k WHERE frame >= 8 AND frame < 20")
add("repeat_whole", lambda spark, sf: A.looped(T.event_signal(spark, sf), ["track_id"], None, None, 2).select("track_id", "frame", r("x")),
    f"WITH {EVENTS}, n AS (SELECT track_id, max(frame) + 1 AS n FROM sig GROUP BY track_id) SELECT sig.track_id, frame + n * i AS frame, {sr('x', 'x')} FROM sig JOIN n ON n.track_id = sig.track_id, range(0, 3) k(i)")
add("seek", lambda spark, sf: A.sought(T.event_signal(spark, sf), ["track_id"], F.lit(30)).select("track_id", "frame", r("x")), f"WITH {EVENTS} SELECT track_id, frame - 30 AS frame, {sr('x', 'x')} FROM sig WHERE frame >= 30")


def gate_edges(spark, sf):
    """A shared gate that events open and close, and an envelope from its edges."""
    return A.gate_level(_log(spark, sf), ["track_id"], F.col("type").isin("click", "view"), 3.0).select("track_id", "frame", r("level"))


add("gate_edges", gate_edges, f"""WITH {LOG}, g AS (SELECT track_id, frame, CASE WHEN type IN ('click', 'view') THEN 1 ELSE 0 END AS gate FROM log), e AS (SELECT *, CASE WHEN gate = 1 AND coalesce(lag(gate) OVER (PARTITION BY track_id ORDER BY frame), 0) = 0 THEN frame END AS up FROM g),
t AS (SELECT *, frame - max(up) OVER (PARTITION BY track_id ORDER BY frame) AS t FROM e) SELECT track_id, frame, {sr('CASE WHEN gate = 1 THEN least((t + 1) / 3.0, 1) ELSE 0 END', 'level')} FROM t""")

# --- delays and LFOs --------------------------------------------------------------------------------------------------

add("delay_int", lambda spark, sf: FO.delayed(T.event_signal(spark, sf), "track_id", 7).select("track_id", "frame", r("x")), f"WITH {EVENTS} SELECT a.track_id, a.frame, {sr('coalesce(b.x, 0)', 'x')} FROM sig a LEFT JOIN sig b ON b.track_id = a.track_id AND b.frame = a.frame - 7")
add("delay_fraction", lambda spark, sf: FO.interpolated_delay(T.event_signal(spark, sf), "track_id", 3.25).select("track_id", "frame", r("x")),
    f"WITH {EVENTS} SELECT a.track_id, a.frame, {sr('0.75 * coalesce(b.x, 0) + 0.25 * coalesce(c.x, 0)', 'x')} FROM sig a LEFT JOIN sig b ON b.track_id = a.track_id AND b.frame = a.frame - 3 LEFT JOIN sig c ON c.track_id = a.track_id AND c.frame = a.frame - 4")
add("lookahead_peak", lambda spark, sf: FO.lookahead_peak(T.event_signal(spark, sf), "track_id", 6).select("track_id", "frame", r("delayed"), r("peak")),
    f"WITH {EVENTS} SELECT a.track_id, a.frame, {sr('coalesce((SELECT x FROM sig b WHERE b.track_id = a.track_id AND b.frame = a.frame - 6), 0)', 'delayed')}, {sr('(SELECT max(abs(x)) FROM sig b WHERE b.track_id = a.track_id AND b.frame BETWEEN a.frame - 5 AND a.frame)', 'peak')} FROM sig a")
_PH = "fmod(frame * 3.0 / 100, 1.0)"


def _phase(f):
    return F.pmod(f * 3.0 / 100, F.lit(1.0))


_a = f"(CASE WHEN {_PH} < 0.5 THEN {_PH} ELSE {_PH} - 1 END * 2 * pi())"
_y = f"({_a} * 4 / pi() - {_a} * abs({_a}) * 4 / (pi() * pi()))"
for _shape, _sql in {
    "sine": f"0.225 * ({_y} * abs({_y}) - {_y}) + {_y}", "triangle": f"CASE WHEN {_PH} < 0.25 THEN 4 * {_PH} WHEN {_PH} < 0.75 THEN 2 - 4 * {_PH} ELSE 4 * {_PH} - 4 END",
    "ramp_up": f"2 * {_PH} - 1", "ramp_down": f"1 - 2 * {_PH}", "square": f"CASE WHEN {_PH} < 0.5 THEN 1.0 ELSE -1.0 END",
}.items():
    by_frame(f"lfo_{_shape}", lambda f, x, _s=_shape: {"y": S.lfo(_phase(f), _s)}, {"y": _sql})


def _noise(k):
    a = f"((({k}) % 65536 * 25173 + {13849 + 7919 * 2}) % 65536)"
    return f"(({a} * 25173 + 13849) % 65536) / 32768.0 - 1"


_CY = "CAST(floor(frame * 3.0 / 100) AS BIGINT)"
by_frame("lfo_held", lambda f, x: {"y": S.lfo_held(F.floor(f * 3.0 / 100), 2)}, {"y": _noise(_CY)})
by_frame("lfo_smooth", lambda f, x: {"y": S.lfo_smooth(F.floor(f * 3.0 / 100), _phase(f), 2)}, {"y": f"({_noise(_CY)}) + (({_noise(_CY + ' + 1')}) - ({_noise(_CY)})) * (1 - cos(pi() * {_PH})) / 2"})

# --- resampling -------------------------------------------------------------------------------------------------------


def resample(name, ratio):
    def query(spark, sf):
        return R.cubic(T.event_signal(spark, sf), "track_id", ratio, ["x"]).select("track_id", "frame", r("x"))

    shift = 0.0 if ratio < 1 else 1 + ratio
    add(name, query, f"""WITH {EVENTS}, n AS (SELECT track_id, max(frame) + 1 AS n FROM sig GROUP BY track_id),
i AS (SELECT track_id, n, unnest(range(0, CAST(ceil(n / {ratio!r}) AS BIGINT) + 2)) AS i FROM n),
g AS (SELECT track_id, i AS frame, i * {ratio!r} + {shift!r} AS p, n FROM i WHERE ceil(i * {ratio!r} + {shift!r}) <= n - 2),
t AS (SELECT g.track_id, g.frame, g.p - floor(g.p) AS f, coalesce(a.x, 0) AS a, b.x AS b, c.x AS c, coalesce(d.x, 0) AS d FROM g LEFT JOIN sig a ON a.track_id = g.track_id AND a.frame = floor(g.p) - 1 JOIN sig b ON b.track_id = g.track_id AND b.frame = floor(g.p)
JOIN sig c ON c.track_id = g.track_id AND c.frame = floor(g.p) + 1 LEFT JOIN sig d ON d.track_id = g.track_id AND d.frame = floor(g.p) + 2)
SELECT track_id, frame, {sr('b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - 0.5 * d + f * ((d - a) / 2 + 1.5 * (b - c))))', 'x')} FROM t""")


resample("resample_up", R.rate_ratio(44100, 48000))
resample("resample_down", 1.5)
resample("resample_speed", R.rate_ratio(44100, 44100, 0.75))


def resample_sinc(spark, sf):
    return R.sinc(T.event_signal(spark, sf), "track_id", 0.5, ["x"], 8).select("track_id", "frame", r("x"))


_X = "(k.i * 0.5 - s.frame)"
_SP = f"(pi() * ({_X} / 8 + 1))"
add("resample_sinc", resample_sinc, f"""WITH {EVENTS}, m AS (SELECT track_id, max(frame) AS last FROM sig GROUP BY track_id)
SELECT s.track_id, k.i AS frame, {sr(f"sum(s.x * (CASE WHEN {_X} = 0 THEN 0.95 ELSE sin(pi() * 0.95 * {_X}) / (pi() * {_X}) END) * (0.35875 - 0.48829 * cos({_SP}) + 0.14128 * cos(2 * {_SP}) - 0.01168 * cos(3 * {_SP})))", 'x')}
FROM sig s JOIN m ON m.track_id = s.track_id JOIN (SELECT unnest(range(0, 2 * max(frame) + 1)) FROM sig) k(i) ON k.i * 0.5 BETWEEN s.frame - 8 AND s.frame + 8 AND k.i * 0.5 <= m.last GROUP BY s.track_id, k.i""")

# --- notes ------------------------------------------------------------------------------------------------------------

_NOTES = f"{LOG}, notes AS (SELECT track_id, seq AS note_id, frame AS on_frame, (SELECT min(e.frame) FROM log e WHERE e.track_id = n.track_id AND e.type IN ('click', 'view', 'error') AND (e.frame, e.seq) > (n.frame, n.seq)) AS off_frame FROM log n WHERE type = 'click')"


def _notes(spark, sf):
    return Y.notes_of(_log(spark, sf), "track_id", "click", ["view", "error"])


add("note_intervals", _notes, f"WITH {_NOTES} SELECT track_id, note_id, on_frame, off_frame FROM notes")


def voices(spark, sf):
    return Y.with_voices(_notes(spark, sf), "track_id", 2, 6).select("track_id", "note_id", "voice", "until")


# two voices, a release of 6 frames: who gets which voice in order, then until when each has it
add("note_voices", voices, f"""WITH RECURSIVE {_NOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY on_frame, note_id) AS rn FROM notes),
v AS (SELECT track_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS note_id, -1 AS voice, CAST(NULL AS BIGINT) AS id0, CAST(NULL AS BIGINT) AS off0, CAST(NULL AS BIGINT) AS id1, CAST(NULL AS BIGINT) AS off1 FROM n WHERE rn = 1
UNION ALL SELECT track_id, rn, note_id, w, CASE WHEN w = 0 THEN note_id ELSE id0 END, CASE WHEN w = 0 THEN off_frame ELSE off0 END, CASE WHEN w = 1 THEN note_id ELSE id1 END, CASE WHEN w = 1 THEN off_frame ELSE off1 END FROM (
SELECT n.*, v.id0, v.off0, v.id1, v.off1, CASE WHEN id0 IS NULL OR coalesce(off0 + 6 <= on_frame, false) THEN 0 WHEN id1 IS NULL OR coalesce(off1 + 6 <= on_frame, false) THEN 1
 WHEN coalesce(off0 <= on_frame, false) AND (NOT coalesce(off1 <= on_frame, false) OR off0 <= off1) THEN 0 WHEN coalesce(off1 <= on_frame, false) THEN 1 WHEN id0 < id1 THEN 0 ELSE 1 END AS w
FROM v JOIN n ON n.track_id = v.track_id AND n.rn = v.rn + 1))
SELECT v.track_id, v.note_id, CAST(v.voice AS INT) AS voice, least(n.off_frame + 6, lead(n.on_frame) OVER (PARTITION BY v.track_id, v.voice ORDER BY v.rn)) AS until FROM v JOIN n ON n.track_id = v.track_id AND n.rn = v.rn""")
_ENV = {"attack": 0.02, "hold": 0.0, "decay": 0.04, "sustain": 0.5, "release": 0.05}


def _buffers(spark, sf):
    return T.embedding_blocks(spark, sf).select(F.col("track_id").alias("buffer_id"), "samples")


def _played(spark, sf):
    n, buffers = _notes(spark, sf), T.read(spark, sf, "embeddings").count()
    return n.select("track_id", "note_id", (F.col("note_id") % buffers).alias("buffer_id"), "on_frame", "off_frame", S.speed_from_note(F.lit(60) + F.col("note_id") % 12).alias("speed"), F.lit(0.5).alias("volume"))


def sampler(spark, sf):
    out = Y.sampled(_played(spark, sf), _buffers(spark, sf), _ENV, 100.0, "track_id")
    return M.mixdown(out, ["track_id", "frame"], ["x"]).select("track_id", "frame", r("x"))


_E = "CASE WHEN {n} + 1 <= 2 THEN least(({n} + 1) / 2.0, 1) ELSE 1 - 0.5 * least(greatest(({n} + 1 - 2) / 4.0, 0), 1) END"
add("sampler_mix", sampler, f"""WITH {_NOTES}, {FLAT}, p AS (SELECT n.*, n.note_id % (SELECT count(*) FROM embeddings) AS b, pow(2.0, (n.note_id % 12) / 12.0) AS speed, off_frame - on_frame AS off FROM notes n),
s AS (SELECT p.*, t.i AS t, floor(t.i * speed) AS low, t.i * speed - floor(t.i * speed) AS part FROM p, range(0, 64) t(i) WHERE t.i <= floor(62 / speed)),
l AS (SELECT s.track_id, s.on_frame + s.t AS frame, s.off, s.t, (a.v * (1 - part) + c.v * part) * 0.5 AS x, CASE WHEN off IS NULL OR t < off THEN {_E.format(n='t')} ELSE ({_E.format(n='(off - 1)')}) * (1 - (t - off + 1) / 5.0) END AS g
FROM s JOIN flat a ON a.track_id = s.b AND a.i = s.low JOIN flat c ON c.track_id = s.b AND c.i = s.low + 1)
SELECT track_id, frame, {sr('sum(x * g)', 'x')} FROM l WHERE off IS NULL OR t < off OR (g > 0.001 AND x <> 0) GROUP BY track_id, frame""")


def grains(spark, sf):
    n = _played(spark, sf).filter("off_frame IS NOT NULL")
    g = Y.cloud_grains(n, 40.0, 0.08, 100.0, 10.0, 3).withColumn("pan", S.noise(F.col("note_id") + F.col("grain"), 5))
    return g, n


def grain_starts(spark, sf):
    g, _ = grains(spark, sf)
    return g.select("track_id", "note_id", "grain", "start", "length", "jitter", r("pan"))


def _lcg(k, seed):
    a = f"((({k}) % 65536 * 25173 + {13849 + 7919 * seed}) % 65536)"
    return f"((({a} * 25173 + 13849) % 65536) / 32768.0 - 1)"


_GR = f"""grains AS (SELECT n.track_id, n.note_id, i AS grain, n.on_frame + greatest(CAST(ceil(i * 2.5) AS BIGINT) - 1, 0) AS start, CAST(8 AS BIGINT) AS length, CAST(round({_lcg('n.note_id * 131 + i', 3)} * 10) AS BIGINT) AS jitter, {_lcg('n.note_id + i', 5)} AS pan
FROM (SELECT *, unnest(range(0, CAST(floor((off_frame - on_frame) / 2.5) AS BIGINT) + 1)) AS i FROM notes WHERE off_frame > on_frame) n WHERE n.on_frame + greatest(CAST(ceil(i * 2.5) AS BIGINT) - 1, 0) < n.off_frame)"""
add("grain_triggers", grain_starts, f"WITH {_NOTES}, {_GR} SELECT track_id, note_id, grain, start, length, jitter, {sr('pan', 'pan')} FROM grains")


def granular(spark, sf):
    g, _ = grains(spark, sf)
    return Y.granular(g, _buffers(spark, sf), "hann", "track_id").select("track_id", "frame", r("l"), r("r"))


add("granular_mix", granular, f"""WITH {_NOTES}, {_GR}, {FLAT}, s AS (SELECT g.track_id, g.start + t.i AS frame, b.v * pow(sin(pi() * t.i / 8.0), 2) AS x, pan FROM grains g, range(0, 8) t(i), flat b WHERE b.track_id = g.note_id % (SELECT count(*) FROM embeddings) AND b.i = ((g.jitter + t.i) % 64 + 64) % 64)
SELECT track_id, frame, {sr('sum(x * (1 - pan) / 2)', 'l')}, {sr('sum(x * (1 + pan) / 2)', 'r')} FROM s GROUP BY track_id, frame""")
_VARIED = {"size": 90.0, "variation": 0.6, "spray": 0.2, "spread": 0.5, "direction": "random", "position": 0.3, "step": 1.5, "seed": 11}


def granular_varied(spark, sf):
    """Grains that vary in size, volume, pitch, place, pan and direction around a moving playhead."""
    notes = _played(spark, sf).withColumn("pan", F.lit(0.1)).filter("off_frame IS NOT NULL")
    g = Y.varied_grains(Y.cloud_triggers(notes, 40.0, 100.0), _buffers(spark, sf), 100.0, **_VARIED)
    return Y.played_grains(Y.pooled(g, "track_id"), "tukey", "track_id").select("track_id", "frame", r("l"), r("r"))


def granular_sequential(spark, sf):
    notes = _played(spark, sf).withColumn("pan", F.lit(0.0)).filter("off_frame IS NOT NULL")
    t = Y.sequential_triggers(notes, 100.0, "exponential", 50.0, 0.5, 4)
    g = Y.varied_grains(t, _buffers(spark, sf), 100.0, size=50.0, variation=0.5, position=0.5, seed=4)
    return g.select("track_id", "note_id", "grain", "start", "length", r("turn"), r("volume"), r("place"))


def _d(k, seed=11):
    return _lcg("n.note_id * 131 + i", seed + k)


def _length(size, variation, seed):
    return f"greatest(CAST(trunc({size} * ({1 - 0.75 * variation!r} + {2.75 * variation!r} * ({_d(1, seed)} + 1) / 2) * 100.0 / 1000) AS BIGINT), 2)"


_SPEED = "pow(2.0, (n.note_id % 12) / 12.0)"
_AT = "(SELECT count(*) FROM embeddings)"
add("granular_varied", granular_varied, f"""WITH {_NOTES}, {FLAT}, g AS (SELECT n.track_id, n.note_id, n.note_id % {_AT} AS b, n.on_frame + greatest(CAST(ceil(i * 2.5) AS BIGINT) - 1, 0) AS start, {_length(90.0, 0.6, 11)} AS len, 0.5 * (1 - 0.6 * ({_d(2)} + 1) / 2) AS vol,
 {_SPEED} * pow(2.0, 0.6 * ({_d(3)} / 2 + {_d(4)} / 2) / 12) * CASE WHEN {_d(6)} < 0 THEN -1 ELSE 1 END AS turn, 0.3 + greatest(CAST(ceil(i * 2.5) AS BIGINT) - 1, 0) * 1.5 / 64 + 0.2 * {_d(5)} * 100.0 / 64 AS place, greatest(least(0.1 + 0.5 * {_d(7)}, 1), -1) AS pan, n.off_frame
 FROM (SELECT *, unnest(range(0, CAST(floor((off_frame - on_frame) / 2.5) AS BIGINT) + 1)) AS i FROM notes WHERE off_frame > on_frame) n),
t AS (SELECT *, start + k AS frame, least(k * 1.0 / len * {2047 / 2048!r}, 1 - k * 1.0 / len * {2047 / 2048!r}) AS edge, (place - floor(place)) + k * turn / 64 AS p FROM (SELECT *, unnest(range(0, len)) AS k FROM g WHERE start < off_frame)),
w AS (SELECT *, vol * CASE WHEN edge < 0.25 THEN 0.5 * (1 - cos(4 * pi() * edge)) ELSE 1 END AS w, (p - floor(p)) * 63 AS z FROM t),
q AS (SELECT w.*, z - floor(z) AS f, a.v AS y0, b1.v AS y1, c.v AS y2, d.v AS y3 FROM w JOIN flat a ON a.track_id = w.b AND a.i = (CAST(floor(z) AS INT) + 63) % 64 JOIN flat b1 ON b1.track_id = w.b AND b1.i = CAST(floor(z) AS INT) JOIN flat c ON c.track_id = w.b AND c.i = (CAST(floor(z) AS INT) + 1) % 64 JOIN flat d ON d.track_id = w.b AND d.i = (CAST(floor(z) AS INT) + 2) % 64 WHERE w > 0.001),
x AS (SELECT *, w * ((-0.5 * y0 + 1.5 * y1 - 1.5 * y2 + 0.5 * y3) * f * f * f + (y0 - 2.5 * y1 + 2.0 * y2 - 0.5 * y3) * f * f + (0.5 * y2 - 0.5 * y0) * f + y1) AS x FROM q)
SELECT track_id, frame, {sr('sum(x * (1 - pan) / 2)', 'l')}, {sr('sum(x * (1 + pan) / 2)', 'r')} FROM x GROUP BY track_id, frame""")
add("granular_sequential", granular_sequential, f"""WITH {_NOTES}, g AS (SELECT n.*, {_length(50.0, 0.5, 4)} AS length, {_SPEED} * pow(2.0, 0.5 * ({_d(3, 4)} / 2 + {_d(4, 4)} / 2) / 12) AS turn, 0.5 * (1 - 0.5 * ({_d(2, 4)} + 1) / 2) AS vol FROM (SELECT *, unnest(range(0, off_frame - on_frame)) AS i FROM notes WHERE off_frame > on_frame) n),
s AS (SELECT *, on_frame + coalesce(sum(CAST(ceil(length * 0.8) AS BIGINT)) OVER (PARTITION BY track_id, note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g)
SELECT track_id, note_id, i AS grain, CAST(start AS BIGINT) AS start, length, {sr('turn', 'turn')}, {sr('vol', 'volume')}, {sr('0.5', 'place')} FROM s WHERE start < off_frame""")


def sampler_pan(spark, sf):
    notes = _played(spark, sf).withColumn("pan", (F.col("note_id") % 5 - 2) / 2.0)
    out = Y.sampled(notes, _buffers(spark, sf), None, 100.0, "track_id")
    return M.mixdown(out, ["track_id", "frame"], ["l", "r"]).select("track_id", "frame", r("l"), r("r"))


add("sampler_pan", sampler_pan, f"""WITH {_NOTES}, {FLAT}, p AS (SELECT n.*, n.note_id % {_AT} AS b, {_SPEED} AS speed, (n.note_id % 5 - 2) / 2.0 AS pan FROM notes n),
s AS (SELECT p.*, t.i AS t, floor(t.i * speed) AS low, t.i * speed - floor(t.i * speed) AS part FROM p, range(0, 64) t(i) WHERE t.i <= floor(62 / speed)),
l AS (SELECT s.track_id, s.on_frame + s.t AS frame, (a.v * (1 - part) + c.v * part) * 0.5 AS x, pan FROM s JOIN flat a ON a.track_id = s.b AND a.i = s.low JOIN flat c ON c.track_id = s.b AND c.i = s.low + 1)
SELECT track_id, frame, {sr('sum(x * sqrt(1 - pan))', 'l')}, {sr('sum(x * sqrt(1 + pan))', 'r')} FROM l GROUP BY track_id, frame""")


def _pitches(spark, sf):
    """A tone for each supplier, of a frequency by its balance."""
    return T.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("track_id"), (1.5 + F.pmod(F.floor("s_acctbal"), F.lit(40)).cast("double") * 0.7).alias("hz"))


_PITCHES = "SELECT CAST(s_suppkey AS BIGINT) AS track_id, CAST(k.i AS BIGINT) AS frame, 1.5 + ((floor(s_acctbal)::BIGINT % 40 + 40) % 40) * 0.7 AS hz FROM supplier, range(0, 64) k(i)"
add("tones", lambda spark, sf: Y.tone(_pitches(spark, sf), 64, 100.0, "saw").select("track_id", "frame", r("x")),
    f"SELECT track_id, frame, {sr('2 * fmod(frame * hz / 100.0, 1.0) - 1', 'x')} FROM ({_PITCHES})")

def polyphonic(spark, sf):
    notes = _notes(spark, sf).filter("off_frame > on_frame").select("*", (3.0 + F.col("note_id") % 12).alias("hz"), F.lit(0.5).alias("volume"), ((F.col("note_id") % 5 - 2) / 2.0).alias("pan"))
    out = Y.polyphonic(notes, "track_id", "saw", 100.0, _ENV, 100)
    return M.mixdown(out, ["track_id", "frame"], ["l", "r"]).select("track_id", "frame", r("l"), r("r"))


add("polyphonic", polyphonic, f"""WITH {_NOTES}, t AS (SELECT *, 3.0 + note_id % 12 AS hz, (note_id % 5 - 2) / 2.0 AS pan, off_frame - on_frame AS off, unnest(range(0, off_frame - on_frame + 5)) AS t FROM notes WHERE off_frame > on_frame),
g AS (SELECT *, CASE WHEN t < off THEN {_E.format(n='t')} ELSE ({_E.format(n='(off - 1)')}) * (1 - (t - off + 1) / 5.0) END AS g FROM t),
x AS (SELECT *, (2 * fmod(t * hz / 100.0, 1.0) - 1) * CASE WHEN t >= off AND g <= 0.001 THEN 0 ELSE g END * 0.5 AS x FROM g)
SELECT track_id, on_frame + t AS frame, {sr('sum(x * sqrt(1 - pan))', 'l')}, {sr('sum(x * sqrt(1 + pan))', 'r')} FROM x GROUP BY track_id, on_frame + t""")


def tracks_due(spark, sf):
    """Notes as tracks: which sound in the frames 20 to 29 of a render."""
    tracks = _notes(spark, sf).select(F.col("note_id").alias("track_id"), F.col("on_frame").alias("start_frame"), F.col("off_frame").alias("stop_frame"))
    return A.due(tracks, 20, 30)


add("tracks_due", tracks_due, f"WITH {_NOTES} SELECT note_id AS track_id, on_frame AS start_frame, off_frame AS stop_frame FROM notes WHERE on_frame < 30 AND (off_frame IS NULL OR off_frame > 20)")
_TR = f"SELECT *, fmod(frame * hz / 100.0, 1.0) AS p FROM ({_PITCHES})"
for _shape, _sum in {
    "saw": "-2 / pi() * list_sum(list_transform(range(1, n + 1), lambda k: sin(2 * pi() * k * p) / k))",
    "triangle": "8 / (pi() * pi()) * list_sum(list_transform(range(1, n + 1), lambda k: CASE k % 4 WHEN 1 THEN sin(2 * pi() * k * p) / (k * k) WHEN 3 THEN -sin(2 * pi() * k * p) / (k * k) ELSE 0 END))",
    "pulse": "-2 / pi() * list_sum(list_transform(range(1, n + 1), lambda k: (sin(2 * pi() * k * p) - sin(2 * pi() * k * (p + 0.3))) / k))",
}.items():
    add(f"tones_bandlimited_{_shape}", lambda spark, sf, _s=_shape: Y.tone(_pitches(spark, sf), 64, 100.0, _s, 0.3, True).select("track_id", "frame", r("x")),
        f"SELECT track_id, frame, {sr(_sum, 'x')} FROM (SELECT *, greatest(CAST(floor(50.0 / hz) AS BIGINT), 1) AS n FROM ({_TR}))")

# --- modulation -------------------------------------------------------------------------------------------------------


def mod_routes(spark, sf):
    log = _log(spark, sf)
    values = log.select(F.col("track_id").alias("key"), F.col("type").alias("source"), "frame", F.col("x").alias("value"), (F.col("type") == "view").alias("bipolar"))
    routes = spark.createDataFrame(
        [("click", "pitch", 0.5, True, 1), ("view", "pitch", -0.4, False, 2), ("click", "pan", 0.3, False, 3), ("error", "pan", 0.0, False, 4), ("click", "pan", 0.7, False, 5), ("view", "pan", 0.2, True, 6)],
        "source string, target string, amount double, bipolar boolean, seq long",
    )
    out = A.routed(values.select("key", "source", F.floor(F.col("frame") / 5).alias("frame"), "value", "bipolar"), routes)
    return out.select("key", "target", F.col("frame").cast("long").alias("frame"), r("value"))


add("mod_routes", mod_routes, f"""WITH {LOG}, v AS (SELECT track_id AS key, type, frame // 5 AS frame, x FROM log),
m AS (SELECT key, 'pitch' AS target, frame, (x - 0.5) * 2 * 0.5 AS v FROM v WHERE type = 'click' UNION ALL SELECT key, 'pitch', frame, (x + 1) / 2 * -0.4 FROM v WHERE type = 'view' UNION ALL SELECT key, 'pan', frame, x * 0.7 FROM v WHERE type = 'click' UNION ALL SELECT key, 'pan', frame, x * 0.2 FROM v WHERE type = 'view')
SELECT key, target, frame, {sr('sum(v)', 'value')} FROM m GROUP BY key, target, frame""")
add("mod_sources", lambda spark, sf: _notes(spark, sf).select("track_id", "note_id", r(S.keytracked(F.col("note_id") % 128), "keytrack"), r(S.velocity(F.col("note_id") % 100, 99.0), "velocity")),
    f"WITH {_NOTES} SELECT track_id, note_id, {sr('(note_id % 128) / 127.0', 'keytrack')}, {sr('(note_id % 100) / 99.0', 'velocity')} FROM notes")
by_frame("frequency_glide", lambda f, x: {"y": A.frequency_glide(f, 220.0, 330.0, 24.0, 100.0)}, {"y": f"CASE WHEN frame >= {int(abs(12 * math.log2(1.5)) / 24.0 * 100)} THEN 330.0 ELSE 220.0 + 110.0 * frame / {int(abs(12 * math.log2(1.5)) / 24.0 * 100)} END"})
_MOTIONS = [(10, "speed", 0.5), (30, "seek", 5.0), (30, "speed", 2.0)]


_ROUTES = [
    MO.Route("lfo1", "density", 0.6, True), MO.Route("envelope", "density", 0.4, False), MO.Route("lfo2", "size", 0.5, True), MO.Route("lfo2", "pan", 0.3, False), MO.Route("keytrack", "position", 0.4, False),
    MO.Route("lfo1", "volume", 0.9, False), MO.Route("lfo1", "volume", -0.5, False), MO.Route("velocity", "volume", 0.25, True), MO.Route("envelope", "speed", -0.3, True), MO.Route("keytrack", "pan", 0.0009, False),
]
_SWINGS, _STEP = ((7.0, "triangle"), (11.0, "random")), 8


def _steps(spark, sf):
    notes = _played(spark, sf).filter("off_frame IS NOT NULL").withColumns({"note": F.col("note_id") % 128, "velocity": (F.col("note_id") % 100) / 99.0, "pan": F.lit(0.1)})
    return MO.voice_steps(notes, 100.0, _ROUTES, _SWINGS, _ENV, _STEP)


def voice_modulation(spark, sf):
    """Two LFOs, an envelope, velocity and key of each note, through a matrix, in steps of 8 frames."""
    return _steps(spark, sf).select("track_id", "note_id", "step", "frames", *[r(f"mod_{c}") for c in MO.TARGETS])


def grains_modulated(spark, sf):
    """Grains of a density that changes, and what each has of the step that it starts in."""
    g = MO.modulated_grains(MO.modulated_triggers(_steps(spark, sf), "track_id", 40.0, 100.0, _STEP), _buffers(spark, sf), 100.0, 90.0, 0.3)
    return g.select("track_id", "note_id", "grain", "start", "length", r("volume"), r("turn"), r("place"), r("pan"))


def granular_modulated(spark, sf):
    g = MO.modulated_grains(MO.modulated_triggers(_steps(spark, sf), "track_id", 40.0, 100.0, _STEP), _buffers(spark, sf), 100.0, 90.0, 0.3)
    return Y.played_grains(g, "tukey", "track_id").select("track_id", "frame", r("l"), r("r"))


_MODULATED = f"""WITH {_NOTES}, {FLAT}, st AS (SELECT *, off_frame - on_frame AS off, unnest(range(0, CAST(ceil((off_frame - on_frame) / 8.0) AS BIGINT))) AS step FROM notes WHERE off_frame > on_frame),
src AS (SELECT *, step * 8 AS t, least(8, off - step * 8) AS frames, step * 8 * 7.0 / 100.0 - floor(step * 8 * 7.0 / 100.0) AS p1, {_lcg('CAST(floor(step * 8 * 11.0 / 100.0) AS BIGINT) + note_id * 131', 2)} AS lfo2,
  note_id % 128 / 127.0 AS keytrack, note_id % 100 / 99.0 AS velocity, {_E.format(n='(step * 8)')} AS env FROM st),
lf AS (SELECT *, CASE WHEN p1 < 0.25 THEN 4 * p1 WHEN p1 < 0.75 THEN 2 - 4 * p1 ELSE 4 * p1 - 4 END AS lfo1 FROM src),
m AS (SELECT *, (lfo1 + 1) / 2 * -0.5 + (velocity - 0.5) * 2 * 0.25 AS mod_volume, (lfo2 + 1) / 2 * 0.3 AS mod_pan, (env - 0.5) * 2 * -0.3 AS mod_speed, lfo2 * 0.5 AS mod_size, lfo1 * 0.6 + env * 0.4 AS mod_density, keytrack * 0.4 AS mod_position FROM lf)"""
_TRIGGERED = f"""{_MODULATED}, pace AS (SELECT *, least(greatest(40 * (1 + mod_density), 1), 100) / 100.0 AS pace FROM m),
run AS (SELECT *, round(coalesce(sum(pace * frames) OVER (PARTITION BY track_id, note_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS since FROM pace),
k AS (SELECT *, unnest(range(CASE WHEN step = 0 THEN 0 ELSE CAST(floor(since) AS BIGINT) + 1 END, CAST(floor(round(since + pace * frames, 9)) AS BIGINT) + 1)) AS grain FROM run),
g AS (SELECT *, note_id % {_AT} AS b, on_frame + t + greatest(CAST(ceil(round((grain - since) / pace, 9)) AS BIGINT) - 1, 0) AS start, greatest(CAST(trunc(least(greatest(90 * (1 + mod_size), 1), 1000) * 100.0 / 1000) AS BIGINT), 2) AS len,
  0.5 * greatest(1 + mod_volume, 0) AS vol, {_SPEED.replace('n.note_id', 'note_id')} * greatest(1 + mod_speed, 0) AS turn, least(greatest(0.3 + mod_position, 0), 1) AS place, least(greatest(0.1 + mod_pan, -1), 1) AS pan FROM k)"""
add("voice_modulation", voice_modulation, f"{_MODULATED} SELECT track_id, note_id, step, frames, {', '.join(sr(f'mod_{c}', f'mod_{c}') for c in MO.TARGETS)} FROM m")
add("grains_modulated", grains_modulated, f"{_TRIGGERED} SELECT track_id, note_id, grain, start, len AS length, {sr('vol', 'volume')}, {sr('turn', 'turn')}, {sr('place', 'place')}, {sr('pan', 'pan')} FROM g WHERE start < off_frame")
add("granular_modulated", granular_modulated, f"""{_TRIGGERED},
t2 AS (SELECT *, start + i AS frame, least(i * 1.0 / len * {2047 / 2048!r}, 1 - i * 1.0 / len * {2047 / 2048!r}) AS edge, (place - floor(place)) + i * turn / 64 AS p FROM (SELECT *, unnest(range(0, len)) AS i FROM g WHERE start < off_frame)),
w AS (SELECT *, vol * CASE WHEN edge < 0.25 THEN 0.5 * (1 - cos(4 * pi() * edge)) ELSE 1 END AS w, (p - floor(p)) * 63 AS z FROM t2),
q AS (SELECT w.*, z - floor(z) AS f, a.v AS y0, b1.v AS y1, c.v AS y2, d.v AS y3 FROM w JOIN flat a ON a.track_id = w.b AND a.i = (CAST(floor(z) AS INT) + 63) % 64 JOIN flat b1 ON b1.track_id = w.b AND b1.i = CAST(floor(z) AS INT) JOIN flat c ON c.track_id = w.b AND c.i = (CAST(floor(z) AS INT) + 1) % 64 JOIN flat d ON d.track_id = w.b AND d.i = (CAST(floor(z) AS INT) + 2) % 64 WHERE w > 0.001),
x AS (SELECT *, w * ((-0.5 * y0 + 1.5 * y1 - 1.5 * y2 + 0.5 * y3) * f * f * f + (y0 - 2.5 * y1 + 2.0 * y2 - 0.5 * y3) * f * f + (0.5 * y2 - 0.5 * y0) * f + y1) AS x FROM q)
SELECT track_id, frame, {sr('sum(x * (1 - pan) / 2)', 'l')}, {sr('sum(x * (1 + pan) / 2)', 'r')} FROM x GROUP BY track_id, frame""")


def note_handles(spark, sf):
    """Notes whose volume, pan and speed are set while they sound: an event of another kind in the track goes to the last note before it."""
    log = _log(spark, sf)
    order = Window.partitionBy("track_id").orderBy("frame", "seq").rowsBetween(Window.unboundedPreceding, -1)
    aimed = log.withColumn("note_id", F.last(F.when(F.col("type") == "click", F.col("seq")), True).over(order)).filter("type <> 'click' AND note_id IS NOT NULL")
    x = F.col("x")
    kind = F.when(F.col("type") == "view", "volume").when(F.col("type") == "error", "pan").otherwise("speed")
    value = F.when(F.col("type") == "view", F.abs(x)).when(F.col("type") == "error", F.least(x, F.lit(1.0))).otherwise(0.25 + F.abs(x))
    changes = aimed.select("track_id", "note_id", "frame", "seq", kind.alias("what"), value.alias("value"))
    notes = _played(spark, sf).withColumn("pan", F.lit(0.0))
    return MO.handled_mix(notes, changes, _buffers(spark, sf), "track_id").select("track_id", "frame", r("l"), r("r"))


# a frame at a time: what was set at this frame or before it holds; the place moves by the speed that held at the frame before
add("note_handles", note_handles, f"""WITH RECURSIVE {_NOTES}, {FLAT}, aimed AS (SELECT *, last_value(CASE WHEN type = 'click' THEN seq END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS note_id FROM log),
ch AS (SELECT note_id, track_id, frame, max(CASE WHEN type = 'view' THEN abs(x) END) AS vol, max(CASE WHEN type = 'error' THEN least(x, 1) END) AS pan, max(CASE WHEN type NOT IN ('view', 'error') THEN 0.25 + abs(x) END) AS speed
  FROM aimed WHERE type <> 'click' AND note_id IS NOT NULL GROUP BY note_id, track_id, frame),
s AS (SELECT n.track_id, n.note_id, n.on_frame, n.note_id % {_AT} AS b, {_SPEED} AS speed FROM notes n),
rec AS (SELECT s.track_id, s.note_id, b, s.on_frame AS frame, 0.0::DOUBLE AS place, s.speed::DOUBLE AS speed, 0.5::DOUBLE AS vol, 0.0::DOUBLE AS pan FROM s
UNION ALL SELECT r.track_id, r.note_id, b, r.frame + 1, r.place + r.speed, coalesce(ch.speed, r.speed), coalesce(ch.vol, r.vol), coalesce(ch.pan, r.pan)
  FROM rec r LEFT JOIN ch ON ch.note_id = r.note_id AND ch.track_id = r.track_id AND ch.frame = r.frame + 1 WHERE r.place + r.speed <= 62),
l AS (SELECT rec.*, (a.v * (1 - (place - floor(place))) + coalesce(c.v, 0) * (place - floor(place))) * vol AS x FROM rec JOIN flat a ON a.track_id = b AND a.i = floor(place) LEFT JOIN flat c ON c.track_id = b AND c.i = floor(place) + 1)
SELECT track_id, frame, {sr('sum(x * sqrt(1 - pan))', 'l')}, {sr('sum(x * sqrt(1 + pan))', 'r')} FROM l GROUP BY track_id, frame""")


def playhead_loops(spark, sf):
    """Playheads of notes that move both ways at several paces, in a loop that moves after 9 frames and ends after 30 for a third of them."""
    n = _notes(spark, sf).filter("off_frame IS NOT NULL").select("track_id", "note_id", (F.col("off_frame") - F.col("on_frame") + 50).alias("frames"))
    loop = lambda frame, low, high, of: n.filter(of).select("track_id", "note_id", F.lit(frame).alias("frame"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
    loops = loop(2, 0.25, 0.5, "note_id % 4 <> 0").unionByName(loop(9, 0.375, 0.75, "note_id % 2 = 1")).unionByName(loop(30, None, None, "note_id % 3 = 0"))
    pace = (F.col("note_id") % 9 - 4) * 0.75 / 64
    held = PL.with_loops(n, loops, ["track_id", "note_id"], (F.col("note_id") % 8) / 8, pace)
    out = held.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)))
    out = PL.with_playhead(PL.with_playhead(out, F.col("frame")), F.col("frame"), "shifted", 0.3125)
    return out.select("track_id", "note_id", "frame", r("place"), r("shifted"))


_fold = lambda x: f"(low + ({x} - low) - floor(({x} - low) / (high - low)) * (high - low))"
# a frame at a time: the loop that holds before this frame decides about the move into it
add("playhead_loops", playhead_loops, f"""WITH RECURSIVE {_NOTES}, n AS (SELECT track_id, note_id, off_frame - on_frame + 50 AS frames, (note_id % 9 - 4) * 0.75 / 64 AS pace FROM notes WHERE off_frame IS NOT NULL),
rec AS (SELECT track_id, note_id, 0::BIGINT AS frame, note_id % 8 / 8.0::DOUBLE AS spot, false AS inside FROM n
UNION ALL SELECT track_id, note_id, frame, CASE WHEN pace = 0 THEN spot WHEN low IS NOT NULL AND inside THEN {_fold('(spot + pace)')} ELSE next END, inside OR (pace <> 0 AND coalesce(next >= low AND next < high, false))
FROM (SELECT r.track_id, r.note_id, r.frame + 1 AS frame, spot, inside, pace, (spot + pace) - floor(spot + pace) AS next,
  CASE WHEN r.frame >= 30 AND r.note_id % 3 = 0 THEN NULL WHEN r.frame >= 9 AND r.note_id % 2 = 1 THEN 0.375 WHEN r.frame >= 2 AND r.note_id % 4 <> 0 THEN 0.25 END AS low,
  CASE WHEN r.frame >= 30 AND r.note_id % 3 = 0 THEN NULL WHEN r.frame >= 9 AND r.note_id % 2 = 1 THEN 0.75 WHEN r.frame >= 2 AND r.note_id % 4 <> 0 THEN 0.5 END AS high
  FROM rec r JOIN n ON n.track_id = r.track_id AND n.note_id = r.note_id AND r.frame + 1 < n.frames)),
p AS (SELECT *, CASE WHEN frame >= 30 AND note_id % 3 = 0 THEN NULL WHEN frame >= 9 AND note_id % 2 = 1 THEN 0.375 WHEN frame >= 2 AND note_id % 4 <> 0 THEN 0.25 END AS low,
  CASE WHEN frame >= 30 AND note_id % 3 = 0 THEN NULL WHEN frame >= 9 AND note_id % 2 = 1 THEN 0.75 WHEN frame >= 2 AND note_id % 4 <> 0 THEN 0.5 END AS high FROM rec)
SELECT track_id, note_id, frame, {sr(f"CASE WHEN inside AND low IS NOT NULL THEN {_fold('spot')} ELSE spot END", 'place')}, {sr(f"CASE WHEN inside AND low IS NOT NULL THEN {_fold('(spot + 0.3125)')} ELSE (spot + 0.3125) - floor(spot + 0.3125) END", 'shifted')} FROM p""")


def seek_and_speed(spark, sf):
    """Tracks that slow down at frame 10, and jump to 5 and double their speed at frame 30."""
    segments = R.speed_segments(1.0, _MOTIONS, 100)
    return R.varispeed(T.event_signal(spark, sf), "track_id", segments, ["x"]).select("track_id", "frame", r("x"))


add("seek_and_speed", seek_and_speed, f"""WITH {EVENTS}, n AS (SELECT track_id, max(frame) AS last FROM sig GROUP BY track_id),
g AS (SELECT track_id, unnest(range(0, 60 + last)) AS frame, last FROM n), p AS (SELECT *, CASE WHEN frame < 10 THEN frame WHEN frame < 30 THEN 10 + (frame - 10) * 0.5 ELSE 5 + (frame - 30) * 2 END AS p FROM g),
t AS (SELECT p.*, p - floor(p) AS f, coalesce(a.x, 0) AS a, b.x AS b, c.x AS c, coalesce(d.x, 0) AS d FROM p LEFT JOIN sig a ON a.track_id = p.track_id AND a.frame = floor(p) - 1 JOIN sig b ON b.track_id = p.track_id AND b.frame = floor(p) JOIN sig c ON c.track_id = p.track_id AND c.frame = floor(p) + 1 LEFT JOIN sig d ON d.track_id = p.track_id AND d.frame = floor(p) + 2)
SELECT track_id, frame, {sr('b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - 0.5 * d + f * ((d - a) / 2 + 1.5 * (b - c))))', 'x')} FROM t""")
