"""User synth graphs: voices of a patch, moving pitches, and patches as sources."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessitura.operators import mixing as M
from tessitura.operators import patches as P
from tessitura.plans.helpers import r, sr
from tessitura.plans.queries_time import _E, _ENV, _NOTES, _notes, _pitches, _PITCHES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATE = 100.0


def _played(spark, sf):
    """Ended notes with a pitch, a volume, a place and a parameter that every third of them leaves at its default."""
    id = F.col("note_id")
    bright = F.when(id % 3 != 0, id % 7 / 6.0)
    return _notes(spark, sf).filter("off_frame > on_frame").select("*", (3.0 + id % 12).alias("hz"), (0.25 + id % 4 / 8.0).alias("volume"), ((id % 5 - 2) / 2.0).alias("pan"), bright.alias("p_bright"))


def _voices(ring: int) -> str:
    """The same as SQL: a voice's frames until its release and `ring` frames more, with g, the level of its envelope."""
    return (
        f"{_NOTES}, t AS (SELECT *, 3.0 + note_id % 12 AS hz, 0.25 + note_id % 4 / 8.0 AS volume, (note_id % 5 - 2) / 2.0 AS pan, CASE WHEN note_id % 3 <> 0 THEN note_id % 7 / 6.0 ELSE 0.5 END AS bright,"
        f" off_frame - on_frame AS off, unnest(range(0, off_frame - on_frame + 5 + {ring})) AS t FROM notes WHERE off_frame > on_frame),"
        f" e0 AS (SELECT *, CASE WHEN t < off THEN {_E.format(n='t')} ELSE ({_E.format(n='(off - 1)')}) * (1 - (t - off + 1) / 5.0) END AS e FROM t),"
        " e1 AS (SELECT *, CASE WHEN t >= off AND e <= 0.001 THEN 0 ELSE e END AS g FROM e0)"
    )


_SIDES = f"SELECT track_id, on_frame + t AS frame, {sr('sum(x * sqrt(1 - pan))', 'l')}, {sr('sum(x * sqrt(1 + pan))', 'r')} FROM {{}} GROUP BY track_id, on_frame + t"


def _mixed(out):
    return M.mixdown(out, ["track_id", "frame"], ["l", "r"]).select("track_id", "frame", r("l"), r("r"))


# --- two oscillators under an envelope, which also opens the filter behind them ---------------------------------------


def subtractive() -> P.Patch:
    envelope = P.Envelope(**_ENV)
    sound = (P.Osc("saw") * 0.5 + P.Osc("sine", P.Pitch() * 1.5) * 0.25) * envelope * P.Velocity()
    cutoff = envelope * 12.0 + P.Param("bright", 0.5) * 20.0 + P.Lfo(3.0, "triangle") * 2.0 + 4.0
    return P.Patch(P.Drive(P.Filter(sound, "lowpass", cutoff, 0.5, lowest=5.0) * 2.0))


def patch_voices(spark, sf):
    return _mixed(P.patched(_played(spark, sf), subtractive(), RATE, "track_id", 100))


# damping at a resonance of 0.5, and the frames in which the lowest filter falls to a millionth
_K = 1.03
_RING = math.ceil(1.2 * math.log(1e6) * 100 / (math.pi * _K * 5))
_LFO = "CASE WHEN p < 0.25 THEN 4 * p WHEN p < 0.75 THEN 2 - 4 * p ELSE 4 * p - 4 END"
QUERIES["patch_voices"] = patch_voices
ORACLES["patch_voices"] = f"""WITH RECURSIVE {_voices(_RING)}, d AS (SELECT *, fmod(t * 3.0 / 100, 1.0) AS p FROM e1),
f AS (SELECT track_id, note_id, t, on_frame, pan, (0.5 * (2 * fmod(t * hz / 100.0, 1.0) - 1) + 0.25 * sin(2 * pi() * fmod(t * hz * 1.5 / 100.0, 1.0))) * g * volume AS x,
 tan(pi() * least(greatest(12 * g + 20 * bright + 2 * ({_LFO}) + 4, 5), 49) / 100) AS w FROM d),
rec AS (SELECT track_id, note_id, CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS on_frame, CAST(0 AS DOUBLE) AS pan, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS y FROM f WHERE t = 0
UNION ALL SELECT track_id, note_id, t, on_frame, pan, 2 * v1 - s1, 2 * v2 - s2, v2 FROM (SELECT *, s2 + w * v1 AS v2 FROM (
 SELECT f.*, s1, s2, (s1 + w * (x - s2)) / (1 + w * (w + {_K})) AS v1 FROM rec JOIN f ON f.track_id = rec.track_id AND f.note_id = rec.note_id AND f.t = rec.t + 1))),
y AS (SELECT track_id, t, on_frame, pan, tanh(2 * y) AS x FROM rec WHERE t >= 0)
{_SIDES.format('y')}"""


# --- a pitch that another oscillator moves: the phase is a running sum --------------------------------------------------


def moving_pitch() -> P.Patch:
    tone = P.Osc("sine", P.Pitch() + P.Osc("triangle", P.Pitch() * 0.5) * 4.0) * P.Envelope(**_ENV)
    return P.Patch(tone * P.Velocity(), tone * P.Gate())


def patch_moving_pitch(spark, sf):
    return _mixed(P.patched(_played(spark, sf), moving_pitch(), RATE, "track_id", 100))


QUERIES["patch_moving_pitch"] = patch_moving_pitch
ORACLES["patch_moving_pitch"] = f"""WITH {_voices(0)}, p AS (SELECT *, hz + 4 * (1 - 4 * abs(fmod(fmod(t * hz * 0.5 / 100.0, 1.0) + 0.25, 1.0) - 0.5)) AS pace FROM e1),
s AS (SELECT *, coalesce(sum(pace / 100.0) OVER (PARTITION BY track_id, note_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turns FROM p),
x AS (SELECT *, sin(2 * pi() * (turns - floor(turns))) * g AS x FROM s)
SELECT track_id, on_frame + t AS frame, {sr('sum(x * volume)', 'l')}, {sr('sum(CASE WHEN t < off THEN x ELSE 0 END)', 'r')} FROM x GROUP BY track_id, on_frame + t"""


# --- a patch as a source: it decays to nothing, and ends when it has been silent for a while --------------------------


def patch_source(spark, sf):
    """A struck tone for each supplier, loud for longer or shorter."""
    patch = P.Patch(P.Osc("sine") * P.Envelope(0.0, 0.05, 0.2, 0.0, 0.0) * P.Param("level", 1.0, 0.0, 2.0))
    tracks = _pitches(spark, sf).withColumn("p_level", F.col("track_id") % 3 * 0.75)
    return P.patch_source(tracks, patch, RATE, "track_id", 64, hush=0.2).select("track_id", "frame", r("l"), r("r"))


QUERIES["patch_source"] = patch_source
ORACLES["patch_source"] = f"""WITH s AS ({_PITCHES}), x AS (SELECT track_id, frame, sin(2 * pi() * fmod(frame * hz / 100.0, 1.0)) * (track_id % 3 * 0.75)
 * CASE WHEN frame + 1 <= 5 THEN 1 ELSE 1 - least(greatest((frame + 1 - 5) / 20.0, 0), 1) END AS x FROM s),
q AS (SELECT *, max(CASE WHEN abs(x) >= 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS loud FROM x),
e AS (SELECT *, min(CASE WHEN loud = 0 AND frame >= 19 THEN frame END) OVER (PARTITION BY track_id) AS ends FROM q)
SELECT track_id, frame, {sr('x', 'l')}, {sr('x', 'r')} FROM e WHERE ends IS NULL OR frame <= ends"""
