"""Tracks as coded files and back, held against what their coding does to numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.plans.helpers import EVENTS, r, sr
from tessitura.sources import adpcm, wav
from tessitura.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _files(spark, sf, **options):
    signal = T.event_signal(spark, sf).select("track_id", "frame", F.col("x").alias("l"), (F.col("x") / 2).alias("r"))
    return wav.rendered(signal, "track_id", 8000, **options)


def _decoded(files, block):
    return wav.as_signal(wav.decoded_contents(files, "track_id", block), "track_id").select("track_id", "frame", r("l"), r("r"))


def flac_decode(spark, sf):
    """Tracks as FLAC files, and back: nothing but the rounding to 16 bits is lost."""
    return _decoded(_files(spark, sf, form="flac"), 50)


QUERIES["flac_decode"] = flac_decode
_whole = "CAST(round({} * 32768) AS BIGINT)"
ORACLES["flac_decode"] = f"WITH {EVENTS} SELECT track_id, frame, {sr(_whole.format('x') + ' / 32768.0', 'l')}, {sr(_whole.format('x / 2') + ' / 32768.0', 'r')} FROM sig"

#: Bytes of a block of two channels, and its frames.
_ALIGN = 40
_EACH = adpcm.frames_of(adpcm.IMA, _ALIGN, 2)


def adpcm_decode(spark, sf):
    """Tracks as ADPCM files in blocks of 33 frames, and back, 20 frames at a time."""
    return _decoded(_files(spark, sf, form="adpcm", align=_ALIGN), 20)


QUERIES["adpcm_decode"] = adpcm_decode
ORACLES["adpcm_decode"] = f"""WITH RECURSIVE {EVENTS}, fixed AS (SELECT {adpcm.STEPS.tolist()} AS steps, {adpcm.MOVES.tolist()} AS moves),
whole AS (SELECT track_id, frame, unnest([0, 1]) AS side, unnest([{_whole.format('x')}, {_whole.format('x / 2')}]) AS q FROM sig),
rec AS (
  SELECT track_id, side, frame, q AS v, 0::BIGINT AS place FROM whole WHERE frame = 0
  UNION ALL
  SELECT track_id, side, frame, CASE WHEN frame % {_EACH} = 0 THEN q ELSE greatest(least(v + CASE WHEN q < v THEN -change ELSE change END, 32767), -32768) END,
    CASE WHEN frame % {_EACH} = 0 THEN place ELSE greatest(least(place + moves[four * 4 + two * 2 + one + 1], {len(adpcm.STEPS) - 1}), 0) END
  FROM (SELECT *, (step >> 3) + four * step + two * (step >> 1) + one * (step >> 2) AS change
    FROM (SELECT *, (far - four * step - two * (step >> 1) >= (step >> 2))::BIGINT AS one
      FROM (SELECT *, (far - four * step >= (step >> 1))::BIGINT AS two
        FROM (SELECT *, (far >= step)::BIGINT AS four
          FROM (SELECT w.track_id, w.side, w.frame, w.q, r.v, r.place, steps[r.place + 1] AS step, abs(w.q - r.v) AS far, moves
            FROM rec r JOIN whole w ON w.track_id = r.track_id AND w.side = r.side AND w.frame = r.frame + 1, fixed)))))
)
SELECT a.track_id, a.frame, {sr('a.v / 32768.0', 'l')}, {sr('b.v / 32768.0', 'r')} FROM rec a JOIN rec b ON b.track_id = a.track_id AND b.frame = a.frame AND a.side = 0 AND b.side = 1"""
