"""Control events within a stream: the sound of the batch kernel, however the stream is cut."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from tessitura.operators import kernels as K
from tessitura.streaming import live

RATE = 1000.0
START = {"cutoff": 200.0}
EVENTS = [(30, 1, "cutoff", 20.0), (30, 0, "cutoff", 450.0), (47, 2, "cutoff", 90.0), (70, 3, K.RESET, 0.0), (500, 4, "cutoff", 1.0)]


def make(cutoff):
    return K.filtered(RATE, "lowpass", cutoff)


def batch(x, events, inertia):
    changes = [(f, n, v) for f, _, n, v in sorted(events)]
    return K.run(K.automated(make, START, changes, inertia, RATE), x[:, None, None])[0][:, 0, 0]


def streamed(spark, folder, blocks, name, **more) -> pd.DataFrame:
    """Blocks of (frames' rows, events' rows), one trigger each, given in their order; an empty one waits for keys to time out."""
    given = 0

    def settle():
        if "idle" not in more:
            return q.processAllAvailable()
        end = time.time() + 40  # with timers, batches never cease
        while spark.table(name).filter("what = 'sound'").count() < given and time.time() < end:
            time.sleep(0.2)

    for kind in ("s", "e"):
        (folder / kind).mkdir()
    samples = spark.readStream.schema("track_id long, frame long, x double").parquet(str(folder / "s"))
    events = spark.readStream.schema("track_id long, frame long, seq long, name string, value double").parquet(str(folder / "e"))
    out = live.controlled(samples, events, "track_id", make, START, ["x"], RATE, **more)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for k, (rows, log) in enumerate(blocks):
            if k and not rows and not log:
                time.sleep(1.5 * more["idle"])
                continue
            if log:
                pd.DataFrame(log, columns=["track_id", "frame", "seq", "name", "value"]).astype({"value": float}).to_parquet(folder / f"{k}.parquet")
                (folder / f"{k}.parquet").rename(folder / "e" / f"{k}.parquet")
            if log and rows:  # events reach the state no later than the frames of their block
                settle()
            if rows:
                given += len(rows)
                pd.DataFrame(rows, columns=["track_id", "frame", "x"]).sample(frac=1, random_state=k).to_parquet(folder / f"{k}.parquet")
                (folder / f"{k}.parquet").rename(folder / "s" / f"{k}.parquet")
            settle()
    finally:
        q.stop()
    return spark.table(name).toPandas().sort_values(["track_id", "frame"]).reset_index(drop=True)


@pytest.mark.parametrize("n,cuts,inertia", [(0, [100], 0.0), (1, [29, 30, 31, 60, 100], 0.0), (2, [13, 48, 71, 100], 0.02)])
def test_any_cut_sounds_like_the_batch(spark, tmp_path, n, cuts, inertia):
    x = np.random.default_rng(3).normal(0, 1, 100)
    blocks, first = [], 0
    for c in cuts:
        log = [(7, *e) for e in EVENTS if first <= e[0] < c] + ([(7, *EVENTS[-1])] if first == 0 else [])
        blocks.append(([(7, f, x[f]) for f in range(first, c)] + [(8, f, -x[f]) for f in range(first, c)], log))
        first = c
    got = streamed(spark, tmp_path, blocks, f"cut{n}", inertia=inertia)
    sound = got[got["what"] == "sound"]
    assert not sound["late"].any()
    assert np.allclose(sound[sound["track_id"] == 7]["x"], batch(x, EVENTS, inertia), atol=1e-12)
    assert np.allclose(sound[sound["track_id"] == 8]["x"], batch(-x, [], 0.0), atol=1e-12)


def test_a_late_event_takes_effect_at_its_block_and_an_early_one_waits(spark, tmp_path):
    x = np.random.default_rng(4).normal(0, 1, 60)
    rows = lambda a, b: [(7, f, x[f]) for f in range(a, b)]
    blocks = [(rows(0, 20), [(7, 45, 0, "cutoff", 300.0)]), (rows(20, 40), [(7, 5, 1, "cutoff", 30.0)]), (rows(40, 60), [])]
    got = streamed(spark, tmp_path, blocks, "timely")
    want = batch(x, [(20, 0, "cutoff", 30.0), (45, 1, "cutoff", 300.0)], 0.0)
    assert np.allclose(got[got["what"] == "sound"]["x"], want, atol=1e-12)


def test_positions_silence_and_the_end_of_a_track(spark, tmp_path):
    rows = lambda a, b, v, key=7: [(key, f, v) for f in range(a, b)]
    loud = rows(0, 30, 1.0) + rows(30, 40, 0.0)
    blocks = [(loud, [(7, 30, 0, K.RESET, 0.0)]), (rows(40, 70, 0.0) + rows(5, 6, 9.0), []), (rows(70, 72, 1.0) + rows(72, 100, 0.0), [(7, 72, 1, K.RESET, 0.0)]), ([], []), (rows(0, 1, 1.0, 9), []), (rows(0, 2, 1.0), [])]
    got = streamed(spark, tmp_path, blocks, "statuses", every=25, hush=0.02, idle=6.0)
    own = got[got["track_id"] == 7]
    at = {w: sorted(own[own["what"] == w]["frame"]) for w in ("position", "silent", "stopped")}
    assert at == {"position": [0, 0, 25, 50, 75], "silent": [49, 91], "stopped": [100]}
    late = own[own["late"]]
    assert late[["frame", "x"]].values.tolist() == [[5, 9.0]]
