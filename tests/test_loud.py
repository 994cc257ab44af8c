"""Queries over events whose values pass full scale, as larger tables have them, against their SQL."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pytest

from tessitura.plans import catalog
from tessitura.sources import adpcm, flac, wav
from tests.test_catalog import same

VALUES = (0.0, 125.0, 350.0, 499.99, 500.0, 500.01, 560.21, 583.4, 640.0, 700.0, 851.0, 999.5, 1501.0, 40.0, 3.3)


@pytest.fixture(scope="module")
def loud(spark, tmp_path_factory):
    """Two tracks of 150 events; every value comes at every place of a block of 33 frames."""
    path, start = str(tmp_path_factory.mktemp("loud")), datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=k), k % 2, "view", VALUES[k // 2 * (1 + k % 2) % len(VALUES)], None) for k in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY events TO '{path}/events.parquet'")
    return path, con


def check(spark, loud, name):
    path, con = loud
    same(catalog.QUERIES[name](spark, path).toPandas(), con.sql(catalog.ORACLES[name]).df())


def test_pan_law(spark, loud):
    check(spark, loud, "pan_law")


def test_oscillators(spark, loud):
    check(spark, loud, "oscillators")


def test_normalised_values(spark, loud):
    check(spark, loud, "normalised_values")


def test_flac_decode(spark, loud):
    check(spark, loud, "flac_decode")


@pytest.mark.parametrize("most, bits", [(32767, 16), (32768, 24), (1 << 23, 32)])
def test_flac_has_room_where_it_is_needed(most, bits):
    x = np.array([[most, 0], [-32768, 5], [7, -most]])
    got, about = wav.samples(flac.encoded_loud(x, 8000))
    assert about["bits"] == bits and (got * 32768 == x).all()


def test_adpcm_decode(spark, loud):
    check(spark, loud, "adpcm_decode")


def test_adpcm_reads_loud_heads_from_any_place_on():
    x = np.zeros((100, 2), np.int64)
    x[33], x[66, 1] = (40000, -50000), 33000
    data = adpcm.ima_encoded(x, 8000, 40)
    got, about = wav.samples(data)
    assert (got[33] * 32768 == x[33]).all() and got[66, 1] * 32768 == 33000
    for first in range(100):
        assert (wav.stretch(lambda at, n: data[at : at + n], about, first, 20) == got[first : first + 20]).all()
    quiet = np.clip(x, -32768, 32767)
    assert b"loud" not in adpcm.ima_encoded(quiet, 8000, 40)
