"""Every query with SQL gives the rows of its SQL."""

from __future__ import annotations

import pandas as pd
import pytest

from tessitura.plans import catalog
from tests.conftest import SF


def same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (df[columns].sort_values(columns).reset_index(drop=True) for df in (ours, theirs))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df())


def test_every_query_without_sql_is_tested_elsewhere():
    assert sorted(set(catalog.QUERIES) - set(catalog.ORACLES)) == ["fx_reverb"]
