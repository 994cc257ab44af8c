"""What the query modules share: rounding alike in both engines, and the signal views as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of doubles depend on their order; results are compared to this many digits, a little off so that no decimal is a tie.
DIGITS, OFF = 7, 3.9e-9


def r(x: Column | str, name: str | None = None) -> Column:
    """Rounded alike in both engines."""
    out = F.round((F.col(x) if isinstance(x, str) else x) + F.lit(OFF), DIGITS)
    return out.alias(name or x) if name or isinstance(x, str) else out


def rounded(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + {OFF!r}, {DIGITS})"


def sr(x: str, name: str) -> str:
    return f"{rounded(x)} AS {name}"


EVENTS = "sig AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500.0 AS x FROM events)"
LOG = "log AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id AS seq, event_type AS type, value / 500.0 AS x FROM events)"
EMBED = "emb AS (SELECT vec_id AS track_id, label AS bus, CAST(t.i AS BIGINT) AS frame, CAST(embedding[CAST(2*t.i+1 AS INT)] AS DOUBLE) AS l, CAST(embedding[CAST(2*t.i+2 AS INT)] AS DOUBLE) AS r FROM embeddings, range(0, 32) t(i))"
FLAT = "flat AS (SELECT vec_id AS track_id, CAST(t.i AS INT) AS i, CAST(embedding[CAST(t.i+1 AS INT)] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(i))"
CUSTOMERS = "cust AS (SELECT CAST(c_nationkey AS BIGINT) AS track_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS frame, c_acctbal / 10000.0 AS x FROM customer)"


def db_to_linear(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'nan'::DOUBLE WHEN ({x}) = 0 THEN 1.0 WHEN ({x}) > -200 THEN exp(({x}) * ln(10.0) / 20) ELSE 0.0 END"


def linear_to_db(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR ({x}) < 0 THEN 'nan'::DOUBLE WHEN ({x}) = 1 THEN 0.0 WHEN ({x}) > 1e-12 THEN 20 * log10({x}) ELSE -200.0 END"
