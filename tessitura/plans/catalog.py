"""Every query of the signal part by name, with the SQL it is held against."""

from __future__ import annotations

from tessitura.plans import queries_basic, queries_files, queries_patches, queries_recursive, queries_time

QUERIES: dict = queries_basic.QUERIES | queries_time.QUERIES | queries_recursive.QUERIES | queries_files.QUERIES | queries_patches.QUERIES
ORACLES: dict[str, str] = queries_basic.ORACLES | queries_time.ORACLES | queries_recursive.ORACLES | queries_files.ORACLES | queries_patches.ORACLES
