"""Corpus operators: packing, sharding, language and quality models, deduplication, privacy, decontamination, scoring.

Nothing outside this subpackage imports it.
"""
