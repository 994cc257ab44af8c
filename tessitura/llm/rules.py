"""Quality rules as a bitmask ledger: every rule is measured once, failures are bits, policies and ablations are bitwise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words as W
from tessitura.llm.common import table

#: Measurements of a text, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper_words")

#: Rules by bit: name and the SQL condition under which a text fails. A bit keeps its meaning in every policy version.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    ("few_letters", "2 * n_letter_words < n_words"),
    ("shouting", "10 * n_upper_words > 5 * n_words AND n_words >= 10"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a text is dropped if it fails any rule of the mask."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("2024-1", tuple(name for name, _ in RULES))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
# letters by the first byte of their code points: ASCII, and U+00C0 to U+1FFF and U+3000 to U+D7FF, which leaves out dashes, symbols and emoji
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if 0xC3 <= b <= 0xE1 or 0xE3 <= b <= 0xED or chr(b).isalpha() and b < 128]] = True


def _covered(flags: np.ndarray, n: int, length: int) -> np.ndarray:
    """Places within n of a flagged start."""
    turns = np.zeros(length + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(turns, at, 1)
    np.add.at(turns, at + n, -1)
    return np.cumsum(turns[:-1]) > 0


def _again(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, value): whether it occurs twice or more, and whether an equal one came before."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    repeated, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    repeated[order[1:]] = same
    later[order[1:]] = same
    repeated[order[:-1]] |= same
    return repeated, later


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a slice."""
    docs = len(offsets) - 1
    starts, ends, first = W.word_bounds(data, offsets)
    n_words = np.diff(first)
    per = lambda flags: np.add.reduceat(np.append(flags, 0), offsets[:-1]) * (np.diff(offsets) > 0)
    word_doc = np.repeat(np.arange(docs), n_words)
    by_word = lambda x: np.bincount(word_doc, x, docs).astype(np.int64)
    sums = lambda table: np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    code_points = ~W._SPACE[data] & ((data & 0xC0) != 0x80)

    hashes = W.word_hashes(data, starts, ends, False)
    five, whole = W.windows(hashes, first, 5)
    repeated = np.zeros(len(five), bool)
    repeated[whole] = _again(five[whole], word_doc[: len(five)][whole])[0]
    cover = _covered(repeated, 5, len(hashes))

    line_end = data == 10
    lines = per(line_end.astype(np.int64)) + 1
    breaks = np.union1d(np.flatnonzero(line_end) + 1, offsets[:-1])
    breaks = breaks[breaks < len(data)]
    stops = np.append(breaks[1:], len(data))
    stops = stops - ((stops > breaks) & line_end[np.maximum(stops - 1, 0)])
    with_word = np.searchsorted(starts, stops) > np.searchsorted(starts, breaks)
    breaks, stops = breaks[with_word], stops[with_word]
    line_hash = W.word_hashes(data, breaks, stops, False)
    line_doc = np.searchsorted(offsets, breaks, "right") - 1
    later = _again(line_hash, line_doc)[1]

    letters, uppers = sums(_LETTER), sums(_UPPER)
    upper = uppers[ends] - uppers[starts]
    return {
        "n_words": n_words,
        "word_chars": per(code_points.astype(np.int64)),
        "n_symbols": per(_SYMBOL[data].astype(np.int64)),
        "n_dup_lines": np.bincount(line_doc, later, docs).astype(np.int64),
        "n_repeat_words": by_word(cover),
        "n_lines": lines,
        "n_letter_words": by_word(letters[ends] > letters[starts]),
        "n_upper_words": by_word((upper > 1) & (2 * upper > ends - starts)),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """docs without text, with one long column per measure and `failed`, the bits of the rules that fail.

    Whole texts are measured in one map over batches; null text counts as empty and fails few_words. Rows with equal or null
    doc_id are measured each for itself; columns of docs with the names of measures or `failed` give way to the new ones; empty
    tables give none.
    """
    others = [c for c in docs.columns if c not in ("text", "failed", *MEASURES)]

    def run(batches):
        for batch in batches:
            got = [measure_slice(data, offsets) for _, data, offsets in W.string_slices(batch.column(0))]
            columns = [pa.array(np.concatenate([g[m] for g in got]) if got else np.zeros(0, np.int64), pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*others, *MEASURES])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    measured = docs.select("text", *others).mapInArrow(run, kept + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, fails) in enumerate(RULES)]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(found: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with `kept` under the policy; the texts are not read again."""
    return found.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(found: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_only: how many texts fail each rule of the policy, and how many that rule alone drops.

    One pass of sums over the failure bits, of a row per rule.
    """
    sums = []
    for k, (name, _) in enumerate(RULES):
        if name in policy.rules:
            mine = F.col("failed").bitwiseAND(F.lit(policy.mask))
            sums += [
                F.struct(
                    F.lit(name).alias("rule"),
                    F.coalesce(F.sum((mine.bitwiseAND(F.lit(1 << k)) != 0).cast("long")), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum((mine == 1 << k).cast("long")), F.lit(0)).alias("n_only"),
                )
            ]
    return found.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = apply_policy(ledger(docs), STANDARD)
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return judged.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "failed")


_RULES_SQL = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, sum(n - 1) AS dups FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id),
v AS (SELECT doc_id, p, array_to_string(ws[p:p+4], ' ') AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
c AS (SELECT doc_id, count(DISTINCT p + k.k) AS again FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM v), range(0, 5) k(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.again, 0) AS BIGINT) AS n_repeat_words,
    len(string_split(t, chr(10))) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\\x{{C0}}-\\x{{1FFF}}\\x{{3000}}-\\x{{D7FF}}]'))) AS n_letter_words,
    len(list_filter(ws, lambda x: len(regexp_extract_all(x, '[A-Z]')) > 1 AND 2 * len(regexp_extract_all(x, '[A-Z]')) > strlen(x))) AS n_upper_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  failed = 0 AS kept, failed FROM (SELECT *, CAST({_RULES_SQL} AS BIGINT) AS failed FROM m)
"""
