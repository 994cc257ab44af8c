"""Repair of conversation structure: fault flags by windows, the cheapest edits by a fold over a conversation's sorted turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import table

#: What edits cost; an undeleted truncated turn costs TRUNCATED besides.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A cost that no conversation reaches: the state cannot be entered.
NEVER = 1 << 40

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_FLAGS = ("blank", "duplicate", "truncated")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `there` of turns with the faults that their ids call for; a dropped turn stays with `there` false.

    crc32 of "conv_id:turn", modulo 20: 0 drops the turn, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 makes it the user's. A null counts as one space, in the key as in role and text; turn itself stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), (F.col("fault") == 3).alias("again"))
    return rows.withColumn("again", F.explode(F.when(F.col("again"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("again")


def _edit(state: Column, cost, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _start() -> Column:
    """The states before the first turn: nothing yet, behind `s`, behind `u`, behind a whole pair."""
    state = lambda cost, audit: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))
    return F.struct(state(0, "").alias("none"), state(NEVER, "").alias("s"), state(INSERT, "I").alias("u"), state(2 * INSERT, "II").alias("a"))


def _turn(held: Column, turn: Column) -> Column:
    """The states behind one more turn, insertions after it included. Of two ways of equal cost into one state neither is the
    beginning of the other, as an insertion costs, so that the lesser stays the lesser."""
    first = F.substring(turn["role"], 1, 1)
    stays = ~(turn["blank"] | turn["duplicate"])
    extra = F.when(turn["truncated"], TRUNCATED).otherwise(0)
    ready = F.least(held["none"], held["s"], held["a"])
    none = _edit(held["none"], DELETE, "D")
    s = F.least(_edit(held["s"], DELETE, "D"), F.when(stays & (first == "s"), _edit(held["none"], extra, "K")))
    u = F.least(_edit(held["u"], DELETE, "D"), F.when(stays & (first == "u"), _edit(ready, extra, "K")), F.when(stays, _edit(ready, extra + REROLE, "R")))
    a = F.least(_edit(held["a"], DELETE, "D"), F.when(stays & (first == "a"), _edit(held["u"], extra, "K")), F.when(stays, _edit(held["u"], extra + REROLE, "R")))
    u = F.least(u, *[_edit(x, INSERT, "I") for x in (none, s, a)])
    return F.struct(none.alias("none"), s.alias("s"), u.alias("u"), F.least(a, _edit(u, INSERT, "I")).alias("a"))


def _replayed(turns: Column, audit: Column) -> Column:
    """The turns that the letters of `audit` leave. Where a turn is given a role or put in, the state says which one."""
    start = F.struct(F.lit(0).alias("next"), F.lit(False).alias("open"), F.array().cast("array<struct<role:string,text:string>>").alias("kept"))

    def step(held: Column, letter: Column) -> Column:
        turn = F.get(turns, held["next"])
        named = F.when(letter == "K", turn["role"]).when(held["open"], "assistant").otherwise("user")
        text = F.when(letter == "I", "").otherwise(turn["text"])
        kept = F.when(letter == "D", held["kept"]).otherwise(F.concat(held["kept"], F.array(F.struct(named.alias("role"), text.alias("text")))))
        opened = F.when(letter == "D", held["open"]).when(letter == "K", F.substring(turn["role"], 1, 1) == "u").otherwise(~held["open"])
        return F.struct(F.when(letter == "I", held["next"]).otherwise(held["next"] + 1).alias("next"), opened.alias("open"), kept.alias("kept"))

    letters = F.filter(F.split(audit, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda held: held["kept"])


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text; a column `there`, if any, is false for turns that count as missing):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and `repaired`, an array of (role, text).

    Windows flag each turn's first fault: nothing but white space; role and text of an earlier turn; no full stop, exclamation or
    question mark at the end. A conversation's turns are then collected in order, and one aggregate() over them carries the
    cheapest (cost, audit) into each of four states; a second one replays the winner. Edits are K(eep), R(erole), D(elete) and I(nsert).

    Turns stand in the order of turn (nulls first), role, text, so that ties and repeated rows have one order. Null role or text counts as one
    space; an empty text is blank; a null conv_id is a conversation; one without turns costs nothing; roles other than those of the
    pattern are given one or deleted; an empty table gives no rows; clashing extra columns are not read. All is one shuffle by conv_id. A conversation's row
    holds its turns, as its audit and its repaired turns do: their number is that of one conversation, whatever the table's size.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), there.alias("there"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv_id", "there").orderBy(*order)
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("place")
    body = F.rtrim("text", F.lit(_SPACE))
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(within), F.substring("role", 1, 1))
    rows = rows.withColumn("place", F.row_number().over(within)).withColumns(
        {
            "blank": body == "",
            "duplicate": (body != "") & (F.row_number().over(same) > 1),
            "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
        }
    )
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.substring(body, -1, 1).isin(".", "!", "?"))
    count = lambda c: F.count(F.when(F.col("there") & F.col(c), 1)).alias(c)
    held = F.struct("place", "role", "text", *_FLAGS)
    found = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("there"), held))).alias("turns"),
        F.collect_set(F.when(F.col("there"), F.col("turn"))).alias("numbers"),
        *[count(c) for c in (*_FLAGS, "illegal")],
    )
    gaps = F.coalesce(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size("numbers"), F.lit(0)).cast("long")
    best = F.aggregate("turns", _start(), _turn, lambda held: F.least(held["none"], held["a"]))
    found = found.select("conv_id", gaps.alias("gaps"), *_FLAGS, "illegal", best.alias("best"), "turns")
    return found.select("conv_id", "gaps", *_FLAGS, "illegal", "best.cost", "best.audit", _replayed(F.col("turns"), F.col("best.audit")).alias("repaired"))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, turn (from 0), role, text."""
    return repair(turns).select("conv_id", F.posexplode("repaired").alias("turn", "one")).select("conv_id", F.col("turn").cast("long").alias("turn"), "one.role", "one.text")


def digest(repaired: DataFrame) -> DataFrame:
    """repaired with the SHA-256 of the lines `role:text` in place of the turns."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select(*[c for c in repaired.columns if c != "repaired"], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def op12_fold_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repair(damaged(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
  FROM conversations
), faulted AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(codes, lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault
  FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulted, (SELECT unnest([1, 2]) AS again) WHERE fault <> 0 AND (again = 1 OR fault = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
  FROM rows
), flagged AS (
  SELECT conv_id, turn, role, text, place, pair NOT IN ('su', 'ua', 'au') AS wrong, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND cut AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen FROM ordered)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS place, {c: 0::BIGINT, a: '', t: []::VARCHAR[]} AS n, {c: 1000000000::BIGINT, a: '', t: []::VARCHAR[]} AS s,
    {c: 2::BIGINT, a: 'I', t: ['user:']} AS u, {c: 4::BIGINT, a: 'II', t: ['user:', 'assistant:']} AS e
  FROM conversations
  UNION ALL
  SELECT conv_id, place, n, s, u, list_sort([e, {c: u.c + 2, a: u.a || 'I', t: list_append(u.t, 'assistant:')}])[1] AS e
  FROM (
    SELECT conv_id, place, n, s, e,
      list_sort([u] || [{c: x.c + 2, a: x.a || 'I', t: list_append(x.t, 'user:')} FOR x IN [n, s, e]])[1] AS u
    FROM (
      SELECT conv_id, place, {c: n.c + 3, a: n.a || 'D', t: n.t} AS n,
        list_sort([{c: s.c + 3, a: s.a || 'D', t: s.t}, {c: n.c + keep_as_s, a: n.a || 'K', t: list_append(n.t, line)}])[1] AS s,
        list_sort([{c: u.c + 3, a: u.a || 'D', t: u.t}, {c: ready.c + keep_as_u, a: ready.a || 'K', t: list_append(ready.t, line)},
          {c: ready.c + give, a: ready.a || 'R', t: list_append(ready.t, 'user:' || text)}])[1] AS u,
        list_sort([{c: e.c + 3, a: e.a || 'D', t: e.t}, {c: u.c + keep_as_a, a: u.a || 'K', t: list_append(u.t, line)},
          {c: u.c + give, a: u.a || 'R', t: list_append(u.t, 'assistant:' || text)}])[1] AS e
      FROM (
        SELECT w.conv_id, f.place, n, s, u, e, list_sort([n, s, e])[1] AS ready, f.text, f.role || ':' || f.text AS line,
          CASE WHEN blank OR duplicate THEN 1000000000 WHEN left(role, 1) = 's' THEN truncated::INT ELSE 1000000000 END AS keep_as_s,
          CASE WHEN blank OR duplicate THEN 1000000000 WHEN left(role, 1) = 'u' THEN truncated::INT ELSE 1000000000 END AS keep_as_u,
          CASE WHEN blank OR duplicate THEN 1000000000 WHEN left(role, 1) = 'a' THEN truncated::INT ELSE 1000000000 END AS keep_as_a,
          CASE WHEN blank OR duplicate THEN 1000000000 ELSE 2 + truncated::INT END AS give
        FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
      )
    )
  )
), last AS (
  SELECT conv_id, list_sort([n, e])[1] AS best FROM walk QUALIFY place = max(place) OVER (PARTITION BY conv_id)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM flagged GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM last l LEFT JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
