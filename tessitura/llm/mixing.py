"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import fresh, table, written

#: Weights of the sources in the order of their code points, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for a hundred words of the input, and how often a document may be taken.
PERCENT, MOST = 150, 2
#: Fractions of a copy, and the random offset, are whole numbers of this.
SCALE = 1 << 28
#: Steps of the size for a doubling; documents of one step stand in the order of a hash.
STEPS = 16
SEED = "mix"

_WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with each source's target and `offset`, its random start in units of 1/SCALE of a copy.

    A source is full if its share by weight passes `most` times its size. In the order of size by weight, full ones come first;
    the others share what those leave, so that no round of resharing is needed. One row a source is ranked here, and nothing else.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    n = len(weights)
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    sizes = sizes.withColumn("weight", reduce(lambda so_far, k: F.when(place == k, weights[k]).otherwise(so_far), range(n - 1), F.lit(weights[-1])))
    sizes = sizes.withColumn("total", total * percent / F.lit(100.0)).withColumn("limit", F.col("source_size") * most)
    ahead = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full, gone = F.coalesce(F.sum("limit").over(ahead), F.lit(0)), F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    level = (F.col("total") - full) / (F.sum("weight").over(Window.partitionBy()) - gone)  # words for a weight of 1, if all before are full
    sizes = sizes.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(shared * F.col("weight"), F.col("limit").cast("double")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 7), 16, 10).cast("long")
    return sizes.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def _planned(rows: DataFrame, ns: dict[str, str], weights, percent: int, most: int) -> DataFrame:
    """rows, which have the columns of `ns`, with the source's figures and the number of copies of each row."""
    rows = rows.withColumn(ns["step"], F.when(F.col(ns["size"]) > 0, F.floor(F.log2(ns["size"]) * STEPS)).otherwise(-1)).withColumn(
        ns["part"], F.substring(ns["tie"], 1, 2)
    )
    key = [ns["source"], ns["step"], ns["part"]]
    counts = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(ns["size"]).alias("words"))
    counts = written(counts.withColumnsRenamed({ns["source"]: "source", ns["step"]: "step", ns["part"]: "part"}), "mix-counts")
    sizes = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    ahead = lambda own, order: F.coalesce(F.sum("rows").over(Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy("source", "step").agg(F.sum("rows").alias("rows")).withColumn("before", ahead(["source"], "step"))
    steps = steps.alias("s").join(sizes.alias("z"), F.expr("s.source <=> z.source")).select("s.source", "step", "before", "source_size", "target", "offset")
    starts = counts.withColumn("start", ahead(["source", "step"], "part")).alias("c").join(steps.alias("s"), F.expr("c.source <=> s.source AND c.step = s.step"))
    starts = starts.select("c.source", "c.step", "part", (F.col("start") + F.col("before")).alias("start"), "source_size", "target", "offset")
    starts = starts.withColumnsRenamed({c: ns[c] for c in starts.columns})

    own = F.row_number().over(Window.partitionBy(*key).orderBy(ns["size"], ns["tie"])) - 1
    rows = rows.withColumn(ns["own"], own)
    met = reduce(lambda a, b: a & b, [F.col(f"rows.{k}").eqNullSafe(F.col(f"starts.{k}")) for k in key])
    out = rows.alias("rows").join(starts.alias("starts"), met).select("rows.*", *[f"starts.{ns[c]}" for c in ("start", "source_size", "target", "offset")])
    copies = F.when(F.col(ns["source_size"]) > 0, F.col(ns["target"]) / F.col(ns["source_size"])).otherwise(0.0)
    whole = F.floor(copies)
    part = F.round((copies - whole) * SCALE).cast("long")
    here = (F.col(ns["offset"]) + part * ((F.col(ns["start"]) + F.col(ns["own"])) % SCALE)) % SCALE  # the prefix sum, behind the last boundary
    return out.withColumn(ns["copies"], (whole + F.when(here + part >= SCALE, 1).otherwise(0)).cast("int"))


_NAMES = ("source", "size", "tie", "step", "part", "own", "start", "source_size", "target", "offset", "copies")


def mix_plan(docs: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST, keep: bool = False) -> DataFrame:
    """How often each row of docs is taken: doc_id, size, source_size, target, copies; with keep, all columns of docs and
    `copies` (a longer name where docs has that).

    Each source has an expected number of copies, target / source_size, between 0 and `most`. Its rows stand in the order of size
    (in STEPS steps for a doubling, then by a hash of doc_id): the running sum of expected copies starts at the source's offset, and a row
    is taken once for each whole number that its copies cross. Neighbours are of like size, so that the words taken stay near the target.

    A row's place is the number of rows in the steps and hash ranges before it, from tables of counts, and its rank within its own: no
    task orders a source. Sums of fractions are whole numbers modulo SCALE, exact at any length. The same rows give the same mix.

    Null text has size 0; a null source is the last source; rows of size 0 are taken, too, and add nothing; a source without words has
    a target of 0 and no copies. Equal rows are counted each for itself; equal or null doc_id tie, which only decides between them. An empty table
    gives no rows; clashing extra columns are not read.
    """
    if keep:
        ns = {}
        for c in _NAMES:
            ns[c] = fresh(c if c == "copies" else f"_{c}", [*docs.columns, *ns.values()])
        rows = docs
    else:
        ns = {c: c for c in _NAMES}
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    text, source = F.col("text"), F.col("source").cast("string")
    rows = rows.withColumn(ns["tie"], F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(ns["size"], _size(text)).withColumn(ns["source"], source)
    if keep:
        return _planned(rows, ns, weights, percent, most).select(*docs.columns, ns["copies"])
    rows = written(rows.drop("text"), "mix-rows")
    return _planned(rows, ns, weights, percent, most).select("doc_id", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs, each as often as mix_plan says."""
    planned = mix_plan(docs, weights, percent, most, keep=True)
    copies = planned.columns[-1]
    return planned.withColumn(copies, F.expr(f"explode(array_repeat(0, `{copies}`))")).select(*docs.columns)


def op11_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS tie FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source
), levels AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total,
    coalesce(sum(2 * source_size) OVER w, 0) AS full_words, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, (total - full_words) / weight_left AS level FROM levels
), goals AS (
  SELECT source, source_size,
    CASE WHEN cap <= level * weight THEN cap::DOUBLE
         ELSE least((SELECT min_by(level, place) FROM t WHERE cap > level * weight) * weight, cap::DOUBLE) END AS target,
    ('0x' || substr(md5('{SEED}' || coalesce('=' || source, '')), 1, 7))::BIGINT AS start
  FROM t
), ranked AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.start, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS copies,
    row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN floor(log2(size) * {STEPS}) ELSE -1 END, substr(tie, 1, 2), size, tie) - 1 AS k
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), stepped AS (
  SELECT *, round((copies - floor(copies)) * {SCALE})::HUGEINT AS part FROM ranked
)
SELECT doc_id, size, source_size, target,
  (size * (floor(copies)::BIGINT + (start + part * (k + 1)) // {SCALE} - (start + part * k) // {SCALE}))::BIGINT AS taken
FROM stepped
"""
