"""Phrase collocation mining with count tries, merged by prefix range."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm import tries
from tessitura.llm.common import table, written

#: A phrase counts from this number of occurrences, and goes if COVER percent of them lie in one longer phrase.
LEAST, COVER = 30, 80
#: Phrases of each language.
TOP = 2000
#: Bytes of text that a task holds, places of a shard's trie, and leaves that a merging task reads.
SHARD_BYTES, SHARD_PLACES, RANGE_LEAVES = 16 << 20, 1 << 22, 1 << 21
#: Leaves that the driver sees for each range, to choose its bounds.
SEEN = 16
#: One leaf of so many goes into a shard's sample.
_GAP = 1 << 14

_TRIES = "lang string, places long, leaves long, sample array<array<binary>>, trie binary"


def shard_tries(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_places: int = SHARD_PLACES) -> DataFrame:
    """A written table of count tries, some for each task and language: lang, places (its words), leaves, sample of its leaves, trie."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flushed():
            for lang, texts in held.items():
                for trie, n in tries.built(b"\n".join(texts), shard_places):
                    leaves = len(trie.counts)
                    several = max(1, leaves // _GAP)
                    sample = [tries.leaf(trie, (2 * k + 1) * leaves // (2 * several)) for k in range(several)]
                    row = [pa.array([lang]), pa.array([n], pa.int64()), pa.array([leaves], pa.int64()), pa.array([sample], pa.list_(pa.list_(pa.binary())))]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([tries.dumped(trie)], pa.binary())], ["lang", "places", "leaves", "sample", "trie"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1])
                if size >= shard_bytes:
                    yield from flushed()
                    size = 0
        yield from flushed()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter(F.length("text") > 0)
    return written(rows.mapInArrow(run, _TRIES), "phrase-tries")


def _bounds(shards: DataFrame, range_leaves: int) -> list[tuple]:
    """Leaves (lang, then words) that cut all tries into ranges of about `range_leaves` leaves. They come from at most about SEEN leaves a
    range, and decide nothing but the tasks' sizes."""
    total, sampled = shards.agg(F.sum("leaves"), F.sum(F.size("sample"))).first()
    ranges = math.ceil((total or 0) / range_leaves)
    if ranges < 2:
        return []
    one = shards.select("lang", (F.col("leaves") / F.size("sample")).alias("weight"), F.explode("sample").alias("leaf"))
    rows = one.filter(F.rand(1) < SEEN * ranges / sampled).collect()
    found = sorted((r["lang"].encode(), *map(bytes, r["leaf"]), r["weight"]) for r in rows)
    step, passed, out = sum(r[-1] for r in found) / ranges, 0.0, []
    for r in found:
        passed += r[-1]
        if passed >= step * (len(out) + 1) and r[:-1] not in out[-1:]:
            out.append(r[:-1])
    return out


def _ranges(shards: DataFrame, bounds: list[tuple]) -> DataFrame:
    """The tries cut at the bounds: part, lang, trie."""

    def run(batches):
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie, code = tries.loaded(data.as_py()), lang.encode()
                first = sum(b[0] < code for b in bounds)
                own = [list(b[1:]) for b in bounds if b[0] == code]
                edges = [0, *tries.places(trie, own), len(trie.counts)]
                for k, (start, end) in enumerate(zip(edges, edges[1:])):
                    if start < end:
                        piece = tries.dumped(tries.cut(trie, start, end)) if own else data.as_py()
                        yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([lang]), pa.array([piece], pa.binary())], ["part", "lang", "trie"])

    return shards.select("lang", "trie").mapInArrow(run, "part long, lang string, trie binary")


def phrase_counts(shards: DataFrame, least: int = LEAST, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """A written table of all sequences of up to tries.DEPTH words with `least` occurrences: lang, phrase, words, f, and `walk`, the
    counts of its first 1, 2, ... words where the walk knew them."""

    def merge(group: pa.Table) -> pa.Table:
        rows = []
        langs = group.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            trie = tries.merged([tries.loaded(x.as_py()) for x, of in zip(group.column("trie"), langs) if of == lang])
            rows += [(lang, phrase, len(walk) + 1, f, walk, rim) for phrase, f, walk, rim in tries.walked(trie, least)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "phrase", "words", "f", "walk", "rim"])

    ranges = _ranges(shards, _bounds(shards, range_leaves))
    nodes = ranges.groupBy("part").applyInArrow(merge, "lang string, phrase string, words int, f long, walk array<long>, rim boolean")
    # only nodes on the rim of a range come more than once, and theirs are parts
    nodes = nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"), F.first("walk").alias("walk"))
    return written(nodes.filter(F.col("f") >= least), "phrase-nodes")


def phrases(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, shard_bytes: int = SHARD_BYTES, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """The `top` phrases of 2 to 4 words of each language, by how much rather their words stand together than apart.

    Each task counts the word sequences of its texts in tries of depth 4. The tries are stored sorted, cut at common bounds and merged, one range of
    prefixes a task; a hot first word is several ranges. The walk of a merged trie gives a node's count and those of its first words;
    nodes that reach over a range's rim are summed afterwards. What is left after the first words is the node behind the suffix
    links, found by a join of the frequent nodes: every part of a frequent phrase is frequent.

    All texts and all their words count. Null or empty text has no words; null lang is `und`; equal rows count each; ids are not read; a
    very long text is cut into several tries between words, with the words that follow looked ahead to; ties go by a, then by phrase; an empty table gives no rows; clashing
    extra columns are not read.
    """
    shards = shard_tries(docs, shard_bytes)
    nodes = phrase_counts(shards, least, range_leaves)
    word = F.split("phrase", " ")
    longer = nodes.filter("words > 1").withColumn("word", word)
    one = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    joined = lambda first, n: F.array_join(F.slice("word", first, n), " ")
    one = one.select(
        "lang", "phrase", "words", F.col("f").alias("a"), "k", F.get("walk", F.col("k") - 1).alias("l"),
        joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    own = nodes.select("lang", "phrase", "f")
    one = one.join(own.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    unknown = one.filter("l IS NULL").drop("l").join(own.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"])
    one = one.filter("l IS NOT NULL").unionByName(unknown)
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r) AS LONG)")
    best = one.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    inner = F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))
    inside = longer.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < cover * F.col("best.a"), F.lit(True)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("best.a"), "phrase"))
    ranked = best.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    total = shards.groupBy("lang").agg(F.sum("places").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r")], "n", "best.score")


def op13_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM documents
), runs AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words)
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS words FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS rest
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT f.lang, array_to_string(f.words[i : i + n - 1], ' ') AS phrase, max(f.f) AS longer
  FROM f, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS n) WHERE n < f.m AND i + n - 1 <= f.m GROUP BY 1, 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN held USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
