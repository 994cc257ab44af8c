"""Near duplicates by HyperMinHash: registers of leading zeros and mantissa bits, banded, estimated, then verified on full sets."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words as W
from tessitura.llm.common import fresh, table, written
from tessitura.llm.components import components

#: Registers (buckets of the hash), mantissa bits of a register, and registers of a band.
REGISTERS, MANTISSA, BAND = 128, 10, 4
BANDS = REGISTERS // BAND
_EMPTY = np.uint16(0xFFFF)
_BUCKET_BITS = REGISTERS.bit_length() - 1
#: A pair is verified unless its estimate is this many standard deviations under the threshold.
DEVIATIONS = 6.0
#: Rows that go are told by a hash; so many are broadcast at most, about 64 MB.
BROADCAST_ROWS = 1 << 21
#: Sets of up to so many shingles have too few registers to band: they are found by their shingles themselves.
SMALL = 32


def registers(hashes: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """docs x REGISTERS of uint16: the least hash of each bucket as its leading zeros and the bits behind the first one.

    hashes are distinct per owner and sorted by (owner, hash); the top bits choose the bucket, so that the first hash of a
    bucket is its least.
    """
    out = np.full((docs, REGISTERS), _EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        place = owner * REGISTERS + bucket
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        rest = ((hashes[first] << np.uint64(_BUCKET_BITS)) >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
        fraction, exponent = np.frexp(rest)
        zeros = np.where(rest > 0, 53 - exponent, 53).astype(np.int64)
        bits = np.where(rest > 0, np.floor((2 * fraction - 1) * (1 << MANTISSA)), 0).astype(np.int64)
        out.reshape(-1)[place[first]] = (zeros << MANTISSA | bits).astype(np.uint16)
    return out


@lru_cache(maxsize=1)
def _probes(rounds: int = 4096) -> np.ndarray:
    return np.random.default_rng(77).integers(0, REGISTERS, (rounds, REGISTERS))


def _filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take that of a bucket which a fixed random sequence of their own finds non-empty first, so that
    equal registers stay as likely as the sets are similar, for small sets too."""
    out = regs.copy()
    row, col = np.nonzero((regs == _EMPTY) & (regs != _EMPTY).any(1)[:, None])
    for probe in _probes():
        if not len(row):
            break
        got = regs[row, probe[col]]
        hit = got != _EMPTY
        out[row[hit], col[hit]] = got[hit]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """docs x BANDS of int64: one key for each band of filled registers."""
    own = _filled(regs).astype(np.uint64).reshape(len(regs), BANDS, BAND)
    keys = np.zeros((len(regs), BANDS), np.uint64)
    for k in range(BAND):
        keys += own[:, :, k] * W._PLACES[k]
    return W.mix(keys + W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def prefix_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The least shingles of a set, so many that sets as similar as `percent` must share one: |A n B| >= percent |A|."""
    n = len(hashes)
    return W.mix(np.sort(hashes)[: n - -(-percent * n // 100) + 1] ^ np.uint64(0x5EED)).view(np.int64)


def search_keys(hashes: np.ndarray, bounds: np.ndarray, regs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all sets, offsets): bands of registers; for sets of up to SMALL shingles, and larger ones that may be similar to
    those, a prefix of the shingles, which is exact; none for sets that can be similar to no other."""
    sizes, bands, parts = np.diff(bounds), band_keys(regs), []
    few = -(-percent // (100 - percent)) if percent < 100 else len(hashes) + 1
    for k, n in enumerate(sizes):
        own = [np.zeros(0, np.int64)]
        if few <= n <= SMALL * 100 // percent:
            own.append(prefix_keys(hashes[bounds[k] : bounds[k + 1]], percent))
        if n > SMALL:
            own.append(bands[k])
        parts.append(np.concatenate(own))
    return np.concatenate(parts or [np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)])


def _chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Buckets in which disjoint sets of n and m elements are expected to have equal registers."""
    level = 0.5 ** np.arange(54)[:, None]
    own = lambda k: np.exp(-k / REGISTERS * level / 2) - np.exp(-k / REGISTERS * level)
    return REGISTERS * (own(n) * own(m)).sum(0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of register rows, and the number of buckets they rest on."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    same = ((a == b) & (a != _EMPTY)).sum(1)
    return np.clip((same - _chance(n, m)) / np.maximum(used, 1), 0, 1), used


def _row() -> Column:
    """A row of the input: doc_id and text as one number."""
    return F.xxhash64("doc_id", "text")


def _sketch(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, data, offsets in W.string_slices(batch.column(2)):
                hashes, owner = W.text_shingles(data, offsets, shingle)
                n = len(offsets) - 1
                bounds = np.searchsorted(owner, np.arange(n + 1))
                regs = registers(hashes, owner, n)
                raw = hashes.tobytes()
                signs = [hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() if j > i else None for i, j in zip(bounds[:-1], bounds[1:])]
                keys, ends = search_keys(hashes, bounds, regs, percent)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.diff(bounds), pa.int64()), pa.array(signs, pa.binary()),
                     pa.array([r.tobytes() for r in regs], pa.binary()), lists],
                    ["row_hash", "doc_id", "n", "sign", "regs", "keys"],
                )

    rows = docs.select(_row().alias("row_hash"), "doc_id", "text")
    return rows.mapInArrow(run, "row_hash long, doc_id long, n long, sign binary, regs binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cls, hashes) for wanted(cls, row_hash, sign): the classes' whole shingle sets, computed again from the texts."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in W.string_slices(batch.column(2)):
                hashes, owner = W.text_shingles(data, offsets, shingle)
                n, raw = len(offsets) - 1, hashes.tobytes()
                bounds = 8 * np.searchsorted(owner, np.arange(n + 1))
                own = [raw[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
                right = [hashlib.blake2b(x, digest_size=16).digest() == s for x, s in zip(own, batch.column(1).slice(first, n).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(own, pa.binary())], ["cls", "hashes"]).filter(pa.array(right, pa.bool_()))

    rows = docs.select(_row().alias("row_hash"), "text").join(wanted, "row_hash")
    return rows.select("cls", "sign", "text").mapInArrow(run, "cls long, hashes binary")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose sizes allow the threshold and whose registers make it likely."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            j, used = estimate(a, b, n, m)
            t = percent / 100
            keep = j >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    side = lambda c, k: reps.select(F.col("cls").alias(c), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").filter(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    return both.select("a", "b", "n1", "n2", "r1", "r2").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with `shared`, the size of the intersection of their full sets, and whether they are `linked`:
    100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both), linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "shared", "linked"])

    side = lambda c, k: sets.select(F.col("cls").alias(c), F.col("hashes").alias(f"h{k}"))
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "h1", "h2").mapInArrow(run, "a long, b long, shared long, linked boolean")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """(cls, hash) for every shingle of sets(cls, hashes)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], ["cls", "own"])

    return sets.select("cls", "hashes").mapInArrow(run, "cls long, own array<long>").select("cls", F.explode("own").alias("hash"))


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """buckets(key, cls, pivot) that span components, with `own`, the class's component."""
    marked = buckets.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "pivot", F.coalesce("component", "cls").alias("own"))
    mixed = marked.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x < y").select("key")
    return marked.join(mixed, "key")


def _across(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), once each, of a bucket's classes in different components that can be linked.

    Two classes share at most the smaller number of their shingles that are `common`, that is not found in one class only. Of
    shingles that the bucket's pivot has they share at most the smaller number `held`, and of the others the smaller rest.
    """
    # sizes in steps of 100 / percent: similar sets are in the same step or the next one, which splits a bucket
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    apart = apart.withColumn("step", step)
    other = apart.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cls", "own", "n", "common", "held", "keys")], F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"))
    by_pivot = "least(held, held_b) + least(common - held, common_b - held_b)"
    most = f"least(common, common_b, coalesce({by_pivot}, common))"
    first = "element_at(array_intersect(keys, keys_b), 1) = key"  # a pair comes from the first bucket that it shares
    sizes = f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    pairs = apart.join(other, ["key", "step"]).filter(f"own < own_b AND {sizes} AND 100 * {most} >= {percent} * (n + n_b - {most}) AND {first}")
    return pairs.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_hash for every row of docs(doc_id, text).

    Equal shingle sets form classes. Classes are banded on compressed registers; every class of a bucket is held against the
    bucket's most central, then, where a bucket still spans components, against those classes of other components that bounds on
    their sizes and common shingles leave within reach. Pairs that pass the collision-corrected estimate are verified on full
    sets, and components follow from the links that remain. Thus copies, and groups of near copies, cost one row each and not
    their square. A pair at the threshold is missed by all bands with a probability of 5e-6. Sets of up to SMALL shingles
    would fill all registers from a few, and share bands by chance; they are found by a prefix of their shingles, exactly.

    Null text, and text without words, is empty and alone. A null doc_id takes part but is no component's id; component_id is
    null where only such rows are. Equal rows share a class; row_hash tells the rows of a repeated doc_id apart by their text. An
    empty table gives none; extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(_sketch(docs, shingle, percent).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = written(base.filter("sign IS NOT NULL").groupBy("sign").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least")), "classes")
    reps = base.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").withColumnRenamed("row", "cls")

    banded = reps.select("cls", F.explode("keys").alias("key"))
    shared = written(banded.join(banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"), "shared")
    # the class that meets most others stands in the middle of its group, and is the pivot of all its buckets
    met = shared.groupBy("cls").agg(F.sum("size").alias("met"))
    pivots = shared.join(met, "cls").groupBy("key").agg(F.max(F.struct("met", -F.col("cls"))).alias("p")).select("key", (-F.col("p.col2")).alias("pivot"))
    buckets = written(shared.join(pivots, "key").select("key", "cls", "pivot"), "buckets")
    members = buckets.select("cls").distinct()
    reps = written(reps.join(members, "cls", "left_semi"), "candidates")

    stars = buckets.filter("pivot <> cls").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
    stars = written(_likely(stars, reps, percent), "stars")
    sets = _sets(docs, reps.select("cls", "row_hash", "sign"), shingle)
    if not base.groupBy("row_hash").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["cls"])  # of rows that are there more than once
    sets = written(sets, "sets")
    seen = written(_verified(stars, sets, percent), "verified")
    links = seen.filter("linked").select("a", "b")
    found = components(links)

    # what the pivots left apart
    mixed = written(_mixed(buckets, found), "mixed")
    alone = _shingle_rows(sets.join(mixed.select("cls").distinct(), "cls", "left_semi"))
    alone = alone.groupBy("hash").agg(F.min("cls").alias("cls"), F.count("*").alias("rows")).filter("rows = 1").groupBy("cls").agg(F.count("*").alias("alone"))
    sized = reps.select("cls", "n", "keys").join(alone, "cls", "left").select("cls", "n", "keys", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    ends = [F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")]
    apart = mixed.join(sized.filter(f"100 * common >= {percent} * n"), "cls").select("*", *ends).join(seen.select("a", "b", "shared"), ["a", "b"], "left")
    held = F.when(F.col("cls") == F.col("pivot"), F.col("n")).otherwise(F.col("shared"))
    apart = written(apart.select("key", "cls", "own", "n", "common", held.alias("held"), "keys"), "apart")
    close = _across(apart, percent).join(stars, ["a", "b"], "left_anti")
    more = written(_verified(_likely(close, reps, percent), sets, percent).filter("linked").select("a", "b"), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    placed = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = found.select(F.col("node").alias("cls"), "component").join(classes.select("cls", "least"), "cls")
    heads = heads.groupBy("component").agg(F.min("least").alias("head"))
    placed = placed.join(heads, "component", "left").select("sign", F.coalesce("head", "least").alias("component_id"))
    out = base.select("doc_id", "n", "sign", "row_hash").join(placed, "sign", "left")
    own = F.when(F.col("sign").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "row_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the smallest doc_id. Rows are judged one by one: of a doc_id
    that is there with different texts, each text stays or goes as its own group says; of rows of one group with the same id, or
    equal rows, one stays. Rows with a null doc_id stay where nothing with an id is in their group; texts without words are
    groups of their own.

    The rows that go are told by a hash: up to BROADCAST_ROWS of them are broadcast, so that no text is shuffled; beyond that
    the same join shuffles.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = written(near_duplicates(plain, percent, shingle), "near")
    stay = near.filter("kept AND doc_id IS NOT NULL")
    first = stay.groupBy("component_id").agg(F.min("row_hash").alias("first"), F.max("row_hash").alias("last"), F.count("*").alias("rows")).filter("rows > 1")
    first = written(first, "repeated")
    more = stay.join(first.filter("first < last"), "component_id").filter("row_hash > first").select("row_hash")
    gone = written(near.filter("NOT kept").select("row_hash").unionAll(more).distinct(), "gone")
    name = fresh("row", docs.columns)
    gone, size = gone.withColumnRenamed("row_hash", name), gone.count()
    marked = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    out = marked.join(F.broadcast(gone) if size <= BROADCAST_ROWS else gone, name, "left_anti")
    if not first.isEmpty():  # equal rows
        twice = near.join(first.select(F.col("first").alias("row_hash")), "row_hash", "left_semi").filter("doc_id IS NOT NULL").groupBy("row_hash").count().filter("count > 1")
        twice = written(twice.select(F.col("row_hash").alias(name)), "twice")
        out = out.join(twice, name, "left_anti").unionByName(out.join(twice, name, "left_semi").dropDuplicates([name]))
    return out.select(docs.columns)


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_hash")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
