"""Sharding by a k-d tree: leaves of near-equal bytes, cut at weighted medians that are found with distributed histograms."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import partitions, table, written

#: Bytes that each row counts besides its text.
ROW_BYTES = 16
#: A group of equal texts over this part of a shard's bytes is placed on the driver; there are PIECE x shards of them at most.
PIECE = 32
#: Only a group over a whole shard is dealt out, in pieces of about this part of a shard.
DEALT = 64
#: A cut is searched until it is known to this part of a shard's bytes, or falls between two neighbouring points.
TOLERANCE = 512
#: Sums that a round of the search brings to the driver, and the least of them for one node.
BINS, LEAST_BINS = 16384, 1024
GRID, TIES = 1 << 20, 1 << 31
DIMENSIONS = ("log_size", "doc", "lang", "source")
_NEVER = 1 << 62


@dataclass
class Group:
    """Equal texts that weigh much, or a piece of them."""

    text_hash: int
    size: int
    piece: int
    weight: int
    at: list[int]
    tie: int
    node: int = 0
    right: bool = False


@dataclass
class Node:
    leaves: int
    dim: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    goal: float = 0.0
    cut: int = _NEVER
    first: int = 0
    open: bool = False
    groups: list[Group] = field(default_factory=list)

    def width(self, bins: int) -> int:
        return max(1, -(-(self.high - self.low) // bins))


def _of_node(values) -> Column:
    """The entry of `values` (a whole number for each node) for the row's node, as a literal: no join."""
    return F.expr(f"element_at(array({', '.join(f'{int(v)}L' for v in values)}), node + 1)")


def _key(dim: Column) -> Column:
    """A point's place along a dimension; equal places are told apart by a hash."""
    return F.element_at("at", dim.cast("int") + 1) * TIES + F.col("tie")


def _steps(groups: DataFrame) -> Column:
    """Coordinates on a grid of GRID steps between each dimension's least and greatest value."""
    ends = groups.agg(*[f(d).cast("double").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("a", F.min), ("z", F.max))]).first()

    def step(d):
        low, high = ends[f"a_{d}"] or 0.0, ends[f"z_{d}"] or 0.0
        return F.least(F.lit(GRID - 1), F.floor((F.col(d).cast("double") - low) * (GRID - 1) / max(high - low, 1e-9))).cast("long")

    return F.array(*[step(d) for d in DIMENSIONS])


def _sides(node: Node, bins: list[tuple[int, int, int, int]], width: int) -> int:
    """Sets each large group's side, by where the median of all weight falls; returns what is on the left."""
    own = sorted((g.at[node.dim] * TIES + g.tie, g.weight, k) for k, g in enumerate(node.groups))
    below, left, at = 0, 0, 0
    for key, weight, k in own:
        while at < len(bins) and node.low + (bins[at][0] + 1) * width <= key:
            below += bins[at][1]
            at += 1
        node.groups[k].right = below + left + weight / 2 > node.goal
        left += 0 if node.groups[k].right else weight
    return left


def _search(points: DataFrame, nodes: list[Node], tolerance: float) -> None:
    """Sets `cut` of each node that splits, narrowing [low, high) by one histogram of all open nodes a round. Large groups choose
    their sides in the first round; the cut of the others makes up for what that leaves uneven."""
    fresh = True
    while any(n.open for n in nodes):
        bins = max(LEAST_BINS, BINS // sum(n.open for n in nodes))
        seen = points.withColumn("key", _key(_of_node(n.dim for n in nodes)))
        low, high = (_of_node(getattr(n, f) if n.open else 0 for n in nodes) for f in ("low", "high"))
        rows = (
            seen.filter((F.col("key") >= low) & (F.col("key") < high))
            .withColumn("low", low).withColumn("width", _of_node(n.width(bins) for n in nodes))
            .groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("weight").alias("w"), F.min("key").alias("a"), F.max("key").alias("z"))
            .collect()
        )
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for r in rows:
            found.setdefault(r["node"], []).append((r["bin"], r["w"], r["a"], r["z"] + 1))
        for k, n in enumerate(nodes):
            if not n.open:
                continue
            mine, width = sorted(found.get(k, [])), n.width(bins)
            if fresh:
                n.goal = min(max(0.0, n.goal - _sides(n, mine, width)), sum(b[1] for b in mine))
            if not mine:
                n.cut, n.open = n.low, False
                continue
            below = n.before
            for _, w, first, last in mine:
                if below + w >= n.goal:
                    break
                below += w
            if w <= tolerance or last - first == 1:
                n.cut = first if n.goal - below < below + w - n.goal else last
                n.open = False
            else:
                n.low, n.high, n.before = first, last, below
        fresh = False


def _split(points: DataFrame, groups: list[Group], shards: int, tolerance: float) -> DataFrame:
    """points with their leaf as `node`; the leaves of `groups` are set in place. Every level is written, so that no plan grows."""
    nodes = [Node(shards)]
    while any(n.leaves > 1 for n in nodes):
        for n in nodes:
            n.groups = []
        for g in groups:
            nodes[g.node].groups.append(g)
        ends = [f(F.col("at")[d]).alias(f"{n}{d}") for d in range(len(DIMENSIONS)) for n, f in (("a", F.min), ("z", F.max))]
        found = {r["node"]: r for r in points.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        for k, n in enumerate(nodes):
            r = found.get(k)
            if n.leaves == 1 or not (r or n.groups):
                continue
            sides = [
                ([r[f"a{d}"], r[f"z{d}"]] if r else []) + [g.at[d] for g in n.groups]
                for d in range(len(DIMENSIONS))
            ]
            n.dim = max(range(len(sides)), key=lambda d: max(sides[d]) - min(sides[d]))
            n.low, n.high = min(sides[n.dim]) * TIES, (max(sides[n.dim]) + 1) * TIES
            n.goal = ((r["w"] if r else 0) + sum(g.weight for g in n.groups)) * (n.leaves // 2) / n.leaves
            n.open = True
        _search(points, nodes, tolerance)
        children = []
        for n in nodes:
            n.first = len(children)
            children += [Node(n.leaves // 2), Node(n.leaves - n.leaves // 2)] if n.leaves > 1 else [Node(1)]
        right = _key(_of_node(n.dim for n in nodes)) >= _of_node(n.cut for n in nodes)
        child = (_of_node(n.first for n in nodes) + right.cast("long")).cast("int")
        points = written(points.withColumn("node", child), "kd-level")
        for g in groups:
            g.node = nodes[g.node].first + (g.right and nodes[g.node].leaves > 1)
            g.right = False
        nodes = children
    return points


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(GRID)), F.lit(-1)) if c in docs.columns else F.lit(0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        code("lang").cast("long").alias("lang"),
        code("source").cast("long").alias("source"),
        F.monotonically_increasing_id().alias("row"),
    )


def _points(rows: DataFrame) -> DataFrame:
    """One row for equal texts: their weight, and the coordinates and tie of the k-d tree."""
    groups = rows.groupBy("text_hash", "size").agg(
        F.sum("size").alias("weight"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc"), F.min("lang").alias("lang"), F.min("source").alias("source")
    )
    groups = written(groups.withColumn("log_size", F.log2("size")), "kd-groups")
    tie = F.pmod(F.xxhash64("text_hash", "size"), F.lit(TIES)).alias("tie")
    return groups.select("text_hash", "size", "weight", _steps(groups).alias("at"), tie)


def _large(points: DataFrame, rows: DataFrame, share: int) -> tuple[list[Group], list[tuple[int, int, int]]]:
    """Groups over share / PIECE bytes, with those over a whole share in pieces; and (text_hash, size, pieces) of each."""
    heavy = points.filter(F.col("weight") > share / PIECE).collect()
    pieces = [(r["text_hash"], r["size"], math.ceil(r["weight"] * DEALT / share) if r["weight"] > share else 1) for r in heavy]
    several = [p for p in pieces if p[2] > 1]
    weights = {(h, s, 0): r["weight"] for r, (h, s, n) in zip(heavy, pieces) if n == 1}
    if several:
        dealt = _dealt(rows, several).filter("piece IS NOT NULL")
        weights |= {tuple(r[:3]): r[3] for r in dealt.groupBy("text_hash", "size", "piece").agg(F.sum("size")).collect()}
    own = {(r["text_hash"], r["size"]): r for r in heavy}
    groups = [Group(h, s, k, w, list(own[h, s]["at"]), (own[h, s]["tie"] + k) % TIES) for (h, s, k), w in sorted(weights.items())]
    return groups, pieces


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of whole numbers, for a broadcast."""
    listed = ", ".join("(" + ", ".join(f"{int(v)}L" if v >= -(2**63) + 1 else "CAST('-9223372036854775808' AS BIGINT)" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def _dealt(rows: DataFrame, pieces: list[tuple[int, int, int]]) -> DataFrame:
    """rows with the piece of a large group that they are in; null for all others. At most PIECE x shards rows are broadcast."""
    if not pieces:
        return rows.withColumn("piece", F.lit(None).cast("long"))
    known = F.broadcast(_values(rows.sparkSession, pieces, "text_hash, size, pieces"))
    return rows.join(known, ["text_hash", "size"], "left").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces"))).drop("pieces")


def kd_shards(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs; shards have near-equal bytes.

    A k-d tree over the metadata (log of size, doc_id, lang, source, each scaled to its range) splits every node at the
    weighted median of its widest dimension, in proportion to the leaves on either side, until `shards` leaves are left, or
    leaves of about `target_bytes`; a cut is exact to 1/tolerance of a shard. Equal texts are one point and stay together;
    only a group that is larger than a whole shard is dealt out, in pieces. A group over 1/PIECE of a shard takes the side
    of the median that it lies on, and the cut of the other points makes up for it. Null text counts as empty, null
    metadata as the least value; rows with equal or null doc_id are placed each for itself, with ties of metadata told
    apart by a hash of the text; an empty table gives no rows. Clashing extra columns are not read.

    Shuffles: one of the metadata by text, one join back on it, one for slots; a level reads the points three or four
    times and writes them once. The driver sees BINS sums a round, whatever the input's size, and PIECE x shards groups.
    """
    spark = docs.sparkSession
    rows = written(_rows(docs), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        shards = max(1, math.ceil(total / target_bytes))
    share = max(1, total // shards)
    points = _points(rows)
    groups, pieces = _large(points, rows, share)
    light = points.filter(F.col("weight") <= share / PIECE).withColumn("node", F.lit(0))
    placed = _split(light, groups, shards, share / tolerance)

    dealt = _dealt(rows, pieces)
    out = dealt.filter("piece IS NULL").drop("piece").join(placed.select("text_hash", "size", F.col("node").alias("shard")), ["text_hash", "size"])
    if groups:
        known = _values(spark, [(g.text_hash, g.size, g.piece, g.node) for g in groups], "text_hash, size, piece, shard")
        known = F.broadcast(known.withColumn("shard", F.col("shard").cast("int")))
        out = out.unionByName(dealt.filter("piece IS NOT NULL").join(known, ["text_hash", "size", "piece"]).drop("piece"))
    return _slotted(out.select("doc_id", "size", "text_crc32", "shard", "row"), partitions(spark))


def _slotted(placed: DataFrame, parts: int) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps; the rows of a shard are sorted in `parts` parts."""
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1)
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # shards x parts rows
    return own.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).alias("slot")
    )


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
