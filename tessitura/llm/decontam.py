"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words as W
from tessitura.llm.common import fresh, table, written

#: Hash functions. One equal minimum makes a candidate, so that an item of containment c in a window is missed with a
#: probability of about (1 - c / 3) ** HASHES.
HASHES = 64
#: Bytes of items whose signatures and shingles are sent to every task at once; more items are searched in blocks.
BLOCK_BYTES = 8 << 20
#: Shingles of documents whose windows are held at a time.
PART = 1 << 18

_seeds = np.random.default_rng(4099).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ordered(texts: pa.Array, n: int):
    """Per slice: first row, count, shingle hashes in text order and their document."""
    for first, data, offsets in W.string_slices(texts):
        starts, ends, words = W.word_bounds(data, offsets)
        yield first, len(offsets) - 1, W.word_hashes(data, starts, ends, True), words


class Items:
    """A block of items: the distinct shingles of each, their size class and their signatures by size class.

    An item of fewer words than a shingle has its whole sequence as the only one, and is looked for as that sequence.
    """

    def __init__(self, ids: list[int], texts: list[str], n: int):
        hashes, owner = [], []
        self.words = np.zeros(len(ids), np.int64)
        for first, count, h, words in _ordered(pa.array(texts, pa.string()), n):
            self.words[first : first + count] = np.diff(words)
            for k in range(1, n + 1):
                rows = np.flatnonzero((np.diff(words) >= n) if k == n else (np.diff(words) == k))
                got, whole = W.windows(h, words, k)
                of = np.repeat(np.arange(count), np.diff(words))[: len(got)]
                whole &= np.isin(of, rows)
                hashes.append(got[whole]), owner.append(of[whole] + first)
        self.ids = np.array(ids, np.int64)
        self.hashes, self.owner = W.distinct(np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owner or [np.zeros(0, np.int64)]))
        self.bounds = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        self.sizes = np.diff(self.bounds)
        self.span = np.where(self.words >= n, n, self.words)  # words of a shingle
        # classes: (words of a shingle, log2 of the size)
        classes: dict[tuple[int, int], list[int]] = {}
        for k in np.flatnonzero(self.sizes):
            classes.setdefault((int(self.span[k]), int(self.sizes[k]).bit_length()), []).append(int(k))
        self.index = {}
        for key, members in classes.items():
            minima = np.stack([(self.hashes[self.bounds[k] : self.bounds[k + 1], None] * _seeds).min(0) for k in members])
            self.index[key] = Minima(np.array(members), minima)

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray, span: int) -> set[tuple[int, int]]:
        """(document, item) pairs of which a window and the item have an equal minimum under some hash.

        hashes: the shingles of the documents in text order; bounds: where each document's begin. They are read in parts
        that overlap by the largest window.
        """
        levels = sorted(level for s, level in self.index if s == span)
        found: set[tuple[int, int]] = set()
        for a in range(0, len(hashes), PART) if levels else ():
            b = min(len(hashes), a + PART + (2 << levels[-1]))
            docs = np.arange(np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left"))
            own = np.clip(bounds[docs[0] : docs[-1] + 2], a, b) - a
            docs, own = docs[np.diff(own) > 0], np.unique(own)
            size = 1 << levels[0]
            count = -(-np.diff(own) // size)  # blocks of each document
            ahead = np.cumsum(count) - count
            of = np.repeat(np.arange(len(docs)), count)
            starts = own[of] + (np.arange(len(of)) - ahead[of]) * size
            blocks = np.empty((len(starts), HASHES), np.uint64)
            for k in range(HASHES):
                blocks[:, k] = np.minimum.reduceat(hashes[a:b] * _seeds[k], starts)
            for level in range(levels[0], levels[-1] + 1):
                if level > levels[0]:  # two blocks of a document become one
                    first = np.concatenate([np.arange(x, x + c, 2) for x, c in zip(ahead, count)]) if len(count) else ahead
                    blocks = np.minimum.reduceat(blocks, first, axis=0)
                    count = (count + 1) // 2
                    ahead = np.cumsum(count) - count
                    of = np.repeat(np.arange(len(docs)), count)
                if (span, level) in self.index:
                    window = blocks.copy()
                    next_too = np.flatnonzero(of[:-1] == of[1:])
                    window[next_too] = np.minimum(window[next_too], blocks[next_too + 1])
                    row, item = self.index[span, level].matches(window)
                    found.update(zip(docs[of[row]].tolist(), item.tolist()))
        return found


class Minima:
    """Signatures of the items of a class, to look up windows in."""

    def __init__(self, members: np.ndarray, minima: np.ndarray):
        self.bits = np.uint64((1 << max(16, min(26, (16 * minima.size - 1).bit_length()))) - 1)
        self.seen = np.zeros(int(self.bits) + 1, bool)
        self.seen[minima & self.bits] = True
        hash_no = np.broadcast_to(np.arange(HASHES), minima.shape)
        order = np.lexsort((minima.ravel(), hash_no.ravel()))
        self.values, self.numbers = minima.ravel()[order], hash_no.ravel()[order]
        self.members = np.broadcast_to(members[:, None], minima.shape).ravel()[order]
        self.edges = np.searchsorted(self.numbers, np.arange(HASHES + 1))

    def matches(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of equal minima."""
        row, number = np.nonzero(self.seen[window & self.bits])
        value = window[row, number]
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(number):
            mine = number == k
            own = self.values[self.edges[k] : self.edges[k + 1]]
            low, high = (np.searchsorted(own, value[mine], side) for side in ("left", "right"))
            rows.append(np.repeat(row[mine], high - low))
            runs = high - low
            at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(low, runs)
            items.append(self.members[self.edges[k] + at])
        return np.concatenate(rows), np.concatenate(items)


def _run(items: Items, n: int, percent: int, out_names: list[str]):
    spans = sorted({s for s, _ in items.index})

    def run(batches):
        for batch in batches:
            doc, item, shared, size = [], [], [], []
            ids = batch.column(0).to_pylist()
            for first, count, h, words in _ordered(batch.column(1), n):
                for span in spans:
                    got, whole = W.windows(h, words, span)
                    of = np.repeat(np.arange(count), np.diff(words))[: len(got)]
                    got, of = got[whole], of[whole]
                    bounds = np.searchsorted(of, np.arange(count + 1))
                    held, own = None, got[:0]
                    for d, k in sorted(items.candidates(got, bounds, span)):
                        if d != held:  # sorted once for all its candidates
                            held, own = d, np.unique(got[bounds[d] : bounds[d + 1]])
                        mine = items.hashes[items.bounds[k] : items.bounds[k + 1]]
                        both = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
                        if 100 * both >= percent * len(mine):
                            doc.append(ids[first + d]), item.append(int(items.ids[k])), shared.append(both), size.append(len(mine))
            i64 = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, i64) for x in (doc, item, shared, size)], out_names)

    return run


def _blocks(benchmark: DataFrame) -> list[tuple[list[int], list[str]]]:
    """The items in blocks of at most BLOCK_BYTES or one item, fetched a block at a time by ranges of a hash."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(2 * total / BLOCK_BYTES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        rows = benchmark.filter(place == k).distinct().collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): items of which a document has at least `percent` of the distinct shingles.

    Items are partitioned by the power of two of their size. For each class a document is read in overlapping windows of a
    size that fits the class, so that a short item is not lost in a long document's signature; a window that shares a
    minimum of an item's signature makes a candidate, and exact containment in the whole document decides. Items travel in
    blocks of a stated size, each searched over all documents: no join, no shuffle. Null item_id or text, and items without
    words, are no items; null or empty documents contain nothing. A repeated doc_id is searched row by row; equal results
    stay as often as the rows that give them. Empty tables give none; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    found = None
    for ids, texts in _blocks(known):
        run = _run(Items(ids, texts, shingle), shingle, percent, ["doc_id", "item_id", "shared", "item_shingles"])
        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(written(part, "contained"))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """The rows of docs that contain no item; columns as they were, whatever their names. Rows are told apart by a hash of doc_id and
    text, so that a null or repeated doc_id is judged by its own text. Empty tables: nothing is dropped from no rows or by no items."""
    row = F.xxhash64("doc_id", "text")
    hit = contained_items(docs.select(row.alias("doc_id"), "text"), benchmark, percent, shingle)
    name = fresh("row", docs.columns)
    hits = written(hit.select(F.col("doc_id").alias(name)).distinct(), "hits")
    return docs.withColumn(name, row).join(hits, name, "left_anti").select(docs.columns)


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
i AS (SELECT id, ws, least(5, len(ws)) AS k FROM w WHERE kind = 1 AND len(ws) > 0),
s AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p+k-1], ' '))) AS sh FROM i),
d AS (SELECT DISTINCT w.id, k.k, unnest(list_transform(range(1, len(ws) - k.k + 2), lambda p: array_to_string(ws[p:p+k.k-1], ' '))) AS sh
  FROM w, (SELECT DISTINCT k FROM i) k WHERE kind = 0 AND len(ws) >= k.k),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT d.id AS doc_id, s.id AS item_id, count(*) AS shared FROM s JOIN d ON d.k = s.k AND d.sh = s.sh GROUP BY 1, 2)
SELECT doc_id, item_id, shared, n.n AS item_shingles FROM p JOIN n ON n.id = item_id WHERE 100 * shared >= 75 * n.n
"""
