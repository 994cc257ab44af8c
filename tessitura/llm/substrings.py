"""Removal of byte strings that an earlier document has: shards' Burrows-Wheeler transforms merged by interleave refinement.

Every 50-byte window is routed by the least hash of its 24-byte parts, so that equal windows meet in one bucket wherever they
stand. Consecutive windows with the same least hash travel as one snippet, and only where that hash is found in two documents.
A bucket's distinct snippets are the collection whose shards' transforms are merged to depth 50; the intervals tell for each
window the least document that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words as W
from tessitura.llm.blocks import answered, bucket_count, packed, slices, squeeze, text_bytes, unpacked, unsqueeze
from tessitura.llm.bwt import least_by_window
from tessitura.llm.common import table, written

WINDOW, PART = 50, 24
#: Bytes of text in a block, and for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 10 << 20
#: Documents that have a part before its windows travel one by one: then equal ones are combined within each block, and no
#: bucket gets a snippet for every document around a common passage.
COMMON = 2000
#: Groups of copies that are broadcast at most: those with more than this part of all copies.
HOT = 1000
#: Bytes of the collections whose transforms are merged at a time; parts with the same hash stay together.
COLLECTION = 1 << 20


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minima of n consecutive values, by doubling."""
    size = 1
    while 2 * size <= n:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def _part_hash(sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of the PART bytes from each place on."""
    h = sums[PART:] - sums[:-PART]
    h *= inverse[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


class Runs:
    """A block's snippets: `key`, first window `start` and `end` byte within the block, document, and hash of the content."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)]
        for first, part, own in slices(data, offsets):
            if len(part) < WINDOW:
                continue
            sums = W.prefix_hashes(W._BYTE[part])
            inverse = W.powers(len(part) + 1)[1]
            least = _least(_part_hash(sums, inverse), WINDOW - PART + 1)
            change = np.append(True, least[1:] != least[:-1])
            change[own[own < len(change)]] = True
            start = np.flatnonzero(change)
            doc = np.searchsorted(own, start, "right") - 1
            end = np.minimum(np.append(start[1:], len(least)) - 1 + WINDOW, own[doc + 1])
            fits = end - start >= WINDOW
            start, end, doc = start[fits], end[fits], doc[fits]
            content = W.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
            at = offsets[first]
            for column, x in zip(found, (W.mix(least[start]), start + at, end + at, doc + first, content)):
                column.append(x)
        self.key, self.start, self.end, self.doc, self.content = (np.concatenate(x) for x in found)


def _place(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 bits within it) of uniform keys, in their order."""
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    b = np.uint64(buckets)
    wide = high * b + (low * b >> np.uint64(32))
    return (wide >> np.uint64(32)).astype(np.int64), (wide & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of runs of a sorted bucket column."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(edge, np.append(edge[1:], len(bucket)))]


def _key_counts(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each run's key among them, and the documents that have each (255 at most)."""
    keys, at = np.unique(runs.key, return_inverse=True)
    pairs = np.unique(at * (int(runs.doc.max(initial=0)) + 1) + runs.doc)
    docs = np.bincount(pairs // (int(runs.doc.max(initial=0)) + 1), minlength=len(keys))
    return keys, at, np.minimum(docs, 255).astype(np.uint8)


def _heads(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, *row in zip(*batch.columns):
                _, data, offsets = unpacked(*row)
                keys, _, docs = _key_counts(Runs(data, offsets))
                bucket, short = _place(keys, buckets)
                cuts = _cuts(bucket)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()] * len(cuts), pa.int64()), pa.array([b for b, _, _ in cuts], pa.int32()),
                        pa.array([short[i:j].tobytes() for _, i, j in cuts], pa.binary()), pa.array([squeeze(docs[i:j]) for _, i, j in cuts], pa.binary()),
                    ],
                    ["block", "bucket", "keys", "docs"],
                )

    return blocks.select("block", "doc_ids", "offsets", "data").mapInArrow(run, "block long, bucket int, keys binary, docs binary")


def _known(part: pa.Table) -> pa.Table:
    """One bucket: for each block's keys 0 (one document has it), 1 (several) or 2 (COMMON or more)."""
    keys = [np.frombuffer(k.as_py(), np.uint32) for k in part["keys"]]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    docs = np.bincount(at, np.concatenate([unsqueeze(d.as_py(), np.uint8) for d in part["docs"]]))
    state = ((docs > 1).astype(np.uint8) + (docs >= COMMON))[at]
    ends = np.cumsum([0, *map(len, keys)])
    reply = [squeeze(state[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    return pa.table({"block": part["block"], "bucket": part["bucket"], "reply": pa.array(reply, pa.binary())})


#: Bytes that are compared at a time.
COMPARED = 1 << 20


def _differ(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Items whose bytes are not those of the item `like` names: hashes only propose what is equal."""
    other = np.flatnonzero(like != np.arange(len(like)))
    wrong = [other[lengths[other] != lengths[like[other]]]]
    other = other[lengths[other] == lengths[like[other]]]
    ends = np.cumsum(lengths[other])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(COMPARED, ends[-1] if len(ends) else 0, COMPARED)), [len(other)]]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        mine = other[i:j]
        n = lengths[mine]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = text[np.repeat(starts[mine], n) + step] != text[np.repeat(starts[like[mine]], n) + step]
        if unlike.any():
            wrong.append(mine[np.add.reduceat(unlike, np.cumsum(n) - n) > 0])
    return np.concatenate(wrong)


class Snippets:
    """What a block sends: distinct snippets by bucket, key and content with their least document. `of` gives for each sent
    run (`start`, `end`, `doc`) its snippet. Built alike when the answers come back."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, replies, buckets: int):
        runs = Runs(data, offsets)
        _, at, _ = _key_counts(runs)
        state = np.concatenate([np.zeros(0, np.uint8), *(unsqueeze(r["reply"], np.uint8) for r in replies)])[at]
        one, common = state == 1, np.flatnonzero(state == 2)
        key, content = runs.key[one], runs.content[one]
        start, end, doc = runs.start[one], runs.end[one], runs.doc[one]
        if len(common):  # window by window
            n = runs.end[common] - runs.start[common] - WINDOW + 1
            single = np.repeat(runs.start[common], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bytes_ = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[single]
            own = W.mix((W._BYTE[bytes_] * W.powers(WINDOW)[0]).sum(1, dtype=np.uint64))
            key, content = np.concatenate([key, own]), np.concatenate([content, own])
            start, end = np.concatenate([start, single]), np.concatenate([end, single + WINDOW])
            doc = np.concatenate([doc, np.repeat(runs.doc[common], n)])
        bucket, short = _place(key, buckets)
        order = np.lexsort((content, short, bucket))
        bucket, short, content, self.start, self.end, self.doc = (x[order] for x in (bucket, short, content, start, end, doc))
        new = np.ones(len(order), bool)
        new[1:] = (content[1:] != content[:-1]) | (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        wrong = _differ(data, self.start, self.end - self.start, first[group] if len(first) else first)
        new[np.isin(group, group[wrong])] = True  # a hash that lied: its items stand each for itself
        self.of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.bucket, self.short, self.first = bucket[first], short[first], first
        self.least = np.minimum.reduceat(ids[self.doc], first) if len(first) else np.zeros(0, np.int64)
        self.length = (self.end - self.start)[first]


def _sent(marked: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, *row, replies in zip(*batch.columns):
                ids, data, offsets = unpacked(*row)
                s = Snippets(np.array(ids, np.int64), data, offsets, replies.as_py() or (), buckets)
                text = lambda i, j: b"".join(data[s.start[k] : s.end[k]].tobytes() for k in s.first[i:j])
                cuts = _cuts(s.bucket)
                columns = [
                    pa.array([block.as_py()] * len(cuts), pa.int64()), pa.array([b for b, _, _ in cuts], pa.int32()),
                    pa.array([squeeze(s.short[i:j]) for _, i, j in cuts], pa.binary()), pa.array([squeeze(s.length[i:j].astype(np.uint32)) for _, i, j in cuts], pa.binary()),
                    pa.array([squeeze(s.least[i:j]) for _, i, j in cuts], pa.binary()), pa.array([squeeze(np.frombuffer(text(i, j), np.uint8)) for _, i, j in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "keys", "lengths", "least", "text"])

    return marked.select("block", "doc_ids", "offsets", "data", "replies").mapInArrow(
        run, "block long, bucket int, keys binary, lengths binary, least binary, text binary"
    )


def _content(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of text[starts:ends], with their lengths."""
    sums = W.prefix_hashes(W._BYTE[text])
    return W.mix((sums[ends] - sums[starts]) * W.powers(len(text) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def _alike(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which distinct snippets of one key can share a window with another one.

    A window holds its least part and 26 bytes more, so 13 at least on one side: without an equal neighbour in either the part
    with 13 bytes before it or with 13 behind it, a snippet has no equal window. A snippet that holds its least part more
    than once is kept.
    """
    sums = W.prefix_hashes(W._BYTE[text])
    inverse = W.powers(len(text) + 1)[1]
    places = len(text) - PART + 1
    short = _place(W.mix(_part_hash(sums, inverse)), buckets)[1] if places > 0 else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(starts)), ends - starts)[: max(0, places)]
    hit = np.flatnonzero((short == keys[of]) & (np.arange(max(0, places)) + PART <= ends[of]))
    found = np.bincount(of[hit], minlength=len(starts))
    at = np.zeros(len(starts), np.int64)
    at[of[hit]] = hit
    keep, side = found != 1, (WINDOW - PART) // 2
    for low, high in ((at - side, at + PART), (at, at + PART + side)):
        fits = np.flatnonzero((found == 1) & (low >= starts) & (high <= ends))
        own = (sums[high[fits]] - sums[low[fits]]) * inverse[low[fits]]
        _, group, count = np.unique(W.mix(own + keys[fits].astype(np.uint64)), return_inverse=True, return_counts=True)
        keep[fits] |= count[group] > 1
    return keep


def _resolved(part: pa.Table, buckets: int) -> pa.Table:
    """One bucket: for each block's snippets, the least document of every window, after merging the collection's shards."""
    texts, starts, lengths, keys, least, content, sizes = [], [], [], [], [], [], []
    base = 0
    for row in range(part.num_rows):
        key, length, own, text = (unsqueeze(part[c][row].as_py(), t) for c, t in (("keys", np.uint32), ("lengths", np.uint32), ("least", np.int64), ("text", np.uint8)))
        ends = np.cumsum(length, dtype=np.int64)
        content.append(_content(text, ends - length, ends))
        texts.append(text), starts.append(ends - length + base), lengths.append(length.astype(np.int64)), keys.append(key), least.append(own)
        sizes.append(len(key))
        base += len(text)
    text = np.concatenate(texts)
    starts, lengths, keys, least, content = (np.concatenate(x) for x in (starts, lengths, keys, least, content))
    del texts
    _, first, of = np.unique(W.mix(content + keys.astype(np.uint64) * W._PLACES[0]), return_index=True, return_inverse=True)
    alone = _differ(text, starts, lengths, first[of] if len(of) else of)
    of[alone] = len(first) + np.arange(len(alone))
    first = np.concatenate([first, alone])
    owners = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owners, of, least)
    order = np.argsort(keys[first], kind="stable")  # distinct snippets by key
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first, owners, of = first[order], owners[order], rank[of]
    windows = lengths[first] - WINDOW + 1
    ahead = np.cumsum(windows) - windows
    answer = np.repeat(owners, windows)
    key = keys[first]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)

    held, size = [], 0

    def close():
        own = np.array(held)
        ends = np.cumsum(lengths[first[own]])
        joined = np.concatenate([text[starts[first[k]] : starts[first[k]] + lengths[first[k]]] for k in held])
        begins = ends - lengths[first[own]]
        keep = np.flatnonzero(_alike(joined, begins, ends, key[own], buckets))
        found = least_by_window([joined[begins[k] : ends[k]] for k in keep], owners[own[keep]], WINDOW)
        for k, values in zip(own[keep], found):
            answer[ahead[k] : ahead[k] + windows[k]] = values

    for i, j in zip(edge, np.append(edge[1:], len(key))):
        if j - i > 1:
            held += range(i, j)
            size += int(lengths[first[i:j]].sum())
            if size >= COLLECTION:
                close()
                held, size = [], 0
    if held:
        close()
    reply, at = [], 0
    for n in sizes:
        mine = of[at : at + n]
        many = windows[mine]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        reply.append(squeeze(answer[np.repeat(ahead[mine], many) + step]))
        at += n
    return pa.table({"block": part["block"], "bucket": part["bucket"], "reply": pa.array(reply, pa.binary())})


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(marked: DataFrame, buckets: int, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for *row, replies, answers in zip(*batch.columns):
                ids, data, offsets = unpacked(*row)
                own = np.array(ids, np.int64)
                s = Snippets(own, data, offsets, replies.as_py() or (), buckets)
                least = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(a["reply"], np.int64) for a in answers.as_py() or ())])
                n = s.length - WINDOW + 1
                base = (np.cumsum(n) - n)[s.of] if len(n) else np.zeros(0, np.int64)
                many = n[s.of] if len(n) else base
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                window = np.repeat(s.start, many) + step
                gone = least[np.repeat(base, many) + step] < np.repeat(own[s.doc], many)
                turn = np.zeros(len(data) + 1, np.int32)
                turn += np.bincount(window[gone], minlength=len(turn)).astype(np.int32)
                turn -= np.bincount(window[gone] + WINDOW, minlength=len(turn)).astype(np.int32)
                removed = np.cumsum(turn[:-1]) > 0
                out = ([], [], [], [], [], [])
                for d, i, j in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                    mask = removed[i:j]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    kept = data[i:j][~mask].tobytes()
                    spans = edges.reshape(-1, 2)
                    values = (d, j - i, int(mask.sum()), len(spans), [] if digest else [{"start": int(a), "end": int(b)} for a, b in spans],
                              hashlib.sha256(kept).digest() if digest else kept)
                    for column, v in zip(out, values):
                        column.append(v)
                i64 = pa.int64()
                kinds = (i64, i64, i64, i64, pa.list_(pa.struct([("start", i64), ("end", i64)])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return marked.select("doc_ids", "offsets", "data", "replies", "answers").mapInArrow(run, REMOVED)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges) and kept (the other bytes) for every row of docs(doc_id, text).

    What decides: a document that is a whole copy is found by its SHA-256; equal snippets of a block, and of a bucket, are proposed
    by a 64-bit hash and compared byte by byte, and stand for one string; between different strings, the merged transforms' intervals
    of 50 characters tell which windows are equal. Keys in one document only, and strings without a neighbour that a window needs,
    are left out ahead of the merge.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id, judged on whole texts as
    given. With digest, kept is the SHA-256 of those bytes and spans is empty. A copy of a smaller document is taken out
    whole at once. Null text is empty. Rows with equal doc_id are one document as far as they are compared: neither removes from
    the other. Rows with a null doc_id are neither compared nor cut. Empty tables give none; extra columns are not read.

    Documents move once, to part from copies, then as blocks; keys and snippets move through buckets whose number follows the
    text, so that tasks stay the same size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    known, other = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    print_ = F.sha2(F.col("text").cast("binary"), 256)
    long = written(known.filter(f"n_bytes >= {WINDOW}").select("doc_id", "n_bytes", print_.alias("sha")), "texts")
    first = written(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "groups")
    # a group of many copies is found by a broadcast, of at most HOT rows, so that no task gets all its copies
    rows = first.agg(F.sum("rows")).first()[0] or 0
    hot, cold = first.filter(F.col("rows") > rows / HOT), first.filter(F.col("rows") <= rows / HOT)
    marked = long.join(F.broadcast(hot.select("sha", F.col("first").alias("hot"))), "sha", "left")
    found = marked.filter("hot IS NULL").drop("hot").join(cold, "sha").drop("rows").unionByName(marked.filter("hot IS NOT NULL").withColumnRenamed("hot", "first"))
    copies = written(found.filter("doc_id > first").select("doc_id", "n_bytes", "sha"), "copies")
    # a merge join at every size: copies grow with the documents
    rest = known.withColumn("sha", print_).hint("merge").join(copies.select("doc_id", "sha").distinct(), ["doc_id", "sha"], "left_anti")

    blocks = packed(rest.select("doc_id", "text"), BLOCK_BYTES)
    buckets = bucket_count(text_bytes(docs), BUCKET_BYTES)
    state = written(_heads(blocks, buckets).groupBy("bucket").applyInArrow(_known, "block long, bucket int, reply binary"), "key-states")
    sent = _sent(answered(blocks, state), buckets)
    least = written(sent.groupBy("bucket").applyInArrow(lambda part: _resolved(part, buckets), "block long, bucket int, reply binary"), "least")
    answers = answered(least.select("block").distinct(), least).withColumnRenamed("replies", "answers")
    cut = _cut(answered(blocks, state).hint("merge").join(answers, "block", "left"), buckets, digest)

    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = lambda b: F.unhex(F.sha2(b, 256)) if digest else b
    empty = F.lit("").cast("binary")
    gone = copies.select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        (none if digest else F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).alias("spans"), whole(empty).alias("kept"),
    )
    zero = F.lit(0).cast("long")
    left = other.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), none.alias("spans"), whole(F.col("text").cast("binary")).alias("kept"))
    return cut.unionByName(gone).unionByName(left)


def op4_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) AS i FROM d)),
m AS (SELECT w, min(doc_id) AS least FROM g GROUP BY w HAVING min(doc_id) < max(doc_id)),
f AS (SELECT g.doc_id, g.i, lag(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS p FROM g JOIN m ON m.w = g.w AND m.least < g.doc_id),
n AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + {WINDOW} AS z FROM n GROUP BY doc_id, k),
t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT t.doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(c.kept, '') || substr(h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
