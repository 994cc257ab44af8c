"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, to which the discounted counts of all word
pairs fall back, beside smoothed word frequencies."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import logbilinear as L
from tessitura.llm import words as W
from tessitura.llm.blocks import bucket_count, bucket_edges, packed, slices, squeeze, text_bytes, unsqueeze
from tessitura.llm.common import remainder, table, written

#: Bytes of text in a block, for each bucket of words, and for each bucket of pairs; tokens that are scored at a time.
BLOCK_BYTES, BUCKET_BYTES, PAIR_BYTES, TOKENS = 8 << 20, 24 << 20, 12 << 20, 1 << 18
#: Words that are symbols of the model: so many times the cube root of the text's bytes, up to a bound on what is broadcast
#: (64 MB of parameters). All others share GROUPS symbols by hash.
PER_ROOT, MOST, GROUPS = 3, 1 << 17, 64
#: Rounds of training, each over all training tokens.
ROUNDS = 1
#: What a pair's count is discounted by; numbers in a row of the sums of parameters.
DISCOUNT, CHUNK = 0.75, 1 << 15
SMOOTH = 0.1


def trains(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def vocabulary_size(text_bytes: int) -> int:
    return max(64, min(MOST, int(PER_ROOT * text_bytes ** (1 / 3))))


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, and each document's first word with the total behind."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, part, own in slices(data, offsets):
        starts, ends, first = W.word_bounds(part, own)
        hashes.append(W.word_hashes(part, starts, ends, True))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _planes(array: np.ndarray) -> bytes:
    """Squeezed by place of the byte: sorted keys and small numbers have places that hardly change."""
    return squeeze(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T)


def _unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


CODED = ["doc_ids", "first", "keys", "codes"]


def _coded(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """What later steps read of a block, whose words are hashed and looked up once: each document's first word with the total
    behind, the hashes of the block's distinct words in order, and each word's place among those."""
    hashes, first = _block_words(data, offsets)
    keys, codes = np.unique(hashes, return_inverse=True)
    return [pa.array([first], pa.list_(pa.int64())), *[pa.array([_planes(x)], pa.binary()) for x in (keys, codes.astype(np.uint32))]]


def _opened(doc_ids, first, keys, codes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, keys, codes) of a coded block's row of Arrow scalars."""
    return doc_ids.as_py(), np.array(first.values, np.int64), _unplanes(keys.as_py(), np.uint64), _unplanes(codes.as_py(), np.uint32)


def _groups(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(16)).astype(np.int64) % GROUPS


def _heads(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, keys, counts): each block's distinct words, with their number in training documents."""

    def run(batches):
        for batch in batches:
            for block, *row in zip(*batch.columns):
                ids, first, keys, codes = _opened(*row)
                learn = np.repeat(np.array([trains(d) for d in ids], bool), np.diff(first))
                counts = np.bincount(codes[learn], minlength=len(keys)).astype(np.uint32)
                edges = bucket_edges(keys, buckets)
                cuts = [(b, i, j) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()] * len(cuts), pa.int64()),
                        pa.array([b for b, _, _ in cuts], pa.int32()),
                        pa.array([keys[i:j].tobytes() for _, i, j in cuts], pa.binary()),
                        pa.array([squeeze(counts[i:j]) for _, i, j in cuts], pa.binary()),
                    ],
                    ["block", "bucket", "keys", "counts"],
                )

    return blocks.select("block", *CODED).mapInArrow(run, "block long, bucket int, keys binary, counts binary")


REPLIES = "block long, bucket int, reply binary, tokens long, words long, kinds array<long>, mass array<long>, top array<struct<key: long, count: long>>"


def _summed(most: int):
    """One bucket: the sum of each word's counts, sent back to every block in the order of its keys; the first row also has
    the bucket's tokens, words, words and tokens of each group, and its `most` most frequent words."""

    def run(part: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_py(), np.uint64) for k in part["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unsqueeze(c.as_py(), np.uint32) for c in part["counts"]]), len(every)).astype(np.uint64)
        ends = np.cumsum([0, *map(len, keys)])
        top = np.lexsort((every, -sums.astype(np.int64)))[:most]
        tops = [{"key": int(every[k].view(np.int64)), "count": int(sums[k])} for k in top if sums[k]]
        first = lambda x: [x, *[None] * (part.num_rows - 1)]
        group = _groups(every)
        return pa.table(
            {
                "block": part["block"],
                "bucket": part["bucket"],
                "reply": pa.array([squeeze(sums[at[i:j]]) for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
                "tokens": pa.array(first(int(sums.sum())), pa.int64()),
                "words": pa.array(first(int((sums > 0).sum())), pa.int64()),
                "kinds": pa.array(first(np.bincount(group[sums > 0], minlength=GROUPS).tolist()), pa.list_(pa.int64())),
                "mass": pa.array(first(np.bincount(group, sums, GROUPS).astype(np.int64).tolist()), pa.list_(pa.int64())),
                "top": pa.array(first(tops), pa.list_(pa.struct([("key", pa.int64()), ("count", pa.int64())]))),
            }
        )

    return run


class Vocabulary:
    """Word hash -> symbol. Symbols are the words of `keys`, the end, and the groups that all other words share, by falling count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, kinds: np.ndarray, mass: np.ndarray):
        self.mass = mass - np.bincount(_groups(keys), counts, GROUPS).astype(np.int64)
        self.kinds = kinds - np.bincount(_groups(keys), minlength=GROUPS)
        every = np.concatenate([counts, [ends], self.mass])
        order = np.argsort(-every, kind="stable")
        symbol = np.empty(len(every), np.int32)
        symbol[order] = np.arange(len(every))
        self.frequencies = L.Frequencies(every[order])
        self.end, self.groups = int(symbol[len(keys)]), symbol[len(keys) + 1 :]
        place = np.argsort(keys)
        self.keys, self.symbols = keys[place], symbol[: len(keys)][place]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64(0xFFFFF)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, and whether each is a word's own."""
        out, own = self.groups[_groups(hashes)], np.zeros(len(hashes), bool)
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFFF)])
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[k] == hashes[at]
            out[at[hit]], own[at[hit]] = self.symbols[k[hit]], True
        return out, own


class Chain:
    """The tokens of a block: words and an end for each document."""

    def __init__(self, first: np.ndarray, keys: np.ndarray, codes: np.ndarray, vocabulary: Vocabulary):
        count = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.stop = self.first[1:] - 1
        self.is_word = np.ones(self.first[-1], bool)
        self.is_word[self.stop] = False
        self.end = vocabulary.end
        self.symbol, self.own = np.full(len(self.is_word), self.end, np.int32), np.ones(len(self.is_word), bool)
        symbol, own = vocabulary.numbers(keys)
        self.symbol[self.is_word], self.own[self.is_word] = symbol[codes], own[codes]
        self.doc = np.repeat(np.arange(len(count)), count)

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each; `start` at the beginning of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first[:-1]] = start
        return out


# --- the model --------------------------------------------------------------------------------------------------------


def _trained(blocks: DataFrame, vocabulary: Vocabulary) -> L.Params:
    """The model after ROUNDS rounds. In a round every task starts from the mean of the round before and learns from its blocks;
    their weighted mean is the next one. The driver gets the parameters' size, whatever the input's."""
    freq = vocabulary.frequencies
    p = L.start(freq)
    spread = max(1, math.isqrt(blocks.count()))

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([unsqueeze(v.as_py(), np.float32) for v in part["sums"]], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"chunk": part["chunk"][:1], "part": part["part"][:1], "sums": pa.array([squeeze(total)], pa.binary())})

    schema = "chunk int, part int, sums binary"
    for _ in range(ROUNDS):
        now = p

        def run(batches, now=now):
            own = {k: v.copy() for k, v in now.items()}
            steps, seen = L.Adagrad(own), L.Weights(freq)
            for batch in batches:
                for row in zip(*batch.columns):
                    ids, *words = _opened(*row)
                    chain = Chain(*words, vocabulary)
                    learn = np.array([trains(d) for d in ids], bool)[chain.doc]
                    text, places = L.stream(chain.symbol, chain.first, vocabulary.end)
                    wanted = np.zeros(len(text), bool)
                    wanted[places] = learn
                    L.learn(own, freq, text, wanted, steps, seen)
            if not seen.total:
                return
            flat = L.weighed(own, freq, seen)
            pid = TaskContext.get().partitionId()
            for k, a in enumerate(range(0, len(flat), CHUNK)):
                columns = [pa.array([k], pa.int32()), pa.array([pid % spread], pa.int32()), pa.array([squeeze(flat[a : a + CHUNK])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "sums"])

        sent = blocks.select(*CODED).mapInArrow(run, schema)
        summed = sent.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
        rows = sorted((r["chunk"], r["sums"]) for r in summed.select("chunk", "sums").collect())
        if rows:
            p = L.mean(p, freq, np.concatenate([unsqueeze(bytes(b), np.float32) for _, b in rows]))
    return p


# --- pairs of words ---------------------------------------------------------------------------------------------------

_LEFT, _RIGHT, _STOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)
_RARE = np.uint64(1 << 31)


def _pairs(hashes: np.ndarray, chain: Chain, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(route, pair) of every token with the one before it. The route is the bucket and 40 bits behind it. A rare context's pairs
    go by its hash, with 31 bits of a hash of both words as the pair; those of a context with a symbol of its own would be too
    many for a bucket, and go by the whole hash of both, with the symbol as the pair."""
    right = np.full(len(chain.is_word), _STOP)
    right[chain.is_word] = hashes
    left = chain.before(right, _STOP)
    both = W.mix(left * _LEFT + W.mix(right + _RIGHT))
    own = chain.before(chain.own, True)
    route = np.where(own, both, left)
    pair = np.where(own, chain.before(chain.symbol, chain.end).astype(np.uint64), both >> np.uint64(33) | _RARE)
    bucket = (route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return bucket << np.uint64(40) | route & np.uint64((1 << 40) - 1), pair.astype(np.uint32)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _distinct_pairs(route: np.ndarray, pair: np.ndarray):
    """First places of distinct (route, pair) in their order, and each item's number among them."""
    order = np.argsort(route)
    of_route = np.cumsum(_changes(route[order])).astype(np.uint64)
    order = order[np.argsort(of_route << np.uint64(32) | pair[order])]
    new = _changes(route[order], pair[order])
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], at


def _pair_heads(blocks: DataFrame, buckets: int, vocabulary: Vocabulary) -> DataFrame:
    """(block, bucket, routes, lengths, pairs, counts): each block's distinct pairs by route, with their number in training
    documents."""

    def run(batches):
        for batch in batches:
            for block, *row in zip(*batch.columns):
                ids, first, keys, codes = _opened(*row)
                chain = Chain(first, keys, codes, vocabulary)
                route, pair = _pairs(keys[codes], chain, buckets)
                learn = np.array([trains(d) for d in ids], bool)[chain.doc]
                one, at = _distinct_pairs(route, pair)
                counts = np.bincount(at[learn], minlength=len(one)).astype(np.uint32)
                route, pair = route[one], pair[one]
                edge = np.flatnonzero(_changes(route >> np.uint64(40))) if len(route) else np.zeros(0, np.int64)
                out = []
                for i, j in zip(edge, np.append(edge[1:], len(route))):
                    begins = np.flatnonzero(_changes(route[i:j]))
                    lengths = np.diff(np.append(begins, j - i)).astype(np.uint32)
                    out.append((block.as_py(), int(route[i] >> np.uint64(40)), *map(_planes, (route[i:j][begins], lengths, pair[i:j], counts[i:j]))))
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["block", "bucket", "routes", "lengths", "pairs", "counts"])

    schema = "block long, bucket int, routes binary, lengths binary, pairs binary, counts binary"
    return blocks.select("block", *CODED).mapInArrow(run, schema)


PAIRS = "block long, bucket int, reply binary, followers binary, common array<struct<symbol: int, n: long>>"


def _pair_replies(part: pa.Table) -> pa.Table:
    """One bucket: every pair's training count, and for each route the number of its different pairs, sent back to every block in its
    order. The first row also has, for each symbol, its different pairs in this bucket."""
    read = lambda name, kind: [_unplanes(x.as_py(), kind) for x in part[name]]
    routes, lengths, pairs = read("routes", np.uint64), read("lengths", np.uint32), read("pairs", np.uint32)
    sizes, ends = np.cumsum([0, *map(len, pairs)]), np.cumsum([0, *map(len, routes)])
    route, pair = np.concatenate([np.repeat(r, n) for r, n in zip(routes, lengths)]), np.concatenate(pairs)
    one, at = _distinct_pairs(route, pair)
    sums = np.bincount(at, np.concatenate(read("counts", np.uint32)), len(one)).astype(np.uint64)
    seen = sums > 0
    begins = np.flatnonzero(_changes(route[one]))
    different = np.add.reduceat(seen.astype(np.uint32), begins)
    of = np.searchsorted(route[one][begins], np.concatenate(routes))
    symbol, n = np.unique(pair[one][seen & (pair[one] < _RARE)], return_counts=True)
    common = [{"symbol": int(s), "n": int(k)} for s, k in zip(symbol, n)]
    return pa.table(
        {
            "block": part["block"],
            "bucket": part["bucket"],
            "reply": pa.array([_planes(sums[at[i:j]]) for i, j in zip(sizes[:-1], sizes[1:])], pa.binary()),
            "followers": pa.array([_planes(different[of[i:j]].astype(np.uint32)) for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
            "common": pa.array([common, *[None] * (part.num_rows - 1)], pa.list_(pa.struct([("symbol", pa.int32()), ("n", pa.int64())]))),
        }
    )


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double, model_score double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, model_score for every row of docs(doc_id, text).

    Counts come from all documents whose id trains (a null id never does). score is log10 of the text's probability. A word
    behind its context has max(n(context, word) - DISCOUNT, 0) / n(context), and what the discounts of the context's different pairs
    have freed times the log-bilinear model's probability; n counts all training text. The model reads L.ORDER words of context;
    a word outside its vocabulary has the probability of its group times its smoothed share of that. model_score is log10 of
    the text's probability under the log-bilinear model alone. Null text counts as empty and has the end alone. Rows with
    equal doc_id are scored each for itself; an empty table gives none; extra columns are not read.

    Counts of words and of pairs move as sorted keys of blocks through buckets and back, and grow with the corpus; the model's
    vocabulary grows with the cube root of it, and learns in every task, from every token of the training documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = packed(docs, BLOCK_BYTES, _coded, "first array<long>, keys binary, codes binary")
    size = text_bytes(docs)
    buckets, most = bucket_count(size, BUCKET_BYTES), vocabulary_size(size)
    # a bucket has a share of the most frequent words that its hash decides: far less than this
    heads = _heads(blocks, buckets).groupBy("bucket").applyInArrow(_summed(64 + 4 * most // buckets), REPLIES)
    replies = written(heads, "word-counts")

    sums = replies.agg(F.sum("tokens"), F.sum("words")).first()
    learned = docs.filter(remainder("doc_id", 10) != 0).count()
    top = replies.filter("top IS NOT NULL").select(F.inline("top")).orderBy(F.desc("count"), "key").limit(most).collect()
    total, different = (sums[0] or 0) + learned, (sums[1] or 0) + (learned > 0)
    groups = np.zeros((2, GROUPS), np.int64)
    for k, *found in replies.filter("kinds IS NOT NULL").select(F.posexplode(F.arrays_zip("kinds", "mass")).alias("k", "z")).groupBy("k").agg(F.sum("z.kinds"), F.sum("z.mass")).collect():
        groups[:, k] = found
    keys, counts = (np.array([r[k] for r in top], np.int64) for k in (0, 1))
    vocabulary = Vocabulary(keys.view(np.uint64), counts, learned, *groups)
    freq = vocabulary.frequencies
    lower = np.log(total + SMOOTH * (different + 1))
    in_group = np.zeros(len(counts) + 1 + GROUPS)
    in_group[vocabulary.groups] = np.log(vocabulary.mass + SMOOTH * (vocabulary.kinds + 1))

    many = bucket_count(size, PAIR_BYTES)
    pairs = written(_pair_heads(blocks, many, vocabulary).groupBy("bucket").applyInArrow(_pair_replies, PAIRS), "pair-counts")
    followers = np.zeros(len(in_group))
    for symbol, n in pairs.filter("common IS NOT NULL").select(F.inline("common")).groupBy("symbol").agg(F.sum("n")).collect():
        followers[symbol] = n
    p = _trained(blocks, vocabulary)

    both = replies.select("block", "bucket", "reply", F.lit(None).cast("binary").alias("followers")).unionAll(pairs.drop("common"))
    own = both.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply", "followers"))).alias("replies"))

    def run(batches):
        for batch in batches:
            for *row, answers in zip(*batch.columns):
                ids, first, keys, codes = _opened(*row)
                found = [(a["reply"].as_py(), a["followers"].as_py()) for a in answers.values] if answers.is_valid else []
                none = [np.zeros(0, np.uint64)]
                seen = np.concatenate(none + [unsqueeze(r, np.uint64) for r, f in found if f is None])[codes]
                chain = Chain(first, keys, codes, vocabulary)
                route, pair = _pairs(keys[codes], chain, many)
                one, at = _distinct_pairs(route, pair)
                together = np.concatenate(none + [_unplanes(r, np.uint64) for r, f in found if f is not None])[at]
                kinds = np.concatenate([np.zeros(0, np.uint32)] + [_unplanes(f, np.uint32) for _, f in found if f is not None])
                kinds = kinds[np.cumsum(_changes(route[one])) - 1][at] if len(one) else kinds
                del found, keys, codes, route, pair, one, at
                own = chain.before(chain.own, True)
                count = np.full(len(chain.doc), float(learned))
                count[chain.is_word] = seen
                before = chain.before(count, learned)
                context = chain.before(chain.symbol, vocabulary.end)
                text, places = L.stream(chain.symbol, chain.first, vocabulary.end)
                smoothed, model, score = np.log(count + SMOOTH), np.empty(len(count)), np.empty(len(count))
                for a in range(0, len(count), TOKENS):
                    k = slice(a, a + TOKENS)
                    low, high = places[k][0], places[k][-1] + 1
                    inside = L.log_probabilities(p, freq, text, low, high)[places[k] - low]
                    model[k] = inside + np.where(chain.own[k], 0.0, smoothed[k] - in_group[chain.symbol[k]])
                    freed = DISCOUNT * np.where(own[k], followers[context[k]], kinds[k])
                    n = np.maximum(before[k], 1)
                    mixed = (np.maximum(together[k] - DISCOUNT, 0) + freed * np.exp(model[k])) / n
                    score[k] = np.where(before[k] > 0, np.log(np.maximum(mixed, 1e-300)), model[k])
                per = lambda x: np.bincount(chain.doc, x, len(ids))
                ten = np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(np.diff(chain.first), pa.int64()), pa.array(per(count > 0).astype(np.int64)),
                        pa.array(per(smoothed - lower) / ten), pa.array(per(score) / ten), pa.array(per(model) / ten),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "model_score"],
                )

    scored = blocks.hint("merge").join(own, "block", "left").select(*CODED, "replies").mapInArrow(run, SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(True))
    return lm_scores(table(spark, sf_dir, "documents")).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "model_score"
    )
