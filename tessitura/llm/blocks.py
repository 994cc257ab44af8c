"""Documents in blocks, and the exchange of per-block tables of 64-bit keys through buckets.

A block is some megabytes of documents in one row of a written table. A step over the corpus that needs to know something of
every key (how often a word occurs, whether a string is found elsewhere) runs as: each block sends its distinct keys, one
slice per bucket of the key space; each bucket answers every slice; each block is joined with its answers. Keys are combined
within a block first, so a key of every document costs a bucket one entry per block, and buckets are even.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import written
from tessitura.llm.words import string_slices


def squeeze(array: np.ndarray) -> bytes:
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zs.ZstdDecompressor().decompress(data), kind)


def _text(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [pa.array([offsets], pa.list_(pa.int64())), pa.array([squeeze(data)], pa.binary())]


def packed(docs: DataFrame, block_bytes: int, kept=_text, schema: str = "offsets array<long>, data binary") -> DataFrame:
    """A written table of blocks: block, doc_ids, offsets (of bytes), data (zstd); or in place of the last two the columns of
    `schema` that `kept` makes of a block's bytes and offsets. Null text is empty; a document over `block_bytes` is a block of
    its own."""
    names = ["doc_ids", *[column.split()[0] for column in schema.split(", ")]]

    def run(batches):
        ids, parts, lengths, held = [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            return pa.RecordBatch.from_arrays([pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())), *kept(np.concatenate(parts), offsets)], names)

        for batch in batches:
            for first, data, offsets in string_slices(batch.column(1)):
                if held and held + len(data) > block_bytes:
                    yield row()
                    ids, parts, lengths, held = [], [], [], 0
                ids.append(batch.column(0).slice(first, len(offsets) - 1))
                parts.append(data.copy())
                lengths.append(np.diff(offsets))
                held += len(data)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_ids array<long>, {schema}")
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def unpacked(doc_ids, offsets, data) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a block's row of Arrow scalars."""
    return doc_ids.as_py(), unsqueeze(data.as_py(), np.uint8), np.array(offsets.values, np.int64)


def slices(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 17):
    """(first document, bytes, offsets) for runs of documents of about `size` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(size: int, bucket_bytes: int) -> int:
    """As many buckets as the text has times `bucket_bytes`, so that a bucket's share stays the same for any input."""
    return max(4, math.ceil(size / bucket_bytes))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's slice of sorted keys begins, and the end."""
    limits = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def answered(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """blocks with `replies`: their (bucket, reply) structs as arrays; blocks without any have null. A merge join at every size,
    as replies grow with the blocks."""
    own = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))
    return blocks.hint("merge").join(own, "block", "left")
