"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, and equal lengths share a bucket."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import table

#: Distinct words whose ids a Python worker keeps; beyond that it starts again with an empty memo.
MEMO_WORDS = 500_000
#: Different runs of marks whose ids it keeps.
MEMO_MARKS = 4096
#: Words of these letters are their own lower-cased pre-token, and a run of these marks behind them is another.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*.,]*)")


#: Texts that a vocabulary must encode as its words one by one, for WordIds to be right: marks, digits, other letters and white space.
PROBES = (
    "The quick brown fox, it isn't here.", " two  spaces\nand\n\nlines ", "Größe ÄÖÜ façade Ünïcode, naïve.", "x=1; y[2] != 3.14 -- (a_b)", "\ttab\rreturn\x0bvertical", "日本語 テスト 🙂 emoji",
    "UPPER lower MiXeD WORDs.", "it's we're I'll don't 'quoted'", "e-mail: a.b@c.de http://x.y/z?q=1", "1234567 12,345.67 50% $9.99 #tag", "no\u00a0break \u2014 dash\u2026", "",
)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies show for each byte: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(dict):
    """Word (a run without space or newline) -> its token ids as little-endian uint32 bytes.

    White space never reaches a token of this vocabulary, so a text's ids are those of its words in turn.
    A word of plain letters skips the normaliser and the splitter, which leave it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.latin = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.marks = {}
        for text in PROBES:
            own = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
            if own != self._whole(text):
                raise ValueError("this vocabulary does not encode word by word")

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if m:
            letters = m[1].lower().encode().decode("latin-1").translate(self.latin)
            ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if m[2]:
                marks = self.marks.get(m[2])
                if marks is None:
                    marks = self._whole(m[2])
                    if len(self.marks) < MEMO_MARKS:
                        self.marks[m[2]] = marks
                ids += marks
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as whole blocks of `longest` (a power of two), then the set bits of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, bucket.

    Every piece has a power-of-two length of at most `sequence_tokens` and is a sequence of its own, so that none crosses
    documents and none needs padding; `bucket` is log2 of the length, for batches of equal length. Each document's ids end
    with `end_id`, so an empty or null text gives one piece of one id. Rows with equal or null doc_id are packed as they
    stand; an empty table gives none. One pass, no shuffle: memory is one Arrow batch and the memo of words.
    sequence_id is unique and follows the input's partitions. Other columns are not read.
    """
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")

    def cut(batches):
        memo = word_ids(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" "))) + end
                start, total = 0, len(ids) // 4
                for n in binary_lengths(total, sequence_tokens):
                    for column, value in zip(out, (doc, start, n, ids[4 * start : 4 * (start + n)], total)):
                        column.append(value)
                    start += n
                held += len(ids)
                if held > 8 << 20:
                    yield _record(out)
                    out, held = ([], [], [], [], []), 0
                if len(memo) > MEMO_WORDS:
                    memo.clear()
            if out[0]:
                yield _record(out)
            pa.default_memory_pool().release_unused()

    pieces = docs.select("doc_id", "text").mapInArrow(cut, PIECES)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2(F.col("length")).cast("int").alias("bucket"),
    )


def _record(out) -> pa.RecordBatch:
    doc, start, length, ids, total = out
    i64 = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, i64), pa.array(start, i64), pa.array(length, i64), pa.array(ids, pa.binary()), pa.array(total, i64)],
        ["doc_id", "start", "length", "ids", "doc_tokens"],
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
