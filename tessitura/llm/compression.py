"""Classifiers by compression: a text belongs to the class whose zstandard raw-content dictionary encodes it smallest."""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import remainder, table, written

#: Bytes that a dictionary takes of a training document at most, from a place anywhere in its whole text: dictionaries have a fixed
#: size and should hold many documents.
PART = 700


class Coder:
    """Sizes of texts under one raw-content dictionary. Texts are cut into blocks, so that a long text leans on the
    dictionary throughout and not on its own beginning; every block counts."""

    def __init__(self, dictionary: bytes, level: int, block: int):
        import zstandard as zs

        own = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        self._compress = zs.ZstdCompressor(
            level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress
        self.block = block
        self.frame = len(self._compress(b""))

    def size(self, text: bytes) -> int:
        blocks = range(0, len(text), self.block)
        return sum(len(self._compress(text[k : k + self.block])) for k in blocks) - self.frame * len(blocks)


@lru_cache(maxsize=8)
def coder(dictionary: bytes, level: int, block: int) -> Coder:
    return Coder(dictionary, level, block)


def dictionary_of(parts: list[bytes], size: int | None = None) -> bytes:
    """The parts in turn: all of them, or up to `size` bytes."""
    return b"\n".join(parts)[:size]


def _chosen(known: DataFrame, name: str, counts: dict, per_class: int) -> list[tuple]:
    """(class, rank, doc_id) of at most `per_class` documents of each class of counts (class -> rows of `known`), those with the
    least hashes of doc_id. About 2 x per_class ids a class come to the driver; nothing is shuffled or ranked in one task."""
    place = F.xxhash64(F.lit(7), F.col("doc_id"))
    found: dict = {c: None for c in counts}
    share = {c: 2.0 * per_class / n for c, n in counts.items()}
    while any(v is None for v in found.values()):
        rows: dict = {c: set() for c, v in found.items() if v is None}
        limit = [(F.col(name) == c) & (place < int(min(share[c], 1.0) * 2**64) - 2**63 if share[c] < 1 else F.lit(True)) for c in rows]
        for c, h, d in known.filter(reduce(or_, limit)).select(name, place, "doc_id").distinct().collect():
            rows[c].add((h, d))
        for c, some in rows.items():
            if len(some) >= per_class or share[c] >= 1:
                found[c] = sorted(some)[:per_class]
            share[c] *= 8
    return [(c, rank, d) for c, some in found.items() for rank, (_, d) in enumerate(some)]


def sample(docs: DataFrame, known: DataFrame, name: str, counts: dict, per_class: int) -> DataFrame:
    """A written table (class, rank, text) of the whole texts of the chosen documents; of rows with equal doc_id, the least text."""
    chosen = docs.sparkSession.createDataFrame(
        [(str(c), rank, d) for c, rank, d in _chosen(known, name, counts, per_class)], "class string, rank int, id long"
    )
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = written(rows.select("class", "rank", "text"), "sample")
    if not rows.groupBy("class", "rank").count().filter("count > 1").isEmpty():
        rows = written(rows.groupBy("class", "rank").agg(F.min("text").alias("text")), "sample")
    return rows


def parts_of(chosen: DataFrame, part: int, fold) -> dict[str, list[bytes]]:
    """class -> a part of each text, by rank: `part` bytes from a place anywhere in the whole folded text."""

    def run(batches):
        for batch in batches:
            out = []
            for rank, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole = fold(text)
                k = random.Random(rank).randrange(len(whole) - part) if len(whole) > part else 0
                out.append(whole[k : k + part])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["class", "rank", "part"])

    found: dict[str, list] = {}
    for c, rank, p in chosen.select("class", "rank", "text").mapInArrow(run, "class string, rank int, part binary").collect():
        found.setdefault(c, []).append((rank, bytes(p)))
    return {c: [p for _, p in sorted(own)] for c, own in found.items()}


# --- language -------------------------------------------------------------------------------------------------------

#: ASCII that is no letter says nothing of the language.
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
#: Training documents of a language, all of which its dictionary holds (PART bytes each), level, block and the languages worked on at a time.
LANG_DOCS, LANG_LEVEL, LANG_BLOCK, LANGS = 300, 6, 4096, 64
#: Nats that a byte of difference counts in the score.
SHARPNESS = 0.2
#: A lead under this share of the best size is too narrow to decide on.
MARGIN = 0.02


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_BLANK)


def learn_languages(docs: DataFrame, per_lang: int = LANG_DOCS) -> dict[str, bytes]:
    """lang -> dictionary, from docs(doc_id, text, lang), for every lang, the most frequent first. At most `per_lang` documents
    of a language are read, for LANGS languages at a time; parts of PART bytes of them come to the driver, and the dictionary holds
    them all."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    langs, learned = list(counts), {}
    for k in range(0, len(langs), LANGS):
        some = {c: counts[c] for c in langs[k : k + LANGS]}
        own = known.filter(F.col("lang").isin(*some))
        parts = parts_of(sample(own, own, "lang", some, per_lang), PART, _folded)
        learned |= {c: dictionary_of(parts.get(c, [])) for c in some}
    return learned


LANG_COLUMNS = "lang_pred string, score double, rejected boolean"


def identify_languages(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs(doc_id, text, others kept behind) with lang_pred, score and rejected.

    The whole text is encoded under every language's dictionary, and the smallest size decides; equal sizes go to the more
    frequent language. score is the softmax of the sizes at SHARPNESS nats a byte. rejected marks a lead over the second of
    less than `margin` of the best size. Null text, and text without a letter, is `und` with score 0, as is every text
    if nothing was learned. Rows with equal doc_id are scored each for itself; columns of docs with the names of the new ones
    give way to them; empty tables give none. A map over batches: no shuffle, memory of one batch and the coders of LANGS
    languages.
    """
    names = list(learned)
    docs = docs.drop("lang_pred", "score", "rejected")

    def score(batches):
        parts = [range(k, min(k + LANGS, len(names))) for k in range(0, len(names), LANGS)]
        make = coder if len(parts) == 1 else Coder
        coders_of = lambda part: [make(learned[names[c]], LANG_LEVEL, LANG_BLOCK) for c in part]
        coders = coders_of(parts[0]) if parts else []
        for batch in batches:
            n = batch.num_rows
            best, second, total, which = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n), np.full(n, -1)
            for part in parts:
                if len(parts) > 1:
                    coders = coders_of(part)
                for at, text in enumerate(batch.column(0)):
                    text = text.as_py()
                    if text is None or not _LETTER.search(text):
                        continue
                    folded = _folded(text)
                    s = np.array([c.size(folded) for c in coders], float)
                    k = int(s.argmin())
                    own = np.exp(-SHARPNESS * np.minimum(s - s[k], 500)).sum()
                    other = np.partition(s, 1)[1] if len(s) > 1 else np.inf
                    if s[k] < best[at]:
                        total[at] = own + (total[at] * np.exp(-SHARPNESS * min(best[at] - s[k], 500)) if which[at] >= 0 else 0.0)
                        best[at], second[at], which[at] = s[k], min(other, best[at]), part[k]
                    else:
                        total[at] += own * np.exp(-SHARPNESS * min(s[k] - best[at], 500))
                        second[at] = min(second[at], s[k])
            found = which >= 0
            pred = [names[k] if k >= 0 else "und" for k in which]
            scores = np.divide(1.0, total, out=np.zeros(n), where=found)
            lead = np.subtract(second, best, out=np.zeros(n), where=found)
            reject = ~found | (lead < margin * np.maximum(best, 1))
            own = [pa.array(pred, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select("text", *[c for c in docs.columns if c != "text"]).mapInArrow(score, f"{kept}, {LANG_COLUMNS}")


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(True))
    learned = learn_languages(docs.select("doc_id", "text", "lang").filter(~held))
    found = identify_languages(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


# --- quality --------------------------------------------------------------------------------------------------------

#: Labelled documents of a class that are read at most (half for the dictionary, half to calibrate), bytes of a dictionary, level, block.
QUALITY_DOCS, QUALITY_BYTES, QUALITY_LEVEL, QUALITY_BLOCK = 1600, 250_000, 5, 1024
THRESHOLD = 0.3


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _sizes(text: bytes, good: Coder, bad: Coder) -> tuple[int, int, int]:
    return good.size(text), bad.size(text), len(text)


def _features(sizes: np.ndarray) -> np.ndarray:
    """The difference and the mean of the sizes per byte, their squares and product, and how short the text is."""
    n = sizes[:, 2] + 64.0
    d, m, short = (sizes[:, 1] - sizes[:, 0]) / n, (sizes[:, 1] + sizes[:, 0]) / n, 64.0 / n
    return np.c_[d, m, d * m, d * d, m * m, short, short * m]


class Quality:
    """Dictionaries of good and bad text, and the logistic curve from normalised sizes to the probability of label 1."""

    def __init__(self, good: bytes, bad: bytes, mean, scale, weights):
        self.good, self.bad, self.mean, self.scale, self.weights = good, bad, mean, scale, weights

    def coders(self) -> tuple[Coder, Coder]:
        return tuple(coder(d, QUALITY_LEVEL, QUALITY_BLOCK) for d in (self.good, self.bad))

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        x = np.clip((_features(sizes) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.weights, -30, 30)))


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = QUALITY_DOCS, size: int = QUALITY_BYTES) -> Quality | None:
    """From docs(doc_id, text) and labels(doc_id, quality); at most `per_class` documents of each class are read. Dictionaries
    come from every second one, the curve from the whole texts of the others, weighted to the classes' shares of labels.
    None without both classes. The driver gets PART bytes or three sizes of a document."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    chosen = sample(docs, known, "quality", counts, per_class)
    first = parts_of(chosen.filter("rank % 2 = 0"), PART, _encoded)
    if len(first) < 2:
        return None
    model = Quality(*(dictionary_of(first[q], size) for q in "10"), 0.0, 1.0, None)

    def measure(batches):
        pair = model.coders()
        for batch in batches:
            sizes = [_sizes(_encoded(t.as_py()), *pair) for t in batch.column(1)]
            columns = [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["class", "good", "bad", "n"])

    rest = chosen.filter("rank % 2 = 1").select("class", "text")
    used = sorted((int(r[0]), (r[1], r[2], r[3])) for r in rest.mapInArrow(measure, "class string, good long, bad long, n long").collect())
    if len({q for q, _ in used}) < 2:
        return None
    y = np.array([q for q, _ in used], float)
    x = _features(np.array([s for _, s in used], float))
    share = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    share *= len(y) / share.sum()
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), np.clip((x - model.mean) / model.scale, -8, 8)]
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [0.3] * x.shape[1])
    for _ in range(40):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (share * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    model.weights = w
    return model


def score_quality(docs: DataFrame, model: Quality | None, keep_text: bool = False) -> DataFrame:
    """docs(text, others kept) with score double. Whole texts are encoded under both dictionaries; null counts as empty.
    Without a model every score is 1. Rows with equal doc_id are scored each for itself; a column `score` of docs gives way to
    the new one; empty tables give none. A map over batches: no shuffle."""
    others = [c for c in docs.columns if c not in ("text", "score")]
    cols = ["text", *others] if keep_text else others

    def run(batches):
        pair = model.coders() if model else None
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(0))
            if model:
                sizes = np.array([_sizes(_encoded(t), *pair) for t in texts], float).reshape(-1, 3)
                scores = model.scores(sizes)
            else:
                scores = np.ones(batch.num_rows)
            kept = batch.columns if keep_text else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*cols, "score"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.select("text", *others).mapInArrow(run, f"{kept}, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder("doc_id", 5) != 0)


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn_quality(docs, training_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    return score_quality(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
