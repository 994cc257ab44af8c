"""The pipeline's stages take effect on all that the stage before kept."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as CP
from tessitura.llm import compression, privacy, tagger
from tests.conftest import SF
from tests.llm.test_operators import ODD, WORD, groups_of, plain_size


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in CP.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    good, bad = (labels[labels.quality == q].doc_id for q in (1, 0))  # eleven bad ones: the classifier learns from few here
    assert sum(d in kept for d in bad) / len(bad) < 0.5 * sum(d in kept for d in good) / len(good)
    pieces = CP.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == kept


def plain_pipeline(spark, docs: pd.DataFrame, ids) -> set[tuple]:
    """All five stages in plain Python; the trained models are those that the stages learn."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = compression.learn_quality(frame.select("doc_id", "text"), compression.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    texts = {}
    for d, t in zip(docs.doc_id, docs.text):
        b = (t or "").encode()
        good, bad = (plain_size(x, compression.QUALITY_LEVEL, compression.QUALITY_BLOCK, b) for x in (model.good, model.bad))
        if model.scores(np.array([[good, bad, len(b)]], float))[0] >= 0.3:
            texts[d] = t
    texts = {d: texts[d] for d, _, component in groups_of(list(texts.items())) if d == component}
    split = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    sets = lambda ws, k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    items = [split(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    clean = {}
    for d, t in texts.items():
        ws = split(t)
        if not any(i and 100 * len(sets(i, min(5, len(i))) & sets(ws, min(5, len(i)))) >= 75 * len(sets(i, min(5, len(i)))) for i in items):
            clean[d] = t
    out, params = set(), tagger.trained()
    for d, t in clean.items():
        if t:
            base = privacy.base_spans(t)
            every = sorted([*base, *privacy._added(t, base, privacy.tag_texts([t], params)[0])], key=lambda s: -s[1])
            for kind, i, j in every:
                t = t[:i] + f"<{kind}>" + t[j:]
        x, at = ids(t), 0
        rest = len(x) % 4096
        for n in [4096] * (len(x) // 4096) + [1 << k for k in range(12, -1, -1) if rest >> k & 1]:
            out.add((d, at, n, zlib.crc32(x[at : at + n].tobytes()), len(x)))
            at += n
    return out


def test_run_gives_the_plain_result(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    got = CP.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    want = plain_pipeline(spark, pd.read_parquet(f"{SF}/documents.parquet"), ids)
    assert len(got) == len(want) > 500 and {tuple(r) for r in got} == want


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns of the names that stages use, come through every stage; empty tables too."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _score double, row int, row_hash long, spans string, failed int, size int"
    rows = [(*r, len(r[1] or ""), 0.5, 0.25, 1, 2, "s", 0, 1) for r in ODD]
    for name, docs, labels, items in (
        ("odd", rows, [(6, 1, 0), (7, 1, 0), (1, 0, 0), (8, 0, None), (None, 1, 1), (1, None, 0)], [(1, "wort10 wort11 wort12 wort13 wort14 wort15"), (None, None), (2, None), (None, "x")]),
        ("empty", [], [], []),
        ("unlabelled", rows, [], []),
    ):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in CP.STAGES[:-1]:
            frame = function(spark, frame, f"{tmp_path}/{name}")
            assert frame.columns == [c.split()[0] for c in schema.split(", ")], stage
            kept = frame.collect()
            assert all((r["score"], r["_score"], r["row"], r["row_hash"], r["spans"], r["failed"]) == (0.5, 0.25, 1, 2, "s", 0) for r in kept)
        out = CP.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "empty")
        if name == "unlabelled":  # nothing is rejected: copies go, and one of two equal rows
            assert {r["doc_id"] for r in kept} == {None, 1, 2, 3, 4, 5, 6, 8, 9} and sum(r["doc_id"] == 5 for r in kept) == 1
            assert [r["text"] for r in kept if r["doc_id"] == 8] == ["mail <email> or <phone> now"] and [r["text"] for r in kept if r["doc_id"] == 2] == [None]
