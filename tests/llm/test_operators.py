"""The corpus operators against brute force, and on nulls, empty and odd input."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessitura.llm import bwt, compression, decontam, lm, neardup, packing, privacy, registry, rules, sharding, substrings, tagger
from tessitura.llm.components import components
from tests.conftest import SF

TOKENS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wort{k}" for k in range(400))
ODD = [
    (1, "Die Katze sitzt. " * 5, "de", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here at all, none", "en", "b"), (4, "  \n\t ", "fr", None),
    (5, "x", "en", "a"), (5, "x", "en", "a"), (6, LONG, "de", "b"), (7, LONG + " mehr", "de", "b"), (8, "mail bob.smith@example.com or +1 (555) 123-4567 now", "en", "a"), (9, "ÀÉ日本語 🙂 ümlaut", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, failed long, `key` string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 7, "k", 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENS)
    return lambda t: np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")


def check_pieces(out: pd.DataFrame, texts: dict, ids):
    for doc, own in out.groupby("doc_id"):
        x = ids(texts[doc])
        own = own.sort_values("start")
        assert own["length"].sum() == len(x) and (own["doc_tokens"] == len(x)).all()
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert all(zlib.crc32(x[a : a + n].tobytes()) == c for a, n, c in zip(own["start"], own["length"], own["ids_crc32"]))
    assert (out["length"] <= 4096).all() and (out["length"] & (out["length"] - 1) == 0).all() and out["sequence_id"].is_unique and (out["offset"] == 0).all()


def test_op1(spark, docs, ids):
    check_pieces(packing.op1_pack_binary(spark, SF).toPandas(), dict(zip(docs.doc_id, docs.text)), ids)


def test_packing_odd(odd, empty, ids):
    out = packing.digest(packing.pack(odd.filter("doc_id <> 5 OR doc_id IS NULL"), TOKENS)).toPandas()
    check_pieces(out[out.doc_id.notna()], {r[0]: r[1] for r in ODD}, ids)
    assert packing.pack(empty, TOKENS).count() == 0
    assert packing.binary_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def test_a_vocabulary_that_is_not_word_by_word_is_turned_down(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    other = Tokenizer(models.BPE(letters, []))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)  # keeps the white space
    other.save(f"{tmp_path}/other.json")
    with pytest.raises(ValueError, match="word by word"):
        packing.WordIds(f"{tmp_path}/other.json")


def test_op2(spark, docs):
    out = sharding.op2_kd_shards(spark, SF).toPandas()
    size = docs.text.fillna("").str.encode("utf-8").str.len() + 16
    assert sorted(out.doc_id) == sorted(docs.doc_id) and out["size"].sum() == size.sum()
    crc = {d: zlib.crc32((t or "").encode()) for d, t in zip(docs.doc_id, docs.text)}
    assert all(crc[d] == c for d, c in zip(out.doc_id, out.text_crc32))
    assert out["shard"].between(0, 39).all()
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_shards_are_even_and_keep_copies(spark):
    r = np.random.default_rng(0)
    frame = pd.DataFrame({"doc_id": np.arange(6000), "text": ["t" * int(n) for n in r.integers(50, 400, 6000)], "lang": r.choice(["en", "de"], 6000), "source": "s"})
    frame.loc[:399, "text"] = "the same text over and over"
    out = sharding.kd_shards(spark.createDataFrame(frame), 7).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 7 and sums.max() / sums.min() < 1.1
    assert out[out.doc_id < 400].groupby("text_crc32")["shard"].nunique().max() == 1


def test_a_group_over_a_shard_is_dealt_out_and_others_are_not(spark):
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"doc_id": np.arange(5000), "text": ["u" * int(n) for n in r.integers(1, 4000, 5000)], "lang": "en", "source": r.choice(["a", "b"], 5000)})
    frame.loc[:1999, "text"] = "hot " * 500  # two fifths of all bytes
    for k in range(2000, 2900):
        frame.loc[k, "text"] = f"group {k % 9} " * 180  # nine groups of most of a shard
    out = sharding.kd_shards(spark.createDataFrame(frame), 20).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 5000 and len(sums) == 20 and sums.max() / sums.mean() < 1.04 and sums.min() / sums.mean() > 0.96
    places = out.groupby(["text_crc32", "size"])["shard"].nunique()
    hot = zlib.crc32(("hot " * 500).encode())
    assert places.drop((hot, 2016)).max() == 1 and places[(hot, 2016)] >= 8


def plain_kd_tree(points: pd.DataFrame, leaves: int) -> np.ndarray:
    """The leaf of each point (at, tie, weight): cut at the weighted median of the widest dimension, in proportion to the leaves."""
    at, tie, weight = np.array(points["at"].tolist(), object), points["tie"].to_numpy(object), points["weight"].to_numpy()

    def split(mine, n):
        if n == 1 or not len(mine):
            return [mine] + [mine[:0]] * (n - 1)
        own = [[at[k][d] for k in mine] for d in range(4)]
        d = max(range(4), key=lambda d: max(own[d]) - min(own[d]))
        order = mine[np.argsort(np.array([at[k][d] * 2**31 + tie[k] for k in mine], np.int64), kind="stable")]
        sums, goal = np.cumsum(weight[order]), weight[order].sum() * (n // 2) / n
        k = int(np.searchsorted(sums, goal))
        below = sums[k] - weight[order[k]]
        k += not goal - below < sums[k] - goal
        return split(order[:k], n // 2) + split(order[k:], n - n // 2)

    out = np.empty(len(points), int)
    for leaf, mine in enumerate(split(np.arange(len(points)), leaves)):
        out[mine] = leaf
    return out


@pytest.mark.parametrize("leaves", [1, 5, 8])
def test_op2_agrees_with_a_plain_tree(spark, leaves):
    r = np.random.default_rng(7)
    frame = pd.DataFrame({"doc_id": r.permutation(3000), "text": [f"{k % 1700} " * (k % 1700 % 60 + 1) for k in range(3000)], "lang": r.choice(["en", "de", "fr"], 3000), "source": r.choice(["a", "b"], 3000)})
    frame.loc[:999, "doc_id"] //= 100  # ties
    docs = spark.createDataFrame(frame)
    out = sharding.kd_shards(docs, leaves, tolerance=1 << 40).toPandas()
    points = sharding._points(sharding._rows(docs)).toPandas()
    light = points["weight"].max() <= points["weight"].sum() // leaves / sharding.PIECE
    assert light  # no group is placed on its own
    points["leaf"] = plain_kd_tree(points, leaves)
    rows = sharding._rows(docs).select("doc_id", "text_crc32", "size", "text_hash").toPandas().merge(points, on=["text_hash", "size"])
    take = lambda f, c: sorted(zip(f["doc_id"], f["text_crc32"], f["size"], f[c]))
    assert take(out, "shard") == take(rows, "leaf")


def test_sharding_odd(odd, empty):
    out = sharding.kd_shards(odd, 3).toPandas()
    assert len(out) == len(ODD) and set(out["shard"]) <= {0, 1, 2}
    assert out[out.doc_id == 5]["shard"].nunique() == 1
    assert sharding.kd_shards(empty, 3).count() == 0


def test_op3_and_op5_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = compression.op3_zstd_language(spark, sf).toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98 and out["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    q = compression.op5_zstd_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out]
    assert (q[q.quality == 1].predicted == 1).mean() > 0.98 and (q[q.quality == 0].predicted == 0).mean() > 0.9


def test_compression_odd(odd, empty):
    learned = compression.learn_languages(odd.select("doc_id", "text", "lang"))
    out = compression.identify_languages(odd.select("doc_id", "text"), learned).toPandas()
    assert out[out.doc_id.isin([2, 3, 4])].lang_pred.eq("und").all() and (out.lang_pred == "und").sum() == 3
    nothing = compression.learn_languages(empty.select("doc_id", "text", "lang"))
    assert compression.identify_languages(odd.select("doc_id", "text"), nothing).filter("lang_pred <> 'und'").count() == 0
    labels = odd.sparkSession.createDataFrame([(6, 1), (7, 1), (1, 0), (8, 0)], "doc_id long, quality int")
    model = compression.learn_quality(odd, labels)
    assert compression.score_quality(odd.select("doc_id", "text"), model).filter("score BETWEEN 0 AND 1").count() == len(ODD)
    assert compression.score_quality(odd.select("doc_id", "text"), compression.learn_quality(empty, labels)).agg(F.min("score")).first()[0] == 1.0


def plain_size(dictionary: bytes, level: int, block: int, text: bytes) -> int:
    """Bytes of a text's blocks under a raw-content dictionary, less those of as many empty frames."""
    import zstandard as zs

    own = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
    press = zs.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
    blocks = [text[k : k + block] for k in range(0, len(text), block)]
    return sum(len(press.compress(b)) for b in blocks) - len(press.compress(b"")) * len(blocks)


def test_languages_and_quality_by_plain_sizes(spark, docs):
    """Every prediction and score again, from sizes by plain zstandard over whole texts."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    learned = compression.learn_languages(frame.select("doc_id", "text", "lang"))
    found = compression.identify_languages(frame.select("doc_id", "text"), learned).toPandas().set_index("doc_id")
    blank = lambda t: "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in t.lower()).encode()
    names = list(learned)
    for d, t in list(zip(docs.doc_id, docs.text))[:60]:
        if not re.search(r"[^\W\d_]", t or ""):
            assert found.lang_pred[d] == "und" and found.score[d] == 0
            continue
        sizes = np.array([plain_size(learned[n], compression.LANG_LEVEL, compression.LANG_BLOCK, blank(t)) for n in names], float)
        k = int(sizes.argmin())
        second = np.delete(sizes, k).min()
        assert found.lang_pred[d] == names[k] and found.rejected[d] == (second - sizes[k] < compression.MARGIN * max(sizes[k], 1))
        assert found.score[d] == pytest.approx(1 / np.exp(-compression.SHARPNESS * np.minimum(sizes - sizes[k], 500)).sum())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = compression.learn_quality(frame, labels)
    scores = compression.score_quality(frame.select("doc_id", "text"), model).toPandas().set_index("doc_id").score
    for d, t in list(zip(docs.doc_id, docs.text))[:60]:
        text = (t or "").encode()
        good, bad = (plain_size(x, compression.QUALITY_LEVEL, compression.QUALITY_BLOCK, text) for x in (model.good, model.bad))
        n = len(text) + 64
        apart, both, short = (bad - good) / n, (bad + good) / n, 64 / n
        x = np.array([apart, both, apart * both, apart**2, both**2, short, short * both])
        z = model.weights[0] + np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights[1:]
        assert scores[d] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_samples_are_bounded_and_whole(spark):
    rows = [(k, f"text {k} " * (1 + k % 50), "a" if k % 10 else "b") for k in range(3000)] + [(7, "the same id again", "a")] * 3 + [(5000, None, "a"), (5001, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    got = compression.sample(docs, known, "lang", counts, 100).collect()
    assert Counter(r["class"] for r in got) == {"a": 100, "b": 100} and {r["text"] for r in got} <= {r[1] for r in rows}
    every = compression.sample(docs, known, "lang", counts, 10**6).collect()
    assert Counter(r["class"] for r in every) == {"a": 2700, "b": 300}
    assert compression.sample(docs, known, "lang", counts, 100).exceptAll(spark.createDataFrame(got, "class string, rank int, text string")).count() == 0


def test_equal_sizes_go_to_the_more_frequent_language(spark):
    docs = spark.createDataFrame([(1, "gleich und gleich")], "doc_id long, text string")
    out = compression.identify_languages(docs, {"first": b"gleich", "second": b"gleich"}).first()
    assert (out["lang_pred"], out["score"], out["rejected"]) == ("first", 0.5, True)


def test_columns_of_the_results_names_give_way(spark):
    docs = spark.createDataFrame([(1, "Die Katze sitzt.", 0.1, "xx", True, "s")], "doc_id long, text string, score double, lang_pred string, rejected boolean, spans string")
    out = compression.identify_languages(docs, {"de": b"Die Katze"})
    assert sorted(out.columns) == ["doc_id", "lang_pred", "rejected", "score", "spans"] and out.first()["lang_pred"] == "de"
    out = compression.score_quality(docs, None)
    assert sorted(out.columns) == ["doc_id", "lang_pred", "rejected", "score", "spans"] and out.first()["score"] == 1.0
    out = privacy.find_private(docs)
    assert out.columns.count("spans") == 1 and out.first()["spans"] == []


def test_very_long_texts(spark):
    """A text of 10^5 words beside short ones: each operator works on all of it."""
    r = np.random.default_rng(14)
    words = [f"w{n}" for n in r.integers(0, 5000, 100_000)]
    long = " ".join(words[:99_990] + ["mail", "far.end@example.com"] + words[99_990:])
    docs = spark.createDataFrame([(1, long, "en"), (2, long + " more", "en"), (3, "short one here", "en"), (4, " ".join(words[50_000:50_020]), "en")], "doc_id long, text string, lang string")
    assert sorted(sharding.kd_shards(docs, 2).groupBy("shard").agg(F.sum("size")).toPandas().iloc[:, 1])[0] > 500_000
    assert compression.identify_languages(docs, compression.learn_languages(docs)).filter("lang_pred = 'en'").count() == 4
    model = compression.learn_quality(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int"))
    assert compression.score_quality(docs, model).count() == 4
    assert rules.ledger(docs).filter("doc_id = 1").first()["n_words"] == 100_002
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert near[1][0] > 99_900 and near[2][1] == 1 and near[4][1] == 4
    items = spark.createDataFrame([(1, " ".join(words[99_950:99_990])), (2, " ".join(words[50_000:50_020]))], "item_id long, text string")
    assert sorted((r[0], r[1]) for r in decontam.contained_items(docs, items).select("doc_id", "item_id").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 2)]
    scores = lm.lm_scores(docs).toPandas().set_index("doc_id")
    assert scores.n_tokens[1] == 100_003 and np.isfinite(scores.score).all()
    spans = {r["doc_id"]: r["spans"] for r in privacy.find_private(docs).collect()}
    at = long.index("far.end")
    assert (("email", at, at + 19) in [(s["kind"], s["start"], s["end"]) for s in spans[1]])
    pieces = packing.pack(docs, TOKENS).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(p["n"] == p["all"] for p in pieces)


def repeats(rows):
    first: dict[bytes, int] = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((d, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def as_digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept"))).collect()), key=str)


@pytest.mark.parametrize("common", [2000, 3])
def test_op4(spark, docs, common, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", common)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    assert as_digest(substrings.remove_repeats(frame, digest=True)) == repeats(list(zip(docs.doc_id, docs.text)))


def test_substrings_odd(spark, odd, empty):
    more = [(20, "z" * 49), (21, "z" * 50), (22, "z" * 200), (23, "ab" * 60), (24, "ba" * 60), (25, "é" * 40), (26, "é" * 26 + "x"), (27, "z" * 50)]
    rows = [(r[0], r[1]) for r in ODD] + more
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_digest(substrings.remove_repeats(frame, digest=True)) == repeats(rows)
    real = substrings.remove_repeats(frame).filter("doc_id = 27").first()
    assert bytes(real["kept"]) == b"" and [tuple(s) for s in real["spans"]] == [(0, 50)]
    assert substrings.remove_repeats(empty).count() == 0


def test_equal_hashes_of_different_snippets_are_told_apart(monkeypatch):
    text = np.frombuffer(b"abcdeabcdxabcdeab", np.uint8)
    starts, lengths = np.array([0, 5, 10, 15]), np.array([5, 5, 5, 2])
    assert sorted(substrings._differ(text, starts, lengths, np.zeros(4, int)).tolist()) == [1, 3]
    monkeypatch.setattr(substrings, "COMPARED", 3)
    assert sorted(substrings._differ(text, starts, lengths, np.array([0, 1, 0, 0])).tolist()) == [3]

    class Alike(substrings.Runs):  # every content hash and key is the same
        def __init__(self, data, offsets):
            super().__init__(data, offsets)
            self.content, self.key = np.zeros_like(self.content), np.zeros_like(self.key)

    monkeypatch.setattr(substrings, "Runs", Alike)
    r = np.random.default_rng(6)
    docs = [bytes(r.choice([97, 98], 300).astype(np.uint8)) for _ in range(3)]
    docs.append(docs[0])
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.arange(0, 1500, 300)
    reply = [{"reply": substrings.squeeze(np.ones(1, np.uint8))}]
    found = substrings.Snippets(np.arange(4), data, offsets, reply, 4)
    for k in range(len(found.of)):
        first = found.first[found.of[k]]
        assert data[found.start[k] : found.end[k]].tobytes() == data[found.start[first] : found.end[first]].tobytes()


def test_merged_transforms_find_all_repeats():
    r = np.random.default_rng(3)
    strings = [r.choice([97, 98], r.integers(3, 60)).astype(np.uint8) for _ in range(40)]
    owners = r.permutation(40)
    bwt_size, bwt.SHARD = bwt.SHARD, 200  # many shards
    try:
        got = bwt.least_by_window(strings, owners, 8)
    finally:
        bwt.SHARD = bwt_size
    least: dict[bytes, int] = {}
    for s, o in zip(strings, owners):
        for i in range(len(s) - 7):
            w = s[i : i + 8].tobytes()
            least[w] = min(least.get(w, 99), o)
    for s, g in zip(strings, got):
        assert g.tolist() == [least[s[i : i + 8].tobytes()] for i in range(len(s) - 7)]


def test_rules(spark, odd, empty, duck):
    out = rules.op6_rule_ledger(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(registry.ORACLES["op6_rule_ledger"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(out[sorted(out)], want[sorted(want)], check_dtype=False)
    found = rules.ledger(odd.drop("failed"))
    kept = rules.apply_policy(found, rules.BASE)
    assert kept.count() == len(ODD) and "text" not in kept.columns
    assert kept.filter("doc_id IN (2, 3, 4, 5) AND kept").count() == 0
    whole = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r["failed"] for r in whole.select("failed").collect()]
    for policy in (rules.BASE, rules.STANDARD):
        for row in rules.ablations(whole, policy).collect():
            k = [name for name, _ in rules.RULES].index(row["rule"])
            assert row["n_failed"] == sum(b >> k & 1 for b in bits) and row["n_only"] == sum(b & policy.mask == 1 << k for b in bits)
    clash = rules.ledger(odd.withColumn("n_words", F.lit("x")))
    assert clash.columns.count("n_words") == clash.columns.count("failed") == 1 and clash.filter("doc_id = 6").first()["n_words"] == 400
    symbols = rules.ledger(spark.createDataFrame([(1, "🙂🙂 — … ✓ a é 日 ж")], "doc_id long, text string")).first()
    assert symbols["n_letter_words"] == 4
    table = {r["rule"]: r for r in rules.ablations(found, rules.BASE).collect()}
    assert table["few_words"]["n_failed"] == found.filter("n_words < 10").count() >= table["few_words"]["n_only"]
    assert rules.ledger(empty.drop("failed")).count() == 0 and rules.ablations(rules.ledger(empty.drop("failed")), rules.BASE).first()["n_failed"] == 0


def sets_of(rows):
    out = []
    for d, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def groups_of(rows):
    sets = sets_of(rows)
    least = {k: k for k in range(len(sets))}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                least[root(i)] = root(j)
    ids: dict[int, list] = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            ids.setdefault(root(k), []).append(d)
    return sorted(((d, len(s), min(ids.get(root(k), [None]), key=lambda x: (x is None, x))) for k, (d, s) in enumerate(sets)), key=str)


def test_near_duplicates(spark, docs, odd, empty):
    rows = list(zip(docs.doc_id, docs.text))
    take = lambda df: sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert take(neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))) == groups_of(rows)
    assert take(neardup.near_duplicates(odd)) == groups_of([(r[0], r[1]) for r in ODD])
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.representatives(odd).filter("doc_id = 5").count() == 1


def test_a_family_of_near_copies(spark):
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(250):
        own = list(base if d % 5 else rows[r.integers(len(rows))][1].split() if rows else base)
        for k in r.choice(120, r.integers(0, 7), replace=False):
            own[k] = f"m{d}x{k}" if r.random() < 0.7 else f"s{k}"
        rows.append((d, " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == sorted(groups_of(rows))


def test_many_short_texts_and_nulls(spark):
    """10^5 texts of few shingles: no band or id is common, and links are those of brute force over shared shingles."""
    r = np.random.default_rng(12)
    rows = [(None if k % 3 == 0 else k, " ".join(f"{w}" for w in r.integers(0, 10**12, n))) for k, n in enumerate(r.integers(1, 9, 100_000))]
    for k in range(300):  # one word more than another text
        rows.append((200_000 + k, rows[1 + 3 * k][1] + f" more{k}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(t[0], t[1]) for t in neardup.near_duplicates(frame).filter("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id", "component_id").collect()}
    sets = sets_of([x for x in rows if x[0] is not None and (x[0] >= 200_000 or x[0] in {1 + 3 * k for k in range(300)})])
    by_id = dict(sets)
    want = set()
    for k in range(300):
        a, b = by_id[1 + 3 * k], by_id[200_000 + k]
        if 100 * len(a & b) >= 75 * len(a | b):
            want.add((200_000 + k, 1 + 3 * k))
    assert want and got == want
    keys = neardup._sketch(frame, 5, 75).select(F.explode("keys").alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] <= 4


def test_prefixes_and_bands_meet_across_the_sizes(spark):
    """Sets around SMALL and 4/3 of it: every pair that is similar shares a key."""
    r = np.random.default_rng(13)
    rows = []
    for base in range(120):
        words = [f"b{base}w{k}" for k in range(int(r.integers(7, 60)))]
        cut = int(len(words) - 4 - np.floor((len(words) - 4) * 0.75)) if len(words) > 8 else 0
        rows.append((2 * base, " ".join(words)))
        rows.append((2 * base + 1, " ".join(words[: len(words) - int(r.integers(0, cut + 2))])))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == sorted(groups_of(rows))


def test_representatives_of_repeated_ids(spark):
    long = [f"w{k}" for k in range(60)]
    near = [*long[:-1], "x"]
    rows = [(1, " ".join(long)), (5, " ".join(near)), (5, "a clean text of its own with some more words"), (7, "twice the same"), (7, "twice the same"), (8, None), (8, None), (None, "no id"), (9, " ".join(near + ["y"])), (9, " ".join(near + ["z"]))]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, row int")
    kept = sorted(((d, t) for d, t, _ in neardup.representatives(frame).collect()), key=str)
    assert kept == sorted([(1, " ".join(long)), (5, "a clean text of its own with some more words"), (7, "twice the same"), (8, None), (None, "no id")], key=str)
    alone = spark.createDataFrame([(9, " ".join(near + ["y"])), (9, " ".join(near + ["z"]))], "doc_id long, text string")
    assert neardup.representatives(alone).count() == 1


def test_registers_estimate():
    r = np.random.default_rng(9)
    pool = r.integers(0, 2**64, 30000, dtype=np.uint64)
    a, b = np.unique(pool[:20000]), np.unique(pool[5000:25000])
    regs = [neardup.registers(x, np.zeros(len(x), np.int64), 1) for x in (a, b)]
    j, used = neardup.estimate(*regs, np.array([len(a)]), np.array([len(b)]))
    assert used[0] == neardup.REGISTERS and abs(j[0] - 15000 / 25000) < 0.15


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    found = {r[0]: r[1] for r in components(links).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 50: 50, 51: 50}


def test_private(spark, odd, empty):
    out = privacy.op8_bilstm_crf(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    email, ip, phone = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for row in out.itertuples():
        t = docs[row.doc_id]
        spans = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
        spans += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        joined = ",".join(f"{k}:{i}:{j}" for k, i, j in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {f"{k}:{i}:{j}" for k, i, j in spans} <= set(row.spans.split(","))
    found = {r["doc_id"]: r["spans"] for r in privacy.find_private(odd.select("doc_id", "text")).collect()}
    assert [s["kind"] for s in found[8]] == ["email", "phone"] and not found[6] and not found[2]
    hidden = {r["doc_id"]: r["text"] for r in privacy.redact(odd).collect()}
    assert hidden[8] == "mail <email> or <phone> now" and hidden[2] is None and hidden[6] == LONG
    assert privacy.find_private(empty.select("doc_id", "text")).count() == 0


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_tags(text: str, params: dict) -> list[int]:
    """Every window of the whole text through the two LSTMs a character at a time, then the best path, in plain loops."""
    codes, H = tagger.classes(text), tagger.HIDDEN
    scores, weights = np.zeros((len(codes), tagger.TAGS)), np.zeros((len(codes), 1))
    squash = lambda z: 1 / (1 + np.exp(-z))

    def states(x, wx, u):
        h, c, out = np.zeros(H), np.zeros(H), []
        for k in x:
            z = wx[k].astype(float) + h @ u
            i, f, o, g = squash(z[:H]), squash(z[H : 2 * H]), squash(z[2 * H : 3 * H]), np.tanh(z[3 * H :])
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
        return out

    for a in range(0, max(1, len(codes) - tagger.STRIDE), tagger.STRIDE):
        x = list(codes[a : a + tagger.WINDOW]) + [0] * max(0, a + tagger.WINDOW - len(codes))
        forth, back = states(x, params["wf"], params["uf"]), states(x[::-1], params["wb"], params["ub"])[::-1]
        for t in range(min(tagger.WINDOW, len(codes) - a)):
            hill = min(t, tagger.WINDOW - 1 - t) + 1
            scores[a + t] += hill * (np.concatenate([forth[t], back[t]]) @ params["out"] + params["bias"])
            weights[a + t] += hill
    e, full = scores / weights, params["trans"] + tagger.BARRED
    best, came = [e[0]], []
    for t in range(1, len(e)):
        both = best[-1][:, None] + full
        came.append(both.argmax(0))
        best.append(both.max(0) + e[t])
    path = [int(best[-1].argmax())]
    for step in reversed(came):
        path.append(int(step[path[-1]]))
    return path[::-1]


def test_spans_are_those_of_a_plain_decoder():
    """Windows that are skipped hold nothing: the spans that are kept are those of decoding every window of the text."""
    import random

    r, params, both, ours, theirs = random.Random(5), tagger.trained(), 0, 0, 0
    for n in range(12):
        parts = [" ".join(tagger._word(r) for _ in range(40)), tagger.labelled_text(r, 120)[0], " ".join(tagger._word(r) for _ in range(30)), "password: correct-horse-battery and more", tagger.labelled_text(r, 60)[0]]
        text = " ".join(r.sample(parts, len(parts)))
        base = privacy.base_spans(text)
        got = set(privacy._added(text, base, privacy.tag_texts([text], params)[0]))
        want = set(privacy._added(text, base, sorted(privacy._spans(np.array(plain_tags(text, params))), key=lambda s: s[1])))
        both, ours, theirs = both + len(got & want), ours + len(got), theirs + len(want)
    assert both >= 0.95 * theirs and both >= 0.95 * ours and theirs > 10


def test_stretches_of_a_long_region_are_decoded_as_a_whole(monkeypatch):
    import random

    r, params = random.Random(11), tagger.trained()
    # a digit in every cell: one region
    text = " ".join(tagger.labelled_text(r, 20)[0] + " 12" for _ in range(900)) + "1 2" * 7000
    assert [(i, j) for i, j in privacy._regions(text)] == [(0, len(text))] and len(text) > 15 * privacy.STRETCH
    cut = privacy.tag_texts([text, "", text[:5000]], params)
    monkeypatch.setattr(privacy, "STRETCH", 1 << 20)
    whole = privacy.tag_texts([text, "", text[:5000]], params)
    assert cut == whole and len(whole[0]) > 100 and whole[1] == []


def test_a_region_of_megabytes():
    text = "12 3-45 " * 250_000
    found = privacy.tag_texts([text], tagger.trained())[0]
    assert all(0 <= i < j <= len(text) for _, i, j in found) and [s[1] for s in found] == sorted(s[1] for s in found)


def test_what_is_added_fits_its_kind():
    fits = lambda kind, text, before="": privacy._fits(before + text, kind, len(before), len(before + text))
    assert fits("card", "378282246310005") and not fits("card", "378282246310006") and not fits("card", "4" * 20)
    assert fits("ip", "10.0.0.1") and not fits("ip", "10.0.0.999")
    assert fits("secret", "correct-horse-battery", "password: ") and not fits("secret", "correct-horse-battery", "the word ") and fits("secret", "ghp_abcdefghijkl")
    assert privacy.base_spans("0" * 10**6 + ".1.1.1") == [("ip", 0, 10**6 + 6)] and privacy.base_spans("1" * 10**6 + ".1.1.1") == []


def test_tagger_on_new_labelled_text():
    import random

    r, params, hit, spans, false = random.Random(99), tagger.trained(), 0, 0, 0
    for _ in range(60):
        text, tags = tagger.labelled_text(r, 400)
        found = {(i, j) for _, i, j in privacy.tag_texts([text], params)[0]}
        want = {(i, j) for _, i, j in privacy._spans(tags)}
        hit, spans, false = hit + len(found & want), spans + len(want), false + len(found - want)
    assert hit / spans > 0.9 and false / spans < 0.1


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "+" * 100_000, "1." * 100_000, "0" * 200_000 + ".1.1.1", "key=" * 50_000):
        privacy.base_spans(text)


def test_containment(spark, duck, odd, empty):
    out = decontam.op9_minhash_containment(spark, SF).toPandas()
    want = duck.sql(registry.ORACLES["op9_minhash_containment"]).df()
    assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, want[out.columns].values.tolist()))
    items = spark.createDataFrame([(1, "wort10 wort11 wort12 wort13 wort14 wort15"), (2, "Katze sitzt."), (3, None), (None, "x"), (4, "  "), (5, "x")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontam.contained_items(odd, items).collect())
    assert found == [(1, 2), (5, 5), (5, 5), (6, 1), (7, 1)]
    assert decontam.contained_items(empty, items).count() == 0 and decontam.contained_items(odd, items.limit(0)).count() == 0
    clean = decontam.decontaminated(odd, items)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {None, 2, 3, 4, 8, 9}


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    whole = decontam.op9_minhash_containment(spark, SF).toPandas()
    assert len(whole) and not whole.duplicated().any()


def test_lm(spark, docs, odd, empty):
    out = lm.op10_log_bilinear(spark, SF).toPandas()
    fold = {c: c + 32 for c in range(65, 91)}
    words = {d: [*WORD.findall((t or "").translate(fold)), 0] for d, t in zip(docs.doc_id, docs.text)}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for row in out.itertuples():
        ws = words[row.doc_id]
        assert row.n_tokens == len(ws) and row.n_known == sum(counts[w] > 0 for w in ws) and row.train_tokens == n
        assert row.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() and held.model_score.sum() > held.base_score.sum() and np.isfinite(out.score).all()
    small = lm.lm_scores(odd).toPandas()
    assert len(small) == len(ODD) and np.isfinite(small.score).all() and small[small.doc_id == 2].n_tokens.tolist() == [1]
    assert lm.lm_scores(empty).count() == 0


def test_lm_agrees_with_a_plain_loop(spark, docs, monkeypatch):
    """Scores of whole texts word by word: counts of pairs in a dictionary, each softmax over all its choices."""
    kept = {}
    trained = lm._trained
    monkeypatch.setattr(lm, "_trained", lambda blocks, vocabulary: kept.setdefault("model", (trained(blocks, vocabulary), vocabulary))[0])
    out = lm.op10_log_bilinear(spark, SF).toPandas().set_index("doc_id")
    p, vocabulary = kept["model"]
    freq, fold, end = vocabulary.frequencies, {c: c + 32 for c in range(65, 91)}, "\n"
    texts = {d: [*WORD.findall((t or "").translate(fold)), end] for d, t in zip(docs.doc_id, docs.text)}
    counts, pairs = Counter(), Counter()
    for d, ws in texts.items():
        if lm.trains(d):
            counts.update(ws)
            pairs.update(zip([end, *ws], ws))
    followers = Counter(a for a, _ in pairs)
    data = {w: np.frombuffer(w.encode(), np.uint8) for ws in texts.values() for w in ws}
    hashed = {w: int(lm.W.word_hashes(b, np.array([0]), np.array([len(b)]), True)[0]) for w, b in data.items() if w != end}
    symbol, group = {end: (vocabulary.end, -1)}, Counter()
    for w, h in hashed.items():
        s, own = vocabulary.numbers(np.array([h], np.uint64))
        symbol[w] = int(s[0]), -1 if own[0] else int(lm._groups(np.array([h], np.uint64))[0])
    mass, kinds = Counter(), Counter()
    for w, n in counts.items():
        mass[symbol[w][1]] += n
        kinds[symbol[w][1]] += 1

    def softmax(h, rows, bias, k):
        x = np.exp(rows.astype(float) @ h + bias)
        return x[k] / x.sum()

    for d in list(texts)[:: len(texts) // 25]:
        before, score, model = [end] * lm.L.ORDER, 0.0, 0.0
        for w in texts[d]:
            h = sum(p["r"][symbol[c][0]].astype(float) * p["c"][k] for k, c in enumerate(reversed(before)))
            s, g = symbol[w]
            own = slice(s // freq.side * freq.side, (s // freq.side + 1) * freq.side)
            one = softmax(h, p["q_class"], p["b_class"], s // freq.side) * softmax(h, p["q_word"][own], p["b_word"][own], s % freq.side)
            if g >= 0:
                one *= (counts[w] + 0.1) / (mass[g] + 0.1 * (kinds[g] + 1))
            model += np.log10(one)
            c = before[-1]
            both = (max(pairs[c, w] - 0.75, 0) + 0.75 * followers[c] * one) / counts[c] if counts[c] else one
            score += np.log10(both)
            before = [*before[1:], w]
        assert out.model_score[d] == pytest.approx(model, rel=1e-4) and out.score[d] == pytest.approx(score, rel=1e-4)


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    freq = lm.L.Frequencies(np.sort(r.poisson(30, 70))[::-1])
    p = lm.L.start(freq)
    words, first = r.integers(0, 70, 5000).astype(np.int32), np.arange(0, 5001, 50)
    text, places = lm.L.stream(words, first, 3)
    assert (text[places] == words).all() and text[places[51] - 4 : places[51]].tolist()[:3] == [3, 3, 3] and text[places[51] - 1] == words[50]
    lm.L.learn(p, freq, text, np.ones(len(text), bool), lm.L.Adagrad(p), lm.L.Weights(freq))
    for k in places[:9]:
        every = [lm.L.log_probabilities(p, freq, np.append(text[:k], w).astype(np.int32), k, k + 1)[0] for w in range(70)]
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns_from_more_than_the_word_before():
    """The word repeats that of three places before: a model of one word of context could not tell."""
    r = np.random.default_rng(2)
    words = np.tile(r.integers(0, 30, (1500, 3)), 8).ravel().astype(np.int32)
    freq = lm.L.Frequencies(np.full(30, 1000))
    text, places = lm.L.stream(words, np.arange(0, len(words) + 1, 24), 0)
    p = lm.L.start(freq)
    began = lm.L.log_probabilities(p, freq, text, 4, len(text))[places - 4].mean()
    for _ in range(12):
        lm.L.learn(p, freq, text, np.isin(np.arange(len(text)), places), lm.L.Adagrad(p), lm.L.Weights(freq))
    later = np.arange(len(words)) % 24 > 2
    assert lm.L.log_probabilities(p, freq, text, 4, len(text))[places - 4][later].mean() > 0.5 * began


def test_lm_step_agrees_with_a_plain_loop():
    """One step over a stream of which some places are left out, token by token in float64."""
    L, r = lm.L, np.random.default_rng(7)
    freq, word = L.Frequencies(np.sort(r.poisson(30, 70))[::-1]), r.integers(0, 70, 400).astype(np.int32)
    p = L.start(freq)
    p["b_word"] += r.normal(0, 0.1, len(p["b_word"])).astype(np.float32)
    q = {k: v.astype(float) for k, v in p.items()}
    wanted = r.random(400) < 0.8
    wanted[:4] = False
    up, side = {k: np.zeros_like(v) for k, v in q.items()}, freq.side
    for t in np.flatnonzero(wanted):
        h = sum(q["c"][k] * q["r"][word[t - 1 - k]] for k in range(4))
        back = np.zeros(L.WIDTH)
        own = word[t] // side
        for name, rows, target, drawn in (("class", np.arange(freq.classes), own, freq.noise_class), ("word", np.arange(own * side, (own + 1) * side), word[t] % side, freq.noise_word[own])):
            drawn = L.NOISE * drawn.astype(float)
            data = 1 / (1 + np.exp(-(q[f"q_{name}"][rows] @ h + q[f"b_{name}"][rows] - np.log(np.maximum(drawn, 1e-30)))))
            g = -drawn * data
            g[target] = 1 - data[target] - drawn[target] * data[target]
            back += g @ q[f"q_{name}"][rows]
            up[f"q_{name}"][rows] += g[:, None] * h
            up[f"b_{name}"][rows] += g
        for k in range(4):
            up["r"][word[t - 1 - k]] += back * q["c"][k]
            up["c"][k] += back * q["r"][word[t - 1 - k]]
    L.learn(p, freq, word, wanted, L.Adagrad(p), L.Weights(freq))
    for k, g in up.items():
        g *= 32 / wanted.sum()
        assert np.allclose(p[k], q[k] + L.RATE * g / np.sqrt((1e-2 if g.ndim == 2 else 1) + g * g), atol=2e-5), k


def test_lm_step_takes_a_few_times_what_its_scores_take():
    """A token has a score for each class and each word of its class; learning takes less than 2.5 times the hyperbolic tangents of these."""
    r = np.random.default_rng(8)
    freq = lm.L.Frequencies((1e6 / np.arange(1, 3001)).astype(np.int64))
    text = np.minimum(r.zipf(1.2, 60_000), 3000).astype(np.int32) - 1
    p, x, took = lm.L.start(freq), r.normal(size=(4096, freq.side)).astype(np.float32), []

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    for _ in range(5):
        ours = seconds(lambda: lm.L.learn(p, freq, text, np.ones(len(text), bool), lm.L.Adagrad(p), lm.L.Weights(freq)))
        took.append(ours / seconds(lambda: [np.tanh(x) for _ in range(2 * len(text) // len(x))]))
    assert min(took) < 2.5


def test_lm_words_are_looked_up_once_a_block():
    """What a block keeps gives the hash of every word, document by document."""
    texts = ["One two TWO one", "", None, "three", "two  three\nfour"]
    plain = [[int(lm.W.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), True)[0]) for w in (t or "").split()] for t in texts]
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t or "") for t in texts]])
    for size in (data, data[:0]):
        kept = lm._coded(size, offsets if len(size) else offsets * 0)
        ids, first, keys, codes = lm._opened(lm.pa.scalar([1, 2, None, 4, 5]), *[column[0] for column in kept])
        assert ids == [1, 2, None, 4, 5] and (np.diff(keys) > 0).all() and len(first) == len(texts) + 1
        found = [[int(h) for h in keys[codes[a:b]]] for a, b in zip(first[:-1], first[1:])]
        assert found == (plain if len(size) else [[]] * len(texts))


def test_mean_of_models_leaves_what_no_task_has_seen():
    freq = lm.L.Frequencies(np.arange(9, 0, -1))
    p = lm.L.start(freq)
    a, b = ({k: v + d for k, v in p.items()} for d in (1, 3))
    once = lm.L.Weights(freq)
    once.of_symbol[:2], once.of_class[0], once.total = 1, 2, 2
    got = lm.L.mean(p, freq, lm.L.weighed(a, freq, once) + lm.L.weighed(b, freq, once))
    assert np.allclose(got["r"][:2], p["r"][:2] + 2, atol=1e-5) and np.allclose(got["r"][2:], p["r"][2:])
    assert np.allclose(got["q_word"][:3], p["q_word"][:3] + 2, atol=1e-5) and np.allclose(got["q_word"][3:], p["q_word"][3:]) and np.allclose(got["c"], p["c"] + 2, atol=1e-5)


def test_lm_learns_from_every_token(spark, monkeypatch):
    """Each word stands in a stretch of its own, so that each is learned from where no stretch is passed over."""
    kept, trained = {}, lm._trained
    monkeypatch.setattr(lm, "_trained", lambda blocks, vocabulary: kept.setdefault("model", (trained(blocks, vocabulary), vocabulary))[0])
    doc = next(k for k in range(99) if lm.trains(k))
    lm.lm_scores(spark.createDataFrame([(doc, " ".join(f"w{k}" for k in range(50) for _ in range(20)))], "doc_id long, text string"))
    p, vocabulary = kept["model"]
    moved = (p["r"] != lm.L.start(vocabulary.frequencies)["r"]).all(1)
    assert len(vocabulary.keys) == 50 and moved[vocabulary.symbols].all()


def test_lm_pairs_of_rare_words(spark):
    """Two texts of the same words, none of them a symbol of its own: the one whose pairs were seen scores higher."""
    common = " ".join(f"common{k}" for k in range(1200))
    rows = [(k, f"{common} {common} alpha{k % 7} beta{k % 7} gamma{k % 7}") for k in range(140)]
    seen = [(1000 + k, f"alpha{k} beta{k} gamma{k}") for k in range(7)]
    mixed = [(2000 + k, f"alpha{k} beta{(k + 1) % 7} gamma{(k + 2) % 7}") for k in range(7)]
    training = {d for d, _ in rows if lm.trains(d)}
    assert lm.vocabulary_size(140 * 2 * len(common)) < 1200
    out = lm.lm_scores(spark.createDataFrame([*rows, *[(None, t) for _, t in seen + mixed]], "doc_id long, text string")).toPandas()
    held = out[out.doc_id.isna()]
    assert len(training) > 100 and len(held) == 14 and (held.n_tokens == 4).all()
    assert held.score.nlargest(7).min() > held.score.nsmallest(7).max() + 2


def test_languages_beyond_one_block(spark, monkeypatch):
    """70 languages of words of their own: the rarest one is learned and found, and blocks of languages change no result."""
    words = {k: " ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(12)) for k in range(70)}
    rows = [(k * 3 + j, words[k], f"l{k:02d}") for k in range(70) for j in range(1 if k == 69 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = compression.learn_languages(docs)
    assert set(learned) == {f"l{k:02d}" for k in range(70)}
    found = compression.identify_languages(docs, learned).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.lang_pred.tolist() == [r[2] for r in rows] and not found.rejected.any()
    monkeypatch.setattr(compression, "LANGS", 100)
    whole = compression.identify_languages(docs, learned).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(found, whole)


def test_pack_marks_behind_words_skip_the_splitter(monkeypatch):
    """Words with runs of marks behind them get the tokenizer's own ids, from the ids of both parts."""
    import public_tokenizers

    from tessitura.llm import packing

    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"{w}{m}" for w in ("junk", "STOP", "façade", "Öl") for m in ("###", "$$$", ".%%%", ",&&&", "!!", "...", "***", "%", "$.#")]
    want = {w: ids._whole(w) for w in words}
    asked = []
    whole = ids._whole
    monkeypatch.setattr(ids, "_whole", lambda w: (asked.append(w), whole(w))[1])
    assert {w: ids[w] for w in words} == want
    assert not any(c.isalpha() for w in asked for c in w)
