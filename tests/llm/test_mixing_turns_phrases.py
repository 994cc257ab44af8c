"""Mixing, conversation repair and phrases against plain Python and their SQL, and on odd input."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.llm import conversations, mixing, phrases, tries
from tests.conftest import SF
from tests.test_catalog import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, step string, Size long, copies int, weight double"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 9, 0.5) for r in rows], SCHEMA)


def test_op11(spark, duck):
    same(mixing.op11_systematic_mix(spark, SF).toPandas(), duck.sql(mixing.ORACLE).df())


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{k}": draw.choice([0, 1, 10, 1000, 50000]) + draw.randrange(3) for k in range(draw.randrange(1, 9))} | ({None: 700} if seed % 2 else {})
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx(want, rel=1e-12)
    assert all(0 <= r["offset"] < mixing.SCALE for r in found)


def test_mix_odd_and_hot(spark):
    draw = random.Random(5)
    rows = [(k, " ".join(["w"] * draw.choice([1, 3, 50, 51, 52, 400])), "en", "hot" if k % 3 else f"s{k % 5}") for k in range(3000)]
    rows += [(None, None, None, None), (7, "", None, None), (9, "a b", None, None), (9, "a b", None, None), (10, "\t\n ", "en", "no words"), (11, "ü 日本 x", "en", "hot")]
    docs = docs_of(spark, rows)
    out = mixing.mix_plan(docs).toPandas()
    assert sorted(out["size"]) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert out["copies"].between(0, 2).all()
    by = out.assign(taken=out["size"] * out["copies"]).groupby("target").agg({"taken": "sum", "source_size": "first", "size": "max"})
    assert (abs(by["taken"] - by.index) <= 2 * by["size"] + 0.05 * by.index).all()
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "copies"]
    pd.testing.assert_frame_equal(*(x.sort_values(key).reset_index(drop=True) for x in (out, again)))

    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    count = mix.groupBy("doc_id", "text").count().toPandas()
    assert count["count"].sum() == out["copies"].sum()
    assert mix.filter("doc_id = 100").count() == out[out.doc_id == 100]["copies"].iloc[0]
    empty = docs.limit(0)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixture(empty).count() == 0
    assert mixing.mix_plan(docs_of(spark, [(1, None, None, None), (2, " ", None, "a")])).select("target", "copies").collect() == [(0.0, 0), (0.0, 0)]


# conversations


def test_op12(spark, duck):
    same(conversations.op12_fold_repair(spark, SF).toPandas(), duck.sql(conversations.ORACLE).df())


def plain_repair(turns):
    """The cheapest edits by a search over (turns read, state), least (cost, audit) first."""
    queue, seen = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, at, state, kept = heapq.heappop(queue)
        if (at, state) in seen:
            continue
        seen[at, state] = 1
        if at == len(turns) and state in ("", "a"):
            return cost, audit, list(kept)
        need = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 2, audit + "I", at, need[0], (*kept, (need, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, need[0], (*kept, (need, text))))
                if role[:1] == need[0] or (role[:1] == "s" and state == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[:1], (*kept, (role, text))))
    raise AssertionError


def plain_conversation(rows):
    faults, seen = [], set()
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    cost, audit, kept = plain_repair([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    return max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_a_search(spark):
    draw = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "Why?", "", None, " \t\n", "Ja! \n", "日本。"]
    convs = {c: [(draw.choice([None, *range(6)]), draw.choice(roles), draw.choice(texts)) for _ in range(draw.randrange(0, 9))] for c in range(150)}
    convs[None] = [(1, "user", "A null conversation.")] * 2
    rows = [(c, *r, "clash", 0, True) for c, own in convs.items() for r in own]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, cost string, place int, illegal boolean")
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.digest(conversations.repair(df)).collect()}
    assert found == {c: plain_conversation(own) for c, own in convs.items() if own}


def test_every_short_conversation_of_three_roles(spark):
    convs = {k: list(c) for k, c in enumerate(c for n in range(5) for c in itertools.product(["user", "assistant", "system"], repeat=n)) if c}
    rows = [(c, t, r, f"{t}.") for c, own in convs.items() for t, r in enumerate(own)]
    found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(convs)
    for r in found:
        cost, audit, kept = plain_repair([(role, f"{t}.", "") for t, role in enumerate(convs[r["conv_id"]])])
        assert (r["cost"], r["audit"], [tuple(x) for x in r["repaired"]]) == (cost, audit, kept)
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in r["repaired"]))


def test_damage(spark):
    rows = [(c, t, "assistant", "So. It goes!") for c in range(40) for t in (None, *range(5))] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            want += [(c, t, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.damaged(df)
    assert Counter(map(tuple, found.filter("there").drop("there").collect())) == Counter(want)
    # a conversation of dropped turns alone is returned
    gone = conversations.digest(conversations.repair(found.withColumn("there", F.lit(False)))).filter("conv_id = 1").collect()[0]
    assert [gone[c] for c in COLUMNS] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert conversations.repair(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t} " + "and so on " * 50 + ".") for t in range(3001)]
    out = conversations.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.count() == 3002 and out.filter("text = ''").select("turn", "role").collect() == [(3001, "assistant")]


# phrases


def test_op13(spark, duck):
    same(phrases.op13_trie_phrases(spark, SF).toPandas(), duck.sql(phrases.ORACLE).df())


def sample_texts(seed: int, n: int):
    draw = random.Random(seed)
    words = ["the", "of", "Rare", "heiß", "日本", "x" * 30, *[f"w{k}" for k in range(40)]]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", ";:"]
    texts = ["".join(draw.choice(words[: draw.choice([3, 8, 46])]) + draw.choice(marks) for _ in range(draw.randrange(0, 80))) for _ in range(n)]
    return [(k, t, draw.choice(["en", "en", "en", "de", None]), "s") for k, t in enumerate(texts)] + [(None, None, "en", None), (1, "", None, None), (2, ".,\n ;", "fr", None)]


@pytest.mark.parametrize("leaves, places", [(1 << 22, 1 << 22), (400, 1 << 22), (60, 50)])
def test_phrases_in_ranges_and_stretches(spark, monkeypatch, leaves, places):
    """Hot first words are cut into ranges, long texts into tries: nothing changes."""
    monkeypatch.setattr(phrases, "_GAP", 16)
    rows = sample_texts(3, 400)
    docs = docs_of(spark, rows).repartition(3)
    monkeypatch.setattr(phrases.shard_tries, "__defaults__", (20000, places))
    shards = phrases.shard_tries(docs, 20000, places)
    assert leaves > 1000 or len(phrases._bounds(shards, leaves)) > 3
    con = duckdb.connect()
    documents = pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "lang"])  # noqa: F841  (read by the SQL)
    same(phrases.phrases(docs, shard_bytes=20000, range_leaves=leaves).toPandas(), con.sql(phrases.ORACLE).df())


def test_a_very_common_pair(spark, monkeypatch):
    """A third of all places start with one pair: its branch is cut, and its count is summed over the ranges."""
    monkeypatch.setattr(phrases, "_GAP", 16)
    docs = docs_of(spark, [(k, f"so far {k} {k + 1} so far {k + 2}", "en", "s") for k in range(800)])
    shards = phrases.shard_tries(docs)
    bounds = phrases._bounds(shards, 300)
    assert len(bounds) > 8 and sum(b[1:3] == (b"so", b"far") for b in bounds) > 2
    nodes = {r["phrase"]: r["f"] for r in phrases.phrase_counts(shards, 30, 300).collect()}
    assert nodes == {"so": 1600, "far": 1600, "so far": 1600}


def test_phrases_of_nothing(spark):
    docs = docs_of(spark, [(1, None, None, None), (2, " .\n", "en", "a"), (3, "one word", "en", "a")])
    assert phrases.phrases(docs).count() == 0 and phrases.phrases(docs.limit(0)).count() == 0


def test_tries_round_trip():
    draw = random.Random(2)
    text = " ".join(draw.choice(["a", "b", "cc", "ß", "d."]) for _ in range(2000)).encode()
    pieces = [p.split() for p in text.decode().split(".")]
    want = Counter(tuple(p[i : i + n]) for p in pieces for i in range(len(p)) for n in range(1, 5) if i + n <= len(p))
    for most in (10_000, 300, 7):
        parts = [t for t, _ in tries.built(text, most)]
        assert sum(n for _, n in tries.built(text, most)) == sum(map(len, pieces))
        for t in parts:
            back = tries.loaded(tries.dumped(t))
            assert back.words.equals(t.words) and (back.counts == t.counts).all() and all((a == b).all() for a, b in zip(back.paths, t.paths))
        whole = tries.merged(parts)
        assert {tuple(p.split(" ")): f for p, f, _, _ in tries.walked(whole, 1)} == dict(want)
        edges = [0, *sorted(draw.sample(range(len(whole.counts)), 5)), len(whole.counts)]
        bounds = [tries.leaf(whole, e) for e in edges[1:-1]]
        assert tries.places(whole, bounds) == edges[1:-1]
        got = Counter()
        for a, b in zip(edges, edges[1:]):
            for p, f, _, _ in tries.walked(tries.cut(whole, a, b), 1) if a < b else []:
                got[tuple(p.split(" "))] += f
        assert got == want
    big = tries.Trie(whole.words, whole.paths, whole.counts + (1 << 33))
    assert (tries.loaded(tries.dumped(big)).counts == big.counts).all()
    assert list(tries.built(b"", 10)) == [] and list(tries.built(b" .\n", 10)) == []
