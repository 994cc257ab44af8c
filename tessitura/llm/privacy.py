"""Personal data: exact patterns, and a character BiLSTM-CRF that adds what they miss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import tagger as T
from tessitura.llm import words as W
from tessitura.llm.common import table

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What announces a secret, and how some begin.
_CUE = r"(?i:passw(?:or)?d|pwd|secret|token|key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
_BEGINS = ("AKIA", "ghp_", "sk-")
#: An added span has a digit or an @, or is a secret behind a cue or with one of the beginnings: only windows around those are
#: decoded. A cue takes the run behind it along.
_TRIGGER = re.compile(rf"[0-9@]+|{_CUE}\S*|(?:{'|'.join(_BEGINS)})\S*")
_CUED = re.compile(_CUE + r"$")
#: Bytes of text that are worked on at a time; windows, and characters of stretches, that are decoded at a time.
TEXTS, WINDOWS, GROUP, CELLS = 1 << 20, 512, 1 << 19, 1 << 17
#: Characters of a stretch, and what of its neighbours it reads: whole windows.
STRETCH, MARGIN = 64 * T.STRIDE, 4 * T.WINDOW
#: The least characters, and digits, of an added span.
LEAST = {"email": (6, 0), "ip": (7, 4), "card": (13, 13), "phone": (8, 7), "secret": (10, 0)}


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octets(text: str) -> bool:
    """Four numbers of at most 255; they may have any number of zeros ahead."""
    parts = [x.lstrip("0") for x in text.split(".")]
    return len(parts) == 4 and all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the exact patterns in code points, by kind as in KINDS, then start."""
    out = [("email", i, j) for i, j in _emails(text)]
    for m in _IP.finditer(text):
        if _octets(m[0]):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches of window places on the text's grid that hold a trigger: (first, last + 1)."""
    cells = sorted({c for m in _TRIGGER.finditer(text) for c in range(m.start() // T.STRIDE, (m.end() - 1) // T.STRIDE + 1)})
    out: list[list[int]] = []
    for c in cells:
        low, high = max(0, (c - 1) * T.STRIDE), min(len(text), (c + 2) * T.STRIDE)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(i, j) for i, j in out]


def _stretches(regions: list[tuple[int, int, int]]):
    """(region, low, high, from, to): regions in stretches of at most STRETCH characters, each with MARGIN more on either side of a cut."""
    for k, (_, i, j) in enumerate(regions):
        for a in range(i, j, STRETCH):
            b = min(j, a + STRETCH)
            yield k, max(i, a - MARGIN), min(j, b + MARGIN), a, b


def _groups(stretches):
    """Stretches, GROUP characters at a time."""
    held, size = [], 0
    for s in stretches:
        if held and size + s[2] - s[1] > GROUP:
            yield held
            held, size = [], 0
        held.append(s)
        size += s[2] - s[1]
    if held:
        yield held


def _paths(codes: list[np.ndarray], params: dict) -> list[np.ndarray]:
    """The tags of each stretch from its characters' classes."""
    places = [(k, a) for k, own in enumerate(codes) for a in range(0, max(1, len(own) - T.STRIDE), T.STRIDE)]
    scores = [np.zeros((len(own), T.TAGS), np.float32) for own in codes]
    weights = [np.zeros((len(own), 1), np.float32) for own in codes]
    hill = (np.minimum(np.arange(T.WINDOW), np.arange(T.WINDOW)[::-1]) + 1.0).astype(np.float32)[:, None]
    for w in range(0, len(places), WINDOWS):
        part = places[w : w + WINDOWS]
        x = np.zeros((len(part), T.WINDOW), np.int64)
        for row, (k, a) in zip(x, part):
            own = codes[k][a : a + T.WINDOW]
            row[: len(own)] = own
        for e, (k, a) in zip(T.emissions(params, x), part):
            n = min(T.WINDOW, len(codes[k]) - a)
            scores[k][a : a + n] += e[:n] * hill[:n]
            weights[k][a : a + n] += hill[:n]
    out: list[np.ndarray] = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    done = 0
    while done < len(order):
        some = 1
        while done + some < len(order) and (some + 1) * len(codes[order[done + some]]) <= CELLS:
            some += 1
        part = order[done : done + some]
        lengths = np.array([len(codes[k]) for k in part])
        e = np.zeros((some, lengths.max(), T.TAGS), np.float32)
        for row, k in zip(e, part):
            row[: len(codes[k])] = scores[k] / weights[k]
        for k, path in zip(part, T.viterbi(e, lengths, params["trans"])):
            out[k] = path
        done += some
    return out


def tag_texts(texts: list[str], params: dict) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text.

    Windows of WINDOW characters overlap by half; a character's scores are the mean over its windows, weighted to their
    middles, and one Viterbi pass over each region settles the tags across windows. A region of any length is decoded in
    stretches, side by side: with margins of four windows, scores up to a cut are those of the whole region, and the best paths have met by there.
    """
    regions = [(n, i, j) for n, text in enumerate(texts) for i, j in _regions(text)]
    tags: list[list[np.ndarray]] = [[] for _ in regions]
    for group in _groups(_stretches(regions)):
        paths = _paths([T.classes(texts[regions[k][0]][low:high]) for k, low, high, _, _ in group], params)
        for (k, low, _, a, b), path in zip(group, paths):
            tags[k].append(path[a - low : b - low])
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (n, base, _), parts in zip(regions, tags):
        found[n] += [(kind, base + i, base + j) for kind, i, j in _spans(np.concatenate(parts))]
    return [sorted(f, key=lambda s: s[1]) for f in found]


def _spans(path: np.ndarray):
    start, kind = None, 0
    for t, tag in enumerate([*path.tolist(), 0]):
        if start is not None and tag != 2 + 2 * kind:
            yield T.KINDS[kind], start, t
            start = None
        if tag % 2 == 1:
            start, kind = t, tag // 2
        elif tag and start is None:
            start, kind = t, tag // 2 - 1


def _pieces(text: str, found):
    """Tagger spans; of kinds without white space, each run between it."""
    for kind, i, j in found:
        if kind in ("card", "phone"):
            yield kind, i, j
        else:
            for m in re.finditer(r"\S+", text[i:j]):
                yield kind, i + m.start(), i + m.end()


def _fits(text: str, kind: str, i: int, j: int) -> bool:
    """Whether a tagger span can be of its kind; cards and addresses that the exact patterns would turn down are none."""
    own = text[i:j]
    digits = [c for c in own if "0" <= c <= "9"]
    if j - i < LEAST[kind][0] or len(digits) < LEAST[kind][1]:
        return False
    if kind == "email":
        return "@" in own
    if kind == "ip":
        return re.fullmatch(r"[0-9.]+", own) is not None and _octets(own)
    if kind == "card":
        return len(digits) <= 19 and _luhn("".join(digits))
    if kind == "phone":
        return len(digits) <= 15
    return bool(digits) or own.startswith(_BEGINS) or _CUED.search(text, max(0, i - 24), i) is not None


def _added(text: str, base, found):
    """Tagger spans that fit their kind and don't overlap a base span, trimmed of white space and marks around."""
    taken = sorted((i, j) for _, i, j in base)
    at = 0
    for kind, i, j in _pieces(text, found):
        while i < j and not (text[i].isalnum() or text[i] in "+(_"):
            i += 1
        while j > i and not text[j - 1].isalnum():
            j -= 1
        if not _fits(text, kind, i, j):
            continue
        while at < len(taken) and taken[at][1] <= i:
            at += 1
        if at < len(taken) and taken[at][0] < j:
            continue
        yield kind, i, j


def _parts(batches, column: int):
    """Batches in slices of about TEXTS bytes of text, so that what is held besides the batch is bounded."""
    for batch in batches:
        for first, _, offsets in W.string_slices(batch.column(column), TEXTS):
            yield batch.slice(first, len(offsets) - 1)
        pa.default_memory_pool().release_unused()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_private(docs: DataFrame, seed: int = 3) -> DataFrame:
    """docs without text, with spans array<struct<kind, start, end, base>> in code points, end exclusive, by kind, then start.

    Exact patterns (email, ip, card, phone) always stay; the tagger, trained on the driver from generated labelled spans
    with `seed`, adds others that do not overlap them (among them `secret`: keys, passwords, tokens). Whole texts are
    searched; null text is empty; a repeated doc_id is searched row by row; a column `spans` of docs gives way to the new
    one; empty tables give none. A map over batches: no shuffle; the model is some kilobytes.
    """
    others = [c for c in docs.columns if c not in ("text", "spans")]
    params = T.trained(seed)
    rank = {k: n for n, k in enumerate(T.KINDS)}

    def run(batches):
        for batch in _parts(batches, 0):
            texts = [t.as_py() or "" for t in batch.column(0)]
            base = [base_spans(t) for t in texts]
            more = tag_texts(texts, params)
            spans = []
            for text, own, found in zip(texts, base, more):
                every = [(*s, True) for s in own] + [(*s, False) for s in _added(text, own, found)]
                every.sort(key=lambda s: (rank[s[0]], s[1], s[2]))
                spans.append([dict(zip(("kind", "start", "end", "base"), s)) for s in every])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, pa.list_(SPAN))], [*others, "spans"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    schema = kept + "spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return docs.select("text", *others).mapInArrow(run, schema)


def redact(docs: DataFrame, seed: int = 3) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; other columns as they are. Null text stays null."""
    params = T.trained(seed)
    names = docs.columns

    def run(batches):
        for batch in _parts(batches, names.index("text")):
            at = names.index("text")
            texts = [t.as_py() for t in batch.column(at)]
            found = tag_texts([t or "" for t in texts], params)
            out = []
            for text, more in zip(texts, found):
                if text:
                    own = base_spans(text)
                    end, parts = 0, []
                    for kind, i, j in sorted([*own, *_added(text, own, more)], key=lambda s: (s[1], -s[2])):
                        if j > end:
                            parts += [text[end:i], f"<{kind}>" if i >= end else ""]
                            end = j
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)


def op8_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_private(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in T.KINDS[:4]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
