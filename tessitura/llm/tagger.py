"""A character-level bidirectional LSTM with a CRF on top, in numpy: training from labelled spans, and decoding."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, WINDOW, STRIDE = 20, 64, 32
BATCH, STEPS, RATE = 48, 260, 0.02

_OWN = " \n.,@+-=()_:;\"'/%#|*&$<>!?"
_CLASSES = {c: k + 1 for k, c in enumerate(_OWN)}
_DIGIT, _HEX, _LOWER, _UPPER, _OTHER = (len(_OWN) + k for k in range(1, 6))
CLASSES = len(_OWN) + 6


def _class(c: str) -> int:
    if c in _CLASSES:
        return _CLASSES[c]
    if "0" <= c <= "9":
        return _DIGIT
    if "a" <= c <= "f":
        return _HEX
    return _LOWER if c.islower() else _UPPER if c.isupper() else _OTHER


_ASCII = np.array([_class(chr(k)) for k in range(0x250)], np.int64)


def classes(text: str) -> np.ndarray:
    """The class of each character; digits are one class, as are lower-case letters but for a-f, and upper-case letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < len(_ASCII), _ASCII[np.minimum(points, len(_ASCII) - 1)], _OTHER)


# transitions that can't be: inside of a kind after anything but that kind
BARRED = np.zeros((TAGS, TAGS))
for _k in range(len(KINDS)):
    _i = 2 + 2 * _k
    BARRED[:, _i] = -1e4
    BARRED[[_i - 1, _i], _i] = 0.0


# --- labelled spans --------------------------------------------------------------------------------------------------


_LETTERS = "etaoinshrdlucmfwypvbgk" * 9 + "etaoinshrdlucmfwypvbgkéèüößñáóç"


def _word(r: random.Random) -> str:
    w = "".join(r.choices(_LETTERS, k=r.randint(1, 11)))
    return w.capitalize() if r.random() < 0.12 else w.upper() if r.random() < 0.03 else w


def _digits(r, n):
    return "".join(r.choices("0123456789", k=n))


def _some(r, letters, n):
    return "".join(r.choices(letters, k=n))


def _email(r):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = _some(r, letters, r.randint(2, 9)) + r.choice(["", "." + _digits(r, 2), "_" + _some(r, letters, 4), "." + _some(r, letters, 5)])
    return f"{name}@{_some(r, letters, r.randint(2, 8))}{r.choice(['', _digits(r, 1)])}{r.choice(['', '.example', '.co'])}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}"


def _ip(r):
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


def _card(r):
    d = _digits(r, r.choice([12, 14, 15, 15, 15, 15, 18]))
    odd = sum(sum(divmod(2 * int(c), 10)) for c in d[::-2]) + sum(int(c) for c in d[-2::-2])
    d += str(-odd % 10)  # the check digit
    mark = r.choice(["", "", "", " ", "-"])
    return mark.join(d[k : k + 4] for k in range(0, len(d), 4)) if mark else d


def _phone(r):
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+{_digits(r, 2)} {_digits(r, 2)} {c} {_digits(r, 4)}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(r, 11)}"])


_MIXED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _secret(r) -> tuple[str, str, str]:
    hexa = "0123456789abcdef"
    kind = r.randrange(4)
    if kind == 0:
        return "", "AKIA" + _some(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ""
    if kind == 1:
        own = r.choice([_some(r, hexa, r.randint(12, 24)), _some(r, hexa, r.randint(12, 24)), _some(r, _MIXED, r.randint(10, 20)), "-".join(_some(r, "etaoinshrdlu", r.randint(3, 8)) for _ in range(r.randint(3, 4)))])
        return r.choice(["password=", "passwd=", "pwd: ", "password: ", "Password: ", 'password="']), own, ""
    if kind == 2:
        return r.choice(['token = "', 'api_key = "', "secret='"]), _some(r, hexa, r.choice([32, 40])), '"'
    return r.choice(["", "key="]), r.choice(["sk-", "ghp_"]) + _some(r, _MIXED + "0123456789", 30), ""


def _plain(r):
    return r.choice(
        [
            f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"version {r.randint(1, 9)}.{r.randint(0, 20)}", str(r.randint(1000, 2100)), str(r.randint(0, 999)),
            f"{r.randint(1, 999)}.{_digits(r, 2)}", f"{r.randint(0, 23)}:{_digits(r, 2)}", f"{r.randint(1900, 2100)}-{_digits(r, 2)}-{_digits(r, 2)}", f"{r.randint(1, 999)},{_digits(r, 3)}",
            f"{r.randint(1, 100)}%", f"{_word(r)}{r.randint(0, 99)}", f"#{r.randint(1, 999)}", f"({r.randint(1, 99)})", f"{r.randint(1, 20)}.", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", "@" + _word(r), _digits(r, r.randint(4, 9)), f"{_word(r)}: {_word(r)}", f"{_word(r)}={_word(r)}", f"{r.choice(['key', 'token', 'secret', 'password'])} {_word(r)}",
        ]
    )


def labelled_text(r: random.Random, length: int) -> tuple[str, np.ndarray]:
    """Words, plain numbers and personal data, with the tag of each character."""
    text, tags = "", []

    def add(piece: str, kind: int | None = None):
        nonlocal text
        text += piece
        tags.extend([0] * len(piece) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1))

    while len(text) < length:
        x = r.random()
        if x < 0.17:
            kind = r.randrange(len(KINDS))
            before, own, behind = _secret(r) if kind == 4 else ("", (_email, _ip, _card, _phone)[kind](r), "")
            add(before), add(own, kind), add(behind)
        elif x < 0.30:
            add(_plain(r))
        else:
            add(_word(r))
        add(r.choice([" "] * 12 + [", ", ". ", ".\n", "\n", "; ", "! ", ") "]))
    return text, np.array(tags)


# --- the network -----------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, wx: np.ndarray, u: np.ndarray, keep: bool):
    """Hidden states (T, B, H) of inputs x (T, B) of classes; wx has the input weights and bias of each class."""
    steps, batch = x.shape
    h, c = np.zeros((batch, HIDDEN), wx.dtype), np.zeros((batch, HIDDEN), wx.dtype)
    out = np.empty((steps, batch, HIDDEN), wx.dtype)
    trace = []
    for t in range(steps):
        z = wx[x[t]] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            trace.append((h, before, s, g, tc))
        h = o * tc
        out[t] = h
    return out, trace


def _lstm_back(x, u, trace, dout, dwx, du):
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    every = np.empty((*x.shape, 4 * HIDDEN))
    for t in range(len(x) - 1, -1, -1):
        h, before, s, g, tc = trace[t]
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        every[t] = dz
        dh, dc = dz @ u.T, dc * f
    flat = every.reshape(-1, 4 * HIDDEN)
    dwx += (x.reshape(-1, 1) == np.arange(CLASSES)).astype(float).T @ flat
    du += np.concatenate([h for h, *_ in trace]).T @ flat


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """(B, T, TAGS) scores of windows x (B, T) of classes."""
    x = x.T
    forth, _ = _lstm(x, p["wf"], p["uf"], False)
    back, _ = _lstm(x[::-1], p["wb"], p["ub"], False)
    return (np.concatenate([forth, back[::-1]], 2) @ p["out"] + p["bias"]).transpose(1, 0, 2)


def _crf(e: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Gradients of the negative log-likelihood for emissions (T, B, K) and transitions, from forward and backward sums that are
    scaled to one at every step."""
    steps, batch, _ = e.shape
    move, own = np.exp(trans + BARRED), np.exp(e - e.max(2, keepdims=True))
    alpha, beta, norm = np.empty_like(own), np.ones_like(own), np.empty((steps, batch, 1))
    for t in range(steps):
        alpha[t] = (alpha[t - 1] @ move) * own[t] if t else own[t]
        norm[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= norm[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (own[t + 1] * beta[t + 1] / norm[t + 1]) @ move.T
    de = alpha * beta
    ahead = own[1:] * beta[1:] / norm[1:]
    dt = move * (alpha[:-1].reshape(-1, TAGS).T @ ahead.reshape(-1, TAGS))
    np.subtract.at(dt, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    np.subtract.at(de, (np.arange(steps)[:, None], np.arange(batch), tags), 1)
    return de / batch, dt / batch


@lru_cache(maxsize=2)
def trained(seed: int = 3) -> dict[str, np.ndarray]:
    """The tagger, trained with Adam on BATCH x STEPS labelled windows drawn with `seed`."""
    r, draw = random.Random(seed), np.random.default_rng(seed)
    p = {
        "wf": draw.normal(0, 0.3, (CLASSES, 4 * HIDDEN)), "wb": draw.normal(0, 0.3, (CLASSES, 4 * HIDDEN)),
        "uf": draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "ub": draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)),
        "out": draw.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)),
    }
    p["bias"][0] = 1.0
    for w in ("wf", "wb"):
        p[w][:, HIDDEN : 2 * HIDDEN] += 1.0  # remember at first
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        windows = [labelled_text(r, WINDOW + 80) for _ in range(BATCH)]
        at = [r.randrange(len(t) - WINDOW) for t, _ in windows]
        x = np.stack([classes(t[a : a + WINDOW]) for (t, _), a in zip(windows, at)]).T
        tags = np.stack([g[a : a + WINDOW] for (_, g), a in zip(windows, at)]).T
        forth, tf = _lstm(x, p["wf"], p["uf"], True)
        back, tb = _lstm(x[::-1], p["wb"], p["ub"], True)
        h = np.concatenate([forth, back[::-1]], 2)
        de, dt = _crf(h @ p["out"] + p["bias"], tags, p["trans"])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["trans"], g["bias"] = dt, de.sum((0, 1))
        g["out"] = np.einsum("tbh,tbk->hk", h, de)
        dh = de @ p["out"].T
        _lstm_back(x, p["uf"], tf, dh[:, :, :HIDDEN], g["wf"], g["uf"])
        _lstm_back(x[::-1], p["ub"], tb, dh[::-1, :, HIDDEN:], g["wb"], g["ub"])
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
        for k, v in g.items():
            v = v * min(1.0, 5 / norm)
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of padded regions e (B, T, TAGS)."""
    full = trans + BARRED.astype(np.float32)
    batch, steps, _ = e.shape
    score, back = e[:, 0], np.zeros((steps, batch, TAGS), np.int8)
    final = score.copy()
    for t in range(1, steps):
        both = score[:, :, None] + full
        back[t] = both.argmax(1)
        score = both.max(1) + e[:, t]
        ends = lengths == t + 1
        final[ends] = score[ends]
    out = []
    for b in range(batch):
        tag, path = int(final[b].argmax()), np.empty(lengths[b], np.int8)
        for t in range(lengths[b] - 1, -1, -1):
            path[t] = tag
            tag = int(back[t, b, tag])
        out.append(path)
    return out
