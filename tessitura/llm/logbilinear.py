"""A log-bilinear language model in numpy: context vectors, a diagonal matrix for each position, classes of words, noise contrast.

Symbols are numbered by falling frequency, and every `side` of them in turn are a class. With the vectors r of the ORDER symbols
before a word, h = sum_i C_i r_i (diagonal C_i); p(word) = p(class | h) p(word | class, h), each a softmax of h . q + b. Both
layers learn by noise contrast against the frequencies: data and noise of a batch enter by their expectation, as matrix products.
"""

from __future__ import annotations

import math

import numpy as np

#: Symbols of context, length of the vectors, noise samples a word, tokens of a step, neighbours among them, and the rate of Adagrad.
ORDER, WIDTH, NOISE, BATCH, RUN, RATE = 4, 16, 16, 4096, 128, 0.3

Params = dict[str, np.ndarray]


class Frequencies:
    """What the layout and the noise need of the symbols' counts, most frequent first."""

    def __init__(self, counts: np.ndarray):
        self.side = max(1, math.ceil(math.sqrt(len(counts))))
        self.classes = -(-len(counts) // self.side)
        padded = np.zeros(self.classes * self.side)
        padded[: len(counts)] = counts + 0.5
        grid = padded.reshape(self.classes, self.side)
        self.noise_class = (grid.sum(1) / grid.sum()).astype(np.float32)
        self.noise_word = (grid / grid.sum(1, keepdims=True)).astype(np.float32)
        self.used = grid > 0


def start(freq: Frequencies, seed: int = 5) -> Params:
    """Biases at the frequencies, small random vectors: before any training, the model is that of the frequencies."""
    draw = np.random.default_rng(seed)
    n = freq.classes * freq.side
    small = lambda rows: draw.normal(0, 0.1, (rows, WIDTH)).astype(np.float32)
    bias = np.where(freq.used, np.log(np.maximum(freq.noise_word, 1e-30)), -30.0).astype(np.float32)
    return {
        "r": small(n), "c": np.ones((ORDER, WIDTH), np.float32) / ORDER, "q_class": small(freq.classes), "q_word": small(n),
        "b_class": np.log(freq.noise_class).astype(np.float32), "b_word": bias.reshape(-1),
    }


def stream(symbols: np.ndarray, first: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream, places): documents that begin at `first`, each with ORDER times `stop` ahead, so that the ORDER symbols before a
    token's place are its context; a document's own end counts as the first `stop` of the next one."""
    places = np.arange(len(symbols)) + ORDER + np.repeat(np.arange(len(first) - 1) * (ORDER - 1), np.diff(first))
    out = np.full(ORDER + len(symbols) + (len(first) - 1) * (ORDER - 1), stop, np.int32)
    out[places] = symbols
    return out, places


def _hidden(c: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """h of the n last of the vectors in each line of `rows` (lines, ORDER + n, or one behind, times WIDTH), from those before each."""
    c = np.tile(c, n)
    out = rows[:, (ORDER - 1) * WIDTH : (ORDER - 1 + n) * WIDTH] * c[0]
    part = np.empty_like(out)
    for k in range(1, ORDER):
        out += np.multiply(rows[:, (ORDER - 1 - k) * WIDTH : (ORDER - 1 - k + n) * WIDTH], c[k], out=part)
    return out


def _by_class(words: np.ndarray, side: int):
    """Order of the tokens by class, and (class, from, to) in it."""
    own = (words // side).astype(np.uint16)  # narrow, so that the sort is by digits
    order = np.argsort(own, kind="stable")
    own = own[order]
    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(order) else np.zeros(0, np.int64)
    return order, list(zip(own[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)]))


def _contrast(g: np.ndarray, target: np.ndarray, drawn: np.ndarray) -> None:
    """Turns the negated scores (tokens, choices) over the noise into the ascent direction of the noise-contrastive likelihood over
    minus the noise that is expected of each choice, in place; drawn: that of each token's own choice."""
    with np.errstate(over="ignore"):
        np.exp(g, out=g)
    g += 1
    np.reciprocal(g, out=g)  # the probability of data
    flat, at = g.reshape(-1), np.arange(0, g.size, g.shape[1]) + target
    own = flat[at]
    flat[at] = own - (1 - own) / drawn


def _climb(value: np.ndarray, seen: np.ndarray, g: np.ndarray) -> None:
    step = g * g
    seen += step
    np.divide(g, np.sqrt(seen, out=step), out=step)
    step *= np.float32(RATE)
    value += step


class Adagrad:
    def __init__(self, p: Params):
        self.p, self.seen = p, {k: np.full(v.shape, 1e-2 if v.ndim == 2 else 1.0, np.float32) for k, v in p.items()}

    def climb(self, name: str, where, g: np.ndarray) -> None:
        value, seen = self.p[name][where], self.seen[name][where]
        _climb(value, seen, g)
        self.p[name][where], self.seen[name][where] = value, seen


class Layer:
    """Vectors with the bias behind each, and what Adagrad has seen of them; drawn: the noise expected of each."""

    def __init__(self, name: str, steps: Adagrad, drawn: np.ndarray):
        self.name, self.steps, self.drawn = name, steps, drawn
        self.value, self.seen = (np.column_stack([x[f"q_{name}"], x[f"b_{name}"]]) for x in (steps.p, steps.seen))
        self.noise, self.log_noise = np.repeat(drawn[:, None], WIDTH + 1, axis=1), np.log(np.maximum(drawn, 1e-30))

    def against(self) -> np.ndarray:
        """Vectors that give the negated scores over the noise."""
        out = -self.value
        out[:, WIDTH] += self.log_noise
        return out

    def climb(self, g: np.ndarray, share: np.float32) -> None:
        g *= self.noise
        g *= share
        _climb(self.value, self.seen, g)

    def close(self) -> None:
        for x, own in ((self.steps.p, self.value), (self.steps.seen, self.seen)):
            x[f"q_{self.name}"][:], x[f"b_{self.name}"][:] = own[:, :WIDTH], own[:, WIDTH]


class Weights:
    """How often each symbol was context, how often each class was that of the word, and the tokens."""

    def __init__(self, freq: Frequencies):
        self.of_symbol, self.of_class, self.total = np.zeros(freq.classes * freq.side, np.int64), np.zeros(freq.classes, np.int64), 0


def learn(p: Params, freq: Frequencies, text: np.ndarray, wanted: np.ndarray, steps: Adagrad, seen: Weights) -> None:
    """One pass over all of a stream, RUN places in a row and BATCH in a step; what is learned from is where `wanted` holds. p changes in place."""
    side, classes = freq.side, freq.classes
    of_class, of_word = Layer("class", steps, NOISE * freq.noise_class), Layer("word", steps, NOISE * freq.noise_word.ravel())
    whole = -(-max(0, len(text) - ORDER) // RUN)
    behind = ORDER + whole * RUN - len(text)
    text, wanted = np.append(text, np.zeros(behind, text.dtype)), np.append(wanted, np.zeros(behind, bool))
    starts = ORDER + RUN * np.arange(whole)
    scores = np.empty(BATCH * max(side, classes), np.float32)
    place = np.empty(len(p["r"]), np.int64)
    for a in range(0, len(starts), BATCH // RUN):
        places = starts[a : a + BATCH // RUN, None] + np.arange(-ORDER, RUN)
        symbols = text[places]
        at = np.flatnonzero(wanted[places[:, ORDER:]].ravel())
        if not len(at):
            continue
        targets = symbols[:, ORDER:].ravel()[at]
        order, cuts = _by_class(targets, side)
        at, target = at[order], targets[order]
        own_class, n = target // side, len(target)
        share = np.float32(-32 / n)
        rows = np.take(p["r"], symbols, axis=0).reshape(len(places), -1)
        h = np.ones((n, WIDTH + 1), np.float32)
        h[:, :WIDTH] = np.take(_hidden(p["c"], rows, RUN).reshape(-1, WIDTH), at, axis=0)
        # the noise is a factor of the vectors, of which there are few, and not of the tokens' scores
        g = np.matmul(h, of_class.against().T, out=scores[: n * classes].reshape(n, classes))
        _contrast(g, own_class, of_class.drawn[own_class])
        back = g @ (of_class.value * of_class.noise)[:, :WIDTH]
        of_class.climb(g.T @ h, share)
        # each class has words of its own: their products are apart, all else is done for all classes at once
        g, against = scores[: n * side].reshape(n, side), of_word.against()
        for k, i, j in cuts:
            np.matmul(h[i:j], against[k * side : (k + 1) * side].T, out=g[i:j])
        _contrast(g, target % side, of_word.drawn[target])
        q, more, up = (of_word.value * of_word.noise)[:, :WIDTH], np.empty_like(back), np.zeros_like(against)
        for k, i, j in cuts:
            np.matmul(g[i:j], q[k * side : (k + 1) * side], out=more[i:j])
            np.matmul(g[i:j].T, h[i:j], out=up[k * side : (k + 1) * side])
        of_word.climb(up, share)
        back += more
        back *= share
        full = np.zeros((len(places) * RUN, WIDTH), np.float32)
        full[at] = back
        full, c = full.reshape(len(places), -1), np.tile(p["c"], RUN)
        up, own, part_of = np.zeros_like(rows), np.empty_like(p["c"]), np.empty_like(full)
        for k in range(ORDER):
            part = slice((ORDER - 1 - k) * WIDTH, (ORDER - 1 - k + RUN) * WIDTH)
            up[:, part] += np.multiply(full, c[k], out=part_of)
            own[k] = np.multiply(rows[:, part], full, out=part_of).sum(0).reshape(-1, WIDTH).sum(0)
        steps.climb("c", slice(None), own)
        times = np.bincount(symbols.ravel(), minlength=len(place))
        inner = np.flatnonzero(times)
        place[inner] = np.arange(0, len(inner) * WIDTH, WIDTH)
        sums = np.bincount((place[symbols][..., None] + np.arange(WIDTH)).ravel(), up.ravel(), len(inner) * WIDTH)
        steps.climb("r", inner, sums.astype(np.float32).reshape(-1, WIDTH))
        seen.of_symbol += times
        seen.of_class += np.bincount(own_class, minlength=classes)
        seen.total += n
    of_class.close()
    of_word.close()


def _log_softmax(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    own = scores.reshape(-1)[np.arange(0, scores.size, scores.shape[1]) + target]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def log_probabilities(p: Params, freq: Frequencies, text: np.ndarray, start: int, end: int) -> np.ndarray:
    """Natural logarithms of the normalised probabilities at the places start..end-1 of a stream."""
    side, out, batch = freq.side, np.empty(max(0, end - start)), 4 * BATCH
    of_class, of_word = (np.column_stack([p[f"q_{x}"], p[f"b_{x}"]]) for x in ("class", "word"))
    buffer = np.empty(min(batch, len(out)) * max(side, freq.classes), np.float32)
    for a in range(start, end, batch):
        b = min(end, a + batch)
        n, (order, cuts) = b - a, _by_class(text[a:b], side)
        target = text[a:b][order]
        h = np.ones((n, WIDTH + 1), np.float32)
        h[:, :WIDTH] = np.take(_hidden(p["c"], np.take(p["r"], text[a - ORDER : b], axis=0).reshape(1, -1), n).reshape(-1, WIDTH), order, axis=0)
        scores = buffer[: n * freq.classes].reshape(n, -1)
        own = _log_softmax(np.matmul(h, of_class.T, out=scores), target // side)
        scores = buffer[: n * side].reshape(n, -1)
        for k, i, j in cuts:
            np.matmul(h[i:j], of_word[k * side : (k + 1) * side].T, out=scores[i:j])
        out[a - start : b - start][order] = own + _log_softmax(scores, target % side)
    return out


# --- models that learned apart ----------------------------------------------------------------------------------------


def weighed(p: Params, freq: Frequencies, seen: Weights) -> np.ndarray:
    """One vector of all parameters times their weights, and the weights. Such vectors add up over tasks."""
    of_symbol, of_class, total = seen.of_symbol.astype(np.float32), seen.of_class.astype(np.float32), np.float32(seen.total)
    of_word = np.repeat(of_class, freq.side)
    parts = [
        p["r"] * of_symbol[:, None], of_symbol, p["q_word"] * of_word[:, None], p["b_word"] * of_word, of_class,
        p["c"] * total, p["q_class"] * total, p["b_class"] * total, np.array([total]),
    ]
    return np.concatenate([np.asarray(x, np.float32).ravel() for x in parts])


def mean(p: Params, freq: Frequencies, sums: np.ndarray) -> Params:
    """The weighted mean of models from the sum of their vectors; what no task has touched stays as it is in p."""
    n, side, classes = len(p["r"]), freq.side, freq.classes
    sizes = [n * WIDTH, n, n * WIDTH, n, classes, ORDER * WIDTH, classes * WIDTH, classes, 1]
    r, of_symbol, q, b, of_class, c, q_class, b_class, total = np.split(sums, np.cumsum(sizes)[:-1])
    of_word = np.repeat(of_class, side)

    def over(x, weight, old):
        weight = weight if x.size == weight.size else np.repeat(weight, WIDTH)
        return np.where(weight > 0, x / np.maximum(weight, 1e-9), old.ravel()).reshape(old.shape).astype(np.float32)

    flat = lambda x, old: over(x, np.full(x.size, total[0]), old)
    return {
        "r": over(r, of_symbol, p["r"]), "q_word": over(q, of_word, p["q_word"]), "b_word": over(b, of_word, p["b_word"]),
        "c": flat(c, p["c"]), "q_class": flat(q_class, p["q_class"]), "b_class": flat(b_class, p["b_class"]),
    }
