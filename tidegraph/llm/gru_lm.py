"""Language model scores: a gated recurrent network with a class-factored softmax, in numpy.

Words. The HEAD commonest training words are the network's own; every other
word enters it as one of SHAPES shapes (what bytes it holds and how it ends). p(word | past) is
p(class | state) * p(word | class): a head class holds 64 words and has its own softmax on the
state; a shape is a class whose words have their add-half share of the shape's training tokens, so
all words, unknown ones too, have a probability, and the score is that of the whole text.

Training. Training rows are dealt into shards by a hash of id and text, in the order of that hash, so the
model depends on the rows alone and not on how they lie in files or tasks. A shard holds about SHARD_TOKENS tokens (more if
that made more than SHARDS shards). Each shard trains a copy of the network by backpropagation truncated to
windows of STEPS words, with the state carried on from window to window; the copies are averaged, weighted by their
words, slice by slice of the weights. A round trains on every token of
every training text, whatever the size of the input; the next one starts from the average. Counts (of words, shapes, training tokens) are those of all training texts.

Scoring. Texts of a task run side by side, sorted by length; the state goes through the whole of each
text, window by window. Counts of the BROADCAST_WORDS commonest words go to all tasks; those of all others are joined.

Results. A null text is empty: one token, the end. Null ids are learnt from and held_out is false. Repeated rows have equal
results. An empty table gives an empty result; with no training text every count is 0. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb
from tidegraph.llm.store import Scratch

HIDDEN = 24
CLASS = 64
HEAD_CLASSES = 31
HEAD = CLASS * HEAD_CLASSES
SHAPES = 32
END_CLASS = HEAD_CLASSES + SHAPES
CLASSES = END_CLASS + 1
#: Inputs: head words, shapes, the end (also what comes before the first word).
INPUTS = HEAD + SHAPES + 1
STEPS = 24
LANES = 512
ROUNDS = 1
RATE = 0.08
SHARD_TOKENS = 2_000_000
SHARDS = 4096
#: Weights are averaged in so many slices, each a group of at most SHARDS rows.
SLICES = 64
BROADCAST_WORDS = 1 << 18
SCORE_WORDS = 2_500_000
COUNT_WORDS = 1 << 20
END = 0x1F3D5B79
U = np.uint64
F32 = np.float32


#: What a byte adds to its word's shape: 1 beyond ASCII, 2 a digit, 4 neither letter nor digit.
KINDS = np.full(256, 4, np.uint8)
KINDS[128:], KINDS[48:58], KINDS[65:91], KINDS[97:123], KINDS[tb.SPACE] = 1, 2, 0, 0, 0
#: The first n of eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Words of more bytes are hashed by prefix sums.
LONG_WORD = 64


def _eights(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table of the bytes, eight at a time from every place on."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(table, data, out=padded[: len(data)], mode="clip")
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_codes(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every word, and n+1 offsets of each text's words."""
    data = chunk.data
    starts, ends, own = tb.words(chunk)
    lengths = ends - starts
    bodies, kinds = _eights(tb.LOWER, data), _eights(KINDS, data)
    mask = FIRST[np.minimum(lengths, 8)]
    codes = tb.mix((bodies[starts] & mask) ^ tb.mix(lengths.astype(U)))
    held = kinds[starts] & mask
    at = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    done = 8
    while len(at):
        place, mask = starts[at] + done, FIRST[np.minimum(lengths[at] - done, 8)]
        codes[at] = tb.mix((bodies[place] & mask) ^ codes[at])
        held[at] |= kinds[place] & mask
        done += 8
        at = at[lengths[at] > done]
    for k in (32, 16, 8):
        held |= held >> U(k)
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        edges = np.zeros(len(long) + 1, np.int64)
        np.cumsum(lengths[long], out=edges[1:])
        bytes_ = data[np.arange(edges[-1]) + np.repeat(starts[long] - edges[:-1], lengths[long])]
        codes[long] = tb.SpanHash(bytes_, lower=True).of(edges[:-1], edges[1:])
        held[long] = np.bitwise_or.reduceat(KINDS[bytes_], edges[:-1])
    last = data[ends - 1] if len(ends) else data[:0]
    # Ends of sentences, and long words, are shapes of their own.
    shape = (held & U(7)).astype(np.int64) + 8 * ((last == 46) | (last == 33) | (last == 63)) + 16 * (lengths > 8)
    return codes, shape, own


class Vocabulary:
    """The commonest training words by hash: their count, and which of them the network knows."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, shape_tokens: np.ndarray, shape_words: np.ndarray, head: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct = total, distinct
        # Numbers of the head words, commonest first; -1 for all others.
        self.number = np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.hashes, head) if len(head) else np.zeros(0, np.int64)
        self.number[at] = np.arange(len(head))
        self.head_counts = self.counts[at]
        self.shape_tokens, self.shape_words = shape_tokens, shape_words

    def _buckets(self) -> None:
        """First word of each value of the hashes' upper bits, about four values a word, and the longest bucket."""
        self.shift = U(64 - max(1, int(len(self.hashes) * 4).bit_length()))
        top = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(int(U(0xFFFFFFFFFFFFFFFF) >> self.shift) + 1)).astype(np.int32)
        self.longest = int(np.bincount(top).max())

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not here) and head number (-1: none) of each word."""
        if not len(self.hashes):
            none = np.full(len(codes), -1, np.int64)
            return none, none
        if not hasattr(self, "first"):
            self._buckets()
        at = self.first[codes >> self.shift]
        found = np.full(len(codes), -1, np.int64)
        last = len(self.hashes) - 1
        hit = self.hashes[np.minimum(at, last)] == codes
        found[hit] = at[hit]
        open_ = np.flatnonzero(~hit)
        for k in range(1, self.longest):
            place = np.minimum(at[open_] + k, last)
            there = self.hashes[place]
            hit = there == codes[open_]
            found[open_[hit]] = place[hit]
            open_ = open_[there < codes[open_]]
        here = found >= 0
        return np.where(here, self.counts[found], -1), np.where(here, self.number[found], -1)


class Network:
    """Weights and the two passes. x: input table, u: recurrent, b: its bias, c, cb: classes, w, wb: words of head classes."""

    NAMES = ("x", "u", "b", "c", "cb", "w", "wb")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights
        self.g = {k: np.full_like(v, 1e-3) for k, v in weights.items()}

    @classmethod
    def start(cls, v: Vocabulary, end_tokens: int, seed: int = 11) -> Network:
        """Random recurrence over the training words' own shares: before any step the model is the smoothed unigram one."""
        rng = np.random.default_rng(seed)
        h = HIDDEN
        counts = np.full(HEAD, 0.01)
        counts[: len(v.head_counts)] = v.head_counts
        classes = np.concatenate([counts.reshape(HEAD_CLASSES, CLASS).sum(1), v.shape_tokens + 0.5, [end_tokens + 0.5]])
        return cls(
            {
                "x": rng.normal(0, 0.3, (INPUTS, 3 * h)).astype(F32), "u": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(F32), "b": np.zeros(3 * h, F32),
                "c": np.zeros((h, CLASSES), F32), "cb": np.log(classes / classes.sum()).astype(F32),
                "w": np.zeros((HEAD_CLASSES, h, CLASS), F32), "wb": np.log(counts.reshape(HEAD_CLASSES, CLASS) / counts.reshape(HEAD_CLASSES, CLASS).sum(1, keepdims=True)).astype(F32),
            }
        )

    def step(self, h: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = HIDDEN
        a = self.p["x"][inputs] + self.p["b"]
        r = h @ self.p["u"]
        gates = np.tanh((a[:, : 2 * n] + r[:, : 2 * n]) * F32(0.5)) * F32(0.5) + F32(0.5)
        z, reset = gates[:, :n], gates[:, n:]
        new = np.tanh(a[:, 2 * n :] + reset * r[:, 2 * n :])
        return new + z * (h - new), (h, z, reset, new, r[:, 2 * n :])

    def steps(self) -> Callable[..., tuple]:
        """step() for many steps with the same weights: the three gates lie apart, the halves and the bias are in the tables."""
        n = HIDDEN
        half = np.array([0.5, 0.5, 1], self.p["x"].dtype)[:, None, None]
        x = (self.p["x"] + self.p["b"]).reshape(-1, 3, n).transpose(1, 0, 2) * half
        u = self.p["u"].reshape(n, 3, n).transpose(1, 0, 2) * half
        x, u = np.ascontiguousarray(x), np.ascontiguousarray(u)
        one_half = x.dtype.type(0.5)

        def step(h: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The next state, the gates and the candidate [3, lanes, hidden], and the recurrent part of the candidate."""
            a, r = x.take(inputs, 1), np.matmul(h, u)
            gates, new = a[:2], a[2]
            gates += r[:2]
            np.tanh(gates, out=gates)
            gates *= one_half
            gates += one_half
            new += a[1] * r[2]
            np.tanh(new, out=new)
            h = h - new
            h *= a[0]
            h += new
            return h, a, r[2]

        return step

    def log_probabilities(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of p(class) and, in head classes, of p(word | class), for states and targets."""
        order, runs = _by_class(classes)
        h, classes, words = h.take(order, 0), classes[order], words[order]
        got = np.empty(len(h))
        cb = _shifted(self.p["c"], self.p["cb"])
        for a in range(0, len(h), TILE):
            at = slice(a, a + TILE)
            got[at] = _log_softmax(h[at], self.p["c"], cb, classes[at])
        for c, a, b in runs:
            wb = _shifted(self.p["w"][c], self.p["wb"][c])
            for first in range(a, b, TILE):
                at = slice(first, min(first + TILE, b))
                got[at] += _log_softmax(h[at], self.p["w"][c], wb, words[at])
        out = np.empty_like(got)
        out[order] = got
        return out

    def train(self, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step on a window [steps, lanes] from state h; fresh marks where a text starts. Returns the last state."""
        grads, h, _ = self.gradients(inputs, classes, words, fresh, h)
        used = np.flatnonzero(np.bincount(inputs.ravel(), minlength=INPUTS))
        for k, g in grads.items():
            # Inputs that do not occur have no gradient.
            rows = used if k == "x" else slice(None)
            g = np.clip(g[rows], -1, 1)
            total = self.g[k][rows] + g * g
            self.g[k][rows] = total
            self.p[k][rows] -= F32(rate) * g / np.sqrt(total)
        return h

    def gradients(self, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        steps, lanes = inputs.shape
        n, p, kind = HIDDEN, self.p, h.dtype
        states, before, gates, candidate = np.empty((steps, lanes, n), kind), [], [], []
        step = self.steps()
        starts = [np.flatnonzero(f) for f in fresh]
        for t in range(steps):
            h = h.copy() if t == 0 else h
            h[starts[t]] = 0
            before.append(h)
            h, a, r = step(h, inputs[t])
            # A start in the next step must not change this step's state.
            states[t] = h
            gates.append(a)
            candidate.append(r)
        scale = kind.type(1 / lanes)
        # All gradients are sums over the window; they are scaled by the lanes at the end.
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "b"}
        # Targets of a class lie side by side.
        order, runs = _by_class(classes.ravel())
        own, target, word = states.reshape(-1, n).take(order, 0), classes.ravel()[order], words.ravel()[order]
        back = np.empty_like(own)
        cb, back_c = _shifted(p["c"], p["cb"]), np.ascontiguousarray(p["c"].T)
        loss = 0.0
        for first in range(0, len(own), TILE):
            at = slice(first, first + TILE)
            prob, lost = _errors(own[at], p["c"], cb, target[at])
            loss += lost
            grads["c"] += own[at].T @ prob
            grads["cb"] += np.ones(len(prob), kind) @ prob
            np.matmul(prob, back_c, out=back[at])
        for c, a, b in runs:
            w = p["w"][c]
            wb = _shifted(w, p["wb"][c])
            for first in range(a, b, TILE):
                at = slice(first, min(first + TILE, b))
                q, lost = _errors(own[at], w, wb, word[at])
                loss += lost
                grads["w"][c] += own[at].T @ q
                grads["wb"][c] += np.ones(len(q), kind) @ q
                back[at] += q @ w.T
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        back = back.take(place, 0).reshape(steps, lanes, n)
        dh = np.zeros((lanes, n), kind)
        da, dr = np.empty((steps, lanes, 3, n), kind), np.empty((3, lanes, n), kind)
        u = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 2, 0))
        of_u = np.zeros((3, n, n), kind)
        for t in reversed(range(steps)):
            (z, reset, new), rn = gates[t], candidate[t]
            dh += back[t]
            keep = dh * z
            dnew = dh
            dnew -= keep
            dnew *= 1 - new * new
            np.subtract(before[t], new, out=dr[0])
            dr[0] *= keep
            dr[0] *= 1 - z
            np.multiply(dnew, reset, out=dr[2])
            np.multiply(dr[2], rn, out=dr[1])
            dr[1] *= 1 - reset
            da[t, :, 0], da[t, :, 1], da[t, :, 2] = dr[0], dr[1], dnew
            of_u += np.matmul(before[t].T, dr)
            back_u = np.matmul(dr, u)
            keep += back_u[0]
            keep += back_u[1]
            keep += back_u[2]
            keep[starts[t]] = 0
            dh = keep
        grads["u"] = of_u.transpose(1, 0, 2).reshape(n, 3 * n)
        _add_rows(grads["x"], da.reshape(-1, 3 * n), inputs.ravel())
        grads["b"] = grads["x"].sum(0)
        for g in grads.values():
            g *= scale
        return grads, h, float(loss * scale)


#: Rows of logits that are held at once, so that they stay in the cache.
TILE = 512


def _shifted(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias less the largest logit that a state can have (its elements lie between -1 and 1), so that no exponential overflows."""
    return bias - (np.abs(weights).sum(0) + bias).max()


def _exponentials(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of a shifted bias, their exponentials less a shift, the rows' sums, and the further shift of each row. It
    is 0, unless a row lies so far below the bound that its sum is lost: then rows are shifted by their largest element."""
    x = h @ weights
    x += bias
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = e @ np.ones(x.shape[1], x.dtype)
    shift = np.zeros((), x.dtype)
    if x.size and not 1e-25 < total.min() <= total.max() < 1e25:
        shift = x.max(1)
        e = np.exp(x - shift[:, None])
        total = e.sum(1)
    return x, e, total, shift


def _errors(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Softmax of each row less 1 at element at[i], and the sum of the targets' negative logarithms."""
    _, e, total, _ = _exponentials(h, weights, bias)
    e *= (1 / total)[:, None]
    cells, place = e.reshape(-1), np.arange(len(e)) * e.shape[1] + at
    own = cells[place]
    cells[place] = own - 1
    return e, -float(np.log(np.maximum(own, 1e-30)).sum())


def _log_softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the share of element at[i] in row i, as doubles."""
    x, _, total, shift = _exponentials(h, weights, bias)
    own = x.reshape(-1)[np.arange(len(x)) * x.shape[1] + at].astype(np.float64)
    return own - shift - np.log(total.astype(np.float64))


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of all targets in the order of their classes, and (class, first, last + 1) of each head class that occurs."""
    order = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1))
    return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _add_rows(out: np.ndarray, rows: np.ndarray, at: np.ndarray, often: int = 32) -> None:
    """Adds each row to row at[i] of out: those that many rows go to take a sum, all others their first, second, ... row."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(at) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(at)))
    down = np.argsort(-counts, kind="stable")
    which, first, counts = sorted_[first[down]], first[down], counts[down]
    sums = np.zeros((len(first), rows.shape[1]), rows.dtype)
    many = int((counts > often).sum())
    for k in range(many):
        sums[k] = rows.take(order[first[k] : first[k] + counts[k]], 0).sum(0)
    for k in range(often):
        left = slice(many, int((counts > k).sum()))
        sums[left] += rows.take(order[first[left] + k], 0)
    out[which] += sums


def sequence(codes: np.ndarray, shapes: np.ndarray, own: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Input number, class, word in class and count of every token, ends included, and n+1 offsets."""
    counts, number = v.lookup(codes)
    lengths = np.diff(own)
    offsets = np.zeros(len(own), np.int64)
    np.cumsum(lengths + 1, out=offsets[1:])
    n = int(offsets[-1])
    place = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    inputs, classes, words = np.full(n, INPUTS - 1, np.int16), np.full(n, END_CLASS, np.int16), np.zeros(n, np.int16)
    known = np.full(n, -2, np.int64)  # the end
    head = number >= 0
    inputs[place] = np.where(head, number, HEAD + shapes.astype(np.int16))
    classes[place] = np.where(head, number // CLASS, HEAD_CLASSES + shapes.astype(np.int16))
    words[place] = np.where(head, number % CLASS, 0)
    known[place] = counts
    return inputs, classes, words, known, offsets


def shifted(inputs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each one; the end stands before the first."""
    out = np.empty_like(inputs)
    out[1:] = inputs[:-1]
    out[offsets[:-1]] = INPUTS - 1
    return out


def score_texts(net: Network, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, offsets: np.ndarray, window: int = 64, lanes: int = 1024) -> np.ndarray:
    """Sum of the natural log probabilities that the network gives to each text's tokens (classes, and words in head classes)."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths))
    before = shifted(inputs, offsets)
    order = np.argsort(-lengths, kind="stable")
    step = net.steps()
    for s in range(0, len(order), lanes):
        rows = order[s : s + lanes]
        own, first = lengths[rows], offsets[rows]
        h = np.zeros((len(rows), HIDDEN), F32)
        longer = len(own) - np.searchsorted(own[::-1], np.arange(int(own[0])), side="right")
        for t0 in range(0, int(own[0]), window):
            states, at = [], []
            for t in range(t0, min(t0 + window, int(own[0]))):
                n = int(longer[t])  # texts longer than t come first
                place = first[:n] + t
                h = step(h[:n], before[place])[0]
                states.append(h)
                at.append(place)
            place = np.concatenate(at)
            lane = np.concatenate([np.arange(len(a)) for a in at])
            got = net.log_probabilities(np.concatenate(states), classes[place], words[place])
            out[rows] += np.bincount(lane, got, minlength=len(rows))
    return out


def train_texts(net: Network, codes: np.ndarray, shapes: np.ndarray, own: np.ndarray, v: Vocabulary, rate: float) -> int:
    """Train on every token of every text, ends included, and return their number."""
    inputs, classes, words, _, offsets = sequence(codes, shapes, own, v)
    before = shifted(inputs, offsets)
    fresh = np.zeros(len(inputs), bool)
    fresh[offsets[:-1]] = True
    lanes = int(min(LANES, max(1, len(before) // STEPS)))
    # The first lanes have one token more if the tokens do not come out even.
    m, rest = divmod(len(before), lanes)
    first = np.arange(lanes) * m + np.minimum(np.arange(lanes), rest)
    h = np.zeros((lanes, HIDDEN), F32)
    for t in range(0, m, STEPS):
        at = first + np.arange(t, min(t + STEPS, m))[:, None]
        h = net.train(before[at], classes[at], words[at], fresh[at], h, rate)
    if rest:
        at = first[None, :rest] + m
        net.train(before[at], classes[at], words[at], fresh[at], h[:rest], rate)
    return len(before)


def counted(rows: DataFrame) -> DataFrame:
    """(hash, shape, c) of all tokens of the rows' texts; ends are words of the hash END and of shape -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slim, codes, shapes, _ in _gathered(batches, COUNT_WORDS):
            order = np.argsort(codes)
            codes = codes[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            n, texts = np.diff(np.append(first, len(codes))), sum(c.n for c in slim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(codes[first], U(END)).view(np.int64)), pa.array(np.append(shapes[order[first]], -1).astype(np.int32)), pa.array(np.append(n, texts).astype(np.int64))],
                names=["hash", "shape", "c"],
            )

    return tb.through_python(rows, run, "hash bigint, shape int, c bigint").groupBy("hash").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The commonest words and the totals, from the table of counts; also the number of ends."""
    # Numbers of words by count, up to a bound: at most a thousand rows come to the driver.
    kept = {r["c"]: r["n"] for r in counts.where("shape >= 0").groupBy(F.least("c", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).collect()}
    least, room = 1001, BROADCAST_WORDS
    for c in sorted(kept, reverse=True):
        if kept[c] > room:
            break
        least, room = c, room - kept[c]
    common = counts.where(F.col("shape") >= 0)
    if least > 1000 and kept:  # even the words of 1000 and more are too many: the commonest of them, by slices of their count
        high = [r[0] for r in common.where("c >= 1000").stat.approxQuantile(["c"], [max(0.0, 1 - BROADCAST_WORDS / 2 / kept[1000])], 0.0001)]
        least = int(high[0]) + 1
    got = common.where(F.col("c") >= least).select("hash", "c", "shape").toPandas().sort_values(["c", "hash"], ascending=[False, True])
    head = got.iloc[:HEAD]
    shapes = common.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tokens, types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in shapes:
        tokens[r["shape"]], types[r["shape"]] = r["c"], r["n"]
    ends = counts.where("shape < 0").agg(F.sum("c")).first()[0] or 0
    total, distinct = int(tokens.sum() + ends), int(types.sum() + (ends > 0))
    tokens -= np.bincount(head["shape"], head["c"], SHAPES).astype(np.int64)
    types -= np.bincount(head["shape"], minlength=SHAPES)
    as_codes = lambda x: x.to_numpy(np.int64).view(U)
    return Vocabulary(as_codes(got["hash"]), got["c"].to_numpy(np.int64), total, distinct, tokens, types, as_codes(head["hash"])), int(ends)


def _missing(codes: np.ndarray, own: np.ndarray, unknown: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each text, the different words that have no count here and how often they occur."""
    of, code = tb.owner(own)[unknown], codes[unknown]
    order = np.argsort(code, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    of, code = of[order], code[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(of)))
    edges = pa.array(np.searchsorted(of[first], np.arange(len(own))).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(code[first].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[tb.Chunk], np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks with their words, together at most about limit words (or one chunk)."""
    kept: list = []
    held = 0
    for chunk in tb.chunks(batches, "__text"):
        codes, shapes, own = word_codes(chunk)
        slim = tb.Chunk(chunk.batch.drop_columns(["__text"]), chunk.data[:0], chunk.offsets)
        kept.append((slim, codes, shapes.astype(np.int8), own))
        held += len(codes)
        if held >= limit:
            yield _joined(kept)
            kept, held = [], 0
    if kept:
        yield _joined(kept)


def _joined(kept: list) -> tuple[list[tb.Chunk], np.ndarray, np.ndarray, np.ndarray]:
    own = np.concatenate([[0], *[k[3][1:] - k[3][:-1] for k in kept]]).cumsum()
    return [k[0] for k in kept], np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept]), own


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of each shard; rows come sorted by shard, which is the first column."""
    parts = (batch.slice(a, b - a) for batch in batches for a, b in _runs(batch.column(0).to_numpy()))
    for shard, own in itertools.groupby(parts, lambda part: part.column(0)[0].as_py()):
        yield shard, own


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(values)]) if len(values) else iter(())


def trained(rows: DataFrame, v: Vocabulary, ends: int) -> Network:
    """The averaged network after ROUNDS rounds over all training rows (id, __text)."""
    spark = rows.sparkSession
    net = Network.start(v, ends)
    shared_v = spark.sparkContext.broadcast(v)
    sizes = {k: a.size for k, a in net.p.items()}
    n_shards = int(min(SHARDS, max(1, -(-v.total // SHARD_TOKENS))))
    dealt = rows.select(F.xxhash64("id", "__text").alias("h"), "id", "__text").select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "h", "id", "__text")
    dealt = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "h", "id").select("shard", "__text")
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net.p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            for shard, own_batches in _by_shard(batches):
                own_net = Network({k: a.copy() for k, a in shared.value.items()})
                done = sum(train_texts(own_net, codes, shapes, own, shared_v.value, RATE / (1 + r)) for _, codes, shapes, own in _gathered(own_batches, SCORE_WORDS))
                flat = np.concatenate([own_net.p[k].ravel() for k in Network.NAMES]).astype(np.float64) * done
                parts = [x.tobytes() for x in np.array_split(flat, SLICES)]
                columns = [pa.array(range(SLICES), pa.int32()), pa.array([shard] * SLICES, pa.int32()), pa.array([float(done)] * SLICES), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "n", "weights"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")  # so that sums are rounded alike
            total = np.zeros(len(pdf["weights"].iloc[0]) // 8)
            for raw in pdf["weights"]:
                total += np.frombuffer(raw)
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [pdf["n"].sum()], "weights": [(total / pdf["n"].sum()).astype(F32).tobytes()]})

        copies = tb.through_python(dealt, run, "part int, shard int, n double, weights binary")
        got = sorted(copies.groupBy("part").applyInPandas(add, "part int, n double, weights binary").collect(), key=lambda x: x["part"])
        if got:
            flat, at, weights = np.concatenate([np.frombuffer(x["weights"], F32) for x in got]), 0, {}
            for k in Network.NAMES:
                weights[k] = flat[at : at + sizes[k]].reshape(net.p[k].shape).copy()
                at += sizes[k]
            net = Network(weights)
    return net


def scores(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "lm") -> tuple[DataFrame, Scratch]:
    """Base and model scores of every row, and the folder of the tables behind them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("__text"))
    counts = scratch.keep(counted(rows.where("NOT held_out").select("__text")), "counts")
    v, ends = vocabulary(counts)
    net = trained(rows.where("NOT held_out").select("id", "__text"), v, ends)
    shared = spark.sparkContext.broadcast((v, net.p))
    end_log = math.log10(ends + 0.5)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = shared.value
        own_net = Network(weights)
        shape_log = np.log10(v.shape_tokens + 0.5 * (v.shape_words + 1))
        for slim, codes, shapes, own in _gathered(batches, SCORE_WORDS):
            inputs, classes, words, known, offsets = sequence(codes, shapes, own, v)
            logs = score_texts(own_net, inputs, classes, words, offsets) / math.log(10)
            c_log = np.log10(np.maximum(known, 0) + 0.5)
            rare = (classes >= HEAD_CLASSES) & (classes < END_CLASS)
            # Words that are not here count as unknown; the join adds the difference for those that are known after all.
            logs += tb.per_text(np.where(rare, c_log - shape_log[np.where(rare, classes - HEAD_CLASSES, 0)], 0.0), offsets)
            base = tb.per_text(np.where(known == -2, end_log, c_log), offsets)
            sure = tb.per_text((known > 0) | ((known == -2) & (ends > 0)), offsets)
            missing = _missing(codes, own, known[known != -2] == -1)
            at = 0
            for c in slim:
                n = c.batch.num_rows
                columns = [c.batch.column(k) for k in range(3)]
                part = slice(at, at + n)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(offsets)[part]), pa.array(sure[part]), pa.array(base[part]), pa.array(logs[part]), *(x.slice(at, n) for x in missing)],
                    names=["id", "held_out", "row", "n_tokens", "sure", "base", "model", "hashes", "times"],
                )
                at += n

    row_kind = rows.schema["id"].dataType.simpleString()
    # A row's number is written with what was measured, so a retry cannot change it.
    numbered = rows.select("id", "held_out", F.monotonically_increasing_id().alias("row"), "__text")
    measured = tb.through_python(numbered, measure, f"id {row_kind}, held_out boolean, row bigint, n_tokens bigint, sure bigint, base double, model double, hashes array<bigint>, times array<int>")
    measured = scratch.keep(measured, "measured")
    unseen = measured.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("w")).select("row", F.col("w.hashes").alias("hash"), F.col("w.times").alias("tf"))
    known = unseen.join(counts.where("shape >= 0").select("hash", "c"), "hash")
    gain = F.col("tf") * (F.log10(F.col("c") + 0.5) - F.lit(math.log10(0.5)))
    late = known.groupBy("row").agg(F.sum("tf").alias("late"), F.sum(gain).alias("gain"))
    norm = math.log10(v.total + 0.5 * (v.distinct + 1))
    joined = measured.drop("hashes", "times").join(late, "row", "left")
    gained = F.coalesce("gain", F.lit(0.0))
    return joined.select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("sure") + F.coalesce("late", F.lit(0))).cast("bigint").alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + gained - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + gained).alias("score"),
    ), scratch
