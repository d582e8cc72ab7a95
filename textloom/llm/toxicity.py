"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the last states of a character network read in both directions, beside a hashed word vector. A
window of WINDOW words is read in both directions, pooled by attention and scored. All overlapping windows of a
text (one from every word that has WINDOW words from it on) are scored, the text's score is that of its most toxic
window, calibrated by a logistic fit. Words longer than PIECE characters count as several, so nothing of a text is
left out. Gates and states are piecewise linear (clipped), which costs less than half of the exponential forms.

The network is trained in numpy, by one task, with a fixed number of steps on a bounded sample of labelled texts (SAMPLE of each
class, up to SAMPLE_CHARS characters each). Labels are of whole texts, so a text's windows share its label by a
noisy or: a clean text has no toxic window, a toxic one some.

Defined results: null and empty texts are one window of padding and get its score; repeated rows get equal scores;
without labels of both classes every score is 0; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.common import quoted, released, slices, table, unused

WINDOW, PIECE = 16, 16
#: Windows that are scored at once; the words between the starts of a training bag's windows (scoring takes every start).
BLOCK, APART = 2048, 12
#: Words whose inputs a task remembers.
KNOWN = 250_000
#: Labelled texts of each class that are learned from, and the most characters of one.
SAMPLE, SAMPLE_CHARS = 1600, 20_000
STEPS, BAGS, BAG_WINDOWS, RATE, DECAY = 440, 24, 8, 0.02, 0.3
CHARS, BUCKETS, CHAR_IN, CHAR_H, WORD_IN, WORD_H, ATTEND = 128, 4096, 8, 8, 8, 8, 8
THRESHOLD = 0.7


def pieces(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of all texts (a list or an Arrow array), each piece's number in order of the texts, and how many
    each text has. A piece is a word in lower case, or PIECE characters of a longer one."""
    texts = pc.fill_null(pc.cast(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), pa.large_string()), "")
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(flat, "")  # at the ends of a text
    words = flat.dictionary_encode()
    owner = np.repeat(np.arange(len(counts)), counts)[there.to_numpy(zero_copy_only=False)]
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[there.to_numpy(zero_copy_only=False)]
    names = words.dictionary.to_pylist()
    long = np.flatnonzero(pc.greater(pc.utf8_length(words.dictionary), PIECE).to_numpy(zero_copy_only=False)).tolist()
    if long:
        known, parts = {w: k for k, w in enumerate(names)}, {}
        for k in long:
            w = names[k]
            parts[k] = [known.setdefault(x, len(known)) for x in (w[j : j + PIECE] for j in range(0, len(w), PIECE))]
        size = np.ones(len(names), np.int64)
        size[long] = [len(parts[k]) for k in long]
        names, n = list(known), size[codes]
        starts = np.cumsum(n) - n
        out = np.repeat(codes, n)
        of_long = np.zeros(len(size), bool)
        of_long[long] = True
        for at in np.flatnonzero(of_long[codes]).tolist():
            out[starts[at] : starts[at] + n[at]] = parts[int(codes[at])]
        codes, owner = out, np.repeat(owner, n)
    return names, codes, np.bincount(owner, minlength=len(counts))


def char_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character numbers forward and backward (left-aligned, 0 behind the end) and lengths."""
    n = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % (CHARS - 1) + 1
    there = np.arange(PIECE)[None, :] < n[:, None]
    forward = np.zeros((len(words), PIECE), np.int64)
    forward[there] = codes
    at = np.where(there, n[:, None] - 1 - np.arange(PIECE)[None, :], 0)
    return forward, np.where(there, np.take_along_axis(forward, at, 1), 0), n


def word_buckets(words: list[str]) -> np.ndarray:
    """A hash of each word without the marks around it."""
    cores = [w.strip(".,;:!?\"'()[]|*%$&#").encode() for w in words]
    n = np.array([len(c) for c in cores], np.int64)
    ends, codes = np.cumsum(n), np.frombuffer(b"".join(cores), np.uint8).astype(np.uint64)
    order = np.argsort(-n, kind="stable")
    firsts, falling = (ends - n)[order], -n[order]
    h = np.full(len(words), 2166136261, np.uint64)
    for t in range(int(n.max(initial=0))):  # only the words that are longer than the step
        m = int(np.searchsorted(falling, -t, "left"))
        h[:m] = (h[:m] ^ codes[firsts[:m] + t]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(words), np.int64)
    out[order] = h % np.uint64(BUCKETS)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


clipped = np._core.umath.clip  # without the checks of np.clip, which cost more than small arrays do
ZERO, ONE, MINUS_ONE, HALF, SLOPE = (np.float32(x) for x in (0, 1, -1, 0.5, 0.25))


def gate(x):
    """The piecewise linear gate: x / 4 + 1 / 2 between 0 and 1. States and attention are clipped to -1 and 1."""
    return np.clip(SLOPE * x + HALF, ZERO, ONE)


def last_states(x, u, out, backward=False):
    """States of all steps of the windows at every start into ``out`` (steps, H, windows), without what training needs.
    x: projected inputs of successive words as columns. x and u are ``scaled``."""
    size, count = u.shape[0], out.shape[2]
    turned, a = np.ascontiguousarray(u.T), np.empty((3 * size, count), np.float32)
    gates, n = a[: 2 * size], a[2 * size :]
    h = None
    for t in reversed(range(WINDOW)) if backward else range(WINDOW):
        now, new = x[:, t : t + count], out[t]
        if h is None:  # the state before the first step is 0
            clipped(now[:size], ZERO, ONE, gates[:size])
            clipped(now[2 * size :], MINUS_ONE, ONE, n)
            np.multiply(gates[:size], n, out=new)
            np.subtract(n, new, out=new)
        else:
            np.matmul(turned, h, out=a)
            gates += now[: 2 * size]
            clipped(gates, ZERO, ONE, gates)
            n *= gates[size:]
            n += now[2 * size :]
            clipped(n, MINUS_ONE, ONE, n)
            np.subtract(h, n, out=new)
            new *= gates[:size]
            new += n
        h = new


def scaled(x, size, shift=True):
    """Projected inputs, or recurrent weights (without ``shift``), such that ``gate`` is but a clip of their sum."""
    out = np.array(x, np.float32)
    out[:, : 2 * size] *= SLOPE
    if shift:
        out[:, : 2 * size] += HALF
    return out


def gru(inputs, u, mask=None):
    """States of all steps and what backpropagation needs. inputs: steps of (rows, 3 H), the projected inputs."""
    size = u.shape[0]
    h = np.zeros((inputs[0].shape[0], size), np.float32)
    states, kept = [], []
    for t, x in enumerate(inputs):
        a = h @ u
        gates = gate(x[:, : 2 * size] + a[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        n = np.clip(x[:, 2 * size :] + r * a[:, 2 * size :], MINUS_ONE, ONE)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t], new, h)
        kept.append((h, z, r, n, a[:, 2 * size :]))
        states.append(new)
        h = new
    return states, kept


def gru_back(grads, kept, u, mask=None):
    """Gradients of the projected inputs and of u. grads: those of each step's state."""
    size = u.shape[0]
    du, carry, out = np.zeros_like(u), np.zeros_like(grads[0]), [None] * len(kept)
    for t in reversed(range(len(kept))):
        h, z, r, n, an = kept[t]
        d = grads[t] + carry
        held = 0
        if mask is not None:
            held, d = np.where(mask[t], 0, d), np.where(mask[t], d, 0)
        dn = d * (1 - z) * (np.abs(n) < 1)
        dz = d * (h - n) * SLOPE * ((z > 0) & (z < 1))
        dr = dn * an * SLOPE * ((r > 0) & (r < 1))
        out[t] = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ da
        carry = d * z + da @ u.T + held
    return out, du


class Network:
    """Parameters by name, forward and backward passes."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        each = 2 * CHAR_H + WORD_IN
        self.p = {"chars": (make(CHARS, CHAR_IN) * 4).astype(np.float32), "words": np.zeros((BUCKETS, WORD_IN), np.float32), "att": make(2 * WORD_H, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": make(ATTEND), "out": make(2 * WORD_H), "out_b": np.full(1, -3, np.float32)}
        for d in "fb":
            self.p |= {f"cw{d}": make(CHAR_IN, 3 * CHAR_H), f"cu{d}": make(CHAR_H, 3 * CHAR_H), f"cb{d}": np.zeros(3 * CHAR_H, np.float32)}
            self.p |= {f"w{d}": make(each, 3 * WORD_H), f"u{d}": make(WORD_H, 3 * WORD_H), f"b{d}": np.zeros(3 * WORD_H, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def word_inputs(self, words: list[str], keep: bool = False):
        """The input vectors of words."""
        p = self.p
        forward, backward, n = char_rows(words)
        order = np.argsort(-n, kind="stable")
        buckets = word_buckets(words)
        ends, kept = [], {}
        for d, rows in (("f", forward), ("b", backward)):
            projected = p["chars"] @ p[f"cw{d}"] + p[f"cb{d}"]
            if keep:
                mask = [(n > t)[:, None] for t in range(PIECE)]
                states, saved = gru([projected[rows[:, t]] for t in range(PIECE)], p[f"cu{d}"], mask)
                ends.append(states[-1])
                kept[d] = (rows, mask, saved)
            else:
                back = np.empty((len(words), CHAR_H), np.float32)
                back[order] = char_states(np.ascontiguousarray(scaled(projected, CHAR_H).T), scaled(p[f"cu{d}"], CHAR_H, False), rows[order], n[order])
                ends.append(back)
        x = np.concatenate([*ends, p["words"][buckets]], 1)
        return (x, (kept, buckets)) if keep else x

    def logits(self, projected_f, projected_b, windows, lens):
        """Scores of windows (rows of word numbers; lens: words of each) and what training keeps. projected: inputs of
        word numbers."""
        p = self.p
        f, kept_f = gru([projected_f[windows[:, t]] for t in range(WINDOW)], p["uf"])
        b, kept_b = gru([projected_b[windows[:, t]] for t in reversed(range(WINDOW))], p["ub"])
        h = np.stack([np.concatenate([f[t], b[WINDOW - 1 - t]], 1) for t in range(WINDOW)], 1)
        inner = np.clip(h @ p["att"] + p["att_b"], MINUS_ONE, ONE)
        score = np.where(np.arange(WINDOW)[None, :] < lens[:, None], inner @ p["att_v"], -30)
        e = np.exp(score - score.max(1, keepdims=True))
        a = e / e.sum(1, keepdims=True)
        pooled = (a[:, :, None] * h).sum(1)
        return pooled @ p["out"] + p["out_b"][0], (kept_f, kept_b, h, inner, a, pooled)

    def all_logits(self, scaled_f, scaled_b, numbers, lens):
        """Scores of the windows at every start in a run of word numbers (lens: words of each). scaled: ``scaled`` projected
        inputs of word numbers."""
        p, count = self.p, len(numbers) - WINDOW + 1
        h = np.empty((WINDOW, 2 * WORD_H, count), np.float32)
        last_states(np.ascontiguousarray(scaled_f.take(numbers, axis=0).T), scaled(p["uf"], WORD_H, False), h[:, :WORD_H])
        last_states(np.ascontiguousarray(scaled_b.take(numbers, axis=0).T), scaled(p["ub"], WORD_H, False), h[:, WORD_H:], True)
        turned, score, value = np.ascontiguousarray(p["att"].T), np.empty((WINDOW, count), np.float32), np.empty((WINDOW, count), np.float32)
        inner = np.empty((ATTEND, count), np.float32)
        for t in range(WINDOW):
            np.matmul(turned, h[t], out=inner)
            inner += p["att_b"][:, None]
            clipped(inner, MINUS_ONE, ONE, inner)
            np.matmul(p["att_v"], inner, out=score[t])
            np.matmul(p["out"], h[t], out=value[t])
        if lens.min() < WINDOW:
            score = np.where(np.arange(WINDOW)[:, None] < lens[None, :], score, np.float32(-30))
        score -= score.max(0)
        e = np.exp(score, out=score)
        value *= e
        return value.sum(0) / e.sum(0) + p["out_b"][0]

    def projected(self, x):
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"]

    def gradients(self, words: list[str], windows, lens, d_logit_of):
        """Loss gradients of all parameters. d_logit_of: the windows' logits to (loss, their gradients)."""
        p, g = self.p, {}
        x, (kept_chars, buckets) = self.word_inputs(words, True)
        out, (kept_f, kept_b, h, inner, a, pooled) = self.logits(*self.projected(x), windows, lens)
        loss, d = d_logit_of(out)
        g["out"], g["out_b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["out"]
        d_a = (h * d_pooled[:, None, :]).sum(2)
        d_h = a[:, :, None] * d_pooled[:, None, :]
        d_score = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["att_v"] = np.einsum("nt,ntk->k", d_score, inner)
        d_inner = d_score[:, :, None] * p["att_v"] * (np.abs(inner) < 1)
        g["att_b"] = d_inner.sum((0, 1))
        g["att"] = np.einsum("nti,ntk->ik", h, d_inner)
        d_h = d_h + d_inner @ p["att"].T
        d_x = np.zeros_like(x)
        for k, kept in (("f", kept_f), ("b", kept_b)):
            steps = range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1)
            part = slice(0, WORD_H) if k == "f" else slice(WORD_H, 2 * WORD_H)
            d_in, g[f"u{k}"] = gru_back([np.ascontiguousarray(d_h[:, t, part]) for t in steps], kept, p[f"u{k}"])
            total = np.zeros((len(words), 3 * WORD_H), np.float32)
            np.add.at(total, np.concatenate([windows[:, t] for t in steps]), np.concatenate(d_in))
            g[f"w{k}"], g[f"b{k}"] = x.T @ total, total.sum(0)
            d_x += total @ p[f"w{k}"].T
        g["chars"], g["words"] = np.zeros_like(p["chars"]), np.zeros_like(p["words"])
        np.add.at(g["words"], buckets, d_x[:, 2 * CHAR_H :])
        for j, k in enumerate("fb"):
            rows, mask, saved = kept_chars[k]
            last = [np.zeros((len(words), CHAR_H), np.float32) for _ in range(PIECE - 1)] + [d_x[:, j * CHAR_H : (j + 1) * CHAR_H]]
            d_in, g[f"cu{k}"] = gru_back(last, saved, p[f"cu{k}"], mask)
            total = np.zeros((CHARS, 3 * CHAR_H), np.float32)
            np.add.at(total, rows.T.ravel(), np.concatenate(d_in))
            g[f"cw{k}"], g[f"cb{k}"] = p["chars"].T @ total, total.sum(0)
            g["chars"] += total @ p[f"cw{k}"].T
        return loss, g


def char_states(table_, u, rows, n) -> np.ndarray:
    """The last states of the character network for words (rows of character numbers) that fall in length ``n``. table_:
    the ``scaled`` inputs of the characters as columns."""
    size, turned = u.shape[0], np.ascontiguousarray(u.T)
    out = np.empty((len(rows), size), np.float32)
    for a in range(0, len(rows), BLOCK):
        codes, falling = np.ascontiguousarray(rows[a : a + BLOCK].T), -n[a : a + BLOCK]
        h = np.zeros((size, codes.shape[1]), np.float32)
        for t in range(PIECE):
            m = int(np.searchsorted(falling, -t, "left"))  # only the words that are longer than the step
            if not m:
                break
            x, state = table_.take(codes[t, :m], axis=1), h[:, :m]
            y = turned @ state
            gates, new = y[: 2 * size], y[2 * size :]
            gates += x[: 2 * size]
            clipped(gates, ZERO, ONE, gates)
            new *= gates[size:]
            new += x[2 * size :]
            clipped(new, MINUS_ONE, ONE, new)
            state -= new
            state *= gates[:size]
            state += new
        out[a : a + BLOCK] = h.T
    return out


def window_rows(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text's word numbers (0 is padding) from ``starts`` on, and how many words each has."""
    n = len(numbers)
    at = starts[:, None] + np.arange(WINDOW)[None, :]
    return np.concatenate([numbers, np.zeros(WINDOW, numbers.dtype)])[np.minimum(at, n)], np.minimum(n - starts, WINDOW)


def last_start(numbers: np.ndarray) -> int:
    return max(0, len(numbers) - WINDOW)


class Scorer:
    """Scores texts; keeps the projected inputs of up to about KNOWN words."""

    def __init__(self, network: Network):
        self.network, self.known, self.rows = network, {}, [np.empty((1024, 3 * WORD_H), np.float32) for _ in range(2)]

    def add(self, words: list[str], x: np.ndarray) -> None:
        base, stop = len(self.known), len(self.known) + len(words)
        self.known.update(zip(words, range(base, stop)))
        for k, made in enumerate(self.network.projected(x)):
            if stop > len(self.rows[k]):
                self.rows[k] = np.concatenate([self.rows[k][:base], np.empty((max(stop, 2 * base) - base, 3 * WORD_H), np.float32)])
            self.rows[k][base:stop] = scaled(made, WORD_H)

    def numbers(self, names: list[str], used: np.ndarray) -> np.ndarray:
        """The rows of ``names`` (of those that are used)."""
        if len(self.known) > KNOWN or not self.known:
            self.known = {}
            self.add([""], np.zeros((1, 2 * CHAR_H + WORD_IN), np.float32))
        known = self.known
        fresh = [w for w, there in zip(names, used.tolist()) if there and w not in known]
        for a in range(0, len(fresh), 8192):
            self.add(fresh[a : a + 8192], self.network.word_inputs(fresh[a : a + 8192]))
        return np.array([known.get(w, 0) for w in names], np.int64)

    def windows(self, texts):
        """The logit of the window at every start, and the text each belongs to."""
        names, codes, counts = pieces(texts)
        used = np.zeros(len(names), bool)
        used[codes] = True
        words = self.numbers(names, used)[codes] if names else codes
        sizes = np.maximum(WINDOW, counts)
        ends = np.cumsum(sizes)
        run = np.zeros(sizes.sum(), np.int64)
        run[np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts) + np.arange(len(words))] = words
        owner = np.repeat(np.arange(len(counts)), sizes)
        lens = np.minimum(counts, WINDOW)[owner]
        count = len(run) - WINDOW + 1
        out = [self.network.all_logits(*self.rows, run[a : min(a + BLOCK, count) + WINDOW - 1], lens[a : min(a + BLOCK, count)]) for a in range(0, count, BLOCK)]
        inside = np.arange(count) <= (ends - WINDOW)[owner[:count]]  # no window runs into the next text
        return np.concatenate(out)[inside], owner[:count][inside]

    def best(self, texts) -> np.ndarray:
        logits, owner = self.windows(texts)
        return np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(texts))))

    def scores(self, texts) -> np.ndarray:
        return sigmoid(self.network.scale * self.best(texts).astype(np.float64) + self.network.shift)


def noisy_or(bags: np.ndarray, labels: np.ndarray):
    """The loss of bags of windows: -log p for label 1, -log(1 - p) for 0, with 1 - p the product over the windows."""

    def of(logits):
        q = sigmoid(logits.astype(np.float64))
        quiet = np.bincount(bags, np.logaddexp(0, logits), len(labels))  # -log(1 - p)
        p = np.clip(-np.expm1(-quiet), 1e-6, 1)
        loss = np.where(labels == 1, -np.log(p), quiet).mean()
        d = np.where(labels == 1, -(1 - p) / p, 1.0)[bags] * q / len(labels)
        return loss, d.astype(np.float32)

    return of


def trained(texts: list[str | None], labels: np.ndarray, share: float = 0.5, seed: int = 1) -> Network | None:
    """A network fitted with a fixed number of steps; None without both classes. share: of toxic texts, where the
    network is to be used."""
    labels = np.asarray(labels)
    if len({*labels.tolist()}) < 2:
        return None
    r, network = np.random.default_rng(seed), Network(seed)
    names, codes, counts = pieces(texts)
    parts = np.split(codes + 1, np.cumsum(counts)[:-1])
    names = ["", *names]  # 0 is padding
    # Every fifth text of a class is kept back for the calibration.
    sides = [np.flatnonzero(labels == k) for k in (0, 1)]
    aside = np.concatenate([x[4::5] for x in sides])
    sides = [np.delete(x, slice(4, None, 5)) for x in sides]
    hard: dict[int, np.ndarray] = {}
    m, v = ({k: np.zeros_like(x) for k, x in network.p.items()} for _ in range(2))
    for step in range(STEPS):
        if step in (STEPS // 4, STEPS // 2, 3 * STEPS // 4):  # the windows that look worst are seen more often
            scorer, long = Scorer(network), [k for k in np.concatenate(sides) if last_start(parts[k]) > (BAG_WINDOWS - 1) * APART]
            for a in range(0, len(long), 200):
                group = long[a : a + 200]
                logits, owner = scorer.windows([texts[k] for k in group])
                for j, k in enumerate(group):
                    own = logits[owner == j]
                    top = [a + int(own[a : a + APART].argmax()) for a in range(0, len(own), APART)]
                    hard[k] = np.array(sorted(top, key=lambda s: -own[s])[: BAG_WINDOWS // 2])
        chosen = np.concatenate([r.choice(s, BAGS) for s in sides])
        rows, lens, bags = [], [], []
        for j, k in enumerate(chosen):
            last = last_start(parts[k])
            # Windows that hold every word of the text; their places differ each time, so all starts are learned from.
            pick = np.unique(np.clip(np.arange(r.integers(APART) - APART, last + APART, APART), 0, last))
            if last > (BAG_WINDOWS - 1) * APART:
                pick = np.unique(np.concatenate([hard.get(k, []), r.choice(pick, BAG_WINDOWS - len(hard.get(k, [])), False)]).astype(np.int64))
            w, n = window_rows(parts[k], pick)
            rows.append(w)
            lens.append(n)
            bags.append(np.full(len(pick), j))
        used, local = np.unique(np.concatenate(rows), return_inverse=True)
        _, g = network.gradients([names[k] for k in used], local.reshape(-1, WINDOW), np.concatenate(lens), noisy_or(np.concatenate(bags), labels[chosen]))
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1, (step + 1) / 20) * (1.05 - step / STEPS)
        for k, x in g.items():
            x = x * min(1, 1 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            network.p[k] = (network.p[k] * (1 - rate * DECAY) - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    scorer = Scorer(network)
    if len({*labels[aside].tolist()}) < 2:
        aside = np.arange(len(texts))
    best = np.concatenate([scorer.best([texts[k] for k in aside[a : a + 200]]) for a in range(0, len(aside), 200)]).astype(np.float64)
    network.scale, network.shift = calibrated(best, labels[aside], share)
    return network


def calibrated(x: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit to softened labels, with the classes weighted by ``share``."""
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    target = np.where(labels == 1, 0.995, 0.005)
    best = (np.inf, 1.0, 0.0)
    for a in np.geomspace(0.1, 3, 35):
        low, high = -60.0, 60.0
        for _ in range(60):  # the shift at which the mean score is right; it falls between the bounds
            b = (low + high) / 2
            low, high = (b, high) if (weight * (sigmoid(a * x + b) - target)).sum() < 0 else (low, b)
        p = np.clip(sigmoid(a * x + b), 1e-9, 1 - 1e-9)
        loss = -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()
        best = min(best, (loss + 1e-3 * np.log(a) ** 2, float(a), float(b)))
    return best[1], best[2]


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network from the labelled rows that are not held out, drawn by a hash of the id. Ids may be of any type; of texts
    that share one, the least is learned from."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).alias("mark"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("n")).filter(~held_out(F.col("doc_id")))
    known = sizes.join(marks, F.col("doc_id") == F.col("of"))
    n, ones = known.agg(F.count("*"), F.count_if(F.col("mark") == 1)).first()
    fits = known.filter(F.col("n").between(1, SAMPLE_CHARS))
    few = [fits.filter(F.col("mark") == k).select("of", "mark").distinct().orderBy(F.xxhash64("of"), "of").limit(SAMPLE) for k in (1, 0)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    chosen = texts.join(F.broadcast(few[0].union(few[1])), F.col("doc_id") == F.col("of"))  # 2 * SAMPLE rows at most
    rows = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("mark").alias("mark")).repartition(1).sortWithinPartitions("doc_id").select("text", "mark")
    share = ones / max(1, n)

    def fit(it):  # the sample is bounded; a task trains on it, so neither its texts nor what training needs are on the driver
        texts, marks = [], []
        for batch in it:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        network = trained(texts, np.array(marks), share) if texts else None
        texts = marks = None
        released()
        if network:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    found = rows.mapInArrow(fit, "network binary").collect()
    return pickle.loads(found[0]["network"]) if found else None


def with_scores(docs: DataFrame, network: Network | None, text_col: str = "text", score_col: str = "tl_score") -> DataFrame:
    """``docs`` and the score of its text column as a further, last column. ``score_col`` may be no column of ``docs``."""
    at = docs.columns.index(text_col)

    def run(it):
        scorer = Scorer(network) if network else None
        for batch in slices(it, 512, 2 << 20, f"c{at}"):
            texts = batch.column(at)
            out = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])
        scorer = None
        released()

    # Python is handed columns by their names, in which a dot would be read as a path.
    plain = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    found = docs.toDF(*(f.name for f in plain)).mapInArrow(run, StructType([*plain, StructField("score", DoubleType())]))
    return found.toDF(*docs.columns, score_col)


def without_toxic(docs: DataFrame, network: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold. Columns may have any names."""
    name = unused("score", docs.columns)
    return with_scores(docs, network, text_col, name).filter(F.col(name) < threshold).select(*map(quoted, docs.columns))


def scored(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score."""
    return with_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), network).select("doc_id", F.col("tl_score").alias("score"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
