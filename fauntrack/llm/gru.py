"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, documents in lanes.

Documents of a batch are dealt to lanes, end to end; a lane's state is carried
from window to window and is set to zero where a document begins, so a
document's log-likelihood covers all of it whatever its length. A word's
probability is that of its class times that of the word within the class;
classes hold about equal shares of the root of the words' mass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Width of the state, number of classes, steps of a window, and lanes at most.
WIDTH, CLASSES, STEPS, LANES = 24, 32, 16, 256
#: Step of Adam, its decays, and the largest norm of a gradient (per token).
RATE, DECAY, CLIP = 0.02, (0.9, 0.99), 1.0

F32 = np.float32


def classes_of(mass: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """Class of every word by the cumulated root of its mass; words are in falling order of mass, so classes are runs."""
    share = np.cumsum(np.sqrt(mass))
    return np.minimum((share - np.sqrt(mass) / 2) / max(share[-1], 1e-30) * n, n - 1).astype(np.int64)


@dataclass
class Shape:
    """What a model's parameters belong to: words in falling order of mass, and where each class begins."""

    words: int
    starts: np.ndarray
    width: int = WIDTH

    @classmethod
    def of(cls, mass: np.ndarray, width: int = WIDTH, n: int = CLASSES) -> Shape:
        k = classes_of(mass, n)
        return cls(len(mass), np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(mass)), width)

    @property
    def classes(self) -> int:
        return len(self.starts) - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        v, h, c = self.words, self.width, self.classes
        return {"inputs": (v, 3 * h), "state": (h, 3 * h), "to_class": (h, c), "class_bias": (c,), "to_word": (v, h), "word_bias": (v,)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out


def first_parameters(shape: Shape, mass: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random weights; the biases give every word its share of the mass, so that an untrained model is the unigram model."""
    flat = (np.random.default_rng(seed).standard_normal(shape.size) * 0.1).astype(F32)
    p = shape.views(flat)
    p["class_bias"][:] = np.log(np.add.reduceat(mass, shape.starts[:-1]))
    p["word_bias"][:] = np.log(mass)
    for name in ("to_class", "to_word"):
        p[name] *= 0.1
    return flat


# ---------------------------------------------------------------- lanes


@dataclass
class Lanes:
    """Tokens in the order of lanes: for each the token before, whether a document begins, and its document; where lanes begin and how long they are (falling)."""

    before: np.ndarray
    now: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, sizes: np.ndarray, first: int, lane_sizes: np.ndarray, order: np.ndarray | None = None) -> Lanes:
        """Documents (runs of tokens of the given sizes, each one at least) end to end in the given order, cut into lanes."""
        starts = np.cumsum(sizes) - sizes
        if order is not None:
            sizes, starts = sizes[order], starts[order]
            at = np.cumsum(sizes) - sizes
            tokens = tokens[np.repeat(starts - at, sizes) + np.arange(len(tokens))]
            starts = at
        doc = np.repeat(np.arange(len(sizes)) if order is None else order, sizes).astype(np.int32)
        before, begin = np.empty(len(tokens), np.int32), np.zeros(len(tokens), bool)
        before[1:] = tokens[:-1]
        before[starts], begin[starts] = first, True
        lane_starts = np.cumsum(lane_sizes) - lane_sizes
        begin[lane_starts] = True
        return cls(before, tokens.astype(np.int32), begin, doc, lane_starts, lane_sizes)

    def windows(self, steps: int = STEPS) -> Iterator[tuple[np.ndarray, ...]]:
        """before, now, begin, doc (-1: the lane is over) of (steps, lanes that are not over); the lanes are the first of the window before."""
        for t in range(0, int(self.sizes[0]) if len(self.sizes) else 0, steps):
            live = int(np.searchsorted(-self.sizes, -t, side="left"))
            step = np.arange(t, min(t + steps, int(self.sizes[0])))[:, None]
            over = step >= self.sizes[:live]
            at = np.where(over, 0, self.starts[:live] + step)
            yield self.before[at], self.now[at], self.begin[at], np.where(over, -1, self.doc[at])


def lanes(tokens: np.ndarray, sizes: np.ndarray, first: int, most: int = LANES) -> Lanes:
    """Whole documents dealt to lanes, the longest first to the shortest lane."""
    n = min(most, len(sizes))
    free, inside, filled = [(0, k) for k in range(n)], [[] for _ in range(n)], np.zeros(n, np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        used, k = heapq.heappop(free)
        inside[k].append(d)
        filled[k] += sizes[d]
        heapq.heappush(free, (used + int(sizes[d]), k))
    order = np.argsort(-filled, kind="stable")
    return Lanes.of(tokens, sizes, first, filled[order], np.concatenate([inside[k] for k in order]))


def even_lanes(tokens: np.ndarray, sizes: np.ndarray, first: int, most: int = LANES) -> Lanes:
    """For training: all documents end to end, cut into lanes of equal length, so that every step has as many tokens.

    A document that a cut goes through begins anew there, with the right token before.
    """
    steps = -(-len(tokens) // most)
    return Lanes.of(tokens, sizes, first, np.array([min(steps, len(tokens) - k) for k in range(0, len(tokens), steps)]))


# ---------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: Exponents up to this need no shift: neither they nor the sums of them leave what a float32 holds.
PLAIN = 60.0


def _bound(weights: np.ndarray) -> float:
    """Largest magnitude of a row of weights times a vector with no component beyond one."""
    return float(np.abs(weights).sum(axis=1).max())


def row_sums(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for each the sum of its rows.

    Runs of a key add up side by side, their k-th rows in step k; the few long ones each by themselves.
    """
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(at, len(key)))
    falling = np.argsort(-size, kind="stable")
    at, size = at[falling], size[falling]
    found = key[at]
    rows = np.take(rows, order, axis=0)
    out = np.take(rows, at, axis=0)
    long = int(np.searchsorted(-size, -16, side="left"))
    ones = np.ones(size[0] if long else 0, rows.dtype)
    for k in range(long):
        np.matmul(ones[: size[k]], rows[at[k] : at[k] + size[k]], out=out[k])
    at, size, short = at[long:], size[long:], out[long:]
    for k in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        short[:n] += np.take(rows, at[:n] + k, axis=0)
    return found, out


class Gru:
    """Arrays of a step are (features, lanes), so that every pass over them runs along memory; what is sorted or gathered by token are rows."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat = shape, flat
        self.p = shape.views(flat)
        self.class_of = np.repeat(np.arange(shape.classes, dtype=np.int16), np.diff(shape.starts))

    def forward(self, before: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool):
        """States of a window as rows (tokens, width and a one), the last one (lanes, width), and what the backward sweep needs."""
        w = self.shape.width
        steps, n = before.shape
        state, inputs = np.ascontiguousarray(self.p["state"].T), self.p["inputs"]
        rows = np.empty((steps, n, w + 1), F32)
        rows[:, :, w] = 1
        kept = [np.empty((steps if keep else 1, size * w, n), F32) for size in (1, 3, 1)]
        h = np.ascontiguousarray(h.T, dtype=F32)
        starts = begin.any(axis=1)
        for t in range(steps):
            if starts[t]:
                h = np.where(begin[t], F32(0), h)
            last, gates, new = (x[t if keep else 0] for x in kept)
            if keep:
                last[:] = h
            x = np.take(inputs, before[t], axis=0).T
            np.matmul(state, h, out=gates)
            zr = gates[: 2 * w]
            zr += x[: 2 * w]
            _sigmoid(zr)
            np.multiply(zr[w:], gates[2 * w :], out=new)
            new += x[2 * w :]
            np.tanh(new, out=new)
            h = h - new
            h *= zr[:w]
            h += new
            rows[t, :, :w] = h.T
        return rows.reshape(steps * n, w + 1), h.T, kept

    def output(self, h: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None):
        """Natural log probability of each target, and with grad the derivative of the summed loss by h (weights' into grad)."""
        k = self.class_of[target]
        order = np.argsort(k, kind="stable")
        out = np.empty(len(target), np.result_type(h, F32))
        rows = np.concatenate([h[order], np.ones((len(h), 1), h.dtype)], axis=1)
        logs, dh = self._sorted(rows, k[order], target[order], grad)
        out[order] = logs
        if dh is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def _sorted(self, h: np.ndarray, k: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None):
        """output() of rows h, each with a one at its end for the biases, whose targets are sorted by their class k."""
        w, p, every = self.shape.width, self.p, np.arange(len(target))
        by_class = np.concatenate([p["to_class"].T, p["class_bias"][:, None]], axis=1)
        by_word = np.concatenate([p["to_word"], p["word_bias"][:, None]], axis=1)
        plain = max(_bound(by_class), _bound(by_word)) * max(h.max(initial=1), -h.min(initial=0)) <= PLAIN
        logits = by_class @ h.T
        if not plain:
            logits -= logits.max(axis=0)
        e = np.exp(logits)
        total = e.sum(axis=0)
        out = logits[k, every]
        dh = None
        if grad is not None:
            e /= total
            e[k, every] = np.exp(out) / total - 1
            d = e @ h
            grad["to_class"] += d[:, :w].T
            grad["class_bias"] += d[:, w]
            dh = e.T @ by_class[:, :w]
            d_word = np.zeros_like(by_word)
        inside, own = np.ones_like(total), np.zeros_like(total)
        cuts = np.searchsorted(k, np.arange(self.shape.classes + 1))
        # where each target stands in the matrix of its class, words by targets
        place = (target - self.shape.starts[k]) * np.diff(cuts)[k] + every - cuts[k]
        cuts, starts = cuts.tolist(), self.shape.starts.tolist()
        for c in range(self.shape.classes):
            i, j, a, b = cuts[c], cuts[c + 1], starts[c], starts[c + 1]
            if i == j or b - a == 1:
                continue
            x, of = h[i:j], by_word[a:b]
            logits = of @ x.T
            if not plain:
                logits -= logits.max(axis=0)
            e = np.exp(logits)
            np.add.reduce(e, axis=0, out=inside[i:j])
            mine = place[i:j]
            own[i:j] = logits.ravel()[mine]
            if grad is not None:
                e /= inside[i:j]
                e.ravel()[mine] -= 1
                np.matmul(e, x, out=d_word[a:b])
                dh[i:j] += e.T @ of[:, :w]
        if grad is not None:
            grad["to_word"] += d_word[:, :w]
            grad["word_bias"] += d_word[:, w]
        out += own
        total *= inside
        out -= np.log(total)
        return out, dh

    def backward(self, before, begin, kept, dstates, grad) -> None:
        """Backpropagation through one window (truncated at its first step); dstates are rows as forward's."""
        h, gates, new = kept
        steps, w, n = h.shape
        z, r, m = gates[:, :w], gates[:, w : 2 * w], gates[:, 2 * w :]
        # what does not hang on later steps, for all steps at once
        by_new = 1 - z
        by_z = h - new
        by_z *= z
        by_z *= by_new
        by_new *= 1 - new * new
        by_r = m * r
        by_r *= 1 - r
        # d are derivatives by: the new state's part from the state, the two gates, the new state's part from the input; rows have the last three
        rows, dh, d = np.empty((steps, n, 3 * w), F32), np.zeros((w, n), F32), np.empty((4 * w, n), F32)
        state, starts = np.roll(self.p["state"], w, axis=1), begin.any(axis=1)
        by_state = np.zeros_like(state)
        dstates = dstates.reshape(steps, n, w)
        for t in range(steps - 1, -1, -1):
            dh += dstates[t].T
            dn = d[3 * w :]
            np.multiply(dh, by_new[t], out=dn)
            np.multiply(dn, r[t], out=d[:w])
            np.multiply(dh, by_z[t], out=d[w : 2 * w])
            np.multiply(dn, by_r[t], out=d[2 * w : 3 * w])
            for k in range(0, 3 * w, w):
                rows[t, :, k : k + w] = d[k + w : k + 2 * w].T
            by_state += h[t] @ d[: 3 * w].T
            dh *= z[t]
            dh += state @ d[: 3 * w]
            if starts[t]:
                dh[:, begin[t]] = 0
        grad["state"] += np.roll(by_state, -w, axis=1)
        x, sums = row_sums(rows.reshape(steps * n, 3 * w), before.ravel().astype(np.int16 if self.shape.words < 1 << 15 else np.int32))
        grad["inputs"][x] += sums

    def _targets(self, now: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a window that hold a token, sorted by its class, with the class and the token."""
        real = np.flatnonzero(doc.ravel() >= 0)
        target = now.ravel()[real]
        k = self.class_of[target]
        order = np.argsort(k, kind="stable")
        return real[order], k[order], target[order]

    def scores(self, laid: Lanes, documents: int, steps: int = 8 * STEPS) -> np.ndarray:
        """Natural log-likelihood of every document of the lanes."""
        out = np.zeros(documents)
        h = np.zeros((len(laid.sizes), self.shape.width), F32)
        for before, now, begin, doc in laid.windows(steps):
            states, h, _ = self.forward(before, begin, h[: before.shape[1]], False)
            real, k, target = self._targets(now, doc)
            logs, _ = self._sorted(np.take(states, real, axis=0), k, target, None)
            out += np.bincount(doc.ravel()[real], logs, documents)
        return out

    def gradient(self, window: tuple[np.ndarray, ...], h: np.ndarray, flat_grad: np.ndarray) -> tuple[float, int, np.ndarray]:
        """Loss, tokens and last state of a window; flat_grad gets the derivative of the summed loss."""
        before, now, begin, doc = window
        grad = self.shape.views(flat_grad)
        states, h, kept = self.forward(before, begin, h[: before.shape[1]], True)
        real, k, target = self._targets(now, doc)
        logs, d = self._sorted(np.take(states, real, axis=0), k, target, grad)
        dstates = np.zeros((before.size, self.shape.width), F32)
        dstates[real] = d
        self.backward(before, begin, kept, dstates, grad)
        return -float(logs.sum()), len(real), h


class Trainer:
    """Adam over windows, from given parameters; one a task."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.model = Gru(shape, flat.astype(F32).copy())
        self.first, self.second, self.step = np.zeros(shape.size, F32), np.zeros(shape.size, F32), 0
        self.tokens, self.loss = 0, 0.0

    def train(self, laid: Lanes) -> None:
        h = np.zeros((len(laid.sizes), self.model.shape.width), F32)
        grad = np.empty(self.model.shape.size, F32)
        for window in laid.windows():
            grad[:] = 0
            loss, n, h = self.model.gradient(window, h, grad)
            self.tokens, self.loss, self.step = self.tokens + n, self.loss + loss, self.step + 1
            grad /= n
            norm = float(np.sqrt(grad @ grad))
            if norm > CLIP:
                grad *= CLIP / norm
            a, b = DECAY
            self.first *= F32(a)
            self.first += F32(1 - a) * grad
            grad *= grad
            grad *= F32(1 - b)
            self.second *= F32(b)
            self.second += grad
            rate = RATE * np.sqrt(1 - b**self.step) / (1 - a**self.step)
            np.sqrt(self.second, out=grad)
            grad += F32(1e-8)
            np.divide(self.first, grad, out=grad)
            grad *= F32(rate)
            self.model.flat -= grad
