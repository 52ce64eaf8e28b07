"""Graph and linear-algebra kernels in numpy over one mesh; they run inside grouped maps.

A mesh has at most some ten thousand units, so its CSR arrays travel as one
broadcast value whose size is checked; the distributed dimension is events,
tags, draws or agents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Most kernel or edge rows that are collected into CSR arrays.
MOST_EDGES = 2_000_000


@dataclass
class Csr:
    """Rows of a sparse matrix over units 1..n (index 0 is unit 1)."""

    start: np.ndarray
    dst: np.ndarray
    w: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[i], self.start[i + 1])
        return self.dst[s], self.w[s]

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (np.repeat(np.arange(self.n), np.diff(self.start)), self.dst), self.w)
        return out

    def push(self, x: np.ndarray) -> np.ndarray:
        """x P for row vectors x (any leading shape)."""
        src = np.repeat(np.arange(self.n), np.diff(self.start))
        flat = np.reshape(x, (-1, self.n))
        return np.array([np.bincount(self.dst, row[src] * self.w, self.n) for row in flat]).reshape(np.shape(x))


def collect_csr(rows: DataFrame, n: int, weight: str = "p") -> Csr:
    """CSR arrays of a mesh-sized table (src, dst, weight), checked before it is collected."""
    count = rows.count()
    if count > MOST_EDGES:
        raise ValueError(f"{count} rows are no mesh-sized table")
    pdf = rows.select("src", "dst", weight).toPandas().sort_values(["src", "dst"])
    return make_csr(pdf["src"].to_numpy() - 1, pdf["dst"].to_numpy() - 1, pdf[weight].to_numpy(float), n)


def make_csr(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> Csr:
    order = np.lexsort((dst, src))
    return Csr(np.r_[0, np.cumsum(np.bincount(src, minlength=n))].astype(np.int64), dst[order].astype(np.int64), w[order])


def dijkstra(g: Csr, u: int, v: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from u, and predecessors (-1: none); ties to the smaller predecessor."""
    cost, before = np.full(g.n, np.inf), np.full(g.n, -1)
    cost[u] = 0.0
    heap = [(0.0, u)]
    while heap:
        c, i = heapq.heappop(heap)
        if c > cost[i]:
            continue
        if i == v:
            break
        dst, w = g.row(i)
        for j, x in zip(dst.tolist(), w.tolist(), strict=True):
            t = c + x
            if t < cost[j] or (t == cost[j] and before[j] > i):
                if t < cost[j]:
                    heapq.heappush(heap, (t, j))
                cost[j], before[j] = t, i
    return cost, before


def trace(before: np.ndarray, u: int, v: int) -> list[int]:
    path = [v]
    while path[-1] != u:
        if before[path[-1]] < 0:
            return []
        path.append(int(before[path[-1]]))
    return path[::-1]


@dataclass
class Inward:
    """Edges with additive scores, sorted by target, then source; runs of a target begin at `first` and end in `into`."""

    src: np.ndarray
    dst: np.ndarray
    score: np.ndarray
    first: np.ndarray
    into: np.ndarray


def inward(g: Csr, score: np.ndarray, ok: np.ndarray | None = None) -> Inward:
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    keep = np.ones(len(src), bool) if ok is None else ok
    src, dst, score = src[keep], g.dst[keep], score[keep]
    order = np.lexsort((src, dst))
    src, dst, score = src[order], dst[order], score[order]
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]][: len(dst)])
    return Inward(src, dst, score, first, dst[first])


def logged(g: Csr, p_min: float = 1e-12) -> Inward:
    """Log probabilities of the steps above p_min."""
    ok = g.w > p_min
    return inward(g, np.log(np.where(ok, g.w, 1.0)), ok)


def advance(e: Inward, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score over the edges into each of e.into, and the smallest source that has it."""
    value = score[e.src] + e.score
    top = np.maximum.reduceat(value, e.first)
    best = value == np.repeat(top, np.diff(np.r_[e.first, len(value)]))
    return top, e.src[np.minimum.reduceat(np.where(best, np.arange(len(value)), len(value)), e.first)]


def best_walks(steps: list[Inward], n: int, u: int, events: list[tuple[int, int]]) -> list[tuple[list[int], float]]:
    """Walk of exactly k steps from u to v with the largest sum of scores, and the sum, for every (v, k); step t uses steps[t - 1], the last one beyond.

    One forward sweep serves all events; without a walk it is ([], -inf); ties go to the smaller unit.
    """
    most = max((k for _, k in events), default=0)
    score, back = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -1)
    score[0, u] = 0.0
    for t in range(1, most + 1):
        e = steps[min(t, len(steps)) - 1]
        if not len(e.src):
            break
        score[t, e.into], back[t, e.into] = advance(e, score[t - 1])
    out = []
    for v, k in events:
        if score[k, v] == -np.inf:
            out.append(([], -np.inf))
            continue
        path = [v]
        for t in range(k, 0, -1):
            path.append(int(back[t, path[-1]]))
        out.append((path[::-1], float(score[k, v])))
    return out


def exact_k(g: Csr, u: int, v: int, k: int, p_min: float = 1e-12) -> list[int]:
    """Most probable walk of exactly k steps; empty if there is none; ties to the smaller unit."""
    return best_walks([logged(g, p_min)], g.n, u, [(v, k)])[0][0]


def collect_steps(rows: DataFrame, n: int, weight: str = "p") -> list[Csr]:
    """CSR arrays of every step of a mesh-sized table (step from 1, src, dst, weight), checked before it is collected."""
    count = rows.count()
    if count > MOST_EDGES:
        raise ValueError(f"{count} rows are no mesh-sized table")
    pdf = rows.select("step", "src", "dst", weight).toPandas()
    return [make_csr(part["src"].to_numpy() - 1, part["dst"].to_numpy() - 1, part[weight].to_numpy(float), n) for _, part in sorted(pdf.groupby("step"))]


def sweep(g: Csr, u: int, wanted: set[int]) -> dict[int, np.ndarray]:
    """Distributions after the wanted numbers of steps from u: one forward sweep serves them all."""
    x = np.zeros(g.n)
    x[u] = 1.0
    out = {0: x.copy()} if 0 in wanted else {}
    for k in range(1, max(wanted, default=0) + 1):
        x = g.push(x)
        if k in wanted:
            out[k] = x.copy()
    return out


def floored(p: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """A distribution without zeros: uniform if it has no mass, small entries raised to floor * max, renormalised."""
    top = p.max()
    if not np.isfinite(top) or top <= 0:
        return np.full(len(p), 1 / len(p))
    p = np.maximum(np.where(np.isfinite(p), p, 0), floor * top)
    return p / p.sum()


def bridge(g: Csr, u: int, v: int, k: int, land: np.ndarray | None = None) -> np.ndarray:
    """(k + 1) x units: where a walk from u is, given that it ends in v after k steps."""
    if k <= 0:
        out = np.zeros((1, g.n))
        out[0, u] = 1
        return out
    f, b = np.zeros((k + 1, g.n)), np.zeros((k + 1, g.n))
    f[0, u] = b[0, v] = 1
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    for t in range(1, k + 1):
        f[t] = g.push(f[t - 1])
        b[t] = np.bincount(src, g.w * b[t - 1][g.dst], g.n)
    total = f[k, v]
    if total <= 1e-15:
        free = np.ones(g.n) if land is None else (~land).astype(float)
        c = np.tile(free / free.sum(), (k + 1, 1))
        c[0], c[k] = 0, 0
        c[0, u] = c[k, v] = 1
    else:
        c = f * b[::-1] / total
    if land is not None:
        c[:, land] = 0
    return c / np.maximum(c.sum(1, keepdims=True), 1e-300)


def bridges(g: Csr, u: int, events: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """bridge() of every (v, k) from one unit: one forward sweep serves them all, and one backward sweep each run of a v."""
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    most = max((k for _, k in events), default=0)
    f = np.zeros((most + 1, g.n))
    f[0, u] = 1
    for t in range(1, most + 1):
        f[t] = np.bincount(g.dst, f[t - 1][src] * g.w, g.n)
    at, b = None, np.zeros((0, 0))
    for v, k in events:
        if k <= 0 or f[k, v] <= 1e-15:
            yield bridge(g, u, v, k)
            continue
        if v != at:  # events of one v stand together, so that one backward sweep is held at a time
            at, b = v, np.zeros((most + 1, g.n))
            b[0, v] = 1
            for t in range(1, most + 1):
                b[t] = np.bincount(src, g.w * b[t - 1][g.dst], g.n)
        c = f[: k + 1] * b[k::-1] / f[k, v]
        yield c / np.maximum(c.sum(1, keepdims=True), 1e-300)


def viterbi_hmm(kernels: list[Csr], emission: np.ndarray) -> np.ndarray:
    """Most likely states of log emissions (time x units); ties to the smaller unit.

    Step t uses kernels[t - 1], the last one beyond; a move that a kernel lacks
    costs 1e9, so that there always is a path. Work is on the edges only.
    """
    t, n = emission.shape
    steps = [logged(g, 1e-15) for g in kernels]
    score = emission[0] - np.log(n)
    back = np.zeros((t, n), int)
    for k in range(1, t):
        e, far = steps[min(k, len(steps)) - 1], int(score.argmax())
        top, frm = np.full(n, score[far] - 1e9), np.full(n, far)
        if len(e.src):
            best, at = advance(e, score)
            better = best >= top[e.into]
            top[e.into[better]], frm[e.into[better]] = best[better], at[better]
        score, back[k] = top + emission[k], frm
    path = [int(score.argmax())]
    for k in range(t - 1, 0, -1):
        path.append(int(back[k][path[-1]]))
    return np.array(path[::-1])


def forward_backward(kernels: list[Csr], likelihood: np.ndarray) -> np.ndarray:
    """State probabilities (time x units) by scaled recursions under the kernels of viterbi_hmm; a time without likelihood is uniform."""
    t, n = likelihood.shape
    src = [np.repeat(np.arange(n), np.diff(g.start)) for g in kernels]
    f, b = np.zeros((t, n)), np.ones((t, n))
    f[0] = likelihood[0] / n
    f[0] = f[0] / f[0].sum() if f[0].sum() > 0 else 1 / n
    for k in range(1, t):
        f[k] = kernels[min(k, len(kernels)) - 1].push(f[k - 1]) * likelihood[k]
        f[k] = f[k] / f[k].sum() if f[k].sum() > 0 else 1 / n
    for k in range(t - 2, -1, -1):
        g, s = kernels[min(k + 1, len(kernels)) - 1], src[min(k + 1, len(kernels)) - 1]
        b[k] = np.bincount(s, g.w * (likelihood[k + 1] * b[k + 1])[g.dst], n)
        b[k] = b[k] / b[k].sum() if b[k].sum() > 0 else 1 / n
    g = f * b
    return g / np.maximum(g.sum(1, keepdims=True), 1e-300)


def component_of(g: Csr, u: int) -> np.ndarray:
    """Units reachable from u, in rising order."""
    seen = np.zeros(g.n, bool)
    seen[u] = True
    front = [u]
    while front:
        nxt = []
        for i in front:
            for j in g.row(i)[0].tolist():
                if not seen[j]:
                    seen[j] = True
                    nxt.append(j)
        front = nxt
    return np.flatnonzero(seen)


def circuit(g: Csr, u: int, v: int, current: float = 1.0) -> tuple[float, np.ndarray]:
    """Effective resistance and voltages when a current enters at u and leaves at v; infinite across components."""
    volt = np.zeros(g.n)
    if u == v:
        return 0.0, volt
    own = component_of(g, u)
    if v not in own:
        return np.inf, volt
    at = {x: k for k, x in enumerate(own.tolist())}
    c = g.dense()[np.ix_(own, own)]
    c = (c + c.T) / 2
    lap = np.diag(c.sum(1)) - c
    free = [k for k in range(len(own)) if k != at[v]]
    rhs = np.zeros(len(own))
    rhs[at[u]] = current
    volt[own[free]] = np.linalg.solve(lap[np.ix_(free, free)], rhs[free])
    return float(volt[u] / current), volt


def potentials(g: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Component of each unit, and the inverse Laplacian of each component: one inversion serves every circuit()."""
    label, out = np.full(g.n, -1), np.zeros((g.n, g.n))
    dense = g.dense()
    for u in range(g.n):
        if label[u] < 0:
            own = component_of(g, u)
            label[own] = u
            c = dense[np.ix_(own, own)]
            c = (c + c.T) / 2
            out[np.ix_(own, own)] = np.linalg.inv(np.diag(c.sum(1)) - c + np.ones((len(own), len(own))) / len(own))
    return label, out


def solved_circuit(solved: tuple[np.ndarray, np.ndarray], u: int, v: int) -> tuple[float, np.ndarray]:
    """circuit() for one unit of current, from potentials()."""
    label, inverse = solved
    volt = np.zeros(len(label))
    if u == v:
        return 0.0, volt
    if label[u] != label[v]:
        return np.inf, volt
    own = label == label[u]
    volt[own] = inverse[own, u] - inverse[own, v]
    volt[own] -= volt[v]
    return float(volt[u]), volt


def node_current(g: Csr, volt: np.ndarray, u: int, v: int) -> np.ndarray:
    """Current through each unit: half the sum over its edges, 1 at both ends."""
    src = np.repeat(np.arange(g.n), np.diff(g.start))
    out = np.bincount(src, np.abs(g.w * (volt[src] - volt[g.dst])), g.n) / 2
    out[u] = out[v] = 1.0
    return out


def resistance_matrix(g: Csr, disconnected: float = 1e6) -> np.ndarray:
    """Effective resistances of all pairs, per component; `disconnected` across components."""
    out = np.full((g.n, g.n), disconnected)
    left = set(range(g.n))
    while left:
        own = component_of(g, min(left))
        left -= set(own.tolist())
        c = g.dense()[np.ix_(own, own)]
        c = (c + c.T) / 2
        m = len(own)
        inv = np.linalg.inv(np.diag(c.sum(1)) - c + np.ones((m, m)) / m)
        d = np.diag(inv)
        out[np.ix_(own, own)] = d[:, None] + d[None] - 2 * inv
    np.fill_diagonal(out, 0)
    return out
