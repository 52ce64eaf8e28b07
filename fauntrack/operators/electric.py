"""Circuits on sparse meshes: conjugate gradients over neighbour lists, one solve an endpoint, currents added up inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs as G

#: Pairs that are worked on at a time, and where the iteration ends (residual by right-hand side; rounds by units).
BLOCK, CLOSE, ROUNDS = 128, 1e-13, 20


class Network:
    """Conductances as padded neighbour lists, and the component of every unit; memory is linear in edges."""

    def __init__(self, g: G.Csr) -> None:
        size = np.diff(g.start)
        src, at = np.repeat(np.arange(g.n), size), np.arange(len(g.dst)) - np.repeat(g.start[:-1], size)
        width = int(size.max()) if len(g.dst) else 0
        self.n = g.n
        self.to, self.c = np.tile(np.arange(g.n)[:, None], (1, width)), np.zeros((g.n, width))
        self.to[src, at], self.c[src, at] = g.dst, g.w
        self.degree = self.c.sum(1)
        self.component = np.arange(g.n)
        while True:  # least label of the neighbourhood, with a jump a round
            low = np.minimum(self.component, np.where(self.c > 0, self.component[self.to], g.n).min(1, initial=g.n)) if width else self.component
            low = low[low]
            if (low == self.component).all():
                break
            self.component = low
        self.size = np.bincount(self.component, minlength=g.n)

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        out = self.degree[:, None] * x
        for k in range(self.c.shape[1]):
            out -= self.c[:, k, None] * x[self.to[:, k]]
        return out

    def potentials(self, units: np.ndarray) -> np.ndarray:
        """Columns of potentials for a current that enters at each of the units and leaves evenly over its component."""
        own = self.component[:, None] == self.component[units][None]
        b = np.where(own, -1.0 / self.size[self.component[units]][None], 0.0)
        b[units, np.arange(len(units))] += 1
        scale = 1 / np.where(self.degree > 0, self.degree, 1.0)[:, None]
        x, r = np.zeros_like(b), b.copy()
        z = scale * r
        p, rz = z.copy(), (r * z).sum(0)
        goal = CLOSE * np.sqrt((b * b).sum(0))
        for _ in range(ROUNDS * self.n):
            if (np.sqrt((r * r).sum(0)) <= goal).all():
                break
            q = self.laplacian(p)
            step = rz / np.maximum((p * q).sum(0), 1e-300)
            x += step * p
            r -= step * q
            z = scale * r
            new = (r * z).sum(0)
            p = z + (new / np.maximum(rz, 1e-300)) * p
            rz = new
        return x

    def voltages(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Voltages (units x pairs) of a unit current from u to v, and the effective resistances: 0 for u = v, infinite across components."""
        ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x = self.potentials(ends)
        volt = x[:, at[: len(u)]] - x[:, at[len(u) :]]
        ohm = volt[u, np.arange(len(u))] - volt[v, np.arange(len(u))]
        apart = self.component[u] != self.component[v]
        volt[:, apart] = 0
        return volt, np.where(apart, np.inf, np.where(u == v, 0.0, ohm))

    def currents(self, volt: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Current through every unit (units x pairs): half the sum over its edges, 1 at both ends."""
        out = np.zeros_like(volt)
        for k in range(self.c.shape[1]):
            out += self.c[:, k, None] * np.abs(volt - volt[self.to[:, k]])
        out /= 2
        out[u, np.arange(len(u))] = out[v, np.arange(len(u))] = 1.0
        return out


def _dealt(sources: DataFrame) -> DataFrame:
    """Distinct pairs with the number of their events, dealt by release so that a task meets few distinct endpoints at a time."""
    n = F.sum("n") if "n" in sources.columns else F.count("*")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.groupBy("release", "recapture").agg(n.cast("double").alias("n")).repartition(tasks, "release").sortWithinPartitions("release", "recapture")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), BLOCK):
            yield pdf.iloc[k : k + BLOCK]


def resistances(sources: DataFrame, conductance: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, resistance of every distinct pair: 0 for a unit and itself, infinite where no way leads."""
    shared = conductance.sparkSession.sparkContext.broadcast(G.collect_csr(conductance, n_units, "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(shared.value)
        for part in _blocks(batches):
            _, ohm = net.voltages(part["release"].to_numpy() - 1, part["recapture"].to_numpy() - 1)
            yield part[["release", "recapture"]].assign(resistance=ohm)

    return _dealt(sources).mapInPandas(run, "release int, recapture int, resistance double")


def current_use(sources: DataFrame, conductance: DataFrame, n_units: int) -> DataFrame:
    """s_idx, current, density: currents through every unit, added over distinct pairs, and their mean over events.

    sources: release, recapture, and n where rows stand for several events. Pairs
    of a unit with itself and across components carry no current, but count as
    events. A task adds up its pairs, so a row a unit and task leaves it.
    """
    shared = conductance.sparkSession.sparkContext.broadcast(G.collect_csr(conductance, n_units, "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, total, weighed, events = Network(shared.value), np.zeros(n_units), np.zeros(n_units), 0.0
        for part in _blocks(batches):
            u, v, n = part["release"].to_numpy() - 1, part["recapture"].to_numpy() - 1, part["n"].to_numpy()
            events += n.sum()
            ok = (net.component[u] == net.component[v]) & (u != v)
            if ok.any():
                volt, _ = net.voltages(u[ok], v[ok])
                j = net.currents(volt, u[ok], v[ok])
                total += j.sum(1)
                weighed += j @ n[ok]
        yield pd.DataFrame({"s_idx": np.arange(1, n_units + 1, dtype="int32"), "current": total, "weighed": weighed, "events": events})

    sums = _dealt(sources).mapInPandas(run, "s_idx int, current double, weighed double, events double").groupBy("s_idx").agg(*[F.sum(c).alias(c) for c in ("current", "weighed", "events")])
    return sums.select("s_idx", "current", F.coalesce(F.try_divide("weighed", "events"), F.lit(0.0)).alias("density"))
