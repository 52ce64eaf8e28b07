"""Walks, corridors and circuits under kernels that change from step to step, directed circuits, and bridge samples.

A kernel table has a column `step` from 1; a walk's step t uses the table of
step t, and the last one beyond. As in `markov`, events are reduced to distinct
(release, recapture, k) and dealt by one end, so that one sweep in numpy over
the broadcast tables (their size is checked) serves all events of that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs as G

#: Smallest probability that a step of a walk may have (fixed value).
LEAST_P = 1e-15


def dealt(events: DataFrame, by: str, then: str) -> DataFrame:
    """Distinct (release, recapture, k), dealt by one column and sorted, so that batches hold whole runs of it."""
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.select("release", "recapture", "k").distinct().repartition(tasks, by).sortWithinPartitions(by, then, "k")


def dynamic_walks(events: DataFrame, kernels: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, k, logp and nodes of the most probable walk of exactly k steps under kernels (step, src, dst, p).

    Equal ends stay where they are, as the definition has it; nodes are empty
    and logp is null if there is no such walk; ties go to the smaller unit.
    """
    steps = events.sparkSession.sparkContext.broadcast([G.logged(g, LEAST_P) for g in G.collect_steps(kernels, n_units)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_home = [dict(zip(g.src[g.src == g.dst].tolist(), g.score[g.src == g.dst].tolist(), strict=True)) for g in steps.value]
        for pdf in batches:
            for u, part in pdf.groupby("release"):
                ends = list(zip((part["recapture"] - 1).tolist(), part["k"].tolist(), strict=True))
                found = G.best_walks(steps.value, n_units, int(u) - 1, ends)
                for i, (v, k) in enumerate(ends):
                    if v == u - 1:
                        found[i] = [v] * (k + 1), sum(at_home[min(t, len(at_home) - 1)].get(v, -np.inf) for t in range(k))
                yield part.assign(logp=[s if w and np.isfinite(s) else None for w, s in found], nodes=[[i + 1 for i in w] for w, _ in found])

    return dealt(events, "release", "recapture").mapInPandas(run, "release int, recapture int, k int, logp double, nodes array<int>")


def step_costs(units: DataFrame, edges: DataFrame) -> DataFrame:
    """step, src, dst, cost of a habitat that changes with `step`, without land.

    A move costs kilometres times the mean friction 1 + 3 (1 - habitat)^2 of
    both ends at its step; a stay costs half the way to the nearest neighbour (1 km if
    there is none) times the unit's own friction.
    """
    f = 1 + 3 * F.pow(1 - F.col("hsi"), 2)
    u = units.where("NOT is_land").select("step", "s_idx", "x", "y", f.alias("f"))
    at = lambda n: u.select("step", F.col("s_idx").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"), F.col("f").alias(f"f_{n}"))
    d = F.hypot(F.col("x_src") - F.col("x_dst"), F.col("y_src") - F.col("y_dst"))
    move = edges.where("src <> dst").join(at("src"), "src").join(at("dst"), ["step", "dst"]).withColumn("d", d)
    near = move.groupBy("step", F.col("src").alias("s_idx")).agg(F.min("d").alias("d"))
    stay = u.join(near, ["step", "s_idx"], "left").select("step", F.col("s_idx").alias("src"), F.col("s_idx").alias("dst"), (0.5 * F.coalesce("d", F.lit(1.0)) * F.col("f")).alias("cost"))
    return move.select("step", "src", "dst", (F.col("d") * (F.col("f_src") + F.col("f_dst")) / 2).alias("cost")).unionByName(stay)


def dynamic_paths(events: DataFrame, costs: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, k, cost and nodes of the cheapest way of exactly k steps under costs (step, src, dst, cost); cost null and nodes empty if there is none."""
    steps = events.sparkSession.sparkContext.broadcast([G.inward(g, -g.w) for g in G.collect_steps(costs, n_units, "cost")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u, part in pdf.groupby("release"):
                found = G.best_walks(steps.value, n_units, int(u) - 1, list(zip((part["recapture"] - 1).tolist(), part["k"].tolist(), strict=True)))
                yield part.assign(cost=[-s if w else None for w, s in found], nodes=[[i + 1 for i in w] for w, _ in found])

    return dealt(events, "release", "recapture").mapInPandas(run, "release int, recapture int, k int, cost double, nodes array<int>")


def dynamic_corridors(events: DataFrame, kernels: DataFrame, n_units: int, land: DataFrame | None = None) -> DataFrame:
    """release, recapture, k, s_idx, intensity of the bridge under kernels (step, src, dst, p); land (s_idx) has none.

    The intensity of a unit is the mean over the k + 1 times of its chance to
    be visited, given both ends; where the ends do not meet in k steps it is
    the mean of the forward and the backward distribution. Units without
    intensity have no row. The corridor between two units is the product of
    their intensities over the square of the largest.
    """
    steps = events.sparkSession.sparkContext.broadcast(G.collect_steps(kernels, n_units))
    closed = [] if land is None else [r["s_idx"] - 1 for r in land.select("s_idx").distinct().limit(n_units).collect()]  # at most the mesh

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ps = steps.value
        p_of = lambda t: ps[min(t, len(ps)) - 1]
        src = [np.repeat(np.arange(n_units), np.diff(p.start)) for p in ps]
        for pdf in batches:
            for u, part in pdf.groupby("release"):
                f = np.zeros((int(part["k"].max()) + 1, n_units))
                f[0, int(u) - 1] = 1
                for t in range(1, len(f)):
                    f[t] = p_of(t).push(f[t - 1])
                out = []
                for v, k in zip(part["recapture"].tolist(), part["k"].tolist(), strict=True):
                    b = np.zeros((k + 1, n_units))
                    b[k, v - 1] = 1
                    for t in range(k, 0, -1):
                        p = p_of(t)
                        b[t - 1] = np.bincount(src[min(t, len(ps)) - 1], p.w * b[t][p.dst], n_units)
                    both = f[: k + 1] * b
                    total = both.sum(1, keepdims=True)
                    c = np.where(total > LEAST_P, both / np.maximum(total, 1e-300), (f[: k + 1] + b) / 2).mean(0)
                    c[closed] = 0
                    s = np.flatnonzero(c)
                    out.append(pd.DataFrame({"release": np.int32(u), "recapture": np.int32(v), "k": np.int32(k), "s_idx": (s + 1).astype("int32"), "intensity": c[s]}))
                    if len(out) == 200:
                        yield pd.concat(out)
                        out = []
                if out:
                    yield pd.concat(out)

    return dealt(events, "release", "recapture").mapInPandas(run, "release int, recapture int, k int, s_idx int, intensity double")


def directed_circuits(events: DataFrame, kernel: DataFrame, n_units: int, alpha: float = 0.99) -> DataFrame:
    """release, recapture, resistance, voltages (per unit) of the directed circuit over a kernel, dealt by its sink.

    A unit's voltage is -ln of its discounted expected visits to the sink (not
    under 1e-15), less the least one; the resistance is the drop from release
    to recapture: 0 for equal ends, infinite where the sink cannot be reached.
    The visits are summed over steps on the sparse rows until what is left
    is below 1e-26, so no dense matrix is made.
    """
    g = events.sparkSession.sparkContext.broadcast(G.collect_csr(kernel, n_units))
    rounds = int(np.ceil(np.log(1e-26 * (1 - alpha)) / np.log(alpha)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = g.value
        src = np.repeat(np.arange(n_units), np.diff(p.start))
        back = G.make_csr(p.dst, src, p.w, n_units)
        for pdf in batches:
            for v, part in pdf.groupby("recapture"):
                term = np.zeros(n_units)
                term[int(v) - 1] = 1
                visits = term.copy()
                for _ in range(rounds):
                    term = alpha * np.bincount(src, p.w * term[p.dst], n_units)
                    visits += term
                volt = -np.log(np.maximum(visits, 1e-15))
                volt -= volt.min()
                reach = np.zeros(n_units, bool)
                reach[G.component_of(back, int(v) - 1)] = True
                for u in part["release"].unique().tolist():
                    ohm = 0.0 if u == v else float(volt[u - 1] - volt[int(v) - 1]) if reach[u - 1] else np.inf
                    yield pd.DataFrame({"release": [np.int32(u)], "recapture": [np.int32(v)], "resistance": [ohm], "voltages": [volt if u != v and reach[u - 1] else np.zeros(n_units)]})

    return dealt(events, "recapture", "release").mapInPandas(run, "release int, recapture int, resistance double, voltages array<double>").dropDuplicates(["release", "recapture"])


def directed_currents(circuits: DataFrame, kernel: DataFrame) -> DataFrame:
    """src, dst, current summed over circuits: p times the voltage drop along every edge where it is positive; equal or unreachable ends have none."""
    v = circuits.select("release", "recapture", F.posexplode("voltages").alias("i", "v")).select("release", "recapture", (F.col("i") + 1).alias("u"), "v")
    k = kernel.where("src <> dst")
    d = v.select("release", "recapture", F.col("u").alias("src"), F.col("v").alias("v1")).join(F.broadcast(k) if k.count() <= 100_000 else k, "src")
    d = d.join(v.select("release", "recapture", F.col("u").alias("dst"), F.col("v").alias("v2")), ["release", "recapture", "dst"]).where("v1 > v2")
    return d.groupBy("src", "dst").agg(F.sum(F.col("p") * (F.col("v1") - F.col("v2"))).alias("current"))


def bridge_samples(events: DataFrame, kernel: DataFrame, n_units: int, draws: int = 1, seed: int = 1) -> DataFrame:
    """release, recapture, k, draw and nodes of walks drawn from the bridge of every event; dealt by recapture, one backward sweep each.

    Equal ends stay; nodes are empty if the ends do not meet in k steps. Every
    (event, draw) has its own random stream, so the number of tasks does not matter.
    """
    g = events.sparkSession.sparkContext.broadcast(G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = g.value
        src = np.repeat(np.arange(n_units), np.diff(p.start))
        for pdf in batches:
            for v, part in pdf.groupby("recapture"):
                b = np.zeros((int(part["k"].max()) + 1, n_units))
                b[0, int(v) - 1] = 1
                for t in range(1, len(b)):
                    b[t] = np.bincount(src, p.w * b[t - 1][p.dst], n_units)
                out = []
                for u, k in zip(part["release"].tolist(), part["k"].tolist(), strict=True):
                    for draw in range(draws):
                        rng = np.random.Generator(np.random.Philox(key=[seed, ((u * n_units + int(v)) * 100_003 + k) * draws + draw]))
                        out.append((u, v, k, draw, [u] * (k + 1) if u == v else walk(p, b, u - 1, k, rng)))
                yield pd.DataFrame(out, columns=["release", "recapture", "k", "draw", "nodes"])

    def walk(p: G.Csr, b: np.ndarray, u: int, k: int, rng) -> list[int]:
        if b[k, u] <= 0:
            return []
        nodes = [u]
        for left in range(k - 1, -1, -1):
            dst, w = p.row(nodes[-1])
            acc = np.cumsum(w * b[left][dst])
            nodes.append(int(dst[min(len(dst) - 1, np.searchsorted(acc, rng.random() * acc[-1], side="right"))]))
        return [i + 1 for i in nodes]

    return dealt(events, "recapture", "release").mapInPandas(run, "release int, recapture int, k int, draw int, nodes array<int>")


def reconstructed_tracks(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """tagid, tag, step, s_idx: the sampled walk of every pair (tagid, tag, release, recapture, k) as a track; the recapture ends a pair's part and begins the next.

    The walk of draw 0 is taken; pairs whose ends do not meet keep their two ends.
    """
    s = samples.where("draw = 0").select("release", "recapture", "k", "nodes")
    ends = F.array("release", "recapture")
    d = pairs.join(s, ["release", "recapture", "k"], "left").withColumn("nodes", F.when(F.size("nodes") > 1, F.col("nodes")).otherwise(ends))
    d = d.select("tagid", "tag", F.posexplode("nodes").alias("i", "s_idx"))
    # the first node of a later pair is the last one of the pair before
    d = d.withColumn("_first", F.min("tag").over(Window.partitionBy("tagid"))).where((F.col("i") > 0) | (F.col("tag") == F.col("_first")))
    return d.select("tagid", "tag", (F.row_number().over(Window.partitionBy("tagid").orderBy("tag", "i")) - 1).alias("step"), "s_idx")
