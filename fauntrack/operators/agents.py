"""Agents with a heading: the exact chain over (unit, last move), and walkers drawn from it, under one kernel or a cycle of kernels.

An agent that has moved keeps the bearing of its last move as its heading. A step
weighs each entry of its unit's kernel row by exp(kappa cos(turn)); a stay counts
as no turn, and before the first move there is no heading and no weighing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo

from . import graphs as G
from .mesh import _cut

#: Most distinct horizons of a pool that are sent to the tasks.
MOST_HORIZONS = 1_000_000


def _bearings(kernel: DataFrame, units: DataFrame) -> DataFrame:
    """src, dst, b: bearing of every entry of a kernel, null for a stay."""
    at = lambda n: units.select(F.col("s_idx").alias(n), F.col("lon").alias(f"lon_{n}"), F.col("lat").alias(f"lat_{n}"))
    return kernel.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", geo.bearing_deg("lon_src", "lat_src", "lon_dst", "lat_dst").alias("b"))


def heading_chain(kernel: DataFrame, units: DataFrame, kappa: float = 1.0, others: DataFrame | None = None) -> DataFrame:
    """src, via, dst, dst_via, p: the chain over a unit and the unit it was entered from (via 0: not moved yet), rows normalised.

    The via of a state gives its heading, since a mesh has one bearing an edge;
    the number of states is that of directed edges and units together. others
    are entries (src, dst) of further kernels by which a unit may be entered.
    """
    bearing = _bearings(kernel, units)
    ways = bearing if others is None else _bearings(kernel.select("src", "dst").union(others.select("src", "dst")), units)
    entered = ways.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("via"), F.col("b").alias("heading")).unionByName(kernel.select("src").distinct().withColumns({"via": F.lit(0), "heading": F.lit(None).cast("double")}))
    stay = F.col("src") == F.col("dst")
    turn = F.when(F.col("heading").isNull(), 0.0).when(stay | F.col("b").isNull(), kappa).otherwise(kappa * F.cos(F.radians(F.col("b") - F.col("heading"))))
    d = kernel.select("src", "dst", "p").join(bearing, ["src", "dst"]).join(entered, "src").withColumn("v", F.col("p") * F.exp(turn)).withColumn("dst_via", F.when(stay, F.col("via")).otherwise(F.col("src")))
    total = F.sum("v").over(Window.partitionBy("src", "via"))
    return d.select("src", "via", "dst", "dst_via", (F.col("v") / total).alias("p"))


def _cycle(kernels: DataFrame) -> list[DataFrame]:
    """The kernels of a table in the order of their step; one row a kernel reaches the driver."""
    if "step" not in kernels.columns:
        return [kernels]
    return [kernels.where(F.col("step") == r["step"]) for r in kernels.select("step").distinct().orderBy("step").collect()]


def heading_distribution(starts: DataFrame, kernels: DataFrame, units: DataFrame, steps: int, kappa: float = 1.0) -> DataFrame:
    """step, s_idx, p: where agents are after each of so many steps, from starts (s_idx, n: how many start there).

    kernels has src, dst, p, and a step from 1 on if there are several, which are
    then taken in turn. Each step is one join of states with the chain, summed
    by state and checkpointed; states are mesh-sized whatever the number of
    agents.
    """
    every = kernels.select("src", "dst")
    chains = [_cut(heading_chain(k, units, kappa, every)) for k in _cycle(kernels)]
    total = starts.agg(F.sum("n").alias("n")).scalar()
    state = _cut(starts.groupBy("s_idx").agg((F.sum("n") / total).alias("q")).select(F.col("s_idx").alias("src"), F.lit(0).alias("via"), "q"))
    out = [state]
    for k in range(steps):
        state = _cut(state.join(chains[k % len(chains)], ["src", "via"]).groupBy(F.col("dst").alias("src"), F.col("dst_via").alias("via")).agg(F.sum(F.col("q") * F.col("p")).alias("q")))
        out.append(state)
    each = [x.groupBy(F.lit(k).alias("step"), F.col("src").alias("s_idx")).agg(F.sum("q").alias("p")) for k, x in enumerate(out)]
    return reduce(DataFrame.unionByName, each)


class _Walker:
    """Padded rows of a cycle of kernels: neighbours, their probabilities and bearings, for many agents at once."""

    def __init__(self, kernels: list[G.Csr], lon: np.ndarray, lat: np.ndarray, kappa: float) -> None:
        self.kappa, self.rows = kappa, []
        for g in kernels:
            size = np.diff(g.start)
            src, at = np.repeat(np.arange(g.n), size), np.arange(len(g.dst)) - np.repeat(g.start[:-1], size)
            to, p, b = np.zeros((g.n, max(1, size.max())), np.int64), np.zeros((g.n, max(1, size.max()))), np.full((g.n, max(1, size.max())), np.nan)
            to[src, at], p[src, at] = g.dst, g.w
            east, north = (lon[g.dst] - lon[src]) * np.cos(np.radians(lat[src])), lat[g.dst] - lat[src]
            b[src, at] = np.where(src == g.dst, np.nan, np.arctan2(east, north))
            self.rows.append((to, p, b))

    def walk(self, start: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Units of agents (rows) after every step (columns), from uniform numbers; an agent whose row has no mass stays."""
        out = np.empty((len(start), draws.shape[1] + 1), np.int64)
        out[:, 0] = start
        pos, heading = start.copy(), np.full(len(start), np.nan)
        who = np.arange(len(start))
        for k in range(draws.shape[1]):
            to, p, b = self.rows[k % len(self.rows)]
            turn = np.cos(b[pos] - heading[:, None])
            log = np.where(np.isnan(heading)[:, None], 0.0, np.where(np.isnan(b[pos]), 1.0, turn))
            acc = np.cumsum(p[pos] * np.exp(self.kappa * log), axis=1)
            total = acc[:, -1]
            chosen = np.minimum((acc < (draws[:, k] * total)[:, None]).sum(1), acc.shape[1] - 1)
            new, moved = np.where(total > 0, to[pos, chosen], pos), b[pos, chosen]
            heading = np.where((new != pos) & (total > 0), moved, heading)
            pos = new
            out[who, k + 1] = pos
        return out


def _mesh(kernels: DataFrame, units: DataFrame, n_units: int, kappa: float) -> _Walker:
    place = units.select("s_idx", "lon", "lat").orderBy("s_idx").toPandas()  # mesh-sized
    each = [G.collect_csr(k, n_units) for k in _cycle(kernels)]
    return _Walker(each, place["lon"].to_numpy(), place["lat"].to_numpy(), kappa)


_DDL = "tagid long, step int, mesh_unit int, start_node int, n_steps int"
#: Agents that walk side by side in a task, and the steps that they may take together.
ABREAST = 4096


def _trajectories(walker: _Walker, tagid: np.ndarray, start: np.ndarray, steps: np.ndarray, seed: int) -> Iterator[pd.DataFrame]:
    """Walks of one batch; each agent has a random stream of its own, so results do not depend on how agents are dealt."""
    order = np.argsort(-steps, kind="stable")
    at = 0
    while at < len(order):
        longest = int(steps[order[at]])
        part = order[at : at + max(1, min(ABREAST, 4_000_000 // (longest + 1)))]
        at += len(part)
        draws = np.zeros((len(part), longest))
        for k, i in enumerate(part):
            draws[k, : steps[i]] = np.random.Generator(np.random.Philox(key=[seed, int(tagid[i]) & 0xFFFFFFFFFFFFFFFF])).random(int(steps[i]))
        units = walker.walk(start[part] - 1, draws) + 1
        n = steps[part] + 1
        inside = np.arange(longest + 1) < n[:, None]
        yield pd.DataFrame({"tagid": np.repeat(tagid[part], n), "step": np.nonzero(inside)[1].astype("int32"), "mesh_unit": units[inside].astype("int32"), "start_node": np.repeat(start[part], n).astype("int32"), "n_steps": np.repeat(steps[part], n).astype("int32")})


def heading_agents(starts: DataFrame, kernels: DataFrame, units: DataFrame, n_units: int, kappa: float = 0.0, seed: int = 42) -> DataFrame:
    """tagid, step, mesh_unit, start_node, n_steps: a walk of every row of starts (tagid, start_node, n_steps), dealt over tasks.

    kernels as in heading_distribution(); kappa 0 is a walk without a heading.
    Rows of a tagid share its random stream; a negative or null horizon is none.
    """
    shared = starts.sparkSession.sparkContext.broadcast(_mesh(kernels, units, n_units, kappa))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _trajectories(shared.value, pdf["tagid"].to_numpy(), pdf["start_node"].to_numpy(), np.maximum(0, pdf["n_steps"].to_numpy()), seed)

    some = starts.select(F.col("tagid").cast("long").alias("tagid"), "start_node", F.coalesce(F.col("n_steps"), F.lit(0)).cast("int").alias("n_steps")).where(F.col("start_node").between(1, n_units))
    return some.mapInPandas(run, _DDL)


def forward_agents(pairs: DataFrame, kernels: DataFrame, units: DataFrame, n_units: int, agents: int, kappa: float = 0.0, seed: int = 42) -> DataFrame:
    """Trajectories of so many agents, as heading_agents() gives them: starts and horizons are drawn with replacement from the pairs' releases and steps.

    The pools are counts by unit and by number of steps, so only those reach the
    driver; agents are dealt over tasks. Empty pools and no agents are errors.
    """
    if agents < 1:
        raise ValueError("at least one agent is needed")
    pools = []
    for column in ("release", "k"):
        counts = pairs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        found = counts.orderBy(column).limit(MOST_HORIZONS + 1).toPandas()
        if found.empty:
            raise ValueError(f"no pair has a {column}: there is nothing to draw from")
        if len(found) > MOST_HORIZONS:
            raise ValueError(f"more than {MOST_HORIZONS} distinct values of {column}")
        pools.append((found[column].to_numpy(), np.cumsum(found["n"].to_numpy()) / found["n"].sum()))
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast((_mesh(kernels, units, n_units, kappa), pools))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker, pools = shared.value
        for pdf in batches:
            ids = pdf["tagid"].to_numpy()
            u = np.array([np.random.Generator(np.random.Philox(key=[seed + 1, int(i)])).random(2) for i in ids])
            start, steps = (values[np.minimum(np.searchsorted(share, x, side="right"), len(values) - 1)] for (values, share), x in zip(pools, u.T, strict=True))
            yield from _trajectories(walker, ids, start, np.maximum(1, steps), seed)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, agents, 1, max(1, min(tasks, agents // 500 + 1))).select(F.col("id").alias("tagid")).mapInPandas(run, _DDL)
