"""Multi-step propagation, likelihood, connectivity, corridors and paths over many events.

Events are the distributed side: they are pre-aggregated to distinct
(release, recapture, k), dealt by release, and each task runs one forward sweep
per release over the broadcast kernel, which serves every k asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs as G


def _share(df: DataFrame, g: G.Csr):
    return df.sparkSession.sparkContext.broadcast(g)


def kstep(pairs: DataFrame, kernel: DataFrame, n_units: int, floor: bool = False) -> DataFrame:
    """release, recapture, k, n, p: the k-step probability of every distinct observed transition."""
    g = _share(kernel, G.collect_csr(kernel, n_units))
    seen = pairs.groupBy("release", "recapture", "k").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        csr = g.value
        u = int(pdf["release"].iloc[0])
        if not 1 <= u <= csr.n:
            return pdf.assign(p=np.nan).iloc[:0]
        rows = G.sweep(csr, u - 1, set(pdf["k"].tolist()))
        rows = {k: G.floored(x) if floor else x for k, x in rows.items()}
        return pdf.assign(p=[rows[k][v - 1] for k, v in zip(pdf["k"], pdf["recapture"], strict=True)])

    return seen.groupBy("release").applyInPandas(run, "release int, recapture int, k int, n long, p double")


def log_likelihood(probabilities: DataFrame) -> DataFrame:
    """One row: pairs, reachable pairs and the sum of n ln p over those with mass."""
    return probabilities.agg(F.sum("n").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("n"))), F.lit(0)).alias("n_reachable"), F.sum(F.when(F.col("p") > 0, F.col("n") * F.log("p"))).alias("loglik"))


def power(kernel: DataFrame, steps: int) -> DataFrame:
    """Kernel of several steps by repeated squaring with joins; rows are normalised at the end."""
    if steps < 1:
        return kernel.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p")).distinct()
    out, base = None, kernel.select("src", "dst", "p")
    while steps:
        if steps & 1:
            out = base if out is None else _times(out, base)
        steps >>= 1
        if steps:
            base = _times(base, base)
    return out.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("src")))


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("src", F.col("dst").alias("m"), F.col("p").alias("p1")), b.select(F.col("src").alias("m"), "dst", F.col("p").alias("p2"))
    return x.join(y, "m").groupBy("src", "dst").agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))


def regional(kernel: DataFrame, regions: DataFrame, per_unit: bool = False) -> DataFrame:
    """from_region, to_region, p: mass between regions, rows normalised; per_unit divides by the sizes first. Region 0 is none."""
    r = regions.where("region > 0") if per_unit else regions
    a, b = r.select(F.col("s_idx").alias("src"), F.col("region").alias("from_region")), r.select(F.col("s_idx").alias("dst"), F.col("region").alias("to_region"))
    m = kernel.join(a, "src").join(b, "dst").groupBy("from_region", "to_region").agg(F.sum("p").alias("m"))
    if per_unit:
        size = r.groupBy("region").agg(F.count("*").alias("size"))
        m = m.join(size.toDF("from_region", "s1"), "from_region").join(size.toDF("to_region", "s2"), "to_region").withColumn("m", F.col("m") / (F.col("s1") * F.col("s2")))
    return m.select("from_region", "to_region", (F.col("m") / F.sum("m").over(Window.partitionBy("from_region"))).alias("p"))


def corridors(events: DataFrame, kernel: DataFrame, n_units: int, least: float = 1e-9) -> DataFrame:
    """event, tau, s_idx, prob of the Markov bridge of every (release, recapture, k); equal events share one solve."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for u, events, found in _bridges(g.value, batches):
            out = []
            for (v, k), c in zip(events, found, strict=True):
                tau, s = np.nonzero(c > least)
                out.append(pd.DataFrame({"release": np.int32(u + 1), "recapture": np.int32(v + 1), "k": np.int32(k), "tau": tau.astype("int32"), "s_idx": (s + 1).astype("int32"), "prob": c[tau, s]}))
                if len(out) == 200:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    return _dealt(events).mapInPandas(run, "release int, recapture int, k int, tau int, s_idx int, prob double")


def _dealt(events: DataFrame) -> DataFrame:
    """Distinct (release, recapture, k), dealt by release and sorted: a batch holds whole runs of a release, and of a recapture within."""
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.select("release", "recapture", "k").distinct().repartition(tasks, "release").sortWithinPartitions("release", "recapture", "k")


def _bridges(g: G.Csr, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        for u, part in pdf.groupby("release"):
            events = list(zip((part["recapture"] - 1).tolist(), part["k"].tolist(), strict=True))
            yield int(u) - 1, events, G.bridges(g, int(u) - 1, events)


def corridor_use(events: DataFrame, kernel: DataFrame, n_units: int, least: float = 1e-9) -> DataFrame:
    """s_idx, prob: corridors() summed over all distinct events and their steps; cells are added up inside the tasks."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_units)
        for _, _, found in _bridges(g.value, batches):
            for c in found:
                total += np.where(c > least, c, 0).sum(0)
        s = np.flatnonzero(total)
        yield pd.DataFrame({"s_idx": (s + 1).astype("int32"), "prob": total[s]})

    return _dealt(events).mapInPandas(run, "s_idx int, prob double").groupBy("s_idx").agg(F.sum("prob").alias("prob"))


def steady_corridors(events: DataFrame, kernel: DataFrame, n_units: int, alpha: float = 0.99) -> DataFrame:
    """release, recapture, s_idx, prob of the discounted corridor: visits from u times chances of reaching v."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.linalg.inv(np.eye(n_units) - alpha * g.value.dense())
        for pdf in batches:
            for u, v in pdf.itertuples(index=False):
                c = np.maximum(m[u - 1], 0) * np.maximum(m[:, v - 1], 1e-15)
                c /= c.sum()
                yield pd.DataFrame({"release": np.int32(u), "recapture": np.int32(v), "s_idx": np.arange(1, n_units + 1, dtype="int32"), "prob": c})

    return events.select("release", "recapture").distinct().mapInPandas(run, "release int, recapture int, s_idx int, prob double")


def resolvent(kernel: DataFrame, n_units: int, beta: float = 0.9) -> DataFrame:
    """(1 - beta) (I - beta P)^-1, rectified and normalised by row; rows are solved in blocks over tasks."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.eye(n_units) - beta * g.value.dense()
        for pdf in batches:
            rows = pdf["src"].to_numpy()
            r = np.maximum(np.linalg.solve(m.T, np.eye(n_units)[:, rows - 1]).T, 0)
            r /= r.sum(1, keepdims=True)
            at, dst = np.nonzero(r > 1e-12)
            yield pd.DataFrame({"src": rows[at].astype("int32"), "dst": (dst + 1).astype("int32"), "p": r[at, dst]})

    starts = kernel.sparkSession.range(1, n_units + 1).select(F.col("id").cast("int").alias("src"))
    return starts.mapInPandas(run, "src int, dst int, p double")


def paths(events: DataFrame, costs: DataFrame, n_units: int, weight: str = "cost") -> DataFrame:
    """release, recapture, cost, hops and node list of the least-cost path of every distinct event.

    Events are dealt by release: one search from a unit serves all its targets.
    """
    g = _share(costs, G.collect_csr(costs, n_units, weight))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = int(pdf["release"].iloc[0]) - 1
        cost, before = G.dijkstra(g.value, u)
        nodes = [G.trace(before, u, v - 1) if np.isfinite(cost[v - 1]) else [u] for v in pdf["recapture"]]
        return pd.DataFrame({"release": pdf["release"], "recapture": pdf["recapture"], "cost": cost[pdf["recapture"].to_numpy() - 1], "hops": [len(x) - 1 for x in nodes], "nodes": [[i + 1 for i in x] for x in nodes]})

    return events.select("release", "recapture").distinct().groupBy("release").applyInPandas(run, "release int, recapture int, cost double, hops int, nodes array<int>")


def least_cost(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge costs: kilometres times the mean friction 1 + 3 (1 - habitat)^2 of both ends; land is closed."""
    u = units.where("NOT is_land")
    at = lambda n: u.select(F.col("s_idx").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"), (1 + 3 * F.pow(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), "hsi")), 2)).alias(f"f_{n}"))
    e = edges.join(at("src"), "src").join(at("dst"), "dst")
    return e.select("src", "dst", (F.hypot(F.col("x_src") - F.col("x_dst"), F.col("y_src") - F.col("y_dst")) * (F.col("f_src") + F.col("f_dst")) / 2).alias("cost"))


def exact_walks(events: DataFrame, kernel: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, k, logp and nodes of the most probable walk of exactly k steps; empty nodes if there is none."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = [G.logged(g.value)]
        for pdf in batches:
            for u, part in pdf.groupby("release"):
                found = G.best_walks(steps, n_units, int(u) - 1, list(zip((part["recapture"] - 1).tolist(), part["k"].tolist(), strict=True)))
                yield part.assign(logp=[s if w else np.nan for w, s in found], nodes=[[i + 1 for i in w] for w, _ in found])

    return _dealt(events).mapInPandas(run, "release int, recapture int, k int, logp double, nodes array<int>")


def stochastic_paths(events: DataFrame, units: DataFrame, edges: DataFrame, n_units: int, draws: int = 10, sd: float = 0.1, seed: int = 1) -> DataFrame:
    """release, recapture, s_idx, visit_prob, mean_cost over habitat draws: (event, draw) pairs are the parallel unit."""
    u = units.select("s_idx", "x", "y", "hsi", "is_land").orderBy("s_idx").toPandas()  # mesh-sized
    e = G.collect_csr(edges.select("src", "dst", "w"), n_units, "w")
    shared = units.sparkSession.sparkContext.broadcast((u, e))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mesh, g = shared.value
        draw, src = int(pdf["draw"].iloc[0]), np.repeat(np.arange(n_units), np.diff(g.start))
        rng = np.random.Generator(np.random.Philox(key=[seed, draw]))
        f = 1 + 3 * (1 - np.clip(mesh["hsi"].to_numpy() + rng.normal(0, sd, n_units), 0, 1)) ** 2
        x, y, land = (mesh[c].to_numpy() for c in ("x", "y", "is_land"))
        c = np.hypot(x[src] - x[g.dst], y[src] - y[g.dst]) * (f[src] + f[g.dst]) / 2
        ok = ~land[src] & ~land[g.dst]
        h = G.make_csr(src[ok], g.dst[ok], c[ok], n_units)
        out = []
        for start, part in pdf.groupby("release"):
            cost, before = G.dijkstra(h, start - 1)
            for v in part["recapture"]:
                nodes = G.trace(before, start - 1, v - 1) if np.isfinite(cost[v - 1]) else [start - 1]
                out += [(start, v, draw, i + 1, cost[v - 1]) for i in nodes]
        return pd.DataFrame(out, columns=["release", "recapture", "draw", "s_idx", "cost"])

    grid = events.select("release", "recapture").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    found = grid.groupBy("draw").applyInPandas(run, "release int, recapture int, draw int, s_idx int, cost double")
    return found.groupBy("release", "recapture", "s_idx").agg((F.countDistinct("draw") / draws).alias("visit_prob"), F.avg("cost").alias("mean_cost"))


def smooth_states(det: DataFrame, kernel: DataFrame, units: DataFrame, n_units: int, unit_seconds: float = 86400.0, sigma_km: float = 15.0) -> DataFrame:
    """tagid, step, s_idx (Viterbi), prob (forward-backward, of that unit), observed for every time step from a tag's first detection to its last; tags are the parallel unit.

    det: tagid, tag, ts, s_idx; units: s_idx, lon, lat, is_land. A detection is
    seen at its unit, or at another one by a Gaussian of the distance; land is
    never a state; steps without a detection tell nothing; of several
    detections in one step the last one counts.
    """
    place = units.select("s_idx", F.radians("lon").alias("lon"), F.radians("lat").alias("lat"), "is_land").orderBy("s_idx").toPandas()  # mesh-sized
    shared = det.sparkSession.sparkContext.broadcast((G.collect_csr(kernel, n_units), place["lon"].to_numpy(), place["lat"].to_numpy(), place["is_land"].to_numpy(bool)))
    spread = sigma_km * sigma_km

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, lon, lat, land = shared.value
        pdf = pdf.sort_values(["us", "tag"])
        us = pdf["us"].to_numpy()
        t = np.rint((us - us[0]) / (unit_seconds * 1e6)).astype(int)
        seen = np.full(t[-1] + 1, -1)
        seen[t] = pdf["s_idx"].to_numpy() - 1
        logs, like = np.zeros((len(seen), n_units)), np.ones((len(seen), n_units))
        for i in np.flatnonzero(seen >= 0):
            u = seen[i]
            a = np.sin((lat - lat[u]) / 2) ** 2 + np.cos(lat) * np.cos(lat[u]) * np.sin((lon - lon[u]) / 2) ** 2
            z = -0.5 * (2 * 6378.137 * np.arcsin(np.sqrt(np.minimum(1.0, a)))) ** 2 / spread
            logs[i], like[i] = z - 0.5 * np.log(2 * np.pi * spread), np.exp(z)
            logs[i, u], like[i, u] = 0.0, 1.0
        logs[:, land], like[:, land] = -1e9, 0.0
        state = G.viterbi_hmm([g], logs)
        prob = G.forward_backward([g], like)
        return pd.DataFrame({"tagid": pdf["tagid"].iloc[0], "step": np.arange(len(seen), dtype="int32"), "s_idx": (state + 1).astype("int32"), "prob": prob[np.arange(len(seen)), state], "observed": seen >= 0})

    return det.select("tagid", "tag", F.unix_micros("ts").alias("us"), "s_idx").groupBy("tagid").applyInPandas(run, "tagid long, step int, s_idx int, prob double, observed boolean")


def agents(starts: DataFrame, kernel: DataFrame, n_units: int, seed: int = 1) -> DataFrame:
    """tagid, step, mesh_unit of independent walkers (tagid, start_node, n_steps): own random stream per agent, any number of tasks."""
    g = _share(kernel, G.collect_csr(kernel, n_units))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csr = g.value
        acc = np.concatenate([np.cumsum(csr.row(i)[1]) for i in range(csr.n)])
        for pdf in batches:
            for tagid, at, n in pdf[["tagid", "start_node", "n_steps"]].itertuples(index=False):
                rng = np.random.Generator(np.random.Philox(key=[seed, int(tagid)]))
                walk = [int(at) - 1]
                for r in rng.random(int(n)):
                    s, e = csr.start[walk[-1]], csr.start[walk[-1] + 1]
                    if s == e:
                        break
                    walk.append(int(csr.dst[s + min(e - s - 1, np.searchsorted(acc[s:e], r * acc[e - 1]))]))
                yield pd.DataFrame({"tagid": np.int64(tagid), "step": np.arange(len(walk), dtype="int32"), "mesh_unit": np.array(walk, "int32") + 1})

    return starts.mapInPandas(run, "tagid long, step int, mesh_unit int")


def space_use(walks: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, visits, visit_probability, mean_dwell_steps for every unit."""
    n = walks.agg(F.countDistinct("tagid").alias("n"))
    v = walks.groupBy(F.col("mesh_unit").alias("u")).agg(F.countDistinct("tagid").alias("visits"), F.count("*").alias("rows"))
    d = units.select(F.col("s_idx").alias("unit_id")).join(v, F.col("unit_id") == F.col("u"), "left")
    visits = F.coalesce("visits", F.lit(0))
    return d.select("unit_id", visits.cast("long").alias("visits"), (visits / n.scalar()).alias("visit_probability"), F.coalesce(F.try_divide("rows", "visits"), F.lit(0.0)).alias("mean_dwell_steps"))


def circuits(sources: DataFrame, conductance: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, resistance, s_idx, current for distinct endpoints, dealt over tasks: one inversion a task serves all of its endpoints."""
    g = _share(conductance, G.collect_csr(conductance, n_units, "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solved = G.potentials(g.value)
        for pdf in batches:
            for u, v in pdf.itertuples(index=False):
                r, volt = G.solved_circuit(solved, u - 1, v - 1)
                j = G.node_current(g.value, volt, u - 1, v - 1) if np.isfinite(r) else np.zeros(n_units)
                yield pd.DataFrame({"release": np.int32(u), "recapture": np.int32(v), "resistance": r, "s_idx": np.arange(1, n_units + 1, dtype="int32"), "current": j})

    return sources.select("release", "recapture").distinct().mapInPandas(run, "release int, recapture int, resistance double, s_idx int, current double")


def conductance(units: DataFrame, edges: DataFrame, exponent: float = 1.0) -> DataFrame:
    """src, dst, c = w exp(exponent (h_i + h_j) / 2), without land, made symmetric."""
    u = units.where("NOT is_land")
    e = edges.join(u.select(F.col("s_idx").alias("src"), F.col("hsi").alias("a")), "src").join(u.select(F.col("s_idx").alias("dst"), F.col("hsi").alias("b")), "dst")
    e = e.select("src", "dst", (F.col("w") * F.exp(0.5 * exponent * (F.col("a") + F.col("b")))).alias("c"))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c"))
    return both.groupBy("src", "dst").agg((F.sum("c") / 2).alias("c"))


def laplacian(c: DataFrame) -> DataFrame:
    """src, dst, l: degrees on the diagonal, less the conductances."""
    return c.select("src", "dst", (-F.col("c")).alias("l")).union(c.groupBy("src").agg(F.sum("c").alias("l")).select("src", F.col("src").alias("dst"), "l"))


def pinch_points(density: DataFrame, q: float = 0.9) -> DataFrame:
    """s_idx, score, is_pinch: density times resistance, at or above the quantile of the positive scores."""
    d = density.withColumn("score", F.col("density") * F.greatest(F.lit(1e-3), F.col("resistance")))
    cut = d.where("score > 1e-9").agg(F.expr(f"percentile(score, {q})").alias("cut"))
    return d.select("s_idx", "score", ((F.col("score") > 1e-9) & (F.col("score") >= cut.scalar())).alias("is_pinch"))


def metropolis(pairs: DataFrame, units: DataFrame, edges: DataFrame, n_units: int, chains: int = 4, draws: int = 40, warmup: int = 20, seed: int = 1) -> DataFrame:
    """chain, draw, velocity, diffusion, gamma, logp, accepted of random-walk chains over the pre-aggregated pairs; chains run side by side."""
    u = units.select("s_idx", "hsi", "is_land").orderBy("s_idx").toPandas()  # mesh-sized
    e = G.collect_csr(edges.select("src", "dst", "w"), n_units, "w")
    obs = pairs.groupBy("release", "recapture", "k").agg(F.count("*").alias("n"))
    if obs.count() > G.MOST_EDGES:
        raise ValueError("too many distinct transitions for chains on one node each")
    shared = pairs.sparkSession.sparkContext.broadcast((u, e, obs.toPandas()))

    def kernel(mesh, g, v, d, gamma):
        h, land = mesh["hsi"].to_numpy(), mesh["is_land"].to_numpy(bool)
        total = v + d + 1e-6
        alpha, rho = min(1, max(0, v / total)), min(0.95, max(0.01, 1 / (1 + total)))
        src = np.repeat(np.arange(n_units), np.diff(g.start))
        ok = ~land[src] & ~land[g.dst]
        src, dst, w = src[ok], g.dst[ok], g.w[ok]
        t = w * np.exp(np.clip(gamma * (h[dst] - h[src]), -25, 25))
        p = (1 - rho) * (alpha * t / np.bincount(src, t, n_units)[src] + (1 - alpha) * w / np.bincount(src, w, n_units)[src])
        stay = 1 - np.bincount(src, p, n_units)
        every = np.arange(n_units)
        return G.make_csr(np.r_[src, every], np.r_[dst, every], np.r_[p, stay], n_units)

    def logp(z):
        mesh, g, o = shared.value
        v, d, gamma = 0.95 / (1 + np.exp(-z[0])), np.exp(z[1]), z[2]
        prior = -0.5 * ((v - 0.3) / 0.2) ** 2 - 0.5 * ((d - 0.1) / 0.2) ** 2 - 0.5 * (gamma - 1) ** 2
        prior += np.log(v) + np.log(0.95 - v) + z[1]  # Jacobians of the linked space
        p = kernel(mesh, g, v, d, gamma).dense()
        x, total = np.eye(n_units), 0.0
        by_k = {k: part for k, part in o.groupby("k")}
        for k in range(1, int(o["k"].max()) + 1):
            x = x @ p
            if k in by_k:
                part = by_k[k]
                q = x[part["release"] - 1, part["recapture"] - 1]
                total += float((part["n"] * np.log(np.maximum(q, 1e-12))).sum())
        return prior + total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chain in pdf["chain"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(chain)]))
                z = np.array([np.log(0.3 / 0.65), np.log(0.1), 1.0])
                now, out = logp(z), []
                for k in range(warmup + draws):
                    new = z + 0.05 * np.array([0.2, 0.2, 1.0]) * rng.normal(size=3)
                    then = logp(new)
                    accept = np.log(rng.random()) < then - now
                    if accept:
                        z, now = new, then
                    if k >= warmup:
                        out.append((chain, k - warmup, 0.95 / (1 + np.exp(-z[0])), np.exp(z[1]), z[2], now, bool(accept)))
                yield pd.DataFrame(out, columns=["chain", "draw", "velocity", "diffusion", "gamma", "logp", "accepted"])

    return pairs.sparkSession.range(0, chains, 1, chains).select(F.col("id").alias("chain")).mapInPandas(run, "chain long, draw long, velocity double, diffusion double, gamma double, logp double, accepted boolean")


def chain_health(draws: DataFrame) -> DataFrame:
    """chain, acceptance, distinct values to nine digits, frozen."""
    d = draws.groupBy("chain").agg(F.avg(F.col("accepted").cast("double")).alias("acceptance"), F.countDistinct(F.round("velocity", 9)).alias("n_distinct"))
    return d.withColumn("frozen", (F.col("acceptance") <= 0.01) | (F.col("n_distinct") <= 1))
