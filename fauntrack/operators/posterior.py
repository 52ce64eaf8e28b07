"""Operators over parameter or habitat draws: (draw, event) pairs are dealt over tasks, summaries are plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fauntrack.functions import geo

from . import graphs as G
from . import habitat, kernel
from .dynamics import dealt


def _mesh(units: DataFrame, edges: DataFrame, n_units: int):
    """Unit columns and adjacency of a mesh as one broadcast value."""
    u = units.select("s_idx", "x", "y", "hsi", "is_land").orderBy("s_idx").toPandas()  # mesh-sized
    return units.sparkSession.sparkContext.broadcast((u, G.collect_csr(edges.select("src", "dst", "w"), n_units, "w")))


def _kernel(mesh: pd.DataFrame, g: G.Csr, hsi: np.ndarray, gamma: float, rho: float, alpha: float) -> G.Csr:
    n, land = g.n, mesh["is_land"].to_numpy(bool)
    src = np.repeat(np.arange(n), np.diff(g.start))
    ok = ~land[src] & ~land[g.dst]
    src, dst, w = src[ok], g.dst[ok], g.w[ok]
    t = w * np.exp(np.clip(gamma * (hsi[dst] - hsi[src]), -25, 25))
    p = (1 - rho) * (alpha * t / np.bincount(src, t, n)[src] + (1 - alpha) * w / np.bincount(src, w, n)[src])
    every = np.arange(n)
    return G.make_csr(np.r_[src, every], np.r_[dst, every], np.r_[p, 1 - np.bincount(src, p, n)], n)


def _by_draw(events: DataFrame, draws: int) -> DataFrame:
    return events.select("release", "recapture", "k").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).groupBy("draw")


def _crossed(events: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every event under every parameter draw: the draws (a bounded table) become one array literal."""
    rows = parameters.select("draw", "alpha", "rho", "gamma").collect()
    one = [F.struct(F.lit(int(r["draw"])).alias("draw"), *[F.lit(float(r[c])).alias(c) for c in ("alpha", "rho", "gamma")]) for r in rows]
    return events.withColumn("_p", F.explode(F.array(*one))).select("*", "_p.*").drop("_p")


# ------------------------------------------------------------------ posterior kernels

#: Parameters of a draw, their names in a chain, and the bounds of the model (fixed values).
PARAMETERS = {"velocity": (0.0, 0.95), "diffusion": (0.0, float("inf")), "gamma": (float("-inf"), float("inf"))}
#: Models in the order in which their chains are taken.
MODEL_ORDER = ("telemetry", "telemetry_and_survey")


def active_chain(chains: DataFrame) -> DataFrame:
    """The rows of the first model of MODEL_ORDER that has any, else of the first by name; an empty table is an error."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, MODEL_ORDER)), F.col("model")), F.lit(0))
    first = chains.agg(F.min(F.struct(F.when(place > 0, place).otherwise(len(MODEL_ORDER) + 1).alias("place"), F.col("model").alias("model"))).alias("m")).first()["m"]
    if first is None:
        raise ValueError("no fitted model has a chain")
    return chains.where(F.col("model") == first["model"]).drop("model")


def parameter_draws(chain: DataFrame, draw: str = "draw") -> DataFrame:
    """draw, velocity, diffusion, gamma, alpha, rho for every row of a chain.

    The chain's columns are named plainly (mu_velocity) or as the sampler wraps
    them (Parameter(mu_velocity)); other columns are ignored. Where a chain also
    has a dispersion (sigma_velocity) and effects of individuals (z_velocity, an
    array), a draw's value is the mean over individuals of mu + sigma z, each
    held within the model's bounds. A missing mu is an error that names it.
    """
    named = {c[c.find("(") + 1 : c.rfind(")")] if "(" in c else c: c for c in chain.columns}
    missing = [f"mu_{p}" for p in PARAMETERS if f"mu_{p}" not in named]
    if missing:
        raise ValueError(f"the chain lacks {', '.join(missing)}; it has {', '.join(sorted(named))}")
    one = lambda name: F.col(f"`{named[name]}`").cast("double")

    def value(p: str) -> Column:
        low, high = PARAMETERS[p]
        mu = one(f"mu_{p}")
        if f"sigma_{p}" not in named or f"z_{p}" not in named:
            return mu
        z, sigma = F.col(f"`{named[f'z_{p}']}`"), one(f"sigma_{p}")
        each = F.transform(z, lambda v: geo.clamp(mu + sigma * v, low, high))
        return F.when(F.size(z) > 0, F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / F.size(z)).otherwise(mu)

    d = chain.select(F.col(f"`{named[draw]}`").cast("long").alias("draw"), *[value(p).alias(p) for p in PARAMETERS])
    alpha, rho = geo.alpha_rho("velocity", "diffusion")
    return d.withColumns({"alpha": alpha, "rho": rho})


def _dealt_draws(draws: DataFrame) -> DataFrame:
    """Draws, spread over as many tasks as the session shuffles into."""
    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return draws.select("draw", "velocity", "diffusion", "gamma", "alpha", "rho").repartition(tasks, "draw")


def posterior_kernels(draws: DataFrame, units: DataFrame, edges: DataFrame, n_units: int) -> DataFrame:
    """draw, src, dst, p: the transition kernel of every draw, entries up to 1e-12 left out. Draws are the parallel unit; the mesh travels to the tasks."""
    shared = _mesh(units, edges, n_units)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mesh, g = shared.value
        hsi = mesh["hsi"].to_numpy()
        for pdf in batches:
            for draw, gamma, alpha, rho in pdf[["draw", "gamma", "alpha", "rho"]].itertuples(index=False):
                p = _kernel(mesh, g, hsi, gamma, rho, alpha)
                keep = p.w > 1e-12
                src = np.repeat(np.arange(n_units), np.diff(p.start))
                yield pd.DataFrame({"draw": np.int64(draw), "src": (src[keep] + 1).astype("int32"), "dst": (p.dst[keep] + 1).astype("int32"), "p": p.w[keep]})

    return _dealt_draws(draws).mapInPandas(run, "draw long, src int, dst int, p double")


def posterior_kernel(draws: DataFrame, units: DataFrame, edges: DataFrame, beta: float = 0.0, form: str = "difference") -> DataFrame:
    """src, dst, p: the kernel at the posterior means of alpha, rho and gamma.

    With a positive beta residency differs from unit to unit by its local
    habitat advantage (form as in habitat.advantage); with zero the fitted one
    holds everywhere.
    """
    m = draws.agg(F.avg("gamma").alias("gamma"), F.avg("rho").alias("rho"), F.avg("alpha").alias("alpha")).first()
    if beta == 0.0:
        return kernel.static(units, edges, m["gamma"], m["rho"], m["alpha"])
    local = habitat.advantage(units, edges, form).select("s_idx", "advantage")
    return kernel.static(units.join(local, "s_idx"), edges, m["gamma"], habitat.residency(m["rho"], F.col("advantage"), beta, form), m["alpha"])


def regional_draws(kernels: DataFrame, regions: DataFrame) -> DataFrame:
    """draw, from_region, to_region, p: mean probability between the units of two regions, rows normalised, for every draw and every two regions.

    regions: s_idx, region; region 0 and null are none. Regions that a draw does
    not connect have 0, as have all of a region without mass.
    """
    r = regions.where("region > 0").select("s_idx", "region")
    a, b = r.select(F.col("s_idx").alias("src"), F.col("region").alias("from_region")), r.select(F.col("s_idx").alias("dst"), F.col("region").alias("to_region"))
    mass = kernels.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").groupBy("draw", "from_region", "to_region").agg(F.sum("p").alias("m"))
    size = r.groupBy("region").agg(F.count("*").alias("units"))
    # the grid of regions is one array for every draw: a row a draw becomes regions squared rows
    some = F.array_sort(F.collect_list(F.struct("region", "units")))
    grid = kernels.select("draw").distinct().withColumn("_r", size.agg(some.alias("r")).scalar())
    grid = grid.select("draw", "_r", F.explode("_r").alias("x")).select("draw", F.col("x.region").alias("from_region"), F.col("x.units").alias("n1"), F.explode("_r").alias("y")).select("draw", "from_region", "n1", F.col("y.region").alias("to_region"), F.col("y.units").alias("n2"))
    m = grid.join(mass, ["draw", "from_region", "to_region"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)) / (F.col("n1") * F.col("n2") + 1e-10))
    total = F.sum("m").over(Window.partitionBy("draw", "from_region"))
    return m.select("draw", "from_region", "to_region", F.when(total > 0, F.col("m") / total).otherwise(F.col("m")).alias("p"))


def connectivity_intervals(by_draw: DataFrame, level: float = 0.95) -> DataFrame:
    """source_region, sink_region, n_draws, mean_conn, lower_ci, upper_ci over all draws of regional_draws()."""
    q = (1 - level) / 2
    ends = lambda x: F.percentile("p", F.lit(x))
    return by_draw.groupBy(F.col("from_region").alias("source_region"), F.col("to_region").alias("sink_region")).agg(F.count("*").alias("n_draws"), F.avg("p").alias("mean_conn"), ends(q).alias("lower_ci"), ends(1 - q).alias("upper_ci"))


#: Weight of an edge towards better habitat, by the rise (fixed formulas).
RISE = {"exponential": np.exp, "logistic": lambda d: 1 / (1 + np.exp(-4.0 * d)), "linear": lambda d: d}


def resolvent_kernel(draws: DataFrame, units: DataFrame, edges: DataFrame, n_units: int, form: str = "exponential", block: int = 512) -> DataFrame:
    """src, dst, p: mean over draws of the rows of (I - velocity A - diffusion L)^-1, rectified and normalised in each draw and at the end.

    A holds the edges towards better habitat, weighed by the rise and normalised
    by row; L is the graph Laplacian. (draw, block of rows) pairs are the
    parallel unit: a task solves for its rows only and adds them up, so what is
    shuffled is blocks of one matrix a task. A row without mass stays where it is.
    """
    shared = _mesh(units, edges, n_units)
    blocks = -(-n_units // block)

    def rectified(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.maximum(x, 0)
        total = x.sum(1)
        x[total > 1e-12] /= total[total > 1e-12, None]
        none = np.flatnonzero(total <= 1e-12)
        x[none] = 0
        x[none, at[none]] = 1
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mesh, g = shared.value
        hsi = mesh["hsi"].to_numpy()
        src = np.repeat(np.arange(n_units), np.diff(g.start))
        rise = hsi[g.dst] - hsi[src]
        up = (rise > 0) & (src != g.dst)
        w = g.w[up] * RISE[form](rise[up])
        out = np.bincount(src[up], w, n_units)
        a, lap = np.zeros((n_units, n_units)), np.zeros((n_units, n_units))
        np.add.at(a, (src[up], g.dst[up]), w / np.where(out[src[up]] > 1e-12, out[src[up]], np.inf))
        np.add.at(lap, (src, g.dst), -g.w)
        lap[np.diag_indices(n_units)] += np.bincount(src, g.w, n_units)
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b, v, d in pdf[["block", "velocity", "diffusion"]].itertuples(index=False):
                at = np.arange(b * block, min(n_units, (b + 1) * block))
                rows = np.linalg.solve((np.eye(n_units) - v * a - d * lap).T, np.eye(n_units)[:, at]).T
                total[b] = total.get(b, 0) + rectified(rows, at)
        for b, x in total.items():
            i, j = np.nonzero(x)
            yield pd.DataFrame({"src": (i + b * block + 1).astype("int32"), "dst": (j + 1).astype("int32"), "p": x[i, j]})

    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = draws.select("draw", "velocity", "diffusion").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "block", "draw")
    sums = grid.mapInPandas(run, "src int, dst int, p double").groupBy("src", "dst").agg(F.sum("p").alias("p"))
    return sums.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("src")))


#: Priors of the parameters: mean, sd, and where the normal is cut off (fixed values).
PRIORS = {"velocity": (0.3, 0.2, 0.0, 0.95), "diffusion": (0.1, 0.2, 0.0, float("inf")), "gamma": (1.0, 1.0, float("-inf"), float("inf"))}
#: A transition that a kernel does not allow counts with this probability.
LEAST_PROBABILITY = 1e-12
#: Most draws that are sent to the tasks of one call.
MOST_DRAWS = 100_000


def log_prior(draws: DataFrame) -> Column:
    """Sum of the logs of the truncated normal densities; minus infinity outside of their bounds."""
    total = F.lit(0.0)
    for name, (mean, sd, low, high) in PRIORS.items():
        inside = [0.5 * (1 + math.erf((x - mean) / sd / math.sqrt(2))) for x in (low, high)]
        z = (F.col(name) - mean) / sd
        log = -0.5 * z * z - math.log(sd * math.sqrt(2 * math.pi) * (inside[1] - inside[0]))
        total = total + F.when((F.col(name) >= low) & (F.col(name) <= high), log).otherwise(float("-inf"))
    return total


def log_posterior(draws: DataFrame, pairs: DataFrame, units: DataFrame, edges: DataFrame, n_units: int) -> DataFrame:
    """draw, n_pairs, prior, loglik, logp of every draw (draw, velocity, diffusion, gamma, alpha, rho) given the pairs (release, recapture, k).

    Pairs are counted by transition and dealt by release; a task sweeps a release
    once for each draw and adds up over its releases, so a row a draw and task is
    shuffled. The same density serves a model with a survey, whose counts have no
    likelihood of their own. Pairs with an end outside the mesh count for nothing.
    """
    some = draws.select("draw", "gamma", "alpha", "rho").limit(MOST_DRAWS + 1).toPandas()
    if len(some) > MOST_DRAWS:
        raise ValueError(f"more than {MOST_DRAWS} draws: call it for parts of them")
    shared = _mesh(units, edges, n_units)
    parameters = draws.sparkSession.sparkContext.broadcast(some)
    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = pairs.where(F.col("release").between(1, n_units) & F.col("recapture").between(1, n_units)).groupBy("release", "recapture", "k").agg(F.count("*").alias("n")).repartition(tasks, "release").sortWithinPartitions("release")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mesh, g = shared.value
        p = parameters.value
        kernels = None
        total, count = np.zeros(len(p)), 0
        for pdf in batches:
            kernels = kernels or [_kernel(mesh, g, mesh["hsi"].to_numpy(), *r) for r in p[["gamma", "rho", "alpha"]].itertuples(index=False)]
            for u, part in pdf.groupby("release"):
                k, v, n = (part[c].to_numpy() for c in ("k", "recapture", "n"))
                count += int(n.sum())
                for i, csr in enumerate(kernels):
                    rows = G.sweep(csr, int(u) - 1, set(k.tolist()))
                    q = np.array([rows[a][b - 1] for a, b in zip(k, v, strict=True)])
                    total[i] += float((n * np.log(np.maximum(q, LEAST_PROBABILITY))).sum())
        yield pd.DataFrame({"draw": p["draw"].to_numpy(), "n_pairs": count, "loglik": total})

    sums = seen.mapInPandas(run, "draw long, n_pairs long, loglik double").groupBy("draw").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("loglik").alias("loglik"))
    d = draws.select("draw", log_prior(draws).alias("prior")).join(sums, "draw", "left").select("draw", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "prior", F.coalesce("loglik", F.lit(0.0)).alias("loglik"))
    return d.withColumn("logp", F.col("prior") + F.col("loglik"))


# ------------------------------------------------------------------ circuits


def circuit_draws(events: DataFrame, units: DataFrame, edges: DataFrame, n_units: int, draws: int = 10, sd: float = 0.05, seed: int = 1) -> DataFrame:
    """draw, s_idx, density: mean current of the events' endpoints under a habitat draw."""
    shared = _mesh(units, edges, n_units)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mesh, g = shared.value
        draw = int(pdf["draw"].iloc[0])
        rng = np.random.Generator(np.random.Philox(key=[seed, draw]))
        h = np.clip(mesh["hsi"].to_numpy() + rng.normal(0, sd, n_units), 0, 1)
        land, src = mesh["is_land"].to_numpy(bool), np.repeat(np.arange(n_units), np.diff(g.start))
        ok = ~land[src] & ~land[g.dst]
        c = G.make_csr(src[ok], g.dst[ok], (g.w * np.exp(0.5 * (h[src] + h[g.dst])))[ok], n_units)
        total = np.zeros(n_units)
        ends = pdf[["release", "recapture"]].drop_duplicates()
        solved = G.potentials(c)
        for u, v in ends.itertuples(index=False):
            ohm, volt = G.solved_circuit(solved, u - 1, v - 1)
            if u != v and np.isfinite(ohm):
                total += G.node_current(c, volt, u - 1, v - 1)
        return pd.DataFrame({"draw": np.int32(draw), "s_idx": np.arange(1, n_units + 1, dtype="int32"), "density": total / max(1, len(ends))})

    return _by_draw(events, draws).applyInPandas(run, "draw int, s_idx int, density double")


def summarize_draws(table: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """Per unit: mean, sd, median, 95 % interval, coefficient of variation, and how often it is in the draw's top share."""
    cut = table.groupBy("draw").agg(F.expr(f"percentile({value}, {q})").alias("cut"))
    d = table.join(cut, "draw")
    return d.groupBy("s_idx").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.025)").alias("lower"),
        F.expr(f"percentile({value}, 0.975)").alias("upper"), F.avg((F.col(value) >= F.col("cut")).cast("double")).alias("pinch_prob"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"),
    )


#: Covariance forms by scaled distance (fixed formulas); any other name is exponential.
COVARIANCE = {
    "matern32": lambda d: (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d),
    "matern52": lambda d: (1 + np.sqrt(5) * d + 5 * d * d / 3) * np.exp(-np.sqrt(5) * d),
    "gaussian": lambda d: np.exp(-0.5 * d * d),
}


def resistance_covariance(conductance: DataFrame, n_units: int, length: float = 1.0, sill: float = 1.0, nugget: float = 0.0, form: str = "exponential") -> DataFrame:
    """s_idx, other, covariance over effective resistances; pairs across components have none. Rows are dealt over tasks."""
    g = conductance.sparkSession.sparkContext.broadcast(G.collect_csr(conductance, n_units, "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = G.resistance_matrix(g.value)
        cov = sill * COVARIANCE.get(form, lambda d: np.exp(-d))(r / length)
        cov[r >= 0.9e6] = 0
        cov[np.diag_indices(n_units)] = sill + nugget
        for pdf in batches:
            for s in pdf["s_idx"]:
                yield pd.DataFrame({"s_idx": np.int32(s), "other": np.arange(1, n_units + 1, dtype="int32"), "covariance": cov[s - 1]})

    return conductance.sparkSession.range(1, n_units + 1).select(F.col("id").cast("int").alias("s_idx")).mapInPandas(run, "s_idx int, other int, covariance double")


def path_draws(events: DataFrame, units: DataFrame, edges: DataFrame, parameters: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, draw, s_idx, length: most probable paths under every parameter draw (draw, alpha, rho, gamma)."""
    shared = _mesh(units, edges, n_units)
    grid = _crossed(events.select("release", "recapture").distinct(), parameters)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mesh, g = shared.value
        a, r, c = (float(pdf[k].iloc[0]) for k in ("alpha", "rho", "gamma"))
        p = _kernel(mesh, g, mesh["hsi"].to_numpy(), c, r, a)
        src = np.repeat(np.arange(n_units), np.diff(p.start))
        ok = (p.w > 1e-12) & (src != p.dst)
        cost = G.make_csr(src[ok], p.dst[ok], -np.log(p.w[ok]), n_units)
        out = []
        for u, part in pdf.groupby("release"):
            dist, before = G.dijkstra(cost, u - 1)
            for v in part["recapture"]:
                nodes = G.trace(before, u - 1, v - 1) if np.isfinite(dist[v - 1]) else [u - 1]
                out += [(u, v, int(pdf["draw"].iloc[0]), i + 1, len(nodes)) for i in nodes]
        return pd.DataFrame(out, columns=["release", "recapture", "draw", "s_idx", "length"])

    return grid.groupBy("draw").applyInPandas(run, "release int, recapture int, draw int, s_idx int, length int")


def path_intervals(paths: DataFrame) -> DataFrame:
    """Per event: mean, sd and 95 % interval of the path length in nodes, waypoints, and the most visited one."""
    one = paths.groupBy("release", "recapture", "draw").agg(F.first("length").alias("length"))
    size = one.groupBy("release", "recapture").agg(F.avg("length").alias("mean"), F.stddev_samp("length").alias("sd"), F.expr("percentile(length, 0.025)").alias("lower"), F.expr("percentile(length, 0.975)").alias("upper"))
    visits = paths.groupBy("release", "recapture", "s_idx").agg(F.count("*").alias("n"))
    modal = visits.groupBy("release", "recapture").agg(F.count("*").alias("n_waypoints"), F.max_by("s_idx", F.struct("n", -F.col("s_idx"))).alias("modal_waypoint"))
    return size.join(modal, ["release", "recapture"])


def _ensemble_kernels(parameters: DataFrame) -> list[tuple[float, ...]]:
    return [tuple(float(r[c]) for c in ("gamma", "rho", "alpha")) for r in parameters.select("gamma", "rho", "alpha").collect()]  # a bounded table


def _averaged(batches: Iterator[pd.DataFrame], mesh: pd.DataFrame, g: G.Csr, rows: list[tuple[float, ...]]) -> Iterator[tuple]:
    """Unit of release, unit of recapture, k and the corridor averaged over the draws, (k + 1) x units, for every event."""
    kernels = [_kernel(mesh, g, mesh["hsi"].to_numpy(), *r) for r in rows]
    for pdf in batches:
        for u, part in pdf.groupby("release"):
            events = list(zip((part["recapture"] - 1).tolist(), part["k"].tolist(), strict=True))
            for (v, k), *found in zip(events, *(G.bridges(p, int(u) - 1, events) for p in kernels), strict=True):
                yield int(u) - 1, v, k, sum(np.where(x > 1e-9, x, 0) for x in found) / len(rows)


def ensemble(events: DataFrame, units: DataFrame, edges: DataFrame, parameters: DataFrame, n_units: int) -> DataFrame:
    """release, recapture, k, tau, s_idx, prob: the bridge corridor averaged over parameter draws; events are dealt by release."""
    shared, rows = _mesh(units, edges, n_units), _ensemble_kernels(parameters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for u, v, k, b in _averaged(batches, *shared.value, rows):
            t, s = np.nonzero(b)
            out.append(pd.DataFrame({"release": np.int32(u + 1), "recapture": np.int32(v + 1), "k": np.int32(k), "tau": t.astype("int32"), "s_idx": (s + 1).astype("int32"), "prob": b[t, s]}))
            if len(out) == 200:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return dealt(events, "release", "recapture").mapInPandas(run, "release int, recapture int, k int, tau int, s_idx int, prob double")


def ensemble_use(events: DataFrame, units: DataFrame, edges: DataFrame, parameters: DataFrame, n_units: int) -> DataFrame:
    """s_idx, prob: ensemble() summed over all distinct events and their steps; cells are added up inside the tasks."""
    shared, rows = _mesh(units, edges, n_units), _ensemble_kernels(parameters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_units)
        for *_, b in _averaged(batches, *shared.value, rows):
            total += b.sum(0)
        s = np.flatnonzero(total)
        yield pd.DataFrame({"s_idx": (s + 1).astype("int32"), "prob": total[s]})

    return dealt(events, "release", "recapture").mapInPandas(run, "s_idx int, prob double").groupBy("s_idx").agg(F.sum("prob").alias("prob"))


def predictive_check(pairs: DataFrame, kernel: DataFrame, n_units: int, draws: int = 30, most_steps: int = 10, seed: int = 1) -> DataFrame:
    """draw, brier, kl of simulated against observed recaptures; steps are capped as documented, pairs are pre-aggregated."""
    g = kernel.sparkSession.sparkContext.broadcast(G.collect_csr(kernel, n_units))
    obs = pairs.withColumn("k", F.least("k", F.lit(most_steps))).groupBy("release", "k").agg(F.count("*").alias("n"))
    grid = obs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, draw = int(pdf["release"].iloc[0]), int(pdf["draw"].iloc[0])
        rng = np.random.Generator(np.random.Philox(key=[seed, draw * n_units + u]))
        rows = G.sweep(g.value, u - 1, set(pdf["k"].tolist()))
        total = sum(rng.multinomial(int(n), np.maximum(rows[k], 0) / rows[k].sum()) for k, n in zip(pdf["k"], pdf["n"], strict=True))
        s = np.flatnonzero(total)
        return pd.DataFrame({"draw": np.int32(draw), "s_idx": (s + 1).astype("int32"), "n": total[s]})

    sim = grid.groupBy("draw", "release").applyInPandas(run, "draw int, s_idx int, n long").groupBy("draw", "s_idx").agg(F.sum("n").alias("n"))
    size = pairs.count()
    o = pairs.groupBy(F.col("recapture").alias("s_idx")).agg((F.count("*") / size).alias("o"))
    cells = sim.select("draw").distinct().withColumn("s_idx", F.explode(F.sequence(F.lit(1), F.lit(n_units))))
    d = cells.join(sim, ["draw", "s_idx"], "left").join(o, "s_idx", "left").select("draw", F.coalesce(F.col("n") / size, F.lit(0.0)).alias("q"), F.coalesce("o", F.lit(0.0)).alias("o"))
    both = (F.col("o") > 1e-10) & (F.col("q") > 1e-10)
    return d.groupBy("draw").agg(F.avg(F.pow(F.col("o") - F.col("q"), 2)).alias("brier"), F.coalesce(F.sum(F.when(both, F.col("o") * F.log(F.col("o") / F.col("q")))), F.lit(0.0)).alias("kl"))


def persistence_gain(pairs: DataFrame, kernel: DataFrame, units: DataFrame, n_units: int, kappas: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 4.0), headings: int = 8) -> DataFrame:
    """kappa, loglik (mean over all pairs, whatever their k) of the kernel with turning cost, baseline (of the kernel itself), gain, is_best, improves; kappas are dealt over tasks.

    A probability counts as 1e-300 at least; of equal kappas the smaller one is
    best, and it improves if its gain is above 1e-9.
    """
    u = units.select("s_idx", "lon", "lat").orderBy("s_idx").toPandas()  # mesh-sized
    obs = pairs.groupBy("release", "recapture", "k").agg(F.count("*").alias("n"))
    if obs.count() > G.MOST_EDGES:
        raise ValueError("too many distinct transitions for one task a kappa")
    shared = pairs.sparkSession.sparkContext.broadcast((u, G.collect_csr(kernel, n_units), obs.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mesh, g, o = shared.value
        src = np.repeat(np.arange(n_units), np.diff(g.start))
        lon, lat = mesh["lon"].to_numpy(), mesh["lat"].to_numpy()
        b = np.degrees(np.arctan2((lon[g.dst] - lon[src]) * np.cos(np.radians(lat[src])), lat[g.dst] - lat[src])) % 360
        stay, width = src == g.dst, 360 / headings
        into = np.minimum(headings - 1, (b / width).astype(int))
        for pdf in batches:
            for kappa in pdf["kappa"]:
                m = np.zeros((n_units * headings, n_units * headings))
                for h in range(headings):
                    w = g.w * np.where(stay, np.exp(kappa), np.exp(kappa * np.cos(np.radians(b - h * width))))
                    np.add.at(m, (src * headings + h, g.dst * headings + np.where(stay, h, into)), w)
                m /= np.maximum(m.sum(1, keepdims=True), 1e-300)
                x = np.repeat(np.eye(n_units), headings, axis=1) / headings
                base, first = np.eye(n_units), 0.0
                total, seen = 0.0, {k: p for k, p in o.groupby("k")}
                for k in range(1, int(o["k"].max()) + 1 if len(o) else 0):
                    x, base = x @ m, g.push(base)
                    if k in seen:
                        p = seen[k]
                        q = x.reshape(n_units, n_units, headings).sum(2)[p["release"] - 1, p["recapture"] - 1]
                        total += float((p["n"] * np.log(np.maximum(q, 1e-300))).sum())
                        first += float((p["n"] * np.log(np.maximum(base[p["release"] - 1, p["recapture"] - 1], 1e-300))).sum())
                n = max(1, o["n"].sum())
                yield pd.DataFrame({"kappa": [float(kappa)], "loglik": [total / n], "baseline": [first / n]})

    scored = pairs.sparkSession.createDataFrame([(float(k),) for k in kappas], "kappa double").repartition(len(kappas)).mapInPandas(run, "kappa double, loglik double, baseline double")
    gain = F.col("loglik") - F.col("baseline")
    best = F.max_by("kappa", F.struct("loglik", -F.col("kappa"))).over(Window.partitionBy())  # a row a kappa
    return scored.withColumns({"gain": gain, "is_best": F.col("kappa") == best}).withColumn("improves", F.col("is_best") & (F.col("gain") > 1e-9))
