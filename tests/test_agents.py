"""Agents with a heading against the exact chain, and posterior kernels against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fauntrack.operators import agents, posterior
from fauntrack.plans import fixtures as X
from fauntrack.plans import inference as Q
from fauntrack.plans.catalog import N, kern

STEPS, KAPPA = 6, 1.5


@pytest.fixture(scope="module")
def mesh(spark, sf_dir):
    return X.units(spark, sf_dir).cache(), X.edges(spark, sf_dir).cache(), kern(spark, sf_dir).cache()


def frequencies(walks, step):
    f = walks.where(F.col("step") == step).groupBy("mesh_unit").agg(F.count("*").alias("n")).toPandas()
    return f.set_index("mesh_unit")["n"]


def agree(walks, exact, n, step):
    """Every unit's share within what the number of agents allows, and no more than chance would have beyond three standard errors."""
    seen = frequencies(walks, step)
    want = exact[exact.step == step].set_index("s_idx")["p"]
    assert set(seen.index) <= set(want.index) and abs(want.sum() - 1) < 1e-9
    p = want.clip(upper=1 - 1e-12)
    z = (seen.reindex(p.index).fillna(0) / n - p) / np.sqrt(p * (1 - p) / n)
    often = p * n >= 5
    assert (z[often].abs() < 4).all() and (z[often].abs() < 3).mean() > 0.98


def test_agents_follow_the_exact_chain(spark, mesh):
    units, _, kernel = mesh
    n = 20_000
    starts = spark.range(n).select(F.col("id").alias("tagid"), F.when(F.col("id") % 2 == 0, 45).otherwise(54).cast("int").alias("start_node"), F.lit(STEPS).alias("n_steps"))
    walks = agents.heading_agents(starts, kernel, units, N, KAPPA, seed=7).cache()
    pool = spark.createDataFrame([(45, 1), (54, 1)], "s_idx int, n int")
    exact = agents.heading_distribution(pool, kernel, units, STEPS, KAPPA).toPandas()
    for step in (1, 3, STEPS):
        agree(walks, exact, n, step)
    flat = agents.heading_distribution(pool, kernel, units, STEPS, 0.0).toPandas()
    a, b = (x[x.step == STEPS].set_index("s_idx")["p"] for x in (exact, flat))
    assert abs(a.sub(b, fill_value=0)).max() > 1e-3  # the heading matters


def test_kernels_are_taken_in_turn(spark, mesh):
    units, edges, kernel = mesh
    still = kernel.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    cycle = kernel.withColumn("step", F.lit(1)).unionByName(still.withColumn("step", F.lit(2)))
    starts = spark.range(4000).select(F.col("id").alias("tagid"), F.lit(45).alias("start_node"), F.lit(4).alias("n_steps"))
    walks = agents.heading_agents(starts, cycle, units, N, KAPPA).cache()
    w = walks.groupBy("tagid").pivot("step", [0, 1, 2, 3, 4]).agg(F.first("mesh_unit")).toPandas()
    assert (w["1"] == w["2"]).all() and (w["3"] == w["4"]).all() and (w["0"] != w["1"]).any() and (w["2"] != w["3"]).any()
    exact = agents.heading_distribution(spark.createDataFrame([(45, 1)], "s_idx int, n int"), cycle, units, 4, KAPPA).toPandas()
    agree(walks, exact, 4000, 4)


def test_dealing_does_not_change_walks(spark, mesh):
    units, _, kernel = mesh
    starts = spark.range(50).select(F.col("id").alias("tagid"), (F.col("id") + 1).cast("int").alias("start_node"), (F.col("id") % 9).cast("int").alias("n_steps"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    one, many = (rows(agents.heading_agents(starts.repartition(k), kernel, units, N, KAPPA)) for k in (1, 7))
    assert one == many and len(one) == sum(k % 9 + 1 for k in range(50))


def test_forward_agents_draw_from_the_pools(spark, sf_dir, mesh):
    units, _, kernel = mesh
    pairs = spark.createDataFrame([(5, 2)] * 3 + [(7, 9)], "release int, k int")
    w = agents.forward_agents(pairs, kernel, units, N, 8000).where("step = 0").groupBy("start_node", "n_steps").agg(F.count("*").alias("n")).toPandas()
    got = {(r.start_node, r.n_steps): r.n / 8000 for r in w.itertuples()}
    want = {(a, b): x * y for a, x in ((5, 0.75), (7, 0.25)) for b, y in ((2, 0.75), (9, 0.25))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.02 for k in want)
    with pytest.raises(ValueError, match="at least one"):
        agents.forward_agents(pairs, kernel, units, N, 0)
    with pytest.raises(ValueError, match="release"):
        agents.forward_agents(pairs.limit(0), kernel, units, N, 5)


# ------------------------------------------------------------------ posterior


def test_names_of_a_chain(spark):
    plain = spark.createDataFrame([(0, 0.3, 0.1, 1.0)], "draw int, mu_velocity double, mu_diffusion double, mu_gamma double")
    wrapped = plain.toDF("draw", "Parameter(mu_velocity)", "Parameter(mu_diffusion)", "Parameter(mu_gamma)")
    assert posterior.parameter_draws(plain).collect() == posterior.parameter_draws(wrapped).collect()
    with pytest.raises(ValueError, match="mu_gamma"):
        posterior.parameter_draws(plain.drop("mu_gamma"))
    both = plain.withColumn("model", F.lit("telemetry_and_survey")).unionByName(plain.withColumn("model", F.lit("telemetry")).withColumn("draw", F.lit(9)))
    assert [r["draw"] for r in posterior.active_chain(both).collect()] == [9]
    assert [r["draw"] for r in posterior.active_chain(both.where("model <> 'telemetry'")).collect()] == [0]
    with pytest.raises(ValueError, match="no fitted model"):
        posterior.active_chain(both.limit(0))


def inverse(m):
    """Gauss-Jordan with pivots, row by row."""
    n = len(m)
    x = np.hstack([m, np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(abs(x[k:, k])))
        x[[k, p]] = x[[p, k]]
        x[k] /= x[k, k]
        rest = np.arange(n) != k
        x[rest] -= x[rest, k : k + 1] * x[k]
    return x[:, n:]


def test_resolvent_agrees_with_an_inverse(spark, sf_dir, mesh):
    units, edges, _ = mesh
    draws = spark.createDataFrame([(0, 0.3, -0.05), (1, 0.1, -0.2), (2, 0.45, -0.01)], "draw long, velocity double, diffusion double")
    u = units.orderBy("s_idx").toPandas()
    w = np.zeros((N, N))
    for r in edges.collect():
        w[r["src"] - 1, r["dst"] - 1] = r["w"]
    h = u["hsi"].to_numpy()
    for form, rise in (("exponential", np.exp), ("linear", lambda x: x)):
        got = np.zeros((N, N))
        for r in posterior.resolvent_kernel(draws, units, edges, N, form, block=33).collect():
            got[r["src"] - 1, r["dst"] - 1] = r["p"]
        delta = h[None, :] - h[:, None]
        up = np.where((w > 0) & (delta > 0), w * rise(delta), 0)
        a = up / np.where(up.sum(1) > 1e-12, up.sum(1), np.inf)[:, None]
        lap = np.diag(w.sum(1)) - w
        want = np.zeros((N, N))
        for _, v, d in draws.collect():
            m = np.maximum(inverse(np.eye(N) - v * a - d * lap), 0)
            want += m / m.sum(1, keepdims=True)
        assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-10)


def test_intervals_are_quantiles_of_draws(spark):
    kernels = spark.createDataFrame([(k, 1, 1, 1 - k / 20) for k in range(11)] + [(k, 1, 2, k / 20) for k in range(11)] + [(k, 2, 2, 1.0) for k in range(11)], "draw long, src int, dst int, p double")
    regions = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "s_idx int, region int")
    got = {(r[0], r[1]): tuple(r)[2:] for r in posterior.connectivity_intervals(posterior.regional_draws(kernels, regions)).collect()}
    x = np.arange(11) / 20
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert np.allclose(got[1, 2], (11, x.mean(), *np.quantile(x, (0.025, 0.975)))) and got[2, 1][1:] == (0, 0, 0)


def test_kernels_of_draws_are_the_static_kernel(spark, sf_dir, mesh):
    units, edges, _ = mesh
    draws = posterior.parameter_draws(Q.chain(spark, sf_dir)).where("draw <= 3").cache()
    got = posterior.posterior_kernels(draws, units, edges, N).toPandas()
    from fauntrack.operators import kernel

    for r in draws.collect():
        want = kernel.static(units, edges, r["gamma"], r["rho"], r["alpha"]).toPandas()
        both = got[got.draw == r["draw"]].merge(want, on=["src", "dst"], how="outer")
        assert both.notna().all().all() and np.allclose(both.p_x, both.p_y, atol=1e-12)
    assert isinstance(got, pd.DataFrame)
