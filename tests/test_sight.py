"""Shortcuts and start nodes against plain searches; reports; the log posterior against scores taken one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fauntrack.operators import markov, mesh, posterior, sight
from fauntrack.plans import fixtures as X
from fauntrack.plans import inference as Q
from fauntrack.plans.catalog import N
from fauntrack.sources import reports


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def blocked(p, q, rings):
    mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    for ring in rings:
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if turn(p, q, a) * turn(p, q, b) < 0 and turn(a, b, p) * turn(a, b, q) < 0:
                return True
            if (a[1] > mid[1]) != (b[1] > mid[1]) and mid[0] < a[0] + (mid[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
        if odd:
            return True
    return False


def plain(points, rings):
    out, at = [0], 0
    while at < len(points) - 1:
        at = next((k for k in range(len(points) - 1, at + 1, -1) if not blocked(points[at], points[k], rings)), at + 1)
        out.append(at)
    return out


def test_shortcuts_agree_with_a_plain_search():
    rng = np.random.default_rng(2)
    shorter = 0
    for _ in range(60):
        rings = [[(x + r * math.cos(t), y + r * math.sin(t)) for t in np.sort(rng.uniform(0, 6.28, 7))] for x, y, r in zip(*rng.uniform((0, 0, 0.3), (10, 10, 2), (4, 3)).T, strict=True)]
        points = [tuple(p) for p in np.cumsum(rng.uniform(-1, 1.4, (15, 2)), axis=0)]
        rows = [(k, *a, *b) for k, ring in enumerate(rings) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        x, y = np.array(points).T
        got = sight.shortened(x, y, sight.Sides(*map(np.array, zip(*rows, strict=True))))
        assert got == plain(points, rings)
        shorter += len(got) < len(points)
    assert shorter > 40


def test_smooth_paths_stay_off_the_rings(spark, sf_dir):
    u = X.units(spark, sf_dir).cache()
    at = {r["s_idx"]: (r["x"], r["y"]) for r in u.collect()}
    vertices = Q.octagons(spark, sf_dir).orderBy("region", "seq").collect()
    rings = [[(r["x"], r["y"]) for r in vertices if r["region"] == k] for k in sorted({r["region"] for r in vertices})]
    df = spark.createDataFrame([(int(r["region"]), int(r["seq"]), float(r["x"]), float(r["y"])) for r in vertices], "region int, seq int, x double, y double")
    paths = markov.paths(X.pairs(spark, sf_dir), markov.least_cost(u, X.edges(spark, sf_dir)), N).withColumn("length", F.lit("clash"))
    got = sight.smooth_paths(paths, u, df).collect()
    assert len(got) > 100 and "cost" in got[0].asDict()
    for r in got:
        points = [at[k] for k in r["nodes"]]
        keep = plain(points, rings) if len(points) > 2 else list(range(len(points)))
        assert r["smooth"] == [r["nodes"][k] for k in keep]
        assert r["smooth_length"] <= r["length"] + 1e-9
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5]), (4, [5, 999, 6]), (5, [1, 2])], "id int, nodes array<int>")
    rows = {r["id"]: (r["smooth"], r["length"]) for r in sight.smooth_paths(odd, u, df).collect()}
    assert rows[1] == (None, None) and rows[2] == ([], None) and rows[3] == ([5], 0.0) and rows[4] == ([5, 999, 6], None) and rows[5][0] == [1, 2]


def test_mesh_in_rings_needs_vertices(spark):
    empty = spark.createDataFrame([], "region int, seq int, x double, y double")
    with pytest.raises(ValueError, match="no vertices"):
        mesh.hex_mesh_in(spark, empty, 5.0)
    far = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 1.1, 1.0), (1, 2, 1.0, 1.1), (1, 3, float("nan"), 1.0)], "region int, seq int, x double, y double")
    units, edges = mesh.hex_mesh_in(spark, far, 50.0)
    assert units.count() == 0 and edges.count() == 0


def test_log_posterior_is_that_of_single_kernels(spark, sf_dir):
    u, e, pairs = X.units(spark, sf_dir).cache(), X.edges(spark, sf_dir).cache(), X.pairs(spark, sf_dir).cache()
    chain = spark.createDataFrame([(0, 0.3, 0.1, 1.0), (1, 0.5, 0.4, -0.5), (2, 0.99, 0.1, 0.0)], "draw int, mu_velocity double, mu_diffusion double, mu_gamma double")
    draws = posterior.parameter_draws(chain)
    got = {r["draw"]: r for r in posterior.log_posterior(draws, pairs, u, e, N).collect()}
    from fauntrack.operators import kernel

    for r in draws.where("draw < 2").collect():
        p = markov.kstep(pairs, kernel.static(u, e, r["gamma"], r["rho"], r["alpha"]), N)
        want = p.agg(F.sum(F.col("n") * F.log(F.greatest("p", F.lit(1e-12))))).first()[0]
        assert abs(got[r["draw"]]["loglik"] - want) < 1e-6 * abs(want) and got[r["draw"]]["n_pairs"] == pairs.count()
    assert got[2]["prior"] == float("-inf") and abs(got[0]["prior"] - (got[0]["logp"] - got[0]["loglik"])) < 1e-9


def test_reports(spark, sf_dir, tmp_path):
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 9, 1)], "tagid int, release int, recapture int")
    regions = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (9, 0)], "s_idx int, region int")
    connectivity = spark.createDataFrame([(1, 1, 0.25), (1, 2, 0.75), (2, 2, 1.0)], "from_region int, to_region int, p double")
    labels = spark.createDataFrame([(1, "north")], "region int, label string")
    d = reports.connectivity_summary(connectivity, pairs, regions, labels)
    got = sorted(map(tuple, reports.report(d, "stock_connectivity_summary").collect()))
    assert got == [("2", "2", 1.0, 0, 0.0), ("2", "north", 0.0, 1, 0.0), ("north", "2", 0.75, 2, 0.5), ("north", "north", 0.25, 0, 0.0)]
    path = reports.export(d, "stock_connectivity_summary", str(tmp_path))
    assert spark.read.csv(path, header=True).columns == list(reports.REPORTS["stock_connectivity_summary"]) and spark.read.csv(path, header=True).count() == 4
    with pytest.raises(ValueError, match="lower_ci"):
        reports.report(d.withColumn("mean_conn", F.lit(0.0)), "stock_connectivity_credible_intervals")
    intervals = spark.createDataFrame([(1, 2, 3.0, 0.5, 2.0, 4.0, 5, 7)], "release int, recapture int, mean double, sd double, lower double, upper double, n_waypoints int, modal_waypoint int")
    assert sorted(map(tuple, reports.report(reports.path_summary(intervals, pairs), "path_credible_intervals").collect())) == [(1, 1, 2, 3.0, 2.0, 4.0, 0.5, 5, 7), (2, 1, 2, 3.0, 2.0, 4.0, 0.5, 5, 7)]


def test_coordinate_spaces(spark):
    from fauntrack.functions import geo

    rows = [(-63.0, 44.0, -62.0, 44.0), (10.0, 20.0, 12.0, 20.0), (120.0, -30.0, 121.0, -30.0), (500.0, 4.0, 501.0, 4.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.node_distance_km("a", "b", "c", "d")).collect()]
    assert 70 < got[0] < 90 and got[1] == 2 and 90 < got[2] < 100 and got[3] == 1
    with pytest.raises(ValueError, match="space"):
        geo.node_distance_km("a", "b", "c", "d", "polar")
