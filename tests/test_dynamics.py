"""Walks and corridors over changing kernels, directed circuits and bridge samples against enumeration of all walks."""

import itertools

import numpy as np
import pytest

from fauntrack.operators import dynamics, graphs
from fauntrack.operators import markov

N = 4


def kernels():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(3):
        p = rng.random((N, N)) * (rng.random((N, N)) < 0.7)
        p[np.arange(N), (np.arange(N) + 1) % N] += 0.2
        p[np.arange(N), np.arange(N)] += 0.1
        out.append(p / p.sum(1, keepdims=True))
    return out


def steps_table(spark, ps):
    return spark.createDataFrame([(t + 1, i + 1, j + 1, float(p[i, j])) for t, p in enumerate(ps) for i in range(N) for j in range(N) if p[i, j] > 0], "step int, src int, dst int, p double")


def events(spark):
    return spark.createDataFrame([(u, v, k) for u in range(1, N + 1) for v in range(1, N + 1) for k in (1, 2, 5)] * 2, "release int, recapture int, k int")


def of(ps, t):
    return ps[min(t, len(ps)) - 1]


def walks(u, v, k):
    for mid in itertools.product(range(N), repeat=k - 1):
        yield (u - 1, *mid, v - 1)


def chance(ps, w):
    return np.prod([of(ps, t)[w[t - 1], w[t]] for t in range(1, len(w))])


def test_dynamic_walks(spark):
    ps = kernels()
    got = dynamics.dynamic_walks(events(spark), steps_table(spark, ps), N).collect()
    assert len(got) == 3 * N * N
    for r in got:
        u, v, k = r["release"], r["recapture"], r["k"]
        if u == v:
            assert r["nodes"] == [u] * (k + 1)
            assert r["logp"] == pytest.approx(np.log(chance(ps, [u - 1] * (k + 1))))
            continue
        best = max(chance(ps, w) for w in walks(u, v, k))
        assert (r["logp"] is None and r["nodes"] == []) if best == 0 else r["logp"] == pytest.approx(np.log(best))
        if best:
            assert chance(ps, [i - 1 for i in r["nodes"]]) == pytest.approx(best)


def test_dynamic_corridors(spark):
    ps = kernels()
    got = {}
    for r in dynamics.dynamic_corridors(events(spark), steps_table(spark, ps), N).collect():
        got.setdefault((r["release"], r["recapture"], r["k"]), np.zeros(N))[r["s_idx"] - 1] = r["intensity"]
    for (u, v, k), c in got.items():
        weight, seen = 0.0, np.zeros(N)
        for w in walks(u, v, k):
            p = chance(ps, w)
            weight += p
            np.add.at(seen, list(w), p)
        if weight:
            assert c == pytest.approx(seen / weight / (k + 1))
    land = spark.createDataFrame([(2,)], "s_idx int")
    assert dynamics.dynamic_corridors(events(spark), steps_table(spark, ps), N, land).where("s_idx = 2").count() == 0


def test_dynamic_paths_stay_or_move(spark):
    units = spark.createDataFrame([(t, i, float(i), 0.0, 1.0 if t == 1 else 0.0, False) for t in (1, 2) for i in (1, 2, 3)], "step int, s_idx int, x double, y double, hsi double, is_land boolean")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src int, dst int")
    e = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 3, 1), (1, 1, 1)], "release int, recapture int, k int")
    got = {(r["recapture"], r["k"]): r for r in dynamics.dynamic_paths(e, dynamics.step_costs(units, edges), 3).collect()}
    assert got[2, 1]["cost"] == pytest.approx(1.0)  # friction 1 in the first step
    assert got[2, 2]["cost"] == pytest.approx(1.0 + 0.5 * 4) and got[2, 2]["nodes"] == [1, 2, 2]  # friction 4 in the second
    assert got[3, 1]["cost"] is None and got[3, 1]["nodes"] == []
    assert got[1, 1]["cost"] == pytest.approx(0.5) and got[1, 1]["nodes"] == [1, 1]


def test_directed_circuit(spark):
    p = np.array([[0.2, 0.8, 0, 0], [0.3, 0.2, 0.5, 0], [0, 0.1, 0.5, 0.4], [0, 0, 0, 1.0]])
    kernel = steps_table(spark, [p]).drop("step")
    e = spark.createDataFrame([(1, 3, 2), (1, 3, 4), (2, 2, 1), (4, 1, 1)], "release int, recapture int, k int")
    found = dynamics.directed_circuits(e, kernel, N)
    got = {(r["release"], r["recapture"]): r for r in found.collect()}
    volt = -np.log(np.maximum(np.linalg.solve(np.eye(N) - 0.99 * p, np.eye(N)[2]), 1e-15))
    volt -= volt.min()
    assert got[1, 3]["resistance"] == pytest.approx(volt[0] - volt[2])
    assert got[1, 3]["voltages"] == pytest.approx(volt)
    assert got[2, 2]["resistance"] == 0 and got[4, 1]["resistance"] == float("inf")
    drop = {(i + 1, j + 1): p[i, j] * (volt[i] - volt[j]) for i in range(N) for j in range(N) if i != j and p[i, j] > 0 and volt[i] > volt[j]}
    assert {(r["src"], r["dst"]): pytest.approx(r["current"]) for r in dynamics.directed_currents(found, kernel).collect()} == drop


def test_bridge_samples_follow_the_bridge(spark):
    p = kernels()[0]
    kernel = steps_table(spark, [p]).drop("step")
    e = spark.createDataFrame([(1, 3, 4), (2, 2, 3)], "release int, recapture int, k int")
    got = dynamics.bridge_samples(e, kernel, N, draws=600).collect()
    assert len(got) == 1200 and all(r["nodes"] == [2] * 4 for r in got if r["release"] == 2)
    paths = np.array([r["nodes"] for r in got if r["release"] == 1]) - 1
    assert (paths[:, 0] == 0).all() and (paths[:, -1] == 2).all()
    assert all((p[paths[:, t], paths[:, t + 1]] > 0).all() for t in range(4))
    g = graphs.make_csr(*(a.ravel() for a in np.indices((N, N))), p.ravel(), N)
    for t, row in enumerate(graphs.bridge(g, 0, 2, 4)):
        assert np.abs(np.bincount(paths[:, t], minlength=N) / 600 - row).max() < 0.09
    again = dynamics.bridge_samples(e.repartition(3), kernel, N, draws=600).collect()
    assert {(r["release"], r["draw"]): r["nodes"] for r in got} == {(r["release"], r["draw"]): r["nodes"] for r in again}


def test_tracks_join_at_recaptures(spark):
    pairs = spark.createDataFrame([(7, 1, 1, 2, 2), (7, 2, 2, 4, 1)], "tagid int, tag int, release int, recapture int, k int")
    samples = spark.createDataFrame([(1, 2, 2, 0, [1, 3, 2]), (2, 4, 1, 0, [])], "release int, recapture int, k int, draw int, nodes array<int>")
    got = dynamics.reconstructed_tracks(pairs, samples).orderBy("step").collect()
    assert [(r["step"], r["s_idx"]) for r in got] == [(0, 1), (1, 3), (2, 2), (3, 4)]


def test_exact_walks_and_corridor_totals_of_a_constant_kernel(spark):
    p = kernels()[1]
    kernel = steps_table(spark, [p]).drop("step")
    for r in markov.exact_walks(events(spark), kernel, N).collect():
        best = max(chance([p], w) for w in walks(r["release"], r["recapture"], r["k"]))
        assert (r["nodes"] == []) if best == 0 else r["logp"] == pytest.approx(np.log(best))
    cells = markov.corridors(events(spark), kernel, N).groupBy("s_idx").sum("prob").collect()
    totals = {r["s_idx"]: r["prob"] for r in markov.corridor_use(events(spark), kernel, N).collect()}
    assert {r[0]: pytest.approx(r[1]) for r in cells} == totals


def test_smoothing_fills_the_gaps(spark):
    import datetime as dt

    units = spark.createDataFrame([(i, -63.0 + 0.5 * i, 44.0, i == 4) for i in range(1, 5)], "s_idx int, lon double, lat double, is_land boolean")
    moves = [(i, j, 1.0) for i in range(1, 5) for j in range(1, 5) if abs(i - j) <= 1]
    kernel = spark.createDataFrame([(i, j, w / sum(1 for m in moves if m[0] == i)) for i, j, w in moves], "src int, dst int, p double")
    day = lambda n, h=0: dt.datetime(2024, 1, 1 + n, h)
    det = spark.createDataFrame([(7, 0, day(0), 1), (7, 1, day(2), 2), (7, 2, day(2, 1), 3), (8, 0, day(0), 2)], "tagid long, tag int, ts timestamp, s_idx int")
    got = markov.smooth_states(det, kernel, units, 4).orderBy("tagid", "step").collect()
    assert [(r["tagid"], r["step"], r["s_idx"], r["observed"]) for r in got] == [(7, 0, 1, True), (7, 1, 2, False), (7, 2, 3, True), (8, 0, 2, True)]
    assert all(0 < r["prob"] <= 1 for r in got)
