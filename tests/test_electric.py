"""Sparse circuits against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fauntrack.operators import electric, markov
from fauntrack.operators import graphs as G
from fauntrack.plans import fixtures as X
from fauntrack.plans.catalog import N


def lattice(rows, cols, seed=1, gone=0.1):
    rng = np.random.default_rng(seed)
    at = lambda r, c: r * cols + c
    e = [(at(r, c), at(r + a, c + b)) for r in range(rows) for c in range(cols) for a, b in ((0, 1), (1, 0), (1, 1)) if r + a < rows and c + b < cols]
    e = [x for x in e if rng.random() > gone]
    w = rng.uniform(0.2, 5, len(e))
    a, b = map(np.array, zip(*e, strict=True))
    return G.make_csr(np.r_[a, b], np.r_[b, a], np.r_[w, w], rows * cols)


def test_agrees_with_dense_circuits():
    g = lattice(6, 7, gone=0.45)  # falls into several components
    net = electric.Network(g)
    assert len(set(net.component)) > 1
    solved = G.potentials(g)
    u, v = (x.ravel() for x in np.meshgrid(np.arange(g.n), np.arange(0, g.n, 5), indexing="ij"))
    volt, ohm = net.voltages(u, v)
    j = net.currents(volt, u, v)
    for k in range(len(u)):
        r, x = G.solved_circuit(solved, u[k], v[k])
        assert (np.isinf(r) and np.isinf(ohm[k])) or abs(r - ohm[k]) < 1e-9
        if np.isfinite(r) and u[k] != v[k]:
            assert np.allclose(j[:, k], G.node_current(g, x, u[k], v[k]), atol=1e-8)


def test_large_meshes_stay_sparse():
    """7,500 units: Kirchhoff's law holds at every unit, and nothing of n times n is made."""
    import tracemalloc

    g = lattice(75, 100, gone=0.02)
    tracemalloc.start()
    net = electric.Network(g)
    u, v = np.array([0, 40, 7000]), np.array([7499, 3300, 12])
    volt, ohm = net.voltages(u, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    flow = net.laplacian(volt)
    for k in range(3):
        want = np.zeros(g.n)
        want[u[k]], want[v[k]] = 1, -1
        assert np.allclose(flow[:, k], want, atol=1e-8)
    assert (ohm > 0).all() and peak < 100e6


@pytest.mark.parametrize("events", [0, 1])
def test_sums_over_events(spark, sf_dir, events):
    c = markov.conductance(X.units(spark, sf_dir), X.edges(spark, sf_dir)).cache()
    pairs = X.pairs(spark, sf_dir).cache()
    sources = pairs.groupBy("release", "recapture").agg(F.count("*").alias("n")) if events else pairs
    got = electric.current_use(sources, c, N).toPandas().set_index("s_idx").sort_index()
    each = markov.circuits(pairs, c, N).where("resistance > 0").join(pairs.groupBy("release", "recapture").agg(F.count("*").alias("n")), ["release", "recapture"])
    finite = F.col("resistance") < float("inf")
    want = each.groupBy("s_idx").agg(F.sum(F.when(finite, F.col("current"))).alias("current"), (F.sum(F.when(finite, F.col("current") * F.col("n"))) / pairs.count()).alias("density")).toPandas().set_index("s_idx").sort_index()
    assert np.allclose(got, want, atol=1e-6)
    ohm = electric.resistances(sources, c, N).join(markov.circuits(pairs, c, N).select("release", "recapture", F.col("resistance").alias("r")).distinct(), ["release", "recapture"])
    bad = ohm.where(~((F.col("r") == F.col("resistance")) | (F.abs(F.col("r") - F.col("resistance")) < 1e-8)))
    assert ohm.count() == pairs.select("release", "recapture").distinct().count() and bad.count() == 0
