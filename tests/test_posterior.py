"""Draw and event operators count every event, whatever its number of steps."""

import numpy as np
import pytest

from fauntrack.operators import graphs as G
from fauntrack.operators import posterior
from fauntrack.plans import catalog

LINE3 = [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.25), (2, 2, 0.5), (2, 3, 0.25), (3, 2, 0.5), (3, 3, 0.5)]


def test_persistence_gain_scores_pairs_of_any_k(spark):
    kernel = spark.createDataFrame(LINE3, "src int, dst int, p double")
    units = spark.createDataFrame([(k, float(k), 44.0) for k in (1, 2, 3)], "s_idx int, lon double, lat double")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 20), (1, 3, 20), (2, 1, 24)], "release int, recapture int, k int")
    got = posterior.persistence_gain(pairs, kernel, units, 3, kappas=(0.0,)).collect()
    p = np.zeros((3, 3))
    for i, j, w in LINE3:
        p[i - 1, j - 1] = w
    power = np.linalg.matrix_power
    # without a turning cost headings do not matter
    want = (np.log(p[0, 1]) + 2 * np.log(power(p, 20)[0, 2]) + np.log(power(p, 24)[1, 0])) / 4
    assert got[0]["loglik"] == pytest.approx(want)


def line12():
    i = np.arange(12)
    src, dst = np.r_[i, i[:-1], i[1:]], np.r_[i, i[1:], i[:-1]]
    return G.make_csr(src, dst, np.where(src == dst, 0.4, 0.1 + 0.02 * dst), 12)


def test_bridges_equal_single_ones():
    g = line12()
    events = [(v, k) for v in (0, 3, 11) for k in (0, 1, 3, 5, 24)]  # some cannot be reached
    for (v, k), c in zip(events, G.bridges(g, 3, events), strict=True):
        assert np.allclose(c, G.bridge(g, 3, v, k), atol=1e-12)


def test_solved_circuits_equal_single_ones():
    g = G.make_csr(np.array([0, 1, 1, 2, 3, 4]), np.array([1, 0, 2, 1, 4, 3]), np.array([1.0, 1, 2, 2, 3, 3]), 6)
    solved = G.potentials(g)
    for u in range(6):
        for v in range(6):
            (r, x), (want, y) = G.solved_circuit(solved, u, v), G.circuit(g, u, v)
            assert r == pytest.approx(want) and np.allclose(x, y)


@pytest.fixture(scope="module")
def few(spark, sf_dir):
    return catalog._few(spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", ["stochastic_paths", "effective_resistance"])
def test_queries_cover_every_release(spark, sf_dir, few, name):
    got = catalog.queries()[name](spark, sf_dir).select("release", "recapture").distinct().count()
    assert got == len(few[["release", "recapture"]].drop_duplicates())


def test_corridor_queries_cover_every_event(spark, sf_dir, few):
    total = lambda name: catalog.queries()[name](spark, sf_dir).toPandas()["prob"].sum()
    assert total("steady_corridor") == pytest.approx(len(few[["release", "recapture"]].drop_duplicates()), rel=1e-4)
    assert total("bayesian_ensemble") == pytest.approx((few["k"] + 1).sum(), rel=1e-4)


def test_draw_and_current_queries_take_all_events(spark, sf_dir, few, monkeypatch):
    seen = {}

    def note(module, name, key):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda events, *a, **k: seen.__setitem__(key, events.count()) or f(events, *a, **k))

    note(catalog.markov, "metropolis", "mh_chain")
    note(catalog.markov, "circuits", "circuit_current")
    note(catalog.posterior, "circuit_draws", "posterior_circuit")
    for name in ("mh_chain", "circuit_current", "posterior_circuit"):
        catalog.queries()[name](spark, sf_dir)
    assert seen == {"mh_chain": catalog.X.pairs(spark, sf_dir).count(), "circuit_current": len(few), "posterior_circuit": len(few)}
