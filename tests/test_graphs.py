"""Graph kernels against small graphs with known answers."""

import numpy as np
import pytest

from fauntrack.operators import graphs as G


def csr(edges, n):
    a = np.array(edges, float)
    return G.make_csr(a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2], n)


def path3():
    return csr([(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)], 3)


def ring4():
    return csr([(i, j % 4, 0.5) for i in range(4) for j in (i + 1, i + 3)], 4)


def test_resistance_of_a_path():
    r = G.resistance_matrix(path3())
    assert r[0, 1] == pytest.approx(1) and r[0, 2] == pytest.approx(2)
    assert np.allclose(r, r.T)
    ohm, volt = G.circuit(path3(), 0, 2)
    assert ohm == pytest.approx(2)
    assert G.node_current(path3(), volt, 0, 2) == pytest.approx([1, 1, 1])


def test_circuit_across_components():
    g = csr([(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1)], 4)
    assert G.circuit(g, 0, 3)[0] == np.inf
    assert G.resistance_matrix(g)[0, 3] == 1e6


def test_exact_k_on_a_ring():
    g = ring4()
    assert G.exact_k(g, 0, 2, 1) == [] and len(G.exact_k(g, 0, 2, 2)) == 3
    assert G.exact_k(g, 0, 1, 2) == [] and G.exact_k(g, 0, 0, 1) == []
    assert G.exact_k(g, 0, 0, 0) == [0]
    assert G.exact_k(csr([(0, 1, 1e-15), (0, 0, 0.0), (1, 0, 0.5), (1, 1, 0.5)], 2), 0, 1, 1) == []


def test_sweep_equals_powers():
    g = ring4()
    p = g.dense()
    for k, x in G.sweep(g, 1, {0, 1, 3, 5}).items():
        assert np.allclose(x, np.linalg.matrix_power(p, k)[1])


def test_bridge_columns_sum_to_one_and_ends_are_pinned():
    c = G.bridge(ring4(), 0, 2, 4)
    assert np.allclose(c.sum(1), 1) and c[0, 0] == 1 and c[4, 2] == 1
    odd = G.bridge(ring4(), 0, 2, 3)  # not reachable in three steps: uniform between the ends
    assert np.allclose(odd[1], 0.25)


def test_dijkstra_ties_and_no_path():
    g = csr([(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)], 5)
    cost, before = G.dijkstra(g, 0)
    assert cost[3] == 2 and G.trace(before, 0, 3) == [0, 1, 3]
    assert G.trace(before, 0, 4) == []


def test_smoothing_agrees_with_enumeration():
    rng = np.random.default_rng(1)
    p = rng.random((3, 3))
    p /= p.sum(1, keepdims=True)
    like = rng.random((4, 3))
    best, total, marg = -1, 0, np.zeros((4, 3))
    for s in np.ndindex(3, 3, 3, 3):
        w = like[0, s[0]] / 3
        for t in range(1, 4):
            w *= p[s[t - 1], s[t]] * like[t, s[t]]
        if w > best:
            best, path = w, s
        total += w
        for t in range(4):
            marg[t, s[t]] += w
    g = G.make_csr(*(a.ravel() for a in np.indices((3, 3))), p.ravel(), 3)
    assert tuple(G.viterbi_hmm([g], np.log(like))) == path
    assert np.allclose(G.forward_backward([g], like), marg / total)


def test_floored():
    assert np.allclose(G.floored(np.zeros(4)), 0.25)
    assert G.floored(np.array([1.0, 0.0])).min() > 0
