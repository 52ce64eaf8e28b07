"""Recall of the nearest-neighbour search on inputs that codes do not tell apart, and its cases."""

import numpy as np
import pytest

from fauntrack.llm import nearest


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        out[int(ids[q])] = np.lexsort((ids, -score))[:k], score
    return out


def recall(spark, x, every=1, k=20):
    """Share of found scores that are among the k true ones; ids are shuffled so that rows of a group are not neighbours."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(t) for t in v], "extra", 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score string, row int").repartition(4)
    got = nearest.search(df, query_every=every).toPandas()
    queries = np.flatnonzero(ids % every == 0)
    want = brute(x, ids, queries, k)
    by_id = {int(i): n for n, i in enumerate(ids)}
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == min(k, len(x) - 1)).all()
    hit = 0
    for q, part in got.groupby("query_id"):
        best, score = want[q]
        rows = [by_id[i] for i in part.vec_id]
        assert by_id[q] not in rows and np.allclose(part.score, x[rows] @ x[by_id[q]], rtol=1e-12)
        hit += (score[rows] >= score[best[-1]] - 1e-12).sum()
    return hit / len(got)


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(1)


def test_close_clusters(spark, rng):
    centres = rng.standard_normal((10, 64))
    x = centres[rng.integers(0, 10, 8192)] + 0.05 * rng.standard_normal((8192, 64))
    assert recall(spark, x / np.linalg.norm(x, axis=1)[:, None], every=8) > 0.99


def test_clusters_of_unlike_norms(spark, rng):
    centres = rng.standard_normal((20, 64)) * rng.uniform(0.3, 3, 20)[:, None]
    assert recall(spark, centres[rng.integers(0, 20, 8192)] + 0.2 * rng.standard_normal((8192, 64)), every=8) > 0.99


def test_a_group_of_near_copies_over_several_blocks(spark, rng):
    x = rng.standard_normal((17_000, 32))
    x[:5000] = 2 * x[0] + 1e-3 * rng.standard_normal((5000, 32))
    assert recall(spark, x, every=50) > 0.99


def test_equal_vectors_go_by_id(spark):
    rows = [(k, [1.0, 2.0]) for k in range(60)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(got.query_id.unique()) == [0, 20, 40]
    for q, part in got.groupby("query_id"):
        assert list(part.sort_values("rank").vec_id) == [k for k in range(21) if k != q][:20]


def test_residuals_are_what_codes_leave_out(rng):
    x = rng.standard_normal((300, 9))
    books = nearest.fit(x)
    codes = nearest.encode(x, books, nearest.parallel_weight(10))
    decoded = np.concatenate([books[k][codes[:, k]] for k in range(len(books))], axis=1)[:, :9]
    pad = np.concatenate([books[k][codes[:, k]] for k in range(len(books))], axis=1)[:, 9:]
    want = np.sqrt(((x - decoded) ** 2).sum(1) + (pad**2).sum(1))
    assert np.allclose(nearest.residual_norms(x, codes, books), want, rtol=1e-5)
