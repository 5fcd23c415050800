"""Stationary ranks and the share of rank that a step keeps, against dense eigenvectors."""

import numpy as np
import pytest

from netweave.operators import centrality

LEAKY = [(0, 1), (0, 2), (1, 2), (1, 0), (2, 3), (3, 4), (5, 0), (5, 4)]  # rank of 3 goes to 4 alone, from which none goes on
ENDS = [(0, 1), (2, 3), (4, 5)]  # all rank leaks in a step


@pytest.mark.parametrize(("cells", "kept"), [(LEAKY, None), (ENDS, 0.15), ([(0, 1), (1, 2), (2, 0)], 1.0)])
def test_what_a_step_keeps(spark, cells, kept):
    a = np.zeros((6, 6))
    for i, j in cells:
        a[i, j] = 1
    live = np.flatnonzero(a.sum(axis=1))
    m = a.T[np.ix_(live, live)]
    total = m.sum(axis=0)
    g = 0.85 * np.divide(m, total, out=np.zeros_like(m), where=total != 0) + 0.15 / len(live)
    values, vectors = np.linalg.eig(g)
    v = vectors[:, np.argmax(values.real)].real
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in cells], "src long, dst long, weight double")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    value, rank = centrality.stationary(edges, nodes)
    got = {r.node: r.v for r in rank.collect()}
    assert np.isclose(value, values.real.max(), atol=1e-8) and (kept is None or np.isclose(value, kept, atol=1e-8))
    assert np.allclose([got[k] for k in live], v / v.sum(), atol=1e-8)


def test_no_rank(spark):
    edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(3).withColumnRenamed("id", "node")
    value, rank = centrality.stationary(edges, nodes)
    assert value == 0 and rank.count() == 0 and [r.score for r in centrality.page_rank(edges, nodes).collect()] == [0, 0, 0]
