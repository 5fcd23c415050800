"""Agglomeration in rounds against the dense kernel."""

import numpy as np
import pytest

from netweave.functions import kernels
from netweave.operators import hierarchy


def z_of(df):
    return np.array([[r.left, r.right, r.height, r.size] for r in df.orderBy("step").collect()], float).reshape(-1, 4)


def edges_of(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j]], "src long, dst long, weight double")


def network(n, seed, share=1.0):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < share), 1)
    return a + a.T


@pytest.mark.parametrize("method, share", [("average", 1.0), ("average", 0.2), ("complete", 1.0), ("single", 0.3)])
def test_the_same_merges_without_ties(spark, method, share):
    a = network(26, 3, share)
    nodes = spark.range(26).withColumnRenamed("id", "node")
    found, want = z_of(hierarchy.linkage(edges_of(spark, a), nodes, method, dense_nodes=5)), kernels.linkage(np.where(a != 0, 1 - a, 1.0), method)
    assert np.abs(found[:, 2] - want[:, 2]).max() < 1e-9
    apart = int((want[:, 2] < 1).sum())
    assert np.array_equal(found[:apart, [0, 1, 3]], want[:apart, [0, 1, 3]])


def test_ties_parts_and_odd_networks(spark):
    a = np.zeros((9, 9))
    a[:3, :3] = a[3:6, 3:6] = 0.5
    np.fill_diagonal(a, 0)
    nodes = spark.range(9).withColumnRenamed("id", "node")
    z = z_of(hierarchy.linkage(edges_of(spark, a), nodes, dense_nodes=1))
    assert list(z[:, 2]) == [0.5] * 4 + [1.0] * 4 and z[-1, 3] == 9
    assert sorted(map(int, z[:, :2].ravel())) == list(range(16))  # every cluster but the last merges once, after it is made
    assert all(max(r[0], r[1]) < 9 + k for k, r in enumerate(z))
    assert z_of(hierarchy.linkage(edges_of(spark, np.zeros((2, 2))), nodes.where("node < 2"), dense_nodes=1)).tolist() == [[0, 1, 1, 2]]
    for bad in (lambda: hierarchy.linkage(edges_of(spark, -a), nodes, dense_nodes=1), lambda: hierarchy.linkage(edges_of(spark, a), nodes, "ward", dense_nodes=1)):
        with pytest.raises(ValueError):
            bad()
