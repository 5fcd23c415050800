"""Lanczos on the table of edges against the dense kernel."""

import numpy as np
import pytest

from netweave.functions import kernels
from netweave.operators import eigen, spectral


def edges_of(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j]], "src long, dst long, weight double")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def network(n, seed):
    a = np.triu(np.random.default_rng(seed).random((n, n)), 1)
    return a + a.T


def entries(found, *columns):
    return np.array([[r[c] for c in columns] for r in found.orderBy("node").collect()])


def test_vectors_and_values_of_64_nodes(spark):
    a = network(64, 4)
    found = eigen.lowest(edges_of(spark, a), nodes_of(spark, 64), 3)
    values, vectors = np.linalg.eigh(kernels.laplacian(a))
    assert np.abs(found.values - values[:3]).max() < 1e-8
    want = np.column_stack([kernels.canonical(vectors[:, k]) for k in (1, 2)])
    assert np.abs(entries(eigen.signed(found.vectors, [1, 2]), "v0", "v1") - want).max() < 1e-8


def test_partition_embedding_and_spectrum(spark):
    a = network(12, 4)
    e, n = edges_of(spark, a), nodes_of(spark, 12)
    assert np.abs(entries(spectral.embedding(e, n, dense_nodes=10), "x", "y") - entries(spectral.embedding(e, n), "x", "y")).max() < 1e-8
    assert entries(spectral.laplace_partition(e, n, dense_nodes=10), "side").tolist() == entries(spectral.laplace_partition(e, n), "side").tolist()
    lowest = [[r.eigenvalue for r in spectral.spectrum(e, n, 4, dense_nodes=limit).orderBy("rank").collect()] for limit in (10, 4096)]
    assert lowest[0] == pytest.approx(lowest[1], abs=1e-8) and len(lowest[0]) == 4


def test_normalised_signed_and_parted_networks(spark):
    a = network(40, 1) * np.sign(np.random.default_rng(2).normal(size=(40, 40)) + 1)
    a = np.triu(a, 1) + np.triu(a, 1).T
    found = eigen.lowest(edges_of(spark, a), nodes_of(spark, 40), 3, fiedler=False)
    assert np.abs(found.values - np.linalg.eigvalsh(kernels.laplacian(a, False))[:3]).max() < 1e-8
    b = np.zeros((30, 30))
    b[:10, :10], b[10:22, 10:22], b[22:29, 22:29] = network(10, 5), network(12, 6), network(7, 7)  # three parts and a single node
    found = eigen.lowest(edges_of(spark, b), nodes_of(spark, 30), 5)
    assert np.abs(found.values - np.linalg.eigvalsh(kernels.laplacian(b))[:5]).max() < 1e-8 and np.abs(found.values[:4]).max() < 1e-9
    with pytest.raises(ValueError):
        eigen.lowest(edges_of(spark, np.triu(a)), nodes_of(spark, 40), 2)


def test_small_and_empty_networks(spark):
    none = edges_of(spark, np.zeros((2, 2)))
    assert eigen.lowest(none, nodes_of(spark, 0), 2).vectors.collect() == []
    assert list(eigen.lowest(none, nodes_of(spark, 1), 2).values) == [0.0]
    assert np.abs(eigen.lowest(none, nodes_of(spark, 3), 2).values).max() == 0
    assert np.abs(eigen.lowest(edges_of(spark, network(2, 0)), nodes_of(spark, 2), 2).values[0]) < 1e-12


@pytest.mark.parametrize("stop", ["size", "weight"])
def test_hierarchy_with_large_clusters(spark, stop):
    rng = np.random.default_rng(3)
    part = np.repeat([0, 1, 1, 0], 6)
    a = network(24, 9) * np.where(part[:, None] == part[None, :], 1.0, 0.05 * rng.random()) + 1e-3 * network(24, 10)
    e, n = edges_of(spark, a), nodes_of(spark, 24)
    rows = lambda limit: sorted(map(tuple, spectral.cluster_laplace(e, n, min_size=3, stop=stop, dense_nodes=limit).collect()))
    assert rows(13) == rows(4096)
