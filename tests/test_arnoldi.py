"""Leading eigenvectors of directed and signed networks, and pairs drawn without forming all."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators import arnoldi, centrality, networks, spectral


def edges_of(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True) for i, j in [(int(i), int(j))]], "src long, dst long, weight double")


@pytest.mark.parametrize(("signed", "basis"), [(False, 24), (True, 24), (False, 4)])
def test_leading_vector_of_directed_networks(spark, signed, basis):
    rng = np.random.default_rng(3)
    a = (rng.random((40, 40)) < 0.3) * rng.random((40, 40))
    if signed:
        a = a - 0.2 * (rng.random((40, 40)) < 0.3) + np.diag([3.0] + [0.0] * 39)
    got = {r.node: r.score for r in arnoldi.leading_vector(edges_of(spark, a), spark.range(40).withColumnRenamed("id", "node"), basis=basis).collect()}
    assert np.allclose([got[k] for k in range(40)], kernels.leading_vector(a), atol=1e-7)


def test_networks_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert arnoldi.leading_vector(none, spark.range(0).withColumnRenamed("id", "node")).count() == 0
    lone = arnoldi.leading_vector(none, spark.range(3).withColumnRenamed("id", "node")).collect()
    assert np.isclose(sum(r.score**2 for r in lone), 1)


def test_layered_scores_both_ways(spark):
    layers = spark.createDataFrame([(t, s, f, float((t + 2 * s + 3 * f * s) % 5)) for t in range(3) for s in range(6) for f in range(4)], "t int, subject int, feature int, value double")
    nodes = layers.select("t", F.col("feature").alias("node")).distinct()
    supra = spectral.stored(networks.supra_adjacency(layers, "correlation"))
    dense, by_edges = ([r.score for r in centrality.supra_scores(supra, nodes, "large_evec", dense_nodes=n).orderBy("node").collect()] for n in (4096, 1))
    assert np.allclose(dense, by_edges, atol=1e-7)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9])
def test_every_pair_once(spark, n):
    pairs = [tuple(sorted(r)) for r in networks.pair_numbers(spark, n, 10**6).collect()]
    assert sorted(pairs) == list(itertools.combinations(range(n), 2))


def test_pairs_of_many_nodes_are_spread(spark):
    n = 1_000_000
    drawn = networks.pair_numbers(spark, n, 20_000, seed=5)
    ends = np.array([sorted(r) for r in drawn.collect()])
    assert len({tuple(e) for e in ends}) == 20_000 and (ends[:, 0] < ends[:, 1]).all() and ends.max() < n
    assert abs(ends[:, 0].mean() / n - 1 / 3) < 0.01 and abs(ends[:, 1].mean() / n - 2 / 3) < 0.01
    assert abs(np.corrcoef(ends.T)[0, 1] - 0.5) < 0.03  # as of the lesser and the greater of two random numbers
    graph = networks.hashed_graph(spark.createDataFrame([(f"n{k}",) for k in range(5)], "node string"), 4)
    assert graph.count() == 8 and graph.where("src >= dst").count() == 4
