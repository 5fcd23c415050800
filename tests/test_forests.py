"""Cuts, leaf order and parents by joins in rounds, against the dense kernels."""

import numpy as np
import pytest

from netweave.functions import kernels
from netweave.operators import hierarchy, matrix


def table(spark, z):
    return spark.createDataFrame([(k, int(a), int(b), float(h), int(s)) for k, (a, b, h, s) in enumerate(z)], hierarchy.LINKAGE)


def chain(n):
    return np.array([(0 if k == 0 else n + k - 1, k + 1, k + 1.0, k + 2) for k in range(n - 1)], float).reshape(-1, 4)


@pytest.mark.parametrize("z", [kernels.linkage(np.abs(np.subtract.outer(x, x))) for x in [np.random.default_rng(4).random(40)]] + [chain(50), chain(2), chain(1)], ids=["tree", "chain", "two", "one"])
def test_cuts_and_order_equal_the_kernels(spark, z):
    df, n = table(spark, z), len(z) + 1
    middle = float(np.median(z[:, 2])) if len(z) else 1.0
    for how in ({"n_clusters": 4}, {"height": middle}, {"height": -1.0}, {"n_clusters": 1}):
        found = [r.cluster for r in hierarchy.cut_tree(df, **how).orderBy("item").collect()]
        assert found == list(kernels.cut(z, **how)), how
    assert [r.item for r in hierarchy.dendrogram_order(df).orderBy("place").collect()] == (kernels.leaf_order(z) if len(z) else [0])
    assert len(found) == n


def test_parents_of_nested_and_of_crossing_clusters(spark):
    nested = [("", k) for k in range(5)] + [("A", k) for k in range(3)] + [("AA", 0), ("AB", 1), ("AB", 2), ("B", 3), ("B", 4), ("other", 9)]
    parents = {(r["rank"], r.parent, r.size) for r in hierarchy.subset_parents(spark.createDataFrame(nested, "path string, node long")).collect()}
    assert parents == {(0, 4, 1), (2, 4, 2), (3, 5, 2), (4, 5, 3)}
    with pytest.raises(Exception, match="not nested"):
        hierarchy.subset_parents(spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("y", 4)], "path string, node long")).collect()


def test_numbers_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "pmod(id * 7919, 1000) AS key").repartition(7)
    found = matrix.numbered(rows, "key").collect()
    assert len(found) == 1000 and all(r.place == r.key for r in found)
