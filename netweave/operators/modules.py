"""Discriminative modules: spectral bisection that goes on where a support vector machine tells the classes better.

A cluster's rate is the mean, over predicted classes, of the share of its subjects that are of that class. The
machine is fitted on all subjects and judged on the same ones, or leaves each subject out in turn. Clusters of few
cells are fitted in a task each, others by sums over partitions; the machine is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators import machines
from netweave.operators.networks import adjacency, fisher_difference
from netweave.operators.spectral import grouped, sides_of, whole
from netweave.sources.scratch import stored

#: Values of a cluster's subjects up to which one task fits its machine (32 MB).
DENSE_CELLS = 4_000_000
RATES = ("precision", "recall")


def predictions(matrix: DataFrame, members: DataFrame, loo: bool = False, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(path, subject, label, predicted) of every cluster of (path, node) and subject of (subject, feature, value, label)."""
    own = matrix.join(members.select("path", F.col("node").alias("feature")), "feature")
    packed = own.groupBy("path", "subject", "label").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("row")).select("path", "subject", "label", F.col("row.value").alias("values"))
    if (own.groupBy("path").count().agg(F.max("count")).first()[0] or 0) > dense_cells:
        return machines.judged(packed, loo)
    kind = matrix.schema["subject"].dataType.simpleString()

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("subject").reset_index(drop=True)
        x, y = np.array(rows["values"].tolist(), float), rows["label"].to_numpy(int)
        return rows.assign(predicted=kernels.left_out(x, y) if loo else kernels.predict(x, y, x))[["path", "subject", "label", "predicted"]]

    return packed.groupBy("path").applyInPandas(judged, f"path string, subject {kind}, label int, predicted int")


def rates(predicted: DataFrame, bsr: str = "precision") -> DataFrame:
    """(path, bsr): over predicted classes (``precision``), or over the subjects' own (``recall``)."""
    if bsr not in RATES:
        raise ValueError(f"bsr {bsr!r} is none of {RATES}")
    each = predicted.groupBy("path", "predicted" if bsr == "precision" else "label").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("share"))
    return each.groupBy("path").agg(F.avg("share").alias("bsr"))


def module_network(matrix: DataFrame, similarity: str) -> DataFrame:
    return fisher_difference(matrix) if similarity == "zobs" else adjacency(matrix, similarity)


def find_modules(matrix: DataFrame, edges: DataFrame, loo: bool = False, fiedler: bool = True, bsr: str = "precision", propagate: bool = False, dense_nodes: int = kernels.DENSE_NODES) -> tuple[DataFrame, DataFrame]:
    """(leaves(path, node), tree(path, size, bsr, mean_edge, is_leaf)); labels are 0 and 1.

    A cluster with a side whose rate is not below its own is cut; the descent goes to the better side, or to both if
    they are equal. It ends where both are worse, at single nodes, and where a cut leaves a side empty. ``fiedler`` holds
    for the first cut alone, and the plain Laplacian for all others, unless ``propagate``.
    """
    members = stored(whole(matrix.select(F.col("feature").alias("node")).distinct()))
    tree = stored(rates(predictions(matrix, members, loo), bsr).join(mean_edges(edges, members), "path", "left"))
    done_tree, leaves, depth = None, None, 0
    while True:
        own_fiedler = fiedler if propagate or not depth else True
        sides = stored(sides_of(edges, members, own_fiedler, dense_nodes).select(F.col("path").alias("parent"), "node", F.concat("path", "side").alias("path")))
        sizes = sides.groupBy("parent", "path").agg(F.count("*").alias("size"))
        large = sides.join(sizes.where("size > 1"), ["parent", "path"]).select("path", "node")
        judged = sizes.join(rates(predictions(matrix, large, loo), bsr), "path", "left").withColumn("bsr", F.coalesce("bsr", F.lit(0.0)))
        per = judged.groupBy("parent").agg(*[F.max(F.when(F.col("path").endswith(s), F.col(c))).alias(f"{c}_{s}") for s in "AB" for c in ("bsr", "size")]).join(tree.select(F.col("path").alias("parent"), F.col("bsr").alias("own")), "parent")
        both = F.col("bsr_A").isNotNull() & F.col("bsr_B").isNotNull()
        worse = (F.col("bsr_A") < F.col("own")) & (F.col("bsr_B") < F.col("own"))
        equal_alone = (F.col("bsr_A") == F.col("bsr_B")) & ((F.col("size_A") < 2) | (F.col("size_B") < 2))
        goes = F.when(~both | worse | equal_alone, "").when(F.col("bsr_A") == F.col("bsr_B"), "AB").when(F.col("bsr_A") > F.col("bsr_B"), "A").otherwise("B")
        choice = stored(per.select("parent", goes.alias("goes")))
        own_tree = tree.join(choice, tree["path"] == choice["parent"]).join(members.groupBy("path").agg(F.count("*").alias("size")), "path").select("path", "size", "bsr", "mean_edge", (F.col("goes") == "").alias("is_leaf"))
        own_leaves = members.join(choice.where("goes = ''"), members["path"] == F.col("parent"), "left_semi").select("path", "node")
        done_tree = own_tree if done_tree is None else done_tree.unionByName(own_tree)
        leaves = own_leaves if leaves is None else leaves.unionByName(own_leaves)
        members = stored(sides.join(choice, "parent").where(F.col("goes").contains(F.substring("path", -1, 1))).select("path", "node"))
        if not members.limit(1).count():
            return leaves, done_tree
        tree = stored(judged.select("path", "bsr").join(members.select("path").distinct(), "path", "left_semi").join(mean_edges(edges, members), "path", "left"))
        depth += 1


def mean_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(path, mean_edge): the mean of the weights, other than 0, inside each cluster, to three places."""
    inside = grouped(edges, members).where("other is not null and weight <> 0")
    return inside.groupBy("path").agg(F.bround(F.avg("weight"), 3).alias("mean_edge"))


def report(tree: DataFrame, matrix: DataFrame) -> DataFrame:
    """(path, before, after, bsr): leaves with the features that there were and that they keep."""
    before = matrix.select("feature").distinct().agg(F.count("*").alias("before"))
    return tree.where("is_leaf").crossJoin(F.broadcast(before)).select("path", "before", F.col("size").alias("after"), F.bround("bsr", 3).alias("bsr"))  # before is one row
