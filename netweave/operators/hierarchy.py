"""Hierarchies: linkage of networks, cuts of linkages, nested clusters as linkages, module representatives.

Linkages are (step, left, right, height, size); items are the nodes' places from 0 in the order of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators.agglomeration import linkage_in_rounds
from netweave.operators.matrix import column_products, followed, numbered
from netweave.operators.networks import correlation, topological_overlap
from netweave.operators.spectral import dense, grouped, whole
from netweave.sources.scratch import stored

LINKAGE = "step int, left long, right long, height double, size long"


def linkage(edges: DataFrame, nodes: DataFrame, method: str = "average", absent: float = 1.0, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """Agglomeration by similarities: a pair's distance is 1 - weight, ``absent`` where there is no edge.

    Networks of more than ``dense_nodes`` nodes are merged in rounds (``agglomeration``).
    """
    if nodes.count() > dense_nodes:
        return linkage_in_rounds(edges, nodes, method, absent)

    def agglomerated(group: pd.DataFrame) -> pd.DataFrame:
        _, a = dense(group)
        z = kernels.linkage(np.where(a != 0, 1 - a, absent), method)
        return pd.DataFrame({"step": np.arange(len(z)), "left": z[:, 0].astype(int), "right": z[:, 1].astype(int), "height": z[:, 2], "size": z[:, 3].astype(int)})

    return grouped(edges, whole(nodes)).groupBy("path").applyInPandas(agglomerated, LINKAGE)


def overlap_linkage(matrix: DataFrame, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """(topological overlap of the matrix's correlations, its linkage)."""
    overlap = topological_overlap(correlation(matrix))
    return overlap, linkage(overlap, matrix.select(F.col("feature").alias("node")).distinct(), method)


def module_representatives(edges: DataFrame, nodes: DataFrame, threshold: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(average linkage of 1 - weight, labels of its cut at ``threshold``); weights above 1 are scaled by the largest."""
    top = edges.agg(F.max("weight").alias("top"))
    scaled = edges.crossJoin(F.broadcast(top)).select("src", "dst", F.when(F.col("top") > 1, F.col("weight") / F.col("top")).otherwise(F.col("weight")).alias("weight"))  # top is one row
    z = linkage(scaled, nodes)
    return z, cut_tree(z, height=threshold)


def _links(z: DataFrame, n: int) -> DataFrame:
    """(node, to, add): each cluster's link to the one it merges into, with the number of items that stand left of it there."""
    sizes = z.select((F.col("step") + n).alias("left"), F.col("size").alias("under"))
    right = z.join(sizes, "left", "left").select(F.col("right").alias("node"), (F.col("step") + n).cast("long").alias("to"), F.coalesce("under", F.lit(1)).alias("add"))
    return right.unionByName(z.select(F.col("left").alias("node"), (F.col("step") + n).cast("long").alias("to"), F.lit(0).cast("long").alias("add")))


def cut_tree(z: DataFrame, n_clusters: int | None = None, height: float | None = None) -> DataFrame:
    """(item, cluster) after the merges up to ``height``, or until ``n_clusters`` are left; clusters are numbered by their first item.

    Links of the merges that stay are followed to their roots, twice as far each round.
    """
    n = z.count() + 1
    steps = z.where(F.col("height") <= height).count() if height is not None else max(0, n - (n_clusters or 1))
    roots = followed(_links(z, n).where(F.col("to") < n + steps)).select(F.col("node").alias("item"), "to")
    items = z.sparkSession.range(n).withColumnRenamed("id", "item").join(roots, "item", "left").select("item", F.coalesce("to", "item").alias("root"))
    names = numbered(items.groupBy("root").agg(F.min("item").alias("first")), "first", name="cluster")
    return items.join(names, "root").select("item", F.col("cluster").cast("int").alias("cluster"))


def cut_trees(z: DataFrame, n_clusters: list[int] | None = None, heights: list[float] | None = None) -> DataFrame:
    """(item, cut, cluster) of several cuts at once, each with its number of clusters or its height as ``cut``."""
    asked = [(float(k), {"n_clusters": k}) for k in n_clusters or []] + [(float(h), {"height": h}) for h in heights or []]
    if not asked:
        raise ValueError("cut_trees needs numbers of clusters or heights")
    z, found = stored(z), None
    for name, how in asked:
        own = cut_tree(z, **how).select("item", F.lit(name).alias("cut"), "cluster")
        found = own if found is None else found.unionByName(own)
    return found


def dendrogram_order(z: DataFrame) -> DataFrame:
    """(place, item): the items from left to right. An item's place is the number of items left of it at all merges above it."""
    z = stored(z)
    n = z.count() + 1
    places = followed(_links(z, n)).select(F.col("node").alias("item"), F.col("add").alias("place"))
    items = z.sparkSession.range(n).withColumnRenamed("id", "item")
    return items.join(places, "item", "left").select(F.coalesce("place", F.lit(0)).cast("int").alias("place"), "item")


def eigengenes(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, subject, value): the leading left singular vector of each cluster's columns; ``clusters``: (feature, cluster).

    The columns' products are small whatever the number of subjects; their leading eigenvector weights the columns,
    and the weighted sums of all subjects are one join and aggregation.
    """
    kind = matrix.schema["feature"].dataType.simpleString()
    first, second = clusters.select(F.col("feature").alias("f1"), F.col("cluster").alias("cluster")), clusters.select(F.col("feature").alias("f2"), F.col("cluster").alias("c2"))
    inside = column_products(matrix).join(first, "f1").join(second, "f2").where("cluster = c2").select("cluster", "f1", "f2", "dot")

    def leading(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group["f1"]) | set(group["f2"]))
        kernels.check_size(len(names))
        place = {x: k for k, x in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        i, j = group["f1"].map(place), group["f2"].map(place)
        g[i, j] = g[j, i] = group["dot"]
        values, vectors = np.linalg.eigh(g)
        scale = np.sqrt(max(values[-1], 0)) or 1.0
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "feature": names, "weight": kernels.canonical(vectors[:, -1]) / scale})

    weights = inside.groupBy("cluster").applyInPandas(leading, f"cluster int, feature {kind}, weight double")
    return matrix.join(weights, "feature").groupBy("cluster", "subject").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def ranked_clusters(clusters: DataFrame) -> DataFrame:
    """(path, rank, size): the clusters of (path, node) by size, and then in the order of their visit."""
    sizes = clusters.groupBy("path").agg(F.count("*").alias("size"))
    return numbered(sizes, "size", "path", name="rank")


def subset_parents(clusters: DataFrame) -> DataFrame:
    """(rank, parent, size): for each cluster of a hierarchy (path, node) the first larger one, by rank, that holds all its nodes.

    Clusters are nested, so that the next larger one of any node is the next larger one of its cluster: each node's own clusters are
    put in order, and no two clusters are compared. Clusters that overlap without one holding the other raise an error.
    """
    own = clusters.select("path", "node").join(ranked_clusters(clusters), "path").select("node", "rank", "size")
    above = own.withColumn("parent", F.lead("rank").over(Window.partitionBy("node").orderBy("rank")))
    told = above.groupBy("rank", "size").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"), F.count("parent").alias("held")).where("held > 0")
    nested = (F.col("parent") == F.col("other")) & (F.col("held") == F.col("size"))
    return told.select("rank", "size", F.when(nested, F.col("parent")).otherwise(F.raise_error(F.lit("clusters are not nested"))).alias("parent"))


def cluster_linkage(clusters: DataFrame, edges: DataFrame | None = None, distance: str = "dumb") -> DataFrame:
    """The linkage of a full hierarchy of clusters (path, node), down to single nodes, which are integers from 0.

    ``dumb``: heights are sizes. ``avg_cut``: the sum of distances sqrt(2 (1 - weight)) across a cut, over the size of
    either side, added; pairs without an edge have weight 0.
    """
    if distance not in ("dumb", "avg_cut"):
        raise ValueError(f"distance {distance!r} is neither dumb nor avg_cut")
    order = stored(ranked_clusters(clusters))
    n = clusters.select("node").distinct().count()
    if order.count() != 2 * n - 1:
        raise ValueError("a linkage needs every cluster of a full hierarchy: 2 n - 1 for n nodes")
    single = clusters.join(order.where("size = 1"), "path").select("rank", F.col("node").cast("long").alias("item"))
    named = subset_parents(clusters).join(single, "rank", "left").select("parent", "rank", "size", F.coalesce("item", "rank").alias("item"))
    children = named.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("rank")))
    left = children.where("place = 1").select("parent", F.col("item").alias("left"), F.col("rank").alias("r1"), F.col("size").alias("s1"))
    right = children.where("place = 2").select("parent", F.col("item").alias("right"), F.col("rank").alias("r2"), F.col("size").alias("s2"))
    joined = left.join(right, "parent").withColumn("size", F.col("s1") + F.col("s2"))
    if distance == "dumb":
        return joined.select((F.col("parent") - n).cast("int").alias("step"), "left", "right", F.col("size").cast("double").alias("height"), "size")
    if edges is None:
        raise ValueError("avg_cut needs the network")
    own = clusters.join(order, "path").select("rank", "node")
    pairs = joined.join(own.select(F.col("rank").alias("r1"), F.col("node").alias("src")), "r1").join(own.select(F.col("rank").alias("r2"), F.col("node").alias("dst")), "r2")
    far = F.sqrt(2 * (1 - F.coalesce("weight", F.lit(0.0))))
    heights = pairs.join(edges, ["src", "dst"], "left").groupBy("parent", "left", "right", "s1", "s2", "size").agg(F.sum(far).alias("far"))
    return heights.select((F.col("parent") - n).cast("int").alias("step"), "left", "right", (F.col("far") / F.col("s1") + F.col("far") / F.col("s2")).alias("height"), "size")
