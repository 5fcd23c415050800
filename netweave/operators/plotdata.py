"""What pictures of networks and matrices show, as tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators.centrality import degree
from netweave.operators.hierarchy import cluster_linkage, dendrogram_order
from netweave.operators.matrix import centred, column_products, numbered
from netweave.operators.spectral import dense, grouped, whole
from netweave.sources.scratch import stored


def display_edges(edges: DataFrame, nodes: DataFrame, remove: bool = True) -> DataFrame:
    """(src, dst, weight) without loops; with ``remove`` also without edges below the median of all cells, absent ones counted as 0. Two places."""
    own = edges.where("src <> dst and weight <> 0")
    if remove:
        cells = nodes.agg((F.count("*") * F.count("*")).alias("cells"))
        held = own.agg(F.count("*").alias("held")).crossJoin(cells).select("held", "cells")
        placed = numbered(own.select("weight"), "weight")
        absent = F.col("cells") - F.col("held")
        at = placed.crossJoin(F.broadcast(held)).select("weight", F.when(F.col("weight") > 0, F.col("place") + absent).otherwise(F.col("place")).alias("place"), "cells")
        low, high = F.floor((F.col("cells") - 1) / 2), F.ceil((F.col("cells") - 1) / 2)
        median = at.agg(F.coalesce(F.max(F.when(F.col("place") == low, F.col("weight"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("place") == high, F.col("weight"))), F.lit(0.0)).alias("b"))
        own = own.crossJoin(F.broadcast(median)).where(F.col("weight") >= (F.col("a") + F.col("b")) / 2)  # median is one row
    return own.select("src", "dst", F.bround("weight", 2).alias("weight")).where("weight <> 0")


def display_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, x, y): degree over the largest, and the node's place on a circle, in the order of ids."""
    scored = numbered(degree(edges, nodes), "node")
    told = scored.agg(F.max("score").alias("top"), F.count("*").alias("nodes"))
    turn = 2 * math.pi * F.col("place") / F.col("nodes")
    sized = scored.crossJoin(F.broadcast(told))  # told is one row
    return sized.select("node", F.when(F.col("top") != 0, F.col("score") / F.col("top")).otherwise(0.0).alias("size"), F.cos(turn).alias("x"), F.sin(turn).alias("y"))


LAYOUTS = ("circular", "shell", "spectral", "spring")


def display_layout(edges: DataFrame, nodes: DataFrame, layout: str = "spring", labels: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(node, label, size, x, y): a node's place, its label of (node, label), or its id, and its score of (node, score) or its degree over the largest.

    ``circular`` and ``shell`` (of one shell) are the circle; ``spectral`` places by the Laplacian's second and third
    eigenvectors; ``spring`` by springs from the circle. A picture has at most kernels.DENSE_NODES nodes.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout!r} is none of {LAYOUTS}")
    kind = nodes.schema["node"].dataType.simpleString()

    def placed(group: pd.DataFrame) -> pd.DataFrame:
        names, a = dense(group)
        if layout == "spectral":
            _, v = np.linalg.eigh(kernels.laplacian(a))
            at = np.column_stack([kernels.canonical(v[:, k]) if k < len(names) else np.zeros(len(names)) for k in (1, 2)])
            at = at / max(np.abs(at).max(), 1e-12)
        else:
            at = kernels.spring(np.maximum(a, a.T)) if layout == "spring" else kernels.circle(len(names))
        return pd.DataFrame({"node": names, "x": at[:, 0], "y": at[:, 1]})

    places = grouped(edges, whole(nodes)).groupBy("path").applyInPandas(placed, f"node {kind}, x double, y double")
    sized = scores if scores is not None else degree(edges, nodes)
    top = sized.agg(F.max("score").alias("top"))
    size = F.coalesce(F.when(F.col("top") != 0, F.col("score") / F.col("top")), F.lit(0.0))
    sized = sized.crossJoin(F.broadcast(top)).select("node", (F.col("score") if scores is not None else size).alias("size"))  # top is one row
    named = labels.select("node", "label") if labels is not None else nodes.select("node", F.lit(None).cast("string").alias("label"))
    return places.join(sized, "node", "left").join(named, "node", "left").select("node", F.coalesce(F.col("label").cast("string"), F.col("node").cast("string")).alias("label"), "size", "x", "y")


def dendrogram(clusters: DataFrame, edges: DataFrame, matrix: DataFrame, distance: str = "dumb") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(linkage of a full hierarchy (path, node), (place, item) of its leaves, (place, subject, value) of the matrix in that order)."""
    z = stored(cluster_linkage(clusters, edges, distance))
    order = stored(dendrogram_order(z))
    return z, order, matrix.join(order.select("place", F.col("item").alias("feature")), "feature").select("place", "subject", "value")


def heat_map(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(row, col, value): the network in the order of (place, item); nodes are the items."""
    row, col = order.select(F.col("place").alias("row"), F.col("item").alias("src")), order.select(F.col("place").alias("col"), F.col("item").alias("dst"))
    return edges.join(row, "src").join(col, "dst").select("row", "col", F.col("weight").alias("value"))


def principal_components(matrix: DataFrame, count: int = 2) -> tuple[DataFrame, DataFrame]:
    """((subject, component, score), (component, ratio of variance explained)) of the centred matrix.

    The features' covariances are small whatever the number of subjects; scores are one join and aggregation.
    """
    own = centred(matrix.select("subject", "feature", "value"))
    kind = matrix.schema["feature"].dataType.simpleString()

    def axes(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group["f1"]) | set(group["f2"]))
        kernels.check_size(len(names))
        place = {x: k for k, x in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        i, j = group["f1"].map(place), group["f2"].map(place)
        g[i, j] = g[j, i] = group["dot"]
        values, vectors = np.linalg.eigh(g)
        out = []
        for c in range(min(count, len(names))):
            v = kernels.canonical(vectors[:, -1 - c])
            out.append(pd.DataFrame({"component": c, "ratio": values[-1 - c] / values.sum() if values.sum() else 0.0, "feature": names, "weight": v}))
        return pd.concat(out)

    loadings = column_products(own).groupBy(F.lit(0).alias("all")).applyInPandas(axes, f"component int, ratio double, feature {kind}, weight double")
    scores = own.join(loadings, "feature").groupBy("subject", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    return scores, loadings.select("component", "ratio").distinct()
