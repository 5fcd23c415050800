"""Spectral bisection of networks, and the hierarchies that repeated bisection gives.

A cluster is named by its path from the whole network: "" and then A or B for the side at each cut, so that the
order of names is the order in which a descent visits them. A level's clusters of up to kernels.DENSE_NODES nodes are cut
in parallel, each in one task; larger ones have their vectors from the table of edges, by Lanczos steps (``eigen``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators import eigen
from netweave.sources.scratch import stored


def grouped(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Rows for a dense kernel: (path, node, other, weight), a row without ``other`` for each member of (path, node)."""
    kind = members.schema["node"].dataType
    first, second = members.select(F.col("path").alias("path"), F.col("node").alias("src")), members.select("path", F.col("node").alias("dst"))
    inside = edges.join(first, "src").join(second, ["path", "dst"]).select("path", F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    return members.select("path", "node", F.lit(None).cast(kind).alias("other"), F.lit(0.0).alias("weight")).unionByName(inside)


def dense(group: pd.DataFrame) -> tuple[list, np.ndarray]:
    """(nodes in order, their matrix) of a group's rows."""
    names = sorted(group.loc[group["other"].isna(), "node"].tolist())
    kernels.check_size(len(names))
    place = {x: k for k, x in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    cells = group[group["other"].notna()]
    a[cells["node"].map(place), cells["other"].map(place)] = cells["weight"]
    return names, a


def whole(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit("").alias("path"), "node")


def second_vector(edges: DataFrame, nodes: DataFrame, fiedler: bool = True) -> DataFrame:
    """(node, value): the Laplacian's second eigenvector, of a network of any size."""
    return eigen.signed(eigen.lowest(edges, nodes, 2, fiedler).vectors, [1]).select("node", F.col("v0").alias("value"))


def laplace_partition(edges: DataFrame, nodes: DataFrame, fiedler: bool = True, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(node, side, value): the sides of the Laplacian's second eigenvector; entries of 0 are on side A."""
    kind = nodes.schema["node"].dataType.simpleString()
    if nodes.count() > dense_nodes:
        return second_vector(edges, nodes, fiedler).select("node", F.when(F.col("value") < 0, "B").otherwise("A").alias("side"), "value")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        names, a = dense(group)
        v = kernels.second_vector(a, fiedler)
        return pd.DataFrame({"node": names, "side": np.where(v < 0, "B", "A"), "value": v})

    return grouped(edges, whole(nodes)).groupBy("path").applyInPandas(cut, f"node {kind}, side string, value double")


def sides_of(edges: DataFrame, members: DataFrame, fiedler: bool = True, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(path, node, side) of every cluster of (path, node), cut by the second vector of its own network."""
    kind = members.schema["node"].dataType.simpleString()
    large = [r.path for r in members.groupBy("path").count().where(F.col("count") > dense_nodes).orderBy("path").collect()]  # as many as fit into all nodes

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        names, a = dense(group)
        return pd.DataFrame({"path": group["path"].iloc[0], "node": names, "side": np.where(kernels.second_vector(a, fiedler) < 0, "B", "A")})

    small = members.where(~F.col("path").isin(large)) if large else members
    found = grouped(edges, small).groupBy("path").applyInPandas(cut, f"path string, node {kind}, side string")
    for path in large:
        own = stored(members.where(F.col("path") == path).select("node"))
        inside = stored(within(edges, own))
        found = found.unionByName(second_vector(inside, own, fiedler).select(F.lit(path).alias("path"), "node", F.when(F.round("value", 12) < 0, "B").otherwise("A").alias("side")))
    return found


def within(edges: DataFrame, own: DataFrame) -> DataFrame:
    """The edges between nodes of (node)."""
    return edges.join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def off_diagonal_mean(a: np.ndarray) -> float:
    n = len(a)
    return float((a.sum() - np.trace(a)) / (n * (n - 1))) if n > 1 else float(a.mean()) if n else float("nan")


def cut_large(edges: DataFrame, own: DataFrame, path: str, min_size: int, stop: str, fiedler: bool) -> DataFrame:
    """(path, node, goes, is_leaf) of one cluster's nodes (node), cut by its second vector; rules as in ``cluster_laplace``."""
    inside = stored(within(edges, own))
    sides = stored(second_vector(inside, own, fiedler).select("node", F.when(F.round("value", 12) < 0, "B").otherwise("A").alias("side")))
    sizes = {r.side: r["count"] for r in sides.groupBy("side").count().collect()}
    if len(sizes) < 2:
        on = ""
    elif stop == "size":
        on = "AB" if min(sizes.values()) >= min_size else ""
    else:
        first, second = sides.select(F.col("node").alias("src"), F.col("side").alias("from")), sides.select(F.col("node").alias("dst"), F.col("side").alias("to"))
        apart = {(r["from"], r["to"]): r.weight for r in inside.where("src <> dst").join(first, "src").join(second, "dst").groupBy("from", "to").agg(F.sum("weight").alias("weight")).collect()}
        mean = lambda total, n: total / (n * (n - 1)) if n > 1 else 0.0
        every = mean(sum(apart.values()), sum(sizes.values()))
        on = next((s for s in "AB" if every < mean(apart.get((s, s), 0.0), sizes[s])), "")
    goes = F.when(F.col("side").isin(list(on)), F.concat(F.lit(path), "side")) if on else F.lit(None).cast("string")
    return sides.select(F.lit(path).alias("path"), "node", goes.alias("goes"), F.lit(not on).alias("is_leaf"))


def cluster_laplace(edges: DataFrame, nodes: DataFrame, min_size: int = 1, stop: str = "size", fiedler: bool = True, propagate: bool = False, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(path, depth, node, is_leaf) of every cluster that repeated bisection visits.

    ``size``: a cluster is cut while both sides have ``min_size`` nodes (and any). ``weight``: only the first side
    whose mean weight is above its cluster's is cut on. ``stop`` and ``fiedler`` hold for the first cut alone, and
    size and the plain Laplacian for all others, unless ``propagate``.
    """
    if stop not in ("size", "weight"):
        raise ValueError(f"stop {stop!r} is neither size nor weight")
    kind = nodes.schema["node"].dataType.simpleString()
    members, visited, depth = stored(whole(nodes)), None, 0
    while True:
        own_stop, own_fiedler = (stop, fiedler) if propagate or not depth else ("size", True)

        def cut(group: pd.DataFrame, own_stop: str = own_stop, own_fiedler: bool = own_fiedler) -> pd.DataFrame:
            names, a = dense(group)
            v = kernels.second_vector(a, own_fiedler)
            side = np.where(v < 0, "B", "A")
            parts = [a[np.ix_(side == s, side == s)] for s in "AB"]
            sizes = [len(p) for p in parts]
            if not all(sizes):
                on = ""
            elif own_stop == "size":
                on = "AB" if min(sizes) >= min_size else ""
            else:
                on = next((s for s, p in zip("AB", parts, strict=True) if off_diagonal_mean(a) < off_diagonal_mean(p)), "")
            path = group["path"].iloc[0]
            return pd.DataFrame({"path": path, "node": names, "goes": [path + s if s in on else None for s in side], "is_leaf": not on})

        large = [r.path for r in members.groupBy("path").count().where(F.col("count") > dense_nodes).orderBy("path").collect()]  # as many as fit into all nodes
        small = members.where(~F.col("path").isin(large)) if large else members
        level = grouped(edges, small).groupBy("path").applyInPandas(lambda g: cut(g), f"path string, node {kind}, goes string, is_leaf boolean")
        for path in large:
            level = level.unionByName(cut_large(edges, stored(members.where(F.col("path") == path).select("node")), path, min_size, own_stop, own_fiedler))
        level = stored(level)
        own = level.select("path", F.lit(depth).alias("depth"), "node", "is_leaf")
        visited = own if visited is None else visited.unionByName(own)
        members = level.where("goes is not null").select(F.col("goes").alias("path"), "node")
        if not members.limit(1).count():
            return visited
        depth += 1


def spectrum(edges: DataFrame, nodes: DataFrame, count: int | None = None, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(rank, eigenvalue) of the Laplacian of a symmetric network, ascending: all, or the lowest ``count``, which takes networks of any size."""
    if count is not None and nodes.count() > dense_nodes:
        values = eigen.lowest(edges, nodes, count).values
        return edges.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "rank int, eigenvalue double")

    def values(group: pd.DataFrame) -> pd.DataFrame:
        _, a = dense(group)
        w = np.linalg.eigvalsh(kernels.laplacian(a))[:count]
        return pd.DataFrame({"rank": np.arange(len(w)), "eigenvalue": w})

    return grouped(edges, whole(nodes)).groupBy("path").applyInPandas(values, "rank int, eigenvalue double")


def embedding(edges: DataFrame, nodes: DataFrame, dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(node, x, y): the Laplacian's second and third eigenvectors."""
    kind = nodes.schema["node"].dataType.simpleString()
    if nodes.count() > dense_nodes:
        return eigen.signed(eigen.lowest(edges, nodes, 3).vectors, [1, 2]).select("node", F.col("v0").alias("x"), F.col("v1").alias("y"))

    def placed(group: pd.DataFrame) -> pd.DataFrame:
        names, a = dense(group)
        _, v = np.linalg.eigh(kernels.laplacian(a))
        x, y = (kernels.canonical(v[:, k]) if k < len(names) else np.zeros(len(names)) for k in (1, 2))
        return pd.DataFrame({"node": names, "x": x, "y": y})

    return grouped(edges, whole(nodes)).groupBy("path").applyInPandas(placed, f"node {kind}, x double, y double")
