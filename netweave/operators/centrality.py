"""Centralities of a network's nodes, components, and the scores of layered networks.

Networks come as edges (src, dst, weight) with the nodes (node) beside them, so that isolated nodes have a score
too. Iterations are joins; each is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators import arnoldi
from netweave.operators.components import component_labels
from netweave.operators.expression import CENTRALITIES, dense_centralities
from netweave.operators.matrix import ranked
from netweave.sources.scratch import stored

DAMPING = 0.85


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score): the sum of the weights of a node's column, that is of the edges to it; a single node scores 0, loop or not."""
    sums = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("score"))
    single = nodes.agg(F.count("*").alias("n"))
    scored = nodes.join(sums, "node", "left").crossJoin(F.broadcast(single))  # single is one row
    return scored.select("node", F.when(F.col("n") > 1, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"))


def transitions(edges: DataFrame, in_rank: bool = False) -> DataFrame:
    """(source, target, share): where a node's rank goes. Without ``in_rank`` it follows the edges, else it runs against them.

    Only nodes from which rank can go are kept, once; a kept node whose targets were all dropped loses its rank.
    """
    own = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight") if not in_rank else edges.select(F.col("dst").alias("source"), F.col("src").alias("target"), "weight")
    kept = own.groupBy("source").agg(F.sum("weight").alias("total")).where("total <> 0").select("source")
    inside = own.join(kept, "source", "left_semi").join(kept.select(F.col("source").alias("target")), "target", "left_semi")
    totals = inside.groupBy("source").agg(F.sum("weight").alias("total")).where("total <> 0")
    return inside.join(totals, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share"))


def live_nodes(edges: DataFrame, nodes: DataFrame, in_rank: bool) -> DataFrame:
    """(node) of the nodes from which rank can go; stored."""
    own = edges.select(F.col("dst" if in_rank else "src").alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("total")).where("total <> 0").select("node")
    return stored(own.join(nodes.select("node").distinct(), "node", "left_semi"))


def handed_on(shares: DataFrame, rank: DataFrame, value: str) -> DataFrame:
    """(node, got): what each node gets of the ``value`` of (node, value)."""
    return shares.join(rank.select(F.col("node").alias("source"), value), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col(value)).alias("got"))


def stationary(edges: DataFrame, nodes: DataFrame, in_rank: bool = False, damping: float = DAMPING, tolerance: float = 1e-10) -> tuple[float, DataFrame]:
    """(eigenvalue, (node, v) of the nodes from which rank can go): what a step keeps of all rank, 1 where none leaks, and the
    stationary ranks, of sum 1. Without two such nodes there is no rank: 0 and no row.

    The walk's matrix is positive, so that its leading eigenvalue is its largest in size; Arnoldi iteration finds it in fewer steps than
    the walk itself takes.
    """
    live = live_nodes(edges, nodes, in_rank)
    n = live.count()
    if n <= 1:
        return 0.0, live.limit(0).select("node", F.lit(0.0).alias("v"))
    shares = stored(transitions(edges, in_rank))

    def walked(rank: DataFrame) -> DataFrame:
        jump = rank.agg((F.sum("last") * ((1 - damping) / n)).alias("jump"))  # one row
        got = live.join(handed_on(shares, rank, "last"), "node", "left").crossJoin(F.broadcast(jump))
        return got.select("node", (damping * F.coalesce("got", F.lit(0.0)) + F.col("jump")).alias("got"))

    value, rows = arnoldi.leading(live, walked, tolerance=tolerance)
    total = rows.agg(F.sum("x")).first()[0]
    return float(value.real), rows.select("node", (F.col("x") / total).alias("v"))


def page_rank(edges: DataFrame, nodes: DataFrame, in_rank: bool = False, damping: float = DAMPING, stochastic: bool = False, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """(node, score), (node of no rank: 0). Exact: the stationary vector, of sum 1 even where rank leaks; ``stochastic``: the plain
    recurrence from a uniform start, ``most`` steps or until a step's length is 1e-3 or less, without rescaling."""
    if not stochastic:
        _, rank = stationary(edges, nodes, in_rank, damping, tolerance)
        return nodes.join(rank, "node", "left").select("node", F.coalesce("v", F.lit(0.0)).alias("score"))
    live = live_nodes(edges, nodes, in_rank)
    n = live.count()
    if n <= 1:
        return nodes.select("node", F.lit(0.0).alias("score"))
    shares = stored(transitions(edges, in_rank))
    rank = stored(live.select("node", F.lit(1.0 / n).alias("v")))
    for _ in range(most):
        given = handed_on(shares, rank, "v")
        raw = stored(live.join(given, "node", "left").join(rank, "node").select("node", F.col("v").alias("was"), (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) / n).alias("raw")))
        rank = raw.select("node", F.col("raw").alias("v"))
        if raw.agg(F.sum(F.pow(F.col("raw") - F.col("was"), 2))).first()[0] ** 0.5 <= 1e-3:
            break
    return nodes.join(rank, "node", "left").select("node", F.coalesce("v", F.lit(0.0)).alias("score"))


def leading_eigenvector(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, score) of a symmetric network of nonnegative weights: its leading eigenvector, of length 1 and nonnegative.

    Power iteration on the network with half its largest degree added to every loop, which keeps the vector and makes
    the leading eigenvalue the largest in size. Directed and signed networks: ``arnoldi.leading_vector``, or the dense kernel of ``dense_centralities``.
    """
    shift = (edges.groupBy("dst").agg(F.sum("weight").alias("k")).agg(F.max("k")).first()[0] or 0.0) / 2
    n = nodes.count()
    if not n or not shift:
        return nodes.select("node", F.lit(0.0).alias("score"))
    vector = stored(nodes.select("node", F.lit(n**-0.5).alias("v")))
    for _ in range(most):
        given = edges.join(vector.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("v")).alias("got"))
        raw = stored(vector.join(given, "node", "left").select("node", F.col("v").alias("was"), (shift * F.col("v") + F.coalesce("got", F.lit(0.0))).alias("raw")))
        length = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0]
        moved = raw.agg(F.max(F.abs(F.col("raw") / length - F.col("was")))).first()[0]
        vector = raw.select("node", (F.col("raw") / length).alias("v"))
        if moved <= tolerance:
            break
    return vector.select("node", F.col("v").alias("score"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that edges of any direction lead to. Labels jump along labels, so rounds are few."""
    own = edges.where("weight <> 0 and src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    found = component_labels(stored(own.select("e.*").distinct()))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cluster_centers(edges: DataFrame, clusters: DataFrame, centrality: str = "degree") -> tuple[DataFrame, DataFrame]:
    """((cluster, node) of highest centrality inside each cluster, lowest node on ties; edges among these nodes).

    The degree takes clusters of any size; ``page_rank`` and ``large_evec`` take each cluster in one task, up to kernels.DENSE_NODES nodes.
    Scores are compared to twelve places.
    """
    if centrality not in CENTRALITIES:
        raise ValueError(f"centrality {centrality!r} is none of {CENTRALITIES}")
    inside = edges.join(clusters.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), "src").join(clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("c2")), "dst").where("c1 = c2")
    if centrality == "degree":
        sums = inside.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("score"))
    else:
        own = clusters.select(F.col("cluster").alias("pathway"), F.col("node").alias("feature"))
        scored = dense_centralities(inside.select(F.col("c1").alias("pathway"), "src", "dst", "weight"), own, centrality, in_rank=False)
        sums = scored.select(F.col("feature").alias("node"), F.round("weight", 12).alias("score"))
    centers = ranked(clusters.join(sums, "node", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "cluster", F.desc("score"), "node").select("cluster", "node")
    among = edges.join(centers.select(F.col("node").alias("src")), "src", "left_semi").join(centers.select(F.col("node").alias("dst")), "dst", "left_semi")
    return centers, among.select("src", "dst", "weight")


def layer_scores(scores: DataFrame) -> DataFrame:
    """(node, score): sums over layers of the absolute scores of (t, node, score)."""
    return scores.groupBy("node").agg(F.sum(F.abs("score")).alias("score"))


def supra_degree(supra: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t, node, score): degrees in a layered network; ``nodes``: (t, node)."""
    sums = supra.groupBy(F.col("dst_t").alias("t"), F.col("dst").alias("node")).agg(F.sum("weight").alias("score"))
    return nodes.join(sums, ["t", "node"], "left").select("t", "node", F.coalesce("score", F.lit(0.0)).alias("score"))


def supra_scores(supra: DataFrame, nodes: DataFrame, centrality: str = "degree", dense_nodes: int = kernels.DENSE_NODES) -> DataFrame:
    """(node, score): centralities in a layered network, absolute, summed over layers; ``nodes``: (t, node).

    All take networks of any size. Couplings have one direction, so that the leading eigenvector is that of a directed network: beyond
    ``dense_nodes`` nodes of all layers it comes by Arnoldi iteration, up to it by the dense kernel; the scores are the same.
    """
    if centrality == "degree":
        return layer_scores(supra_degree(supra, nodes))
    if centrality not in CENTRALITIES:
        raise ValueError(f"centrality {centrality!r} is none of {CENTRALITIES}")
    place = lambda t, node, name: F.struct(F.col(t).cast("long").alias("t"), F.col(node).alias("node")).alias(name)
    own, edges = nodes.select(place("t", "node", "node")), supra.select(place("src_t", "src", "src"), place("dst_t", "dst", "dst"), "weight")
    if centrality == "page_rank":
        scored = page_rank(edges, own)
        return layer_scores(scored.select("node.t", "node.node", "score"))
    if own.count() > dense_nodes:
        found = arnoldi.leading_vector(stored(edges), own)
        return layer_scores(found.select("node.t", "node.node", "score"))
    text = lambda column, name: F.to_json(column).alias(name)
    small = edges.select(F.lit(0).alias("pathway"), text("src", "src"), text("dst", "dst"), "weight")
    scored = dense_centralities(small, own.select(F.lit(0).alias("pathway"), text("node", "feature")), "large_evec", in_rank=False)
    named = own.select(text("node", "feature"), "node.t", "node.node")
    return layer_scores(named.join(scored, "feature").select("t", "node", F.col("weight").alias("score")))
