"""Group expression: a subject's value of a group is the weighted sum of its values of the group's features.

Weights are (pathway, feature, weight), and all groups are known from (pathway) beside them, so that groups
without weights express 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators.networks import MEASURES, adjacency, coded_network

#: Weight rows up to which a transform broadcasts them.
BROADCAST_WEIGHTS = 1_000_000
#: Scores this near are equal: sums depend on the order of rows.
TIE = 1e-12
CENTRALITIES = ("degree", "page_rank", "large_evec")


def normalised(weights: DataFrame) -> DataFrame:
    """Each group's weights over their sum, where that is not 0."""
    total = F.sum("weight").over(Window.partitionBy("pathway"))
    return weights.withColumn("weight", F.when(total != 0, F.col("weight") / total).otherwise(F.col("weight")))


def linear_weights(members: DataFrame, features: DataFrame, normalize: bool = True) -> DataFrame:
    """Equal weights of a group's members that the data have."""
    own = members.select("pathway", "feature").distinct().join(features.select("feature"), "feature", "left_semi").select("pathway", "feature", F.lit(1.0).alias("weight"))
    return normalised(own) if normalize else own


def transform(matrix: DataFrame, weights: DataFrame, pathways: DataFrame) -> DataFrame:
    """(subject, pathway, value) for all subjects and groups.

    The weights are broadcast while they are few, so that only partial sums of subject and group are shuffled.
    """
    side = F.broadcast(weights) if weights.count() <= BROADCAST_WEIGHTS else weights
    sums = matrix.join(side, "feature").groupBy("subject", "pathway").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    grid = matrix.select("subject").distinct().crossJoin(pathways.select("pathway").distinct())  # the result's own rows
    return grid.join(sums, ["subject", "pathway"], "left").select("subject", "pathway", F.coalesce("value", F.lit(0.0)).alias("value"))


def pathway_networks(matrix: DataFrame | None, members: DataFrame, features: DataFrame, edges: DataFrame | None, network: str, directed: bool = True, parameter: float = 2) -> DataFrame:
    """(pathway, src, dst, weight) of each group's own network among the features that the data have."""
    own = members.select("pathway", "feature").distinct().join(features.select("feature"), "feature", "left_semi")
    if network == "precomputed":
        if edges is None:
            raise ValueError("precomputed networks need coded edges")
        inside = edges.join(own.select("pathway", F.col("feature").alias("src")), ["pathway", "src"], "left_semi").join(own.select("pathway", F.col("feature").alias("dst")), ["pathway", "dst"], "left_semi")
        return coded_network(inside, directed)
    if network.replace("_", "") not in MEASURES or matrix is None:
        raise ValueError(f"network {network!r} is none of precomputed, {', '.join(MEASURES)}, or has no matrix")
    whole = adjacency(matrix.join(own.select("feature").distinct(), "feature", "left_semi"), network, parameter=parameter)  # a pair's weight is the same in all groups
    first, second = own.select("pathway", F.col("feature").alias("src")), own.select("pathway", F.col("feature").alias("dst"))
    return first.join(second, "pathway").join(whole, ["src", "dst"]).select("pathway", "src", "dst", "weight")


def centrality_weights(networks: DataFrame, members: DataFrame, features: DataFrame, centrality: str, normalize: bool = True) -> DataFrame:
    """(pathway, feature, weight): each member's centrality in its group's network."""
    own = members.select("pathway", "feature").distinct().join(features.select("feature"), "feature", "left_semi")
    if centrality == "degree":
        sums = networks.groupBy("pathway", F.col("dst").alias("feature")).agg(F.sum("weight").alias("k"))
        group = Window.partitionBy("pathway")
        scored = own.join(sums, ["pathway", "feature"], "left").withColumn("k", F.when(F.count("*").over(group) > 1, F.coalesce("k", F.lit(0.0))).otherwise(0.0))
        top = F.max("k").over(group)
        weights = scored.select("pathway", "feature", F.when(top != 0, F.col("k") / top).otherwise(F.col("k")).alias("weight"))
    else:
        if centrality not in ("page_rank", "large_evec", "largest_evec"):
            raise ValueError(f"centrality {centrality!r} is none of {CENTRALITIES}")
        weights = dense_centralities(networks, own, centrality)
    return normalised(weights) if normalize else weights


def dense_centralities(networks: DataFrame, members: DataFrame, centrality: str, in_rank: bool = True) -> DataFrame:
    """(pathway, feature, weight) of one small graph a group, each in one task; a group has at most kernels.DENSE_NODES members."""
    rows = members.select("pathway", "feature", F.lit(None).cast(members.schema["feature"].dataType).alias("other"), F.lit(0.0).alias("weight")).unionByName(networks.select("pathway", F.col("src").alias("feature"), F.col("dst").alias("other"), "weight"))

    def scores(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(group.loc[group["other"].isna(), "feature"])
        kernels.check_size(len(names))
        place = {x: k for k, x in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        cells = group[group["other"].notna()]
        a[cells["feature"].map(place), cells["other"].map(place)] = cells["weight"]
        v = (kernels.page_rank(a, in_rank) if centrality == "page_rank" else kernels.leading_vector(a)) if len(names) > 1 else np.zeros(len(names))
        return pd.DataFrame({"pathway": group["pathway"].iloc[0], "feature": names, "weight": v})

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    return rows.groupBy("pathway").applyInPandas(scores, f"pathway {kinds['pathway']}, feature {kinds['feature']}, weight double")


def group_scores(weights: DataFrame, pathways: DataFrame, featureset: DataFrame | None = None) -> DataFrame:
    """(pathway, score): the weights of a feature set's features, summed; of all features without a set."""
    own = weights if featureset is None else weights.join(featureset.select("feature").distinct(), "feature", "left_semi")
    sums = own.groupBy("pathway").agg(F.sum("weight").alias("score"))
    return pathways.select("pathway").distinct().join(sums, "pathway", "left").select("pathway", F.coalesce("score", F.lit(0.0)).alias("score"))


def null_sets(universe: list, size: int, trials: int) -> list[tuple[int, object]]:
    """(trial, feature) of draws without replacement, seeded by the trial's number."""
    return [(t, x) for t in range(trials) for x in np.random.RandomState(t).choice(np.array(universe), size, replace=False).tolist()]


def rank_groups(weights: DataFrame, pathways: DataFrame, universe: DataFrame, featureset: list, trials: int = 10) -> DataFrame:
    """(pathway, score, p_val): a set's score in each group, and the share of random sets of its size that score more, by more than TIE.

    All trials are one job: sets joined to the weights once. Features that the universe lacks raise ValueError.
    """
    spark: SparkSession = weights.sparkSession
    known = [r[0] for r in universe.select("feature").distinct().orderBy("feature").collect()]
    missing = set(featureset) - set(known)
    if missing:
        raise ValueError(f"not in the universe: {sorted(missing)[:3]}")
    kind = universe.schema["feature"].dataType.simpleString()
    sets = spark.createDataFrame([(-1, x) for x in featureset] + null_sets(known, len(featureset), trials), f"trial int, feature {kind}")
    hits = weights.join(F.broadcast(sets), "feature").groupBy("trial", "pathway").agg(F.sum("weight").alias("score"))
    grid = pathways.select("pathway").distinct().crossJoin(spark.range(-1, trials).select(F.col("id").cast("int").alias("trial")))
    scores = grid.join(hits, ["trial", "pathway"], "left").select("trial", "pathway", F.coalesce("score", F.lit(0.0)).alias("score"))
    own = scores.where("trial = -1").select("pathway", "score")
    null = scores.where("trial >= 0").select("pathway", F.col("score").alias("null"))
    return own.join(null, "pathway").groupBy("pathway", "score").agg(F.avg(F.when(F.col("score") < F.col("null") - TIE, 1.0).otherwise(0.0)).alias("p_val"))


@dataclass
class Expression:
    """A fitted transform: weights, and all groups."""

    weights: DataFrame
    pathways: DataFrame

    def transform(self, matrix: DataFrame) -> DataFrame:
        return transform(matrix, self.weights, self.pathways)

    def centrality_scores(self, featureset: DataFrame | None = None) -> DataFrame:
        return group_scores(self.weights, self.pathways, featureset)

    def rank(self, universe: DataFrame, featureset: list, trials: int = 10) -> DataFrame:
        return rank_groups(self.weights, self.pathways, universe, featureset, trials)


@dataclass
class LinearExpression:
    """Settings of equal weights; ``fit`` gives an Expression."""

    members: DataFrame
    features: DataFrame
    normalize: bool = True

    def fit(self, matrix: DataFrame | None = None) -> Expression:
        return Expression(linear_weights(self.members, self.features, self.normalize), self.members.select("pathway").distinct())


@dataclass
class CentralityExpression:
    """Settings of centrality weights; ``fit`` gives an Expression. Precomputed networks need no matrix."""

    members: DataFrame
    features: DataFrame
    centrality: str = "degree"
    network: str = "precomputed"
    edges: DataFrame | None = None
    directed: bool = True
    heat_kernel_parameter: float = 2
    normalize: bool = True

    def fit(self, matrix: DataFrame | None = None) -> Expression:
        networks = pathway_networks(matrix, self.members, self.features, self.edges, self.network, self.directed, self.heat_kernel_parameter)
        return Expression(centrality_weights(networks, self.members, self.features, self.centrality, self.normalize), self.members.select("pathway").distinct())
