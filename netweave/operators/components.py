"""Connected components by joins that no hub can turn into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.sources.scratch import stored

#: Tasks among which the rows of one key are dealt.
SALT = 16
#: Labels up to which Spark may broadcast them, SALT times (some 100 MB).
BROADCAST_LABELS = 100_000


def salted_join(many: DataFrame, single: DataFrame, key: str, how: str = "inner", merge: bool = False) -> DataFrame:
    """``many`` joined by ``key`` with ``single``, which has a key once and is small beside it: a key's rows go to SALT tasks.

    Spark takes ``single`` to be as large as its files, which are compressed and hold each row once; ``merge`` keeps it from a broadcast.
    """
    spread = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    if merge:
        spread = spread.hint("merge")
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALT)).cast("int"))
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b), which holds every edge both ways: the least node that they reach.

    Each round takes the least label of a node and its neighbours, and then that label's own label, so that the
    rounds grow with the logarithm of a chain's length.
    """
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    large = labels.count() > BROADCAST_LABELS
    while True:
        told = labels.select(F.col("node").alias("b"), F.col("component").alias("m"))
        near = salted_join(edges, told, "b", merge=large).groupBy(F.col("a").alias("node")).agg(F.min("m").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("m")))
        beyond = step.select(F.col("node").alias("m"), F.col("m").alias("beyond"))
        least = F.least("m", "beyond")
        after = stored(salted_join(step, beyond, "m", merge=large).select("node", least.alias("component"), (least != F.col("was")).alias("moved")))
        labels = after.select("node", "component")
        if not after.where("moved").limit(1).count():
            return labels
