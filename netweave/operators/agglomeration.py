"""Agglomeration of large networks in rounds: every two clusters that are each other's nearest merge at once.

For single, complete and average linkage a merge never brings clusters nearer than they were, so that such pairs are merged
in any clustering, and all of a round's merge together. Only pairs with an edge are held, as sums, largest or least distances; pairs without
one stand at the distance ``absent``, which no edge reaches, so that they matter last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.matrix import numbered
from netweave.sources.scratch import stored

#: Clusters made in round r have r in the bits above these, and their first item in these.
BITS = 40
METHODS = ("average", "complete", "single")
MERGES = "x long, y long, d double, round int, id long, size long"


def merged(pairs: DataFrame, turn: int) -> DataFrame:
    """(x, y, d, round, id, size) of the pairs (a, b, na, nb, d) that are each other's nearest; ties go to the least pair."""
    key = F.struct("d", "a", "b", "na", "nb")
    nearest = pairs.select(key.alias("key"), F.explode(F.array("a", "b")).alias("side")).groupBy("side").agg(F.min("key").alias("key"))
    both = nearest.groupBy("key").agg(F.count("*").alias("sides")).where("sides = 2")
    name = F.lit(turn << BITS).bitwiseOR(F.col("key.a").bitwiseAND((1 << BITS) - 1))
    return both.select(F.col("key.a").alias("x"), F.col("key.b").alias("y"), F.col("key.d").alias("d"), F.lit(turn).alias("round"), name.alias("id"), (F.col("key.na") + F.col("key.nb")).alias("size"))


def linkage_in_rounds(edges: DataFrame, nodes: DataFrame, method: str = "average", absent: float = 1.0) -> DataFrame:
    """(step, left, right, height, size), as of ``hierarchy.linkage``, of a symmetric network of any size; equal heights may come in another order.

    A distance is 1 - weight; weights of 0 count as no edge, and weights that stand farther than ``absent`` raise ValueError.
    """
    if method not in METHODS:
        raise ValueError(f"a network of this size is agglomerated by one of {METHODS}, not {method!r}")
    own = edges.where("weight <> 0 and src <> dst")
    if own.where(1 - F.col("weight") >= absent).limit(1).count():
        raise ValueError(f"edges have to stand nearer than {absent}")
    items = stored(numbered(nodes.select("node").distinct(), "node"))
    n = items.count()
    first, second = items.select(F.col("node").alias("src"), F.col("place").alias("a")), items.select(F.col("node").alias("dst"), F.col("place").alias("b"))
    one = F.lit(1).cast("long")
    value = 1 - F.col("weight") - (absent if method == "average" else 0.0)
    pairs = stored(own.join(first, "src").join(second, "dst").where("a < b").select("a", "b", one.alias("na"), one.alias("nb"), value.alias("s"), one.alias("held")))
    gather = {"average": F.sum, "complete": F.max, "single": F.min}[method]
    distance = absent + F.col("s") / (F.col("na") * F.col("nb")) if method == "average" else F.col("s")
    merges, turn = None, 1
    while True:
        near = pairs.where("held = na * nb") if method == "complete" else pairs
        now = stored(merged(near.withColumn("d", distance), turn))
        if not now.limit(1).count():
            break
        merges = now if merges is None else merges.unionByName(now)
        told = now.select(F.explode(F.array("x", "y")).alias("old"), "id", "size")
        moved = pairs
        for side in "ab":
            names = told.select(F.col("old").alias(side), F.col("id").alias("id_"), F.col("size").alias("size_"))
            moved = moved.join(names, side, "left").withColumns({side: F.coalesce("id_", side), f"n{side}": F.coalesce("size_", f"n{side}")}).drop("id_", "size_")
        low = F.col("a") < F.col("b")
        ordered = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"), "s", "held")
        pairs = stored(ordered.groupBy("a", "b", "na", "nb").agg(gather("s").alias("s"), F.sum("held").alias("held")))
        turn += 1
    # what is left has no edge in between, or not all of them: pairs of neighbours in order, until one is left
    made = items.select(F.col("place").alias("id"), one.alias("size"))
    gone = merges.select(F.explode(F.array("x", "y")).alias("id")) if merges is not None else made.select("id").limit(0)
    alone = made.unionByName(merges.select("id", "size")) if merges is not None else made
    left = stored(alone.join(gone, "id", "left_anti"))
    while left.limit(2).count() > 1:
        halves = numbered(left, "id").groupBy((F.col("place") / 2).cast("long").alias("half")).agg(F.min("id").alias("x"), F.max("id").alias("y"), F.sum("size").alias("size"))
        name = F.when(F.col("x") < F.col("y"), F.lit(turn << BITS).bitwiseOR(F.col("x").bitwiseAND((1 << BITS) - 1))).otherwise(F.col("x"))
        level = stored(halves.select("x", "y", F.lit(float(absent)).alias("d"), F.lit(turn).alias("round"), name.alias("id"), "size"))
        now = level.where("x < y")
        merges = now if merges is None else merges.unionByName(now)
        left = level.select("id", "size")
        turn += 1
    if merges is None:
        return edges.sparkSession.createDataFrame([], "step int, left long, right long, height double, size long")
    placed = stored(numbered(merges.withColumn("near", F.round("d", 12)), "near", "round", "x", name="step"))
    names = placed.select("id", (F.col("step") + n).alias("number"))
    ends = placed
    for side in "xy":
        ends = ends.join(names.select(F.col("id").alias(side), F.col("number").alias(f"n{side}")), side, "left").withColumn(f"n{side}", F.coalesce(f"n{side}", side))
    return ends.select(F.col("step").cast("int").alias("step"), F.least("nx", "ny").alias("left"), F.greatest("nx", "ny").alias("right"), F.col("d").alias("height"), "size")
