"""Feature networks as edges (src, dst, weight). Symmetric networks hold every edge in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.matrix import centred, column_products, numbered
from netweave.operators.products import column_pairs, largest, powers
from netweave.sources.scratch import stored

MEASURES = ("correlation", "heatkernel")
#: A network is multiplied as tiles where one in so many of its cells has an edge, and joined by its middle nodes where fewer have.
SPARSE = 16
#: Pairs of a dense network that a task makes, about.
TASK_PAIRS = 1_000_000


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges i < j in both directions."""
    turned = edges.select("src", "dst", "weight", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return turned.select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight")


def thresholded(weight: Column, epsilon: float) -> Column:
    """Weights below a positive ``epsilon``, negative ones included, are 0."""
    return F.when(weight < epsilon, 0.0).otherwise(weight) if epsilon > 0 else weight


def _cosines(dots: DataFrame) -> DataFrame:
    norms = dots.where("f1 = f2").select(F.col("f1").alias("f"), F.when(F.col("dot") == 0, 1.0).otherwise(F.sqrt("dot")).alias("norm"))
    first, second = norms.select(F.col("f").alias("f1"), F.col("norm").alias("n1")), norms.select(F.col("f").alias("f2"), F.col("norm").alias("n2"))
    return dots.where("f1 <> f2").join(first, "f1").join(second, "f2").select(F.col("f1").alias("src"), F.col("f2").alias("dst"), (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("r"))


def correlation(matrix: DataFrame, epsilon: float = 0, negative: bool = False, center: bool = False) -> DataFrame:
    """Cosines of columns (with ``center``, or of a scaled matrix, Pearson's correlation), absolute unless ``negative``, at most 1, without loops."""
    r = F.col("r") if negative else F.abs("r")
    cosines = _cosines(column_products(centred(matrix) if center else matrix))
    return mirrored(cosines.select("src", "dst", thresholded(F.least(r, F.lit(1.0)), epsilon).alias("weight")))


def heat_kernel(matrix: DataFrame, parameter: float = 2, order: float = 2, epsilon: float = 0) -> DataFrame:
    """exp(-d^2 / (2 parameter)) of the columns' distances of Minkowski ``order`` (inf: the largest difference); absent cells are 0."""
    if order == 2:
        dots = column_products(matrix)
        own = dots.where("f1 = f2")
        first, second = own.select("f1", F.col("dot").alias("d1")), own.select("f2", F.col("dot").alias("d2"))
        far = dots.where("f1 <> f2").join(first, "f1").join(second, "f2").select(F.col("f1").alias("src"), F.col("f2").alias("dst"), F.greatest(F.col("d1") + F.col("d2") - 2 * F.col("dot"), F.lit(0.0)).alias("square"))
    else:
        top = order == float("inf")
        gaps = column_pairs(matrix.select("subject", "feature", "value"), largest if top else powers(order), maximum=top).where("f1 <> f2")
        distance = F.col("dot") if top else F.pow("dot", F.lit(1.0 / order))
        far = gaps.select(F.col("f1").alias("src"), F.col("f2").alias("dst"), F.pow(distance, F.lit(2.0)).alias("square"))
    return mirrored(far.select("src", "dst", thresholded(F.exp(-F.col("square") / (2.0 * parameter)), epsilon).alias("weight")))


def adjacency(matrix: DataFrame, measure: str, epsilon: float = 0, negative: bool = False, parameter: float = 2, order: float = 2) -> DataFrame:
    """The network of a ``measure``: correlation or heatkernel. There is no default, and no partial correlation."""
    if measure == "correlation":
        return correlation(matrix, epsilon, negative)
    if measure.replace("_", "") == "heatkernel":
        return heat_kernel(matrix, parameter, order, epsilon)
    raise ValueError(f"measure {measure!r} is none of {MEASURES}")


def fisher_difference(matrix: DataFrame, label: str = "label", negative: bool = False) -> DataFrame:
    """Difference of the two classes' Fisher-transformed cosines over its standard error; label 0 less label 1.

    Both classes need more than three subjects; else the weight is null. Cosines of exactly 1 or beyond count as
    just below it, on both sides.
    """
    def transformed(k: int) -> DataFrame:
        near = F.least(F.greatest(F.col("r"), F.lit(-0.99999999)), F.lit(0.99999999))
        return _cosines(column_products(matrix, F.col(label) == k)).select("src", "dst", F.atanh(near).alias(f"z{k}"))

    sizes = matrix.groupBy().agg(*[F.count_distinct(F.when(F.col(label) == k, F.col("subject"))).alias(f"n{k}") for k in (0, 1)])
    error = F.when((F.col("n0") > 3) & (F.col("n1") > 3), F.sqrt(1 / F.greatest(F.col("n0") - 3, F.lit(1)) + 1 / F.greatest(F.col("n1") - 3, F.lit(1))))
    z = (F.col("z0") - F.col("z1")) / error
    both = transformed(0).join(transformed(1), ["src", "dst"]).crossJoin(F.broadcast(sizes))  # sizes is one row
    return mirrored(both.select("src", "dst", (z if negative else F.abs(z)).alias("weight")))


def topological_overlap(edges: DataFrame) -> DataFrame:
    """Overlap of two nodes' neighbourhoods, (shared + a) / (least degree + 1 - a), of a symmetric network without loops; 1 on the diagonal is left out."""
    size = edges.agg(F.count("*").alias("cells"), F.count_distinct("dst").alias("nodes")).first()
    if size.cells * SPARSE >= size.nodes**2:  # as products of columns; zeros are no common neighbours
        products = column_products(edges.select(F.col("src").alias("subject"), F.col("dst").alias("feature"), F.col("weight").alias("value")))
        shared = products.where("f1 <> f2 and dot <> 0").select(F.col("f1").alias("src"), F.col("f2").alias("dst"), F.col("dot").alias("shared"))
    else:
        left = edges.select("src", F.col("dst").alias("mid"), F.col("weight").alias("a"))
        right = edges.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("b"))
        shared = left.join(right, "mid").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("shared")).where("shared <> 0")
    degree = edges.groupBy("dst").agg(F.sum("weight").alias("k"))
    direct = edges.where("src < dst").select("src", "dst", F.col("weight").alias("w"))
    pairs = shared.join(direct, ["src", "dst"], "full")
    k1, k2 = degree.select(F.col("dst").alias("src"), F.col("k").alias("k1")), degree.select("dst", F.col("k").alias("k2"))
    w = F.coalesce("w", F.lit(0.0))
    overlap = (F.coalesce("shared", F.lit(0.0)) + w) / (F.least("k1", "k2") + 1 - w)
    return mirrored(pairs.join(k1, "src").join(k2, "dst").select("src", "dst", overlap.alias("weight")))


def similarity_to_distance(edges: DataFrame) -> DataFrame:
    """sqrt(2 (1 - weight)); null where the weight is above 1."""
    return edges.withColumn("weight", F.when(F.col("weight") <= 1, F.sqrt(2 * (1 - F.col("weight")))))


def coded_network(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(pathway, src, dst, weight) of coded cells: 1 is an edge, 2 an edge both ways; other codes keep their value.

    Without ``directed``, edges whose reverse is missing or of another weight are removed.
    """
    back = edges.where("code = 2").select("pathway", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight"), F.lit(1).alias("first"))
    own = edges.select("pathway", "src", "dst", F.when(F.col("code") == 2, 1.0).otherwise(F.col("code")).alias("weight"), F.when(F.col("code") == 2, 1).otherwise(0).alias("first"))
    network = own.unionByName(back).groupBy("pathway", "src", "dst").agg(F.max_by("weight", "first").alias("weight")).where("weight <> 0")
    if directed:
        return network
    reverse = network.select("pathway", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return network.join(reverse, ["pathway", "src", "dst", "weight"], "left_semi")


def supra_adjacency(matrices: DataFrame, measure: str, epsilon: float = 0, parameter: float = 2) -> DataFrame:
    """(src_t, src, dst_t, dst, weight) of a network for each ``t``, and of couplings from a layer's nodes to themselves one layer earlier.

    ``measure``: correlation, or heatkernel with its ``parameter`` (distances of the columns over the layer's subjects).
    A coupling's weight is the mean of all cells of all layers, zeros included. Layers are numbered without gaps.
    """
    if measure.replace("_", "") not in MEASURES:
        raise ValueError(f"measure {measure!r} is none of {MEASURES}")
    left = matrices.select("t", "subject", F.col("feature").alias("src"), F.col("value").alias("a"))
    right = matrices.select("t", "subject", F.col("feature").alias("dst"), F.col("value").alias("b"))
    dots = left.join(right, ["t", "subject"]).where("src <= dst").groupBy("t", "src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    own = dots.where("src = dst").select("t", F.col("src").alias("f"), F.col("dot").alias("square"))
    names = own.select("t", F.col("f").alias("src"), F.col("square").alias("s1")).join(own.select("t", F.col("f").alias("dst"), F.col("square").alias("s2")), "t").where("src < dst")
    pairs = names.join(dots, ["t", "src", "dst"], "left")  # columns without a common subject have product 0
    dot = F.coalesce("dot", F.lit(0.0))
    norm = lambda s: F.when(F.col(s) == 0, 1.0).otherwise(F.sqrt(s))
    cosine = F.least(F.abs(dot / (norm("s1") * norm("s2"))), F.lit(1.0))
    heat = F.exp(-F.greatest(F.col("s1") + F.col("s2") - 2 * dot, F.lit(0.0)) / (2.0 * parameter))
    cells = (pairs.where("dot is not null").select("t", "src", "dst", thresholded(cosine, epsilon).alias("weight")) if measure == "correlation" else pairs.select("t", "src", "dst", thresholded(heat, epsilon).alias("weight")))
    layers = cells.select("t", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), "weight").select(F.col("t").alias("src_t"), "e.src", F.col("t").alias("dst_t"), "e.dst", "weight")
    size = matrices.agg(F.count_distinct("t").alias("layers"), F.count_distinct("feature").alias("nodes"), F.min("t").alias("first"))
    mean = layers.agg(F.sum("weight").alias("total")).crossJoin(size).select((F.col("total") / (F.col("layers") * F.col("nodes") * F.col("nodes"))).alias("weight"), "first")
    steps = matrices.select("t", "feature").distinct().crossJoin(F.broadcast(mean)).where("t > first")  # mean is one row
    couplings = steps.select(F.col("t").alias("src_t"), F.col("feature").alias("src"), (F.col("t") - 1).alias("dst_t"), F.col("feature").alias("dst"), "weight")
    return layers.unionByName(couplings)


def random_pairs(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(src, dst, weight) of all pairs src < dst of ``nodes`` (node), with weights in [0, 1) that a hash of the pair and the seed gives.

    Tasks take some of the nodes each, against all others, however few files the nodes come from.
    """
    n = nodes.count()
    one = nodes.select(F.col("node").alias("src")).repartition(max(1, n * (n - 1) // 2 // TASK_PAIRS), "src")
    other = nodes.select(F.col("node").alias("dst"))  # small beside its square
    code = F.md5(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(str(seed))).cast("binary"))
    weight = F.conv(F.substring(code, 1, 8), 16, 10).cast("double") / 4294967296.0
    return one.join(F.broadcast(other), F.col("src") < F.col("dst")).select("src", "dst", weight.alias("weight"))


def random_weights(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """A symmetric network of all pairs of ``nodes`` (node), weighted as random_pairs, and no loops.

    The result has all pairs, so that its size is that of a dense matrix; the weights are the same on any cluster.
    """
    return mirrored(random_pairs(nodes, seed))


def random_graph(spark: SparkSession, nodes: int, seed: int = 0) -> DataFrame:
    """random_weights of the nodes from 0."""
    return random_weights(spark.range(nodes).withColumnRenamed("id", "node"), seed)


def keyed(seed: int, turn: Column, x: Column) -> Column:
    """48 bits of a hash of the seed, the turn and a number."""
    code = F.md5(F.concat_ws("-", F.lit(str(seed)), turn.cast("string"), x.cast("string")).cast("binary"))
    return F.conv(F.substring(code, 1, 12), 16, 10).cast("long")


def pair_numbers(spark: SparkSession, nodes: int, edges: int, seed: int = 0, rounds: int = 4) -> DataFrame:
    """(i, j) of ``edges`` different pairs of the numbers below ``nodes``, drawn without forming any other pair.

    The n (n - 1) / 2 pairs are a grid: n by (n - 1) / 2 for an odd n (a number, and the distance to the next, around a circle), n / 2 by
    n - 1 for an even one (a place and a round of a tournament). The first cells of the grid are permuted by Feistel rounds, each of which moves a cell
    along one side by a keyed hash of the other. Rounds are one to one, so that no pair comes twice.
    """
    odd = nodes % 2 == 1
    p, q = (nodes, (nodes - 1) // 2) if odd else (nodes // 2, nodes - 1)
    p, q, ring = max(p, 1), max(q, 1), max(nodes - 1, 1)

    def turned(cell: Column, turn: Column) -> Column:
        side = (cell["l"] + keyed(seed, turn, cell["r"]) % p) % p
        other = (cell["r"] + keyed(seed, turn, cell["l"]) % q) % q
        return F.when(turn % 2 == 0, F.struct(side.alias("l"), cell["r"].alias("r"))).otherwise(F.struct(cell["l"].alias("l"), other.alias("r")))

    first = F.struct(F.expr(f"id div {q}").alias("l"), (F.col("id") % q).alias("r"))
    turns = F.sequence(F.lit(0), F.lit(2 * rounds - 1))
    cells = spark.range(min(edges, nodes * (nodes - 1) // 2)).select(F.aggregate(turns, first, turned).alias("c")).select("c.l", "c.r")
    if odd:
        return cells.select(F.col("l").alias("i"), ((F.col("l") + F.col("r") + 1) % nodes).alias("j"))
    met = F.col("l") == 0
    return cells.select(F.when(met, nodes - 1).otherwise((F.col("r") + F.col("l")) % ring).alias("i"), F.when(met, F.col("r")).otherwise((F.col("r") - F.col("l") + ring) % ring).alias("j"))


def hashed_graph(nodes: DataFrame, edges: int, seed: int = 0) -> DataFrame:
    """A graph of ``edges`` unweighted edges among the pairs of ``nodes`` (node), all pairs if there are fewer; the same everywhere.

    Its work is that of numbering the nodes and of ``edges`` rows, whatever the number of pairs.
    """
    places = stored(numbered(nodes.select("node").distinct(), "node"))
    drawn = pair_numbers(nodes.sparkSession, places.count(), edges, seed)
    ends = drawn.join(places.select(F.col("place").alias("i"), F.col("node").alias("a")), "i").join(places.select(F.col("place").alias("j"), F.col("node").alias("b")), "j")
    return mirrored(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("weight")))
