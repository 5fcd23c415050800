"""The leading eigenvector of a directed or signed network, by restarted Arnoldi iteration on the table of edges.

The basis is a table of one row a node with an array of basis entries. A step is one join of the edges with the newest entry, and two
sums of products that make the result orthogonal, twice, to all entries before. The driver holds the small Hessenberg matrix of these sums alone.
Where the basis is full, the iteration starts again from the leading Ritz vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.sources.scratch import stored

#: Entries of a full basis, restarts at most, and the length of a residual over the eigenvalue's size at which a vector counts as found.
BASIS, RESTARTS, TOLERANCE = 24, 40, 1e-9


def mixed(factors: np.ndarray, entries: str = "v") -> Column:
    """The sum of a node's basis entries, each times its factor."""
    return sum((F.lit(float(x)) * F.col(entries)[k] for k, x in enumerate(factors)), F.lit(0.0))


def leading_ritz(hessenberg: np.ndarray) -> tuple[complex, np.ndarray]:
    """The eigenvalue of largest real part, and its vector."""
    values, vectors = np.linalg.eig(hessenberg)
    best = np.argmax(values)
    return values[best], vectors[:, best]


def leading(nodes: DataFrame, multiply: Callable[[DataFrame], DataFrame], basis: int = BASIS, restarts: int = RESTARTS, tolerance: float = TOLERANCE) -> tuple[complex, DataFrame]:
    """(eigenvalue of largest real part, (node, x): the real part of its vector, of any length and sign) of the map ``multiply``.

    ``nodes``: (node), each once, one at least; ``multiply`` takes (node, last) and gives (node, got), nodes of product 0 left out or not. The start is a hash of
    the nodes, so that it is the same everywhere. Raises RuntimeError where the restarts do not suffice: where leading eigenvalues are equal or nearly so.
    """
    start = 1 + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = stored(nodes.select("node", start.alias("x")))
    for _ in range(restarts):
        length = rows.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        rows = rows.select("node", F.array(F.col("x") / length).alias("v"))
        hessenberg = np.zeros((basis + 1, basis))
        for j in range(basis):
            products = multiply(rows.select("node", F.col("v")[j].alias("last")))
            rows = stored(rows.join(products, "node", "left").select("node", "v", F.coalesce("got", F.lit(0.0)).alias("w")))
            along = np.array(rows.agg(*[F.sum(F.col("v")[k] * F.col("w")) for k in range(j + 1)]).first())
            rest = rows.withColumn("w", F.col("w") - mixed(along))
            *again, square = rest.agg(*[F.sum(F.col("v")[k] * F.col("w")) for k in range(j + 1)], F.sum(F.col("w") * F.col("w"))).first()
            again = np.array(again)
            beyond = max(square - again @ again, 0.0) ** 0.5
            hessenberg[: j + 1, j] = along + again
            hessenberg[j + 1, j] = beyond
            value, y = leading_ritz(hessenberg[: j + 1, : j + 1])
            scale = max(abs(value), np.abs(hessenberg).max() * 1e-6, 1e-300)
            found = beyond * abs(y[-1]) <= tolerance * scale
            if found or j + 1 == basis:
                break
            rows = rest.select("node", F.concat("v", F.array((F.col("w") - mixed(again)) / beyond)).alias("v"))
        rows = stored(rows.select("node", mixed(y.real).alias("x")))
        if found:
            return value, rows
    raise RuntimeError(f"{restarts} restarts leave a residual of {beyond * abs(y[-1]):.1e}")


def leading_vector(edges: DataFrame, nodes: DataFrame, basis: int = BASIS, restarts: int = RESTARTS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, score): the eigenvector of the eigenvalue of largest real part, its real part, of length 1 and a nonnegative sum.

    ``edges``: (src, dst, weight) of any direction and sign, several of a pair being added; ``nodes``: (node), isolated ones included. A node's product is the sum
    over its edges of the weight times the entry of the edge's end. A network without nodes gives no row; one without edges
    has every vector, and gives the start.
    """
    own = stored(nodes.select("node").distinct())
    if not own.limit(1).count():
        return own.select("node", F.lit(0.0).alias("score"))

    def products(near: DataFrame) -> DataFrame:
        ends = near.select(F.col("node").alias("dst"), "last")
        return edges.join(ends, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("last")).alias("got"))

    value, rows = leading(own, products, basis, restarts, tolerance)
    told = rows.agg(F.sum("x").alias("total"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).first()
    length = told.length if abs(value.imag) == 0 else 1.0  # of a complex vector the whole has length 1
    return rows.select("node", (F.col("x") / (-length if told.total < 0 else length)).alias("score"))
