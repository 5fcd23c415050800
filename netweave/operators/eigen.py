"""Lowest eigenvectors of a network's Laplacian, by block Lanczos with thick restart on the table of edges.

The basis is a table: one row a node, with an array of basis entries and one of the Laplacian's products with them. A step
multiplies the newest columns by one join with the edges, and everything else is sums over nodes: the projected matrix,
the residuals and their products with the basis, small matrices of which every task sends its own. The driver holds
these alone, never a column. Where the basis is full it is turned into its best Ritz vectors (the thick restart), which
needs no product.

The block lets eigenvalues have copies, of networks in several parts for example, up to its width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.sources.scratch import stored

#: Columns that are multiplied at once beside the asked ones; columns of a full basis beside twice the block.
EXTRA, BASIS = 6, 40
#: Length of a residual over the Laplacian's bound at which a vector counts as found, and steps at most.
TOLERANCE, STEPS = 1e-10, 300


@dataclass
class Lowest:
    """Eigenvalues, ascending, the table (node, entries) of their vectors, and the largest residual over the Laplacian's bound."""

    values: np.ndarray
    vectors: DataFrame
    residual: float


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def summed(rows: DataFrame, kernel, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of ``kernel`` (of a batch of (v, l)): a small matrix."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += kernel(stacked(batch["v"]), stacked(batch["l"]))
        yield pd.DataFrame({"place": np.arange(total.size), "x": total.ravel()})

    sums = rows.select("v", "l").mapInPandas(each, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in sums:
        out[r.place] = r.x
    return out.reshape(shape)


def turned(rows: DataFrame, kind: str, kernel) -> DataFrame:
    """(node, degree, v, l, x): the arrays that ``kernel`` (of a batch's v and l) gives for a batch's nodes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v, l, x = kernel(stacked(batch["v"]), stacked(batch["l"]))  # noqa: E741
                yield pd.DataFrame({"node": batch["node"], "degree": batch["degree"], "v": list(v), "l": list(l), "x": list(x)})

    return rows.select("node", "degree", "v", "l").mapInPandas(each, f"node {kind}, degree double, v array<double>, l array<double>, x array<double>")


def multiplied(rows: DataFrame, edges: DataFrame, width: int, fiedler: bool) -> DataFrame:
    """(node, degree, v, l): ``x`` becomes columns of v, and the Laplacian's product with it columns of l."""
    root = F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(0.0)
    scale = F.lit(1.0) if fiedler else root
    near = rows.select(F.col("node").alias("dst"), *[(scale * F.col("x")[k]).alias(f"x{k}") for k in range(width)])
    sums = edges.join(near, "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("weight") * F.col(f"x{k}")).alias(f"s{k}") for k in range(width)])
    got = lambda k: F.coalesce(f"s{k}", F.lit(0.0))
    own = lambda k: F.col("degree") * F.col("x")[k] - got(k) if fiedler else root * (F.col("degree") * root * F.col("x")[k] - got(k))
    return stored(rows.join(sums, "node", "left").select("node", "degree", F.concat("v", "x").alias("v"), F.concat("l", F.array(*[own(k) for k in range(width)])).alias("l")))


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal, without directions that rounding alone gives."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values[-1], 0) * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def lowest(edges: DataFrame, nodes: DataFrame, count: int, fiedler: bool = True, tolerance: float = TOLERANCE, steps: int = STEPS, basis: int = BASIS) -> Lowest:
    """The ``count`` lowest eigenvalues and vectors of the Laplacian of a symmetric network; without ``fiedler`` the normalised one.

    ``edges``: (src, dst, weight), both ways; ``nodes``: (node), isolated ones included. Vectors have length 1 and any sign. The start
    is a hash of the nodes, so that it is the same everywhere. Raises ValueError where the network is not symmetric, and
    RuntimeError where ``steps`` do not suffice.
    """
    reverse = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    odd = edges.join(reverse, ["src", "dst"], "left").where(F.abs(F.col("weight") - F.coalesce("back", F.lit(0.0))) > 1e-12 + 1e-9 * F.abs("weight"))
    if odd.limit(1).count():
        raise ValueError("a Laplacian needs a symmetric network")
    kind = nodes.schema["node"].dataType.simpleString()
    sums = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("degree"), F.sum(F.abs("weight")).alias("reach"))
    degrees = nodes.select("node").distinct().join(sums, "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("reach", F.lit(0.0)).alias("reach"))
    told = degrees.agg(F.count("*").alias("n"), F.max(F.col("reach") + F.abs("degree")).alias("bound")).first()
    count = min(count, told.n)
    none = F.array().cast("array<double>")
    if not told.n:
        return Lowest(np.zeros(0), degrees.select("node", none.alias("entries")), 0.0)
    bound = max(told.bound if fiedler else 2.0, 1e-300)
    width = min(count + EXTRA, told.n)
    start = F.array(*[F.xxhash64(F.lit(k), F.col("node")) / F.lit(2.0**63) for k in range(width)])
    rows = stored(degrees.select("node", "degree", none.alias("v"), start.alias("l")))
    turn = orthonormal(summed(rows, lambda v, l: l.T @ l, (width, width)))
    rows = stored(turned(rows, kind, lambda v, l, t=turn: (v, np.zeros((len(l), 0)), l @ t)))
    size = turn.shape[1]
    rows = multiplied(rows, edges, size, fiedler)
    for _ in range(steps):
        gram = summed(rows, lambda v, l: np.hstack([v.T @ v, v.T @ l]), (size, 2 * size))
        own, projected = gram[:, :size], gram[:, size:]
        unit = orthonormal(own)
        values, y = np.linalg.eigh(unit.T @ (projected + projected.T) / 2 @ unit)
        y = unit @ y
        wide = min(width, y.shape[1])

        def residuals(v: np.ndarray, l: np.ndarray, y: np.ndarray = y[:, :wide], values: np.ndarray = values[:wide]) -> np.ndarray:  # noqa: E741
            return l @ y - (v @ y) * values

        products = summed(rows, lambda v, l, f=residuals: (lambda r: np.vstack([v.T @ r, r.T @ r]))(f(v, l)), (size + wide, wide))
        off = np.sqrt(np.maximum(np.diag(products[size:]), 0)) / bound
        if off[:count].max() <= tolerance or size >= told.n or size > y.shape[1] + width:
            found = stored(turned(rows, kind, lambda v, l, y=y[:, :count]: (v @ y, l[:, :0], l[:, :0])).select("node", F.col("v").alias("entries")))
            return Lowest(values[:count], found, float(off[:count].max()))
        along = np.linalg.solve(own, products[:size])
        rest = products[size:] - products[:size].T @ along
        open_ones = np.flatnonzero(off > tolerance / 10)
        scale = np.diag(1 / np.sqrt(np.maximum(np.diag(rest)[open_ones], 1e-300)))  # residuals differ in length
        turn = np.zeros((wide, 0))
        if len(open_ones):
            turn = np.zeros((wide, len(open_ones)))
            turn[open_ones] = scale
            turn = turn @ orthonormal(scale @ rest[np.ix_(open_ones, open_ones)] @ scale)
        turn = turn[:, : told.n - size]
        keep = y[:, : min(y.shape[1], wide + width)] if size + turn.shape[1] > basis + 2 * width else np.eye(size)

        def grown(v: np.ndarray, l: np.ndarray, f=residuals, along: np.ndarray = along, turn: np.ndarray = turn, keep: np.ndarray = keep) -> tuple:  # noqa: E741
            return v @ keep, l @ keep, (f(v, l) - v @ along) @ turn

        rows = multiplied(stored(turned(rows, kind, grown)), edges, turn.shape[1], fiedler)
        size = keep.shape[1] + turn.shape[1]
    raise RuntimeError(f"{steps} steps leave a residual of {off[:count].max():.1e}")


def signed(vectors: DataFrame, places: list[int]) -> DataFrame:
    """(node, v0, v1, ...): the entries at ``places``, in the sign in which the largest (to nine places; of several that of the least node) is positive."""
    chosen = vectors.select("node", *[F.col("entries")[p].alias(f"v{k}") for k, p in enumerate(places)])
    peak = [F.min_by(F.col(f"v{k}"), F.struct(-F.round(F.abs(f"v{k}"), 9), F.col("node"))).alias(f"p{k}") for k in range(len(places))]
    peaks = chosen.agg(*peak)  # one row
    return chosen.crossJoin(F.broadcast(peaks)).select("node", *[F.when(F.col(f"p{k}") < 0, -F.col(f"v{k}")).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in range(len(places))])
