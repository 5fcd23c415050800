"""Permutation index for nearest neighbours by inner product.

A vector is represented by its nearest pivots in order. Each block of rows posts its vectors in inverted files, one list
of (row, place) a pivot. A query reads the lists of its own pivots and sums what the footrule distance of two such orders
leaves: both lists' places count, a pivot that one lacks stands at the end of it. Vectors whose footrule is within a bound
are ranked again by their products, in double precision.

Pivots are PIVOTS distinct vectors of least hash, and the bound is the footrule within which TARGET of the true
neighbours of SAMPLE queries lie, which are searched exactly: both samples are bounded, and every row is indexed. The bound
caps nothing: all vectors within it are compared, however many; a query that finds fewer than asked is compared with all rows.

Largest products are nearest angles once vectors, over the largest length, get one more coordinate that makes their length 1,
and queries a 0; permutations are made of these.

Blocks of rows stay in their tasks, and one block of queries at a time is broadcast, of QUERIES rows on average; a task
hands on the best of its rows for each query.

Defined cases: rows without id, and vectors null, zero, or with null or non-finite components, take no part. A shorter
vector ends in zeros. Rows that share an id are candidates each, but none for a query of that id; equal queries of one id count
once, others of it have their results together. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import hand_back, shared_folder, stored

PIVOTS, PREFIX, SAMPLE, TARGET = 512, 64, 128, 0.96
#: Rows of an index block, and queries of a block on average.
ROWS, QUERIES = 16384, 4096
FOUND = "query_id long, vec_id long, score double, shared long"
INDEX = "ids binary, vectors binary, lists binary, rows binary, places binary"


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, in double precision."""
    own = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return own.where(finite & F.exists("vector", lambda x: x != 0))


def length(vector: Column) -> Column:
    """The Euclidean length, scaled by the largest component so that squares do not overflow."""
    top = F.array_max(F.transform(vector, F.abs))
    return top * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrays of numbers as rows, with zeros behind shorter ones."""
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def chosen_pivots(vectors: DataFrame, width: int, top: float) -> np.ndarray:
    """The PIVOTS distinct vectors of least hash, on the unit sphere. A task hands on as many of its own at most."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[float]] = {}
        for batch in batches:
            held |= dict(zip(batch.column("h").to_pylist(), batch.column("vector").to_pylist(), strict=True))
            held = {h: held[h] for h in sorted(held)[:PIVOTS]}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.list_(pa.float64()))], names=["h", "vector"])

    rows = vectors.select(F.xxhash64("vector").alias("h"), "vector").mapInArrow(least, "h long, vector array<double>").dropDuplicates(["h"]).orderBy("h").limit(PIVOTS)
    return on_sphere(matrix(pa.array([r.vector for r in rows.collect()], pa.list_(pa.float64())), width), top)


def on_sphere(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors over the largest length, with the coordinate that makes their length 1."""
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The first PREFIX pivots of each row, nearest first."""
    near, k = x @ pivots.T, min(PREFIX, len(pivots))
    first = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def built(vectors: DataFrame, pivots: np.ndarray, width: int, top: float) -> DataFrame:
    """One row for each block of rows of a task: ids, vectors, and the inverted file of its pivots."""

    def block(ids: list[np.ndarray], xs: list[np.ndarray]) -> pa.RecordBatch:
        own, x = np.concatenate(ids), np.concatenate(xs)
        order = nearest_pivots(on_sphere(x, top), pivots)
        n, k = order.shape
        post = np.argsort(order.ravel(), kind="stable")  # by pivot, then by row
        edges = np.searchsorted(order.ravel()[post], np.arange(len(pivots) + 1))
        told = (own.astype(np.int64), x, edges.astype(np.int32), (post // k).astype(np.uint16), (post % k).astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in told], names=["ids", "vectors", "lists", "rows", "places"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy())
                xs.append(matrix(batch.column("vector"), width))
            if sum(map(len, ids)) >= ROWS - 1000:  # a batch has 1000 rows at most
                yield block(ids, xs)
                ids, xs = [], []
        if ids:
            yield block(ids, xs)
        hand_back()

    return stored(vectors.mapInArrow(blocks, INDEX))


def query_blocks(queries: DataFrame, count: int, width: int) -> DataFrame:
    """(block, query_ids, queries): the queries, packed by blocks of QUERIES on average."""
    blocks = max(1, math.ceil(count / QUERIES))

    def pack(group: pa.Table) -> pa.Table:
        x = matrix(group.column("vector").combine_chunks(), width)
        return pa.table({"block": group.column("block").slice(0, 1), "query_ids": pa.array([group.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "queries": pa.array([x.tobytes()], pa.binary())})

    dealt = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, query_ids binary, queries binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nearest(index: DataFrame, block: DataFrame, pivots: np.ndarray, width: int, k: int, bound: int) -> DataFrame:
    """(query_id, vec_id, score, shared): for each task of the index the k best of its rows for each query of a broadcast block.

    ``shared`` is what the footrule leaves of its largest value, halved; rows below ``bound`` are not compared.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        names = queries = orders = None
        for batch in batches:
            for row in batch.to_pylist():
                if names is None:
                    names = np.frombuffer(row["query_ids"], np.int64)
                    queries = np.frombuffer(row["queries"], np.float64).reshape(-1, width)
                    turned = queries / np.abs(queries).max(axis=1, keepdims=True)
                    turned = turned / np.sqrt((turned * turned).sum(axis=1, keepdims=True))
                    orders = nearest_pivots(np.hstack([turned, np.zeros((len(turned), 1))]), pivots)
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
                edges, rows, places = np.frombuffer(row["lists"], np.int32), np.frombuffer(row["rows"], np.uint16), np.frombuffer(row["places"], np.uint8)
                prefix = orders.shape[1]
                shares = (prefix - places).astype(np.int16)
                for q in range(len(names)):
                    shared = np.zeros(len(ids), np.int16)
                    for place, pivot in enumerate(orders[q]):
                        own = slice(edges[pivot], edges[pivot + 1])
                        shared[rows[own]] += np.minimum(shares[own], np.int16(prefix - place))
                    near = np.flatnonzero((shared >= bound) & (ids != names[q]))
                    if not len(near):
                        continue
                    rough = x[near] @ queries[q]
                    if len(near) > k:  # products of equal rows may differ in their last bits here, so that those below are summed in order
                        kth = np.partition(rough, -k)[-k]
                        near = near[rough >= kth - 1e-9 * np.abs(rough).max()]
                    score = np.zeros(len(near))
                    for d in range(width):
                        score += x[near, d] * queries[q, d]
                    at, score, kept = ids[near], score, shared[near]
                    if q in held:
                        at, score, kept = (np.concatenate(c) for c in zip(held[q], (at, score, kept), strict=True))
                    first = best(score, at, k)
                    held[q] = at[first], score[first], kept[first]
        for some in range(0, len(held), 1000):
            part = [(names[q], *held[q]) for q in list(held)[some : some + 1000]]
            columns = [np.repeat([p[0] for p in part], [len(p[1]) for p in part]), *[np.concatenate([p[c] for p in part]) for c in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3].astype(np.int64))], names=["query_id", "vec_id", "score", "shared"])
        hand_back()

    return index.crossJoin(F.broadcast(block)).mapInArrow(search, FOUND)  # one row of QUERIES queries on average


def ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def searched(index: DataFrame, queries: DataFrame, count: int, pivots: np.ndarray, width: int, k: int, bound: int) -> DataFrame:
    """The k best of all rows within the bound for each query, a block of queries after the other."""
    blocks, path = stored(query_blocks(queries, count, width)), shared_folder(index.sparkSession)
    for r in blocks.select("block").collect():
        nearest(index, blocks.where(F.col("block") == r.block), pivots, width, k, bound).write.mode("append").parquet(path)
    return ranked(index.sparkSession.read.schema(FOUND).parquet(path), k)


def nearest_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id ``every`` divides, against all rows."""
    vectors = usable(embeddings, id_col, vector_col)
    queries = vectors.where(F.col("vec_id") % every == 0)
    told = vectors.agg(F.max(F.size("vector")).alias("width"), F.max(length(F.col("vector"))).alias("top"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    if not told.queries:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = chosen_pivots(vectors, told.width, told.top)
    index = built(vectors, pivots, told.width, told.top)
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).dropDuplicates(["vector"])
    true = sorted(r.shared for r in searched(index, sample, SAMPLE, pivots, told.width, k, 0).collect())  # SAMPLE times k rows at most
    bound = true[int((1 - TARGET) * len(true))] if true else 0
    found = stored(searched(index, queries, told.queries, pivots, told.width, k, bound))
    fewer = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = stored(queries.join(fewer.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    left = short.count()
    if left:
        whole = searched(index, short, left, pivots, told.width, k, 0)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
