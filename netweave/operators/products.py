"""Products and distances of all pairs of columns, tile by tile, for matrices of any number of subjects and features.

Features are dealt to tiles and subjects to row blocks by their hashes. A task packs the cells of one tile and block into
a dense array; the tiles of a block meet by its number, are combined pair by pair, and what each pair of tiles gets from the blocks is
summed as it comes. So no task holds more than two blocks and one result tile. Absent cells count as 0, and every pair of
features has a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.sources.scratch import stored

#: Features of a tile, and subjects of a row block, on average.
TILE, ROWS = 512, 4096
#: Result cells handed on at once.
CELLS = 1 << 16


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.T @ b


def powers(order: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sums over rows of the columns' differences to a power."""
    return lambda a, b: np.stack([(np.abs(a[:, [k]] - b) ** order).sum(axis=0) for k in range(a.shape[1])])


def largest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest difference of the columns."""
    return np.stack([np.abs(a[:, [k]] - b).max(axis=0) for k in range(a.shape[1])])


def pack(group: pa.Table) -> pa.Table:
    """One row of a tile's and a block's cells: the subjects and features that have some, and the dense array of their values."""
    group = group.combine_chunks()
    sides = {}
    for name in ("subject", "feature"):
        coded = group.column(name).combine_chunks().dictionary_encode()
        sides[name] = coded.dictionary, coded.indices.to_numpy()
    x = np.zeros((len(sides["subject"][0]), len(sides["feature"][0])))
    np.add.at(x, (sides["subject"][1], sides["feature"][1]), group.column("value").to_numpy())
    lists = [pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d) for d, _ in (sides["subject"], sides["feature"])]
    return pa.table({"tile": group.column("tile").slice(0, 1), "block": group.column("block").slice(0, 1), "subjects": lists[0], "features": lists[1], "cells": pa.array([x.tobytes()], pa.binary())})


def column_pairs(matrix: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = dot, features: DataFrame | None = None, maximum: bool = False, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """(f1, f2, dot), f1 <= f2: ``combine`` of every two columns of (subject, feature, value), added over row blocks, or their ``maximum``.

    ``features`` (feature) may name more than those that have cells. A cell that comes twice counts as the sum.
    """
    kind, who = matrix.schema["feature"].dataType.simpleString(), matrix.schema["subject"].dataType.simpleString()
    told = (matrix if features is None else features).select("feature").distinct()
    tiles, blocks = (max(1, math.ceil(n / most)) for n, most in ((told.count(), tile), (matrix.agg(F.count_distinct("subject")).first()[0], rows)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    names = stored(told.groupBy(dealt("feature", tiles).alias("tile")).agg(F.sort_array(F.collect_list("feature")).alias("names")))
    cells = matrix.select(dealt("feature", tiles).alias("tile"), dealt("subject", blocks).alias("block"), "subject", "feature", F.col("value").cast("double").alias("value"))
    packed = cells.groupBy("tile", "block").applyInArrow(pack, f"tile int, block int, subjects array<{who}>, features array<{kind}>, cells binary")
    grid = names.join(matrix.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")))  # a row for each tile and block, cells or none
    whole = stored(grid.join(packed, ["tile", "block"], "left"))
    left = whole.select("block", *[F.col(c).alias(f"{c}_1") for c in ("tile", "names", "subjects", "features", "cells")])
    right = whole.select("block", *[F.col(c).alias(f"{c}_2") for c in ("tile", "names", "subjects", "features", "cells")])

    def side(row: dict, k: int, order: dict) -> np.ndarray:
        """The tile's columns in the order of all its names, its rows in ``order``."""
        x = np.zeros((len(order), len(row[f"names_{k}"])))
        if row[f"cells_{k}"] is not None:
            place = {f: n for n, f in enumerate(row[f"names_{k}"])}
            own = np.frombuffer(row[f"cells_{k}"]).reshape(len(row[f"subjects_{k}"]), -1)
            x[np.ix_([order[s] for s in row[f"subjects_{k}"]], [place[f] for f in row[f"features_{k}"]])] = own
        return x

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                order = {s: k for k, s in enumerate(dict.fromkeys((row["subjects_1"] or []) + (row["subjects_2"] or [])))}
                if order:
                    part = combine(side(row, 1, order), side(row, 2, order))
                    yield pa.RecordBatch.from_arrays([batch.column("tile_1").slice(n, 1), batch.column("tile_2").slice(n, 1), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], names=["tile_1", "tile_2", "part"])

    def out(key: tuple, names: tuple[pa.Array, pa.Array], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(len(total)) if key[0] == key[1] else (x.ravel() for x in np.indices(total.shape))
        for k in range(0, len(i), CELLS):
            own, other = i[k : k + CELLS], j[k : k + CELLS]
            yield pa.RecordBatch.from_arrays([names[0].take(pa.array(own)), names[1].take(pa.array(other)), pa.array(total[own, other])], names=["a", "b", "dot"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, total = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                key = batch.column("tile_1")[n].as_py(), batch.column("tile_2")[n].as_py()
                if key != now:
                    if now is not None:
                        yield from out(now, names, total)
                    # the row of the pair itself comes first
                    now, names = key, tuple(batch.column(c)[n].values for c in ("names_1", "names_2"))
                    total = np.zeros((len(names[0]), len(names[1])))
                part = batch.column("part")[n]
                if part.is_valid:
                    own = np.frombuffer(part.as_py()).reshape(total.shape)
                    total = np.maximum(total, own) if maximum else total + own
        if now is not None:
            yield from out(now, names, total)

    met = left.join(right, "block").where("tile_1 <= tile_2").mapInArrow(multiply, "tile_1 int, tile_2 int, part binary")
    pairs = names.select(F.col("tile").alias("tile_1"), F.col("names").alias("names_1")).join(names.select(F.col("tile").alias("tile_2"), F.col("names").alias("names_2")), F.col("tile_1") <= F.col("tile_2"))
    nothing = F.lit(None)
    every = pairs.select("tile_1", "tile_2", "names_1", "names_2", nothing.cast("binary").alias("part")).unionByName(met.select("tile_1", "tile_2", nothing.cast(f"array<{kind}>").alias("names_1"), nothing.cast(f"array<{kind}>").alias("names_2"), "part"))
    streamed = every.repartition("tile_1", "tile_2").sortWithinPartitions("tile_1", "tile_2", F.col("part").isNotNull())
    return streamed.mapInArrow(summed, f"a {kind}, b {kind}, dot double").select(F.least("a", "b").alias("f1"), F.greatest("a", "b").alias("f2"), "dot")
