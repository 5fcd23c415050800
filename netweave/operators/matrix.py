"""Data matrices in long form: (subject, feature, value), with an optional label of the subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.operators.products import column_pairs
from netweave.sources.scratch import stored

#: Features up to which column products are summed as dense blocks in tasks; beyond, rows are joined.
DENSE_FEATURES = 2048


def long_matrix(packed: DataFrame, subject: str, values: str, *others: str) -> DataFrame:
    """(subject, feature, value, others...) of rows that hold a subject's values as an array; feature is the place from 0."""
    each = packed.select(F.col(subject).alias("subject"), *others, F.posexplode(values).alias("feature", "value"))
    return each.select("subject", F.col("feature").cast("long").alias("feature"), F.col("value").cast("double").alias("value"), *others)


def validate(matrix: DataFrame) -> DataFrame:
    """``matrix``; raises ValueError where it has a null or NaN value or a cell twice."""
    bad = matrix.where(F.col("value").isNull() | F.isnan("value")).limit(1).count()
    twice = matrix.groupBy("subject", "feature").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("a matrix has one value, and no null or NaN, for each subject and feature")
    return matrix


def standard_scale(matrix: DataFrame) -> DataFrame:
    """Each feature less its mean and over its population deviation; a constant feature is only centred."""
    told = matrix.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    scaled = (F.col("value") - F.col("mean")) / F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation"))
    return matrix.join(told, "feature").withColumn("value", scaled).select(*matrix.columns)


def centred(matrix: DataFrame) -> DataFrame:
    """Each feature less its mean."""
    means = matrix.groupBy("feature").agg(F.avg("value").alias("mean"))
    return matrix.join(means, "feature").withColumn("value", F.col("value") - F.col("mean")).select(*matrix.columns)


def restrict(matrix: DataFrame, features: DataFrame) -> DataFrame:
    return matrix.join(features.select("feature"), "feature", "left_semi").select(*matrix.columns)


def with_metadata(subjects: DataFrame, metadata: DataFrame, key: str = "subject") -> DataFrame:
    """``subjects`` with their metadata; raises KeyError where a subject has none."""
    missing = subjects.join(metadata, key, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no metadata of {missing[0][key]}")
    return subjects.join(metadata, key)


def is_case(label: Column, control: str = "control") -> Column:
    return label != control


def column_products(matrix: DataFrame, where: Column | None = None, dense_features: int = DENSE_FEATURES) -> DataFrame:
    """(f1, f2, dot), f1 <= f2: sums over subjects of the products of two features' values; a row for every pair of the
    matrix's features, absent cells being 0, whichever subjects ``where`` takes.

    Up to ``dense_features`` features, a task packs its subjects into rows and adds their outer products; only
    its matrix of sums is shuffled, whatever the number of subjects. Beyond, tiles of columns are multiplied.
    """
    own = matrix.where(where) if where is not None else matrix
    features = matrix.select("feature").distinct()
    names = [r[0] for r in features.orderBy("feature").limit(dense_features + 1).collect()]
    if len(names) > dense_features:
        return column_pairs(own.select("subject", "feature", "value"), features=features)
    place = {name: k for k, name in enumerate(names)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            block = np.zeros((len(batch), len(names)))
            for k, (features, values) in enumerate(zip(batch["features"], batch["values"], strict=True)):
                block[k, [place[f] for f in features]] = values
            total += block.T @ block
        i, j = np.triu_indices(len(names))
        yield pd.DataFrame({"f1": [names[k] for k in i], "f2": [names[k] for k in j], "dot": total[i, j]})

    packed = own.groupBy("subject").agg(F.collect_list("feature").alias("features"), F.collect_list("value").alias("values")).select("features", "values")
    kind = matrix.schema["feature"].dataType.simpleString()
    return packed.mapInPandas(sums, f"f1 {kind}, f2 {kind}, dot double").groupBy("f1", "f2").agg(F.sum("dot").alias("dot"))


def ranked(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """The first row of each ``by``."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in ``order``: sorted by ranges, each range's rows counted on from those before it."""
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return dealt.join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_at") + F.col("_offset")).alias(name))  # a row a task


def followed(links: DataFrame) -> DataFrame:
    """(node, to, add) of a forest's links (node, to, add): the root above each node, and the sum of ``add`` on the way. Links jump twice as far each round."""
    rows = stored(links.select("node", "to", "add"))
    while True:
        further = rows.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("add").alias("far_add"))
        step = stored(rows.join(further, "to", "left").select("node", F.coalesce("far", "to").alias("to"), (F.col("add") + F.coalesce("far_add", F.lit(0))).alias("add"), F.col("far").isNotNull().alias("moved")))
        rows = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return rows
