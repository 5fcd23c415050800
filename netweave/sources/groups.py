"""Feature groups from files: one labelled edge matrix a group, or one membership matrix for all.

An edge matrix is a CSV whose header and first column name the group's features; a cell is empty (no edge), 1
(an edge from the row's feature to the column's) or 2 (an edge both ways). The group's name is the file name
without its first seven characters and its suffix. A membership matrix has a group a row; a nonzero cell is a
member.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX = 7, 4


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        raise ValueError(f"neither a file nor a folder: {path}")
    return files.getFileStatus(jvm_path).isDirectory()


def group_name(file_name: Column) -> Column:
    return F.regexp_extract(file_name, f"^.{{{PREFIX}}}(.*).{{{SUFFIX}}}$", 1)


def plain_labels(labels: list[str]) -> list[str]:
    """Labels such as entrez_123 lose everything up to their first underscore; the first label tells."""
    if labels and "entrez" in labels[0]:
        return [x.partition("_")[2] for x in labels]
    return labels


def read_edge_matrices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(members(pathway, feature, ord), edges(pathway, src, dst, code)) of all files of a folder.

    Each file is one row of the scan and is parsed in the task that reads it. Members come from the header, so
    features without edges stay. Cells that are empty or zero are no edges.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.csv").select(group_name(F.col("_metadata.file_name")).alias("pathway"), "value")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pathway, text in zip(batch["pathway"], batch["value"], strict=True):
                rows = list(csv.reader(io.StringIO(text)))
                names = plain_labels(rows[0][1:]) if rows else []
                found = [(pathway, name, None, float(k)) for k, name in enumerate(names)]
                own = plain_labels([r[0] for r in rows[1:] if r])
                for src, row in zip(own, (r for r in rows[1:] if r), strict=True):
                    found += [(pathway, src, dst, float(x)) for dst, x in zip(names, row[1:], strict=False) if x.strip() and float(x) != 0]
                yield pd.DataFrame(found, columns=["pathway", "a", "b", "x"])

    parsed = files.mapInPandas(cells, "pathway string, a string, b string, x double")
    members = parsed.where("b is null").select("pathway", F.col("a").alias("feature"), F.col("x").cast("int").alias("ord"))
    edges = parsed.where("b is not null").select("pathway", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("x").alias("code"))
    return members, edges


def membership(wide: DataFrame) -> DataFrame:
    """members(pathway, feature) of a wide table whose first column names the group and whose others are features."""
    key, *names = wide.columns
    rows = wide.select(F.col(f"`{key}`").alias("pathway"), *[F.col(f"`{n}`").cast("double").alias(p) for n, p in zip(names, plain_labels(names), strict=True)])
    values = [F.struct(F.lit(p).alias("feature"), F.col(f"`{p}`").alias("value")) for p in plain_labels(names)]
    return rows.select("pathway", F.inline(F.array(*values))).where("value <> 0").select("pathway", "feature")


def read_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(members, edges) of a folder of edge matrices, or (members, None) of one membership file."""
    if is_folder(spark, path):
        return read_edge_matrices(spark, path)
    return membership(spark.read.option("header", True).csv(path)), None


def group_names(members: DataFrame) -> DataFrame:
    return members.select("pathway").distinct().orderBy("pathway")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(subject, feature, value) of CSV files with a subject a row: its name in the first column, features in the header.

    The header is read from the files, and every row becomes its cells in the task that reads it. Empty cells are
    left out, so that ``matrix.validate`` and joins see them as absent.
    """
    wide = spark.read.option("header", True).csv(path)
    key, *names = wide.columns
    values = F.array(*[F.struct(F.lit(p).alias("feature"), F.col(f"`{n}`").cast("double").alias("value")) for n, p in zip(names, plain_labels(names), strict=True)])
    return wide.select(F.col(f"`{key}`").alias("subject"), F.inline(values)).where("value is not null").select("subject", "feature", "value")


def read_metadata(spark: SparkSession, path: str, column: str, control: str = "control") -> DataFrame:
    """(subject, label): 1 for cases and 0 for subjects whose ``column`` is ``control``; the first column names the subject."""
    wide = spark.read.option("header", True).csv(path)
    if column not in wide.columns:
        raise KeyError(f"no column {column}")
    return wide.select(F.col(f"`{wide.columns[0]}`").alias("subject"), (F.col(f"`{column}`") != control).cast("int").alias("label"))
