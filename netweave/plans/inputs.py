"""The tables that the queries read, as matrices, groups and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.matrix import long_matrix


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, feature, value, label) of the embeddings."""
    return long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subjects in two classes: labels below 5, and the others."""
    return matrix(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))


def features(m: DataFrame) -> DataFrame:
    return m.select("feature").distinct()


def nodes(m: DataFrame) -> DataFrame:
    return m.select(F.col("feature").alias("node")).distinct()


def members(m: DataFrame) -> DataFrame:
    """Groups 2 to 9: the features that the group's number divides."""
    numbers = F.explode(F.sequence(F.lit(2), F.lit(9)).cast("array<long>")).alias("pathway")
    return features(m).select(numbers, "feature").where(F.col("feature") % F.col("pathway") == 0)


def coded_edges(m: DataFrame) -> DataFrame:
    """Cells of codes 1 and 2 between a group's members."""
    own = members(m)
    pairs = own.select("pathway", F.col("feature").alias("src")).join(own.select("pathway", F.col("feature").alias("dst")), "pathway").where("src <> dst")
    h = (31 * F.col("src") + 17 * F.col("dst")) % 23
    return pairs.select("pathway", "src", "dst", F.when(h <= 2, 1.0).when(h <= 4, 2.0).alias("code")).where("code is not null")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): quantity from suppliers' nations to customers'."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    by_customer = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return line.join(by_customer, line.l_orderkey == by_customer.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey).groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, subject, feature, value): each user's sum of values by week and event type."""
    rows = read(spark, sf_dir, "events").select(F.date_trunc("week", F.col("ts").cast("timestamp_ntz")).alias("week"), F.col("user_id").alias("subject"), F.col("event_type").alias("feature"), "value")
    first = rows.agg(F.min("week").alias("first"))
    number = (F.datediff(F.to_date("week"), F.to_date("first")) / 7).cast("int")
    return rows.crossJoin(F.broadcast(first)).select(number.alias("t"), "subject", "feature", "value").groupBy("t", "subject", "feature").agg(F.sum("value").alias("value"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) from customers to the suppliers of all their order lines; suppliers are numbered below zero."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.lit(1.0).alias("weight")).distinct()


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).union(read(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("node")))


def given_clusters(m: DataFrame) -> DataFrame:
    """(path, node): the 64 features in nested halves, down to single ones, by the bits of a number that mixes their ids."""
    code = F.lpad(F.bin((F.col("node") * 37 + 11) % 64), 6, "0")
    depth = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("depth")
    return nodes(m).select("node", code.alias("code"), depth).select(F.translate(F.substring("code", F.lit(1), F.col("depth")), "01", "AB").alias("path"), "node")
