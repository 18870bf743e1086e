"""The driver's tables as entity x feature data: retail (customers x parts), vectors, single cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import table


def retail_cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, dataset, origin, experiment): customers by market segment, region and nation."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("dataset"), F.col("r_name").alias("origin"), F.col("n_name").alias("experiment"))


def retail_counts(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, gene_id, dataset, count): quantities by customer and part."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sums = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("count"))
    return sums.where("count <> 0").join(retail_cells(spark, d).select("cell_id", "dataset"), "cell_id").select("cell_id", "gene_id", "dataset", "count")


def retail_genes(spark: SparkSession, d: str) -> DataFrame:
    """(gene_id, symbol): parts by name and key."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.col("p_partkey").cast("string")).alias("symbol"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, pc, cluster): embeddings and their labels."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("pc"), F.col("label").alias("cluster"))


def single_cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, dataset, origin, experiment, sample_label), one row a cell."""
    cells = table(spark, d, "cells")
    return cells.groupBy("cell_id").agg(*(F.max(c).alias(c) for c in ("dataset", "origin", "experiment", "sample_label")))


def highest_level(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, cell_id, cluster): distinct memberships at each run's highest level, null clusters left out."""
    member = table(spark, d, "membership")
    top = member.groupBy("run_id").agg(F.max("lvl").alias("lvl"))
    rows = member.join(top, ["run_id", "lvl"]).where("cluster_id is not null")
    return rows.select("run_id", "cell_id", F.col("cluster_id").alias("cluster")).distinct()
