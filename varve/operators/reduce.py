"""The tables behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.order_statistics import percentiles, wide
from varve.session import Scratch


def by_group(values: DataFrame, keys: Sequence[str], value: str, *reducers: Column) -> DataFrame:
    """A chain of aggregates of a value by group (A5, E2); without reducers its mean."""
    return values.groupBy(*keys).agg(*(reducers or (F.avg(value).alias(value),)))


def heatmap(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, gene_id, mean, exp_mean, detection) of every cluster and gene seen anywhere, zeros filled in."""
    grid = sizes.crossJoin(sums.select("gene_id").distinct())
    full = grid.join(sums, ["cluster", "gene_id"], "left").fillna(0, ["s", "ss", "nnz"])
    mean = F.col("s") / F.col("n")
    return full.select("cluster", "gene_id", mean.alias("mean"), F.exp(mean).alias("exp_mean"), (F.col("nnz") / F.col("n")).alias("detection"))


def row_order(heat: DataFrame) -> DataFrame:
    """(gene_id, cluster): where each gene's mean is greatest, ties to the smaller cluster."""
    best = heat.groupBy("gene_id").agg(F.min(F.struct((-F.col("mean")).alias("m"), "cluster")).alias("b"))
    return best.select("gene_id", F.col("b.cluster").alias("cluster"))


def scaled(heat: DataFrame, by: str, value: str = "mean") -> DataFrame:
    """heat with `z`, the value's z-score within a gene or a cluster (W11); null without variance."""
    stats = heat.groupBy(F.col(by).alias("_k")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    return heat.join(stats, F.col(by) == F.col("_k")).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_sd"))).drop("_k", "_m", "_sd")


def min_max(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """values with `scaled`, the value's place between its group's least and greatest (W12, V6); null if they are equal."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return values.join(ends, list(keys)).withColumn("scaled", F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): counts of pairs and their share within a (A8, V2). Nulls are left out."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, q25, q50, q75) of the values that are neither null nor NaN (V2, V6)."""
    return wide(percentiles(df, keys, value, (0.25, 0.5, 0.75)), keys, q25=0.25, q50=0.5, q75=0.75)


def activation(normalised: DataFrame, cells: DataFrame, genes: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(cell_id, z) of the cells whose signature mean, as a z-score, is above its quantile (V8)."""
    from varve.operators.expression import signature_mean

    scores = Scratch(normalised.sparkSession, "activation").save(signature_mean(normalised, cells, genes), "scores")
    ends = scores.agg(F.avg("score").alias("_m"), F.stddev_samp("score").alias("_sd"))
    cut = wide(percentiles(scores, [], "score", [quantile]), [], _q=quantile).drop("n")
    joined = scores.join(F.broadcast(ends)).join(F.broadcast(cut))
    return joined.where(F.col("score") > F.col("_q")).select("cell_id", F.try_divide(F.col("score") - F.col("_m"), F.col("_sd")).alias("z"))


def pair_scatter(normalised: DataFrame, cells: DataFrame, one: int, two: int, seed: int | None = None) -> DataFrame:
    """(cell_id, x, y): two genes' values of every cell; with a seed zeros are jittered by min(non-zero) / 5."""
    out = cells.select("cell_id")
    for name, gene in (("x", one), ("y", two)):
        out = out.join(normalised.where(F.col("gene_id") == gene).select("cell_id", F.col("norm").alias(name)), "cell_id", "left").fillna(0.0, [name])
        if seed is not None:
            least = normalised.where((F.col("gene_id") == gene) & (F.col("norm") > 0)).agg(F.min("norm").alias("_l"))
            # a normal draw from two hashes of the cell, so that it does not depend on the partitioning
            u1, u2 = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.lit(i), "cell_id"), F.lit(2**40)) + 1) / float(2**40 + 1) for i in (1, 2))
            draw = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * u2)
            out = out.join(F.broadcast(least)).withColumn(name, F.when(F.col(name) == 0, draw * F.col("_l") / 5).otherwise(F.col(name))).drop("_l")
    return out


def qc_pairs(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cell_id, a, b, x, y): every pair of quality metrics in long form."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return metrics.select("cell_id", F.explode(F.array(*pairs)).alias("p")).select("cell_id", "p.*")
