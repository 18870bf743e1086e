"""Normalisation, variable genes and gene scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.session import Scratch


def normalise(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """counts with norm = ln(scale x count / all of its cell's counts + 1) (M0); it comes before any gene filter."""
    total = counts.groupBy("cell_id").agg(F.sum("count").alias("_total")).where("_total > 0")
    return counts.join(total, "cell_id").withColumn("norm", F.log1p(scale * F.col("count") / F.col("_total"))).drop("_total")


def moments(values: DataFrame, cells: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, gene_id, n, mean, var, frac) over all cells of the keys, zeros included (A3).

    values: (cell_id, keys, gene_id, ...) without zeros; cells: (cell_id, keys). var is null for a single cell.
    """
    size = cells.groupBy(*keys).agg(F.count("*").cast("double").alias("n")) if keys else cells.agg(F.count("*").cast("double").alias("n"))
    sums = values.groupBy(*keys, "gene_id").agg(F.sum(value).alias("_s"), F.sum(value * value).alias("_q"), F.count_if(value > 0).alias("_p"))
    joined = sums.join(size, list(keys)) if keys else sums.join(F.broadcast(size))
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.col("n") - 1))
    return joined.select(*keys, "gene_id", "n", (F.col("_s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, var).alias("var"), (F.col("_p") / F.col("n")).alias("frac"))


def variable_genes(normalised: DataFrame, cells: DataFrame, *, min_mean: float = 0.05, min_frac: float = 0.0, min_z: float = 1.0, bins: int = 20) -> DataFrame:
    """(dataset, gene_id, mean, dispersion, bin, z) of the genes that pass in their dataset (M2).

    On x = exp(norm) - 1: mean = ln(mean x + 1), dispersion = ln(var x / mean x), z within `bins` equal bins of the
    mean. A gene without variance takes no part in its bin's statistics and has z 0, as the only gene of a bin has.
    """
    stats = moments(normalised.withColumn("_x", F.expm1("norm")), cells, ["dataset"], F.col("_x"))
    level = stats.select("dataset", "gene_id", "frac", F.log1p("mean").alias("mean"), F.when(F.col("var") > 0, F.ln(F.col("var") / F.col("mean"))).alias("dispersion"))
    level = Scratch(normalised.sparkSession, "variable").save(level, "level")  # read four times, and small against the values
    ends = level.groupBy("dataset").agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("mean") - F.col("_lo")) / width)))).otherwise(1).cast("int")
    binned = level.join(ends, "dataset").withColumn("bin", place)
    group = binned.groupBy("dataset", "bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_sd"))
    z = F.coalesce(F.try_divide(F.col("dispersion") - F.col("_m"), F.col("_sd")), F.lit(0.0))
    scored = binned.join(group, ["dataset", "bin"]).withColumn("z", z)
    kept = scored.where((F.col("mean") >= min_mean) & (F.col("frac") >= min_frac) & (F.col("z") >= min_z))
    return kept.select("dataset", "gene_id", "mean", "dispersion", "bin", "z")


def signature_mean(normalised: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, score): the mean norm of the genes, zeros included (A7); null if there are no genes."""
    members = genes.select("gene_id").distinct()
    sums = normalised.join(members, "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("norm").alias("_s"))
    size = members.agg(F.count("*").alias("_n"))
    return cells.select("cell_id").join(sums, "cell_id", "left").join(F.broadcast(size)).select("cell_id", F.try_divide(F.coalesce("_s", F.lit(0.0)), F.col("_n")).alias("score"))


def technical_features(normalised: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene_id, m, v): every gene's mean and variance of norm over all cells, each as a z-score."""
    stats = Scratch(normalised.sparkSession, "technical").save(moments(normalised, cells, [], F.col("norm")), "moments")
    ends = stats.agg(F.avg("mean").alias("_a"), F.stddev_samp("mean").alias("_b"), F.avg("var").alias("_c"), F.stddev_samp("var").alias("_d"))
    z = lambda x, a, b: F.coalesce(F.try_divide(F.col(x) - F.col(a), F.col(b)), F.lit(0.0))
    return stats.join(F.broadcast(ends)).select("gene_id", z("mean", "_a", "_b").alias("m"), z("var", "_c", "_d").alias("v"))


GRID = 12


def similar_genes(features: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(gene_id, rank, other): the k genes nearest in (m, v) to each asked gene, itself left out by id.

    Distances are squared, ties go to smaller ids; null and NaN features are left out. Genes lie in square cells of GRID
    sizes, each twice the one before. For an asked gene the counts of the cells tell the smallest size at which the three by three
    around it hold k others; those are nearer than its side times the root of 8, so the three by three of four times that size hold
    the k nearest, and only these are compared. Of genes with equal features the k + 1 smallest ids stand for all.
    """
    scratch = Scratch(features.sparkSession, "similar")
    usable = features.where(~F.isnan("m") & ~F.isnan("v")).select("gene_id", "m", "v")
    same = F.row_number().over(Window.partitionBy("m", "v").orderBy("gene_id"))
    points = scratch.save(usable.withColumn("_n", same).where(F.col("_n") <= k + 1).drop("_n"), "points")
    ends = points.agg(F.min("m").alias("_m0"), F.min("v").alias("_v0"), F.greatest(F.max("m") - F.min("m"), F.max("v") - F.min("v")).alias("_w"))
    # the largest cell holds every point; a spread of 0 is one cell of any size
    side = lambda level: F.when(F.col("_w") > 0, F.col("_w") * 1.000001).otherwise(1.0) / F.pow(F.lit(2.0), F.lit(GRID) - level)
    cell = lambda c, level: F.floor((F.col(c) - F.col(f"_{c}0")) / side(level))
    placed = points.join(F.broadcast(ends))
    levels = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda level: F.struct(level.alias("level"), cell("m", level).alias("x"), cell("v", level).alias("y")))
    counts = placed.select(F.explode(levels).alias("c")).groupBy("c.level", "c.x", "c.y").agg(F.count("*").alias("n"))
    # the asked genes count themselves, hence more than k; a gene that only stands for others is asked with its own features
    query = scratch.save(usable.join(asked.select("gene_id").distinct(), "gene_id", "left_semi").join(F.broadcast(ends)), "asked")
    near = lambda c: F.array(*(F.struct((c.x + i).alias("x"), (c.y + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = query.select("gene_id", F.explode(levels).alias("c")).select("gene_id", "c.level", F.explode(near(F.col("c"))).alias("b"))
    held = around.select("gene_id", "level", "b.x", "b.y").join(counts, ["level", "x", "y"]).groupBy("gene_id", "level").agg(F.sum("n").alias("n"))
    first = held.where(F.col("n") > k).groupBy("gene_id").agg(F.min("level").alias("level"))
    level = F.least(F.lit(GRID), F.coalesce("level", F.lit(GRID)) + 2)
    wide = scratch.save(query.join(first, "gene_id", "left").withColumn("level", level), "wide")
    far = wide.select(F.col("gene_id").alias("_g"), F.col("m").alias("_m"), F.col("v").alias("_v"), "level", F.explode(near(F.struct(cell("m", F.col("level")).alias("x"), cell("v", F.col("level")).alias("y")))).alias("b"))
    used = F.broadcast(wide.select("level").distinct())
    there = placed.select("gene_id", "m", "v", F.explode(levels).alias("c")).select("gene_id", "m", "v", "c.level", "c.x", "c.y").join(used, "level", "left_semi")
    pairs = far.select("_g", "_m", "_v", "level", "b.x", "b.y").join(there, ["level", "x", "y"]).where("gene_id <> _g")
    gap = (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m")) + (F.col("v") - F.col("_v")) * (F.col("v") - F.col("_v"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(gap, "gene_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_g").alias("gene_id"), "rank", F.col("gene_id").alias("other"))


def controlled_score(normalised: DataFrame, cells: DataFrame, signature: DataFrame, k: int = 10) -> DataFrame:
    """(cell_id, score): mean norm of the signature less that of its background, the union of each gene's k technically
    nearest genes without the signature's own (M3). k = 0 gives the plain mean; without a signature or a background the score is null.

    Signature and background are scored in one pass over the values.
    """
    if not k:
        return signature_mean(normalised, cells, signature)
    scratch = Scratch(normalised.sparkSession, "score")
    own = signature.select("gene_id").distinct()
    features = scratch.save(technical_features(normalised, cells), "features")
    back = similar_genes(features, own, k).select(F.col("other").alias("gene_id")).distinct().join(own, "gene_id", "left_anti")
    sides = scratch.save(own.withColumn("_front", F.lit(True)).unionByName(back.withColumn("_front", F.lit(False))), "sides")
    mean = lambda front: F.sum(F.when(F.col("_front") == front, F.col("norm")))
    sums = normalised.join(sides, "gene_id").groupBy("cell_id").agg(mean(True).alias("_f"), mean(False).alias("_b"))
    sizes = sides.agg(F.count_if("_front").alias("_nf"), F.count_if(~F.col("_front")).alias("_nb"))
    share = lambda s, n: F.try_divide(F.coalesce(s, F.lit(0.0)), F.col(n))
    return cells.select("cell_id").join(sums, "cell_id", "left").join(F.broadcast(sizes)).select("cell_id", (share("_f", "_nf") - share("_b", "_nb")).alias("score"))


def gene_set_score(normalised: DataFrame, cells: DataFrame, genes: DataFrame, pattern: str, *, control: bool, k: int = 10) -> DataFrame:
    """(cell_id, score) of the genes whose symbol matches: against their background with control, else the plain mean (M4)."""
    members = genes.where(F.col("symbol").rlike(pattern)).select("gene_id").distinct()
    return controlled_score(normalised, cells, members, k if control else 0)


def match_signature(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, gene_id): the first gene of each listed symbol, letter case aside; unknown symbols are dropped."""
    first = genes.where("symbol is not null").groupBy(F.lower("symbol").alias("_s")).agg(F.min("gene_id").alias("gene_id"))
    return symbols.select("symbol").distinct().join(first, F.lower("symbol") == F.col("_s")).select("symbol", "gene_id")


def cell_cycle_scores(normalised: DataFrame, cells: DataFrame, genes: DataFrame, listed: DataFrame, k: int = 10) -> DataFrame:
    """(cell_id, s_stage, g2m_stage, aggregate_s_g2m_stage) from (at, symbol): places 1 to 43 are S, 44 to 98 G2M (M5)."""
    out = cells.select("cell_id")
    for name, low, high in (("s_stage", 1, 43), ("g2m_stage", 44, 98), ("aggregate_s_g2m_stage", 1, 98)):
        score = controlled_score(normalised, cells, match_signature(genes, listed.where(F.col("at").between(low, high))), k)
        out = out.join(score.withColumnRenamed("score", name), "cell_id")
    return out


def add_confounders(confounders: DataFrame, **columns: DataFrame) -> DataFrame:
    """confounders with one column per (cell_id, value) table (M6, J6, E3); cells without a value have null."""
    for name, values in columns.items():
        value = next(c for c in values.columns if c != "cell_id")
        confounders = confounders.join(values.select("cell_id", F.col(value).alias(name)), "cell_id", "left")
    return confounders


def regress_one(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """df with `residual` of y ~ 1 + x within the keys; the mean is not added back (M7). Rows with a null keep null."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = both.groupBy(*keys).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_b"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    return df.join(fit, list(keys)).withColumn("residual", F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_b", "_my", "_mx")


def regress_all(normalised: DataFrame, covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """(dataset, gene_id, beta): least squares of every gene on 1 and the covariates by dataset, from sums alone (M7).

    covariates: (cell_id, dataset, names), one row a cell, without nulls. Covariates are taken from their means in the dataset
    first, else a mean that is large against the spread costs the digits of the slopes. Their products are one small
    array a dataset, a gene adds its products with them; zeros add nothing to those.
    """
    size = len(names)
    means = covariates.groupBy("dataset").agg(F.count("*").cast("double").alias("_n"), *(F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(names)))
    centred = covariates.join(F.broadcast(means), "dataset").select("cell_id", "dataset", *((F.col(c).cast("double") - F.col(f"_m{i}")).alias(f"_x{i}") for i, c in enumerate(names)))
    terms = [F.col(f"_x{i}") for i in range(size)]
    double = "array<double>"
    design = centred.groupBy("dataset").agg(F.array(*(F.sum(a * b) for a in terms for b in terms)).cast(double).alias("xx"))
    centre = means.select("dataset", "_n", F.array(*(F.col(f"_m{i}") for i in range(size))).cast(double).alias("mx"))
    joined = normalised.select("cell_id", "gene_id", "norm").join(centred, "cell_id")
    products = joined.groupBy("dataset", "gene_id").agg(F.sum("norm").alias("_y"), F.array(*(F.sum(t * F.col("norm")) for t in terms)).cast(double).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, y: pd.Series, mx: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for count, total, at, a, b in zip(n, y, mx, xx, xy, strict=True):
            # in units of its spread a covariate weighs alike, whatever it is measured in
            a = np.reshape(np.asarray(a, dtype=float), (size, size))
            unit = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            slopes = np.linalg.lstsq(a / np.outer(unit, unit), np.asarray(b, dtype=float) / unit, rcond=None)[0] / unit
            out.append([float(total / count - slopes @ np.asarray(at, dtype=float)), *slopes.tolist()])
        return pd.Series(out)

    return products.join(F.broadcast(design), "dataset").join(F.broadcast(centre), "dataset").select("dataset", "gene_id", solve("_n", "_y", "mx", "xx", "xy").alias("beta"))


def residuals(normalised: DataFrame, covariates: DataFrame, betas: DataFrame, names: Sequence[str]) -> DataFrame:
    """(cell_id, gene_id, residual) of every cell and gene of a dataset's betas, zeros included (M7)."""
    design = covariates.select("cell_id", "dataset", F.array(F.lit(1.0), *(F.col(c).cast("double") for c in names)).alias("_x"))
    dense = design.join(betas, "dataset")
    fitted = F.aggregate(F.zip_with("_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    there = normalised.select("cell_id", "gene_id", "norm")
    return dense.join(there, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", (F.coalesce("norm", F.lit(0.0)) - fitted).alias("residual"))
