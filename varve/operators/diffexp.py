"""Differential expression between clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import stats
from varve.session import Scratch


TIES, TIED = 100_000, 10_000


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, out: str = "q") -> DataFrame:
    """df with adjusted p-values: min over p' >= p of p' x n / #(p'' <= p'), at most 1, within the keys.

    Null and NaN p-values do not count and get null. Ranks come from counts per distinct p, summed first over cells
    of p and then within a cell, so that no task holds all the tests of a large group.
    """
    scratch = Scratch(df.sparkSession, "adjusted")
    df = scratch.save(df.drop(out), "tests")
    usable = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    cell = F.when(F.col("_p") <= 0, F.lit(-2_000)).otherwise(F.greatest(F.lit(-1_999), F.floor(F.log10("_p") * 64))).cast("int")
    counts = scratch.save(usable.groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_cell", cell), "counts")
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"))
    over = Window.partitionBy(*keys)
    cells = cells.withColumn("_before", F.sum("_c").over(over.orderBy("_cell")) - F.col("_c")).withColumn("_all", F.sum("_c").over(over))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_cell")]
    within = Window.partitionBy(*keys, "_cell")
    ranked = counts.alias("l").join(cells.alias("r"), same).select("l.*", "_before", "_all")
    ranked = ranked.withColumn("_raw", F.col("_p") * F.col("_all") / (F.col("_before") + F.sum("_n").over(within.orderBy("_p"))))
    lows = ranked.groupBy(*keys, "_cell").agg(F.min("_raw").alias("_low"))
    lows = lows.withColumn("_later", F.min("_low").over(over.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_cell")]
    final = ranked.alias("l").join(lows.select(*keys, "_cell", "_later").alias("r"), same).select("l.*", "_later")
    tail = F.min("_raw").over(within.orderBy(F.desc("_p")))
    adjusted = final.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_p", "_n", F.least(F.lit(1.0), tail, F.coalesce("_later", F.lit(1.0))).alias(out))
    adjusted = scratch.save(adjusted, "adjusted")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(p) == F.col("_p")]
    spare = ["_p", "_n", *(f"_k{i}" for i in range(len(keys)))]
    # p-values that very many tests share go to the rows by broadcast (there are at most TIED of them), so that
    # no task gets all rows of one; the others by a join
    total = adjusted.agg(F.sum("_n")).first()[0] or 0
    shared = F.col("_n") > max(TIES, total / TIED)
    tied = adjusted.where(shared)
    if tied.isEmpty():
        return df.join(adjusted, on, "left").drop(*spare)
    hot = df.join(F.broadcast(tied), on).drop(*spare)
    return hot.unionByName(df.join(F.broadcast(tied), on, "left_anti").join(adjusted.where(~shared), on, "left").drop(*spare))


def cluster_sums(values: DataFrame, member: DataFrame, keys: Sequence[str], value: str = "norm") -> tuple[DataFrame, DataFrame]:
    """Sums (keys, cluster, gene_id, s, ss, nnz) and sizes (keys, cluster, n), in one pass over the values.

    values: (cell_id, gene_id, value) without zeros; member: (cell_id, keys, cluster), one row a cell. Cells with
    a null cluster are left out.
    """
    placed = member.where("cluster is not null")
    x = F.col(value)
    joined = values.select("cell_id", "gene_id", value).join(placed.select("cell_id", *keys, "cluster"), "cell_id")
    sums = joined.groupBy(*keys, "cluster", "gene_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.count_if(x > 0).alias("nnz"))
    return sums, placed.groupBy(*keys, "cluster").agg(F.count("*").alias("n"))


def one_vs_rest(sums: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cluster, gene_id, n1, n2, mean1, mean2, logfc, fold, s2, df, ave_expr, nnz1, nnz2) of every cluster against the
    rest of its keys, for the genes seen in the keys (M17). The rest is total less cluster; zeros count. A cluster
    without a rest is left out.
    """
    whole = sums.groupBy(*keys, "gene_id").agg(F.sum("s").alias("_s"), F.sum("ss").alias("_ss"), F.sum("nnz").alias("_nnz"))
    total = sizes.groupBy(*keys).agg(F.sum("n").alias("_n"))
    groups = sizes.join(total, list(keys)) if keys else sizes.join(F.broadcast(total))
    grid = (groups.join(whole, list(keys)) if keys else groups.crossJoin(whole)).where("_n > n")
    full = grid.join(sums, [*keys, "cluster", "gene_id"], "left").fillna(0, ["s", "ss", "nnz"])
    n1, n2 = F.col("n").cast("double"), (F.col("_n") - F.col("n")).cast("double")
    m1, m2 = F.col("s") / n1, (F.col("_s") - F.col("s")) / n2
    inner = F.greatest(F.lit(0.0), F.col("_ss") - F.col("s") * F.col("s") / n1 - (F.col("_s") - F.col("s")) * (F.col("_s") - F.col("s")) / n2)
    df = n1 + n2 - 2
    return full.select(
        *keys, "cluster", "gene_id", F.col("n").alias("n1"), (F.col("_n") - F.col("n")).alias("n2"), m1.alias("mean1"), m2.alias("mean2"),
        (m1 - m2).alias("logfc"), F.exp(m1 - m2).alias("fold"), F.try_divide(inner, df).alias("s2"), df.alias("df"),
        (F.col("_s") / (n1 + n2)).alias("ave_expr"), F.col("nnz").alias("nnz1"), (F.col("_nnz") - F.col("nnz")).alias("nnz2"),
    )


def pooled_t(tests: DataFrame) -> DataFrame:
    """tests with the pooled two-sample t; null without variance."""
    return tests.withColumn("t", F.try_divide(F.col("logfc"), F.sqrt(F.col("s2") * (1 / F.col("n1") + 1 / F.col("n2")))))


def hyper_parameters(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d0, s02) of the scaled inverse chi-squared prior of variances, by matching moments of ln s2.

    Tests without variance take no part; d0 is infinite (and s02 the mean) if the variances spread no more than by chance.
    """
    usable = tests.where("s2 > 0 and df >= 1")
    e = F.ln("s2") - stats.log_variance_offset(F.col("df"))
    moments = usable.groupBy(*keys).agg(F.avg(e).alias("_m"), F.var_samp(e).alias("_v"), F.avg("df").alias("_df"))

    @F.pandas_udf("struct<d0: double, s02: double>")
    def solve(m: pd.Series, v: pd.Series, df: pd.Series) -> pd.DataFrame:
        rows = []
        for mean, var, d in zip(m, v, df, strict=True):
            left = (0.0 if var is None or np.isnan(var) else var) - float(stats.trigamma(d / 2))
            if left > 0:
                d0 = 2 * stats.trigamma_inverse(left)
                rows.append((d0, float(np.exp(mean + stats.digamma(d0 / 2) - np.log(d0 / 2)))))
            else:
                rows.append((float("inf"), float(np.exp(mean))))
        return pd.DataFrame(rows, columns=["d0", "s02"])

    return moments.select(*keys, solve("_m", "_v", "_df").alias("h")).select(*keys, "h.d0", "h.s02")


def moderated_t(tests: DataFrame, keys: Sequence[str], max_q: float | None = None) -> DataFrame:
    """tests with t, p and q of the moderated test, adjusted within the keys (M16): the variance is shrunk to the prior's.

    With max_q only the tests with a smaller q stay.
    """
    prior = hyper_parameters(tests, keys)
    joined = tests.join(prior, list(keys), "left")
    free = F.isnan("d0") | (F.col("d0") == float("inf"))
    s2 = F.when(free, F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df")))
    scored = joined.withColumn("_s2", s2).withColumn("t", F.try_divide(F.col("logfc"), F.sqrt(F.col("_s2") * (1 / F.col("n1") + 1 / F.col("n2")))))
    scored = scored.withColumn("df_total", F.when(free, F.lit(1e7)).otherwise(F.col("d0") + F.col("df"))).withColumn("p", stats.t_two_sided("t", "df_total"))
    adjusted = benjamini_hochberg(scored.drop("_s2", "d0", "s02"), keys, "p")
    return adjusted if max_q is None else adjusted.where(F.col("q") < max_q)


def moderated_f(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gene_id, f, p, q): the moderated F of every gene over all clusters, zeros included (M16 for more than two groups).

    Fewer than two clusters give no rows.
    """
    groups = sizes.agg(F.count("*").cast("double").alias("_k"), F.sum("n").cast("double").alias("_n")).where("_k > 1")
    parts = sums.join(sizes, "cluster").groupBy("gene_id").agg(F.sum("s").alias("_s"), F.sum("ss").alias("_ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_b"))
    joined = parts.join(F.broadcast(groups))
    between = (F.col("_b") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_k") - 1)
    tests = joined.select(F.lit(0).alias("_all"), "gene_id", between.alias("_between"), (F.col("_k") - 1).alias("_df1"), (F.col("_n") - F.col("_k")).alias("df"), F.try_divide(F.greatest(F.lit(0.0), F.col("_ss") - F.col("_b")), F.col("_n") - F.col("_k")).alias("s2"))
    shrunk = tests.join(hyper_parameters(tests, ["_all"]), "_all", "left")
    free = F.isnan("d0") | (F.col("d0") == float("inf"))
    s2 = F.when(free, F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df")))
    scored = shrunk.withColumn("f", F.try_divide("_between", s2)).withColumn("_df2", F.when(free, F.lit(1e7)).otherwise(F.col("d0") + F.col("df")))
    return benjamini_hochberg(scored.select("gene_id", "f", stats.f_upper("f", "_df1", "_df2").alias("p")), [], "p")


def significant(tests: DataFrame, min_fold: float = 1.5, quantile: float = 0.95) -> DataFrame:
    """Tests with q <= 1 - quantile and fold >= min_fold (F10); nulls fail."""
    return tests.where((F.col("q") <= F.lit(round(1 - quantile, 12))) & (F.col("fold") >= min_fold))


def two_sided(tests: DataFrame, min_fold: float = 1.5, max_q: float = 0.05, annotate: Column | None = None) -> DataFrame:
    """Tests with fold >= f or <= 1/f and q <= max_q, and those annotated."""
    kept = ((F.col("fold") >= min_fold) | (F.col("fold") <= 1 / min_fold)) & (F.col("q") <= max_q)
    return tests.where(kept if annotate is None else kept | annotate)


def detection_ratios(tests: DataFrame) -> DataFrame:
    """tests with ratio1, ratio2 (shares of cells that express the gene) and their quotient; x/0 is infinite, 0/0 null."""
    r1, r2 = F.col("nnz1") / F.col("n1"), F.col("nnz2") / F.col("n2")
    quotient = F.when(r2 > 0, F.try_divide(r1, r2)).when(r1 > 0, F.lit(float("inf")))
    return tests.withColumn("ratio1", r1).withColumn("ratio2", r2).withColumn("ratio", quotient)


def robust_markers(sums: DataFrame, sizes: DataFrame, one: Sequence, two: Sequence, *, min_fold: float = 1.5, min_ratio: float = 3.0, max_q: float = 0.05) -> DataFrame:
    """Genes that set two groups of clusters apart: moderated test, two-sided fold, detection ratio.

    The ratio must reach min_ratio either way; genes in neither group drop out (F12).
    """
    side = F.when(F.col("cluster").isin(*one), F.lit("one")).when(F.col("cluster").isin(*two), F.lit("two"))
    merged = sums.withColumn("cluster", side).where("cluster is not null").groupBy("cluster", "gene_id").agg(*(F.sum(c).alias(c) for c in ("s", "ss", "nnz")))
    counts = sizes.withColumn("cluster", side).where("cluster is not null").groupBy("cluster").agg(F.sum("n").alias("n"))
    tests = moderated_t(one_vs_rest(merged, counts, []).where("cluster = 'one'"), ["cluster"])
    rated = detection_ratios(two_sided(tests, min_fold, max_q))
    kept = rated.where((F.col("ratio") >= min_ratio) | (F.col("ratio") <= 1 / min_ratio))
    return kept.select("gene_id", "logfc", "fold", "t", "p", "q", "ratio1", "ratio2", "ratio")


def top_per_cluster(tests: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The n tests of greatest fold of every cluster, ties to the smaller gene."""
    order = Window.partitionBy(*keys).orderBy(F.desc("fold"), "gene_id")
    return tests.where("fold is not null and not isnan(fold)").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def cluster_names(significant_genes: DataFrame, types: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, name) for every cluster (M19): types of whose markers more than half are significant, by excess and
    name, joined by `_`; `Unknown` without any; names that occur twice are numbered in cluster order (W9).

    significant_genes: (cluster, gene); types: (type, gene), many to many; genes are matched letter case aside.
    """
    rules = types.select("type", F.lower("gene").alias("gene")).distinct()
    need = rules.groupBy("type").agg(F.count("*").alias("_n"))
    hits = significant_genes.select("cluster", F.lower("gene").alias("gene")).distinct().join(rules, "gene").groupBy("cluster", "type").agg(F.count("*").alias("_h"))
    excess = hits.join(need, "type").withColumn("_e", F.col("_h") - F.col("_n") / 2).where("_e > 0")
    order = F.sort_array(F.collect_list(F.struct((-F.col("_e")).alias("e"), "type")))
    named = excess.groupBy("cluster").agg(F.array_join(F.transform(order, lambda x: x.type), "_").alias("name"))
    full = clusters.select("cluster").distinct().join(named, "cluster", "left").fillna("Unknown", ["name"])
    same = Window.partitionBy("name")
    numbered = F.concat_ws("_", "name", F.row_number().over(same.orderBy("cluster")).cast("string"))
    return full.withColumn("name", F.when(F.count("*").over(same) > 1, numbered).otherwise(F.col("name")))


def set_names(member: DataFrame, names: DataFrame) -> DataFrame:
    """member with its cluster's name (M20); clusters without one have null."""
    return member.join(names.select("cluster", "name"), "cluster", "left")


def drop_clusters(member: DataFrame, removed: DataFrame) -> DataFrame:
    """Cells of other clusters."""
    return member.join(removed.select("cluster").distinct(), "cluster", "left_anti")


def keep_clusters(member: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells of these clusters (F8)."""
    return member.join(kept.select("cluster").distinct(), "cluster", "left_semi")


def varying_genes(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Values of genes whose variance over the cells, zeros included, is above zero."""
    from varve.operators.expression import moments

    stays = moments(values.join(cells.select("cell_id"), "cell_id", "left_semi"), cells, [], F.col("norm")).where("var > 1e-12")
    return values.join(cells.select("cell_id"), "cell_id", "left_semi").join(stays.select("gene_id"), "gene_id", "left_semi")
