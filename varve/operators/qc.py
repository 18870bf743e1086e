"""Quality metrics, cut-offs and filters of cells and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.order_statistics import percentiles
from varve.session import Scratch

RIBOSOMAL = "(?i)^rp[ls]"
MITOCHONDRIAL = "(?i)^mt-"


def gene_set(genes: DataFrame, pattern: str) -> DataFrame:
    """Genes whose symbol matches, letter case aside (F6); null symbols match nothing."""
    return genes.where(F.col("symbol").rlike(pattern))


def cell_metrics(counts: DataFrame, cells: DataFrame, sets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(cells' columns, numi, ngenes, <set>_mean, <set>_frac) for every cell (A1).

    A set's mean divides by the number of its genes. A cell without counts has numi and ngenes 0 and null fractions.
    """
    aggregates = [F.sum("count").alias("numi"), F.count_if(F.col("count") > 0).alias("ngenes")]
    rows, sizes = counts, {}
    for name, genes in (sets or {}).items():
        members = genes.select("gene_id").distinct()
        sizes[name] = members.agg(F.count("*").alias(f"_{name}_size"))
        rows = rows.join(members.withColumn(f"_{name}", F.lit(True)), "gene_id", "left")
        aggregates.append(F.coalesce(F.sum(F.when(F.col(f"_{name}"), F.col("count"))), F.lit(0.0)).alias(f"_{name}_sum"))
    metrics = cells.join(rows.groupBy("cell_id").agg(*aggregates), "cell_id", "left").fillna(0, ["numi", "ngenes"])
    for name, size in sizes.items():
        total = F.coalesce(F.col(f"_{name}_sum"), F.lit(0.0))
        metrics = metrics.join(F.broadcast(size)).withColumn(f"{name}_mean", F.try_divide(total, F.col(f"_{name}_size"))).withColumn(f"{name}_frac", F.try_divide(total, F.col("numi")))
        metrics = metrics.drop(f"_{name}_size", f"_{name}_sum")
    return metrics


def quantile_table(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """(keys, p, value): exact quantiles, linear between order statistics (A4). Nulls and NaN do not count."""
    return percentiles(df, keys, column, probs).drop("n")


def passing(metrics: DataFrame, *, min_genes: int = 500, genes_quantile: float = 0.98, umis_quantile: float = 0.98, max_mito: float = 0.1, max_ribo: float | None = None, marker: Column | None = None) -> DataFrame:
    """metrics with `passed` (F3). Quantile cut-offs are those of a dataset's cells before the filter.

    metrics: (cell_id, dataset, numi, ngenes, mito_frac[, ribo_frac]). Bounds are inclusive. A cell with a null among the
    values a bound needs fails it.
    """
    metrics = Scratch(metrics.sparkSession, "passing").save(metrics, "metrics")
    every = metrics.select("dataset", "cell_id", F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in ("ngenes", "numi")))).alias("e")).select("dataset", "cell_id", "e.f", "e.x")
    found = percentiles(every, ["dataset", "f"], "x", [genes_quantile, umis_quantile])
    at = lambda f, p: F.max(F.when((F.col("f") == f) & (F.col("p") == p), F.col("value")))
    cuts = found.groupBy("dataset").agg(at("ngenes", genes_quantile).alias("_g"), at("numi", umis_quantile).alias("_u"))
    fine = (F.col("ngenes") >= min_genes) & (F.col("ngenes") <= F.col("_g")) & (F.col("numi") <= F.col("_u"))
    if "mito_frac" in metrics.columns:
        fine &= F.col("mito_frac") <= max_mito
    if max_ribo is not None:
        fine &= F.col("ribo_frac") <= max_ribo
    if marker is not None:
        fine &= marker
    joined = metrics.join(cuts.withColumnRenamed("dataset", "_d"), F.col("dataset").eqNullSafe(F.col("_d")), "left")
    return joined.withColumn("passed", F.coalesce(fine, F.lit(False))).drop("_g", "_u", "_d")


def marker_filter(counts: DataFrame, cells: DataFrame, genes: DataFrame, rules: DataFrame) -> DataFrame:
    """cells with `marker_passed`: for every rule (dataset, gene, expressed) of its dataset, (count > 0) = expressed.

    Rules on unknown genes and null flags are ignored; a cell without rules passes.
    """
    known = rules.where("expressed is not null").join(genes.select(F.col("symbol").alias("gene"), "gene_id"), "gene").select("dataset", "gene_id", "expressed").distinct()
    asked = cells.select("cell_id", "dataset").join(known, "dataset")
    there = counts.where("count > 0").select("cell_id", "gene_id", F.lit(True).alias("_has"))
    verdict = asked.join(there, ["cell_id", "gene_id"], "left").groupBy("cell_id").agg(F.bool_and(F.coalesce("_has", F.lit(False)) == F.col("expressed")).alias("_ok"))
    return cells.join(verdict, "cell_id", "left").withColumn("marker_passed", F.coalesce("_ok", F.lit(True))).drop("_ok")


def prefilter(counts: DataFrame, min_genes: int) -> DataFrame:
    """Counts of cells with at least so many genes (F1)."""
    rich = counts.where("count > 0").groupBy("cell_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_genes)
    return counts.join(rich.select("cell_id"), "cell_id", "left_semi")


def subsample(cells: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Exactly m cells (all if fewer), the same on every run: those whose id and seed have the smallest digests (F2)."""
    return cells.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("cell_id").cast("string"))), "cell_id").limit(m)


def gene_counts(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """genes with n_cells, the cells that express each (A2)."""
    seen = counts.where("count > 0").groupBy("gene_id").agg(F.count("*").alias("n_cells"))
    return genes.join(seen, "gene_id", "left").fillna(0, ["n_cells"])


def gene_filter(counts: DataFrame, genes: DataFrame, min_cells: int = 1) -> DataFrame:
    """Counts of genes that at least min_cells cells express."""
    kept = gene_counts(counts, genes).where(F.col("n_cells") >= min_cells)
    return counts.join(kept.select("gene_id"), "gene_id", "left_semi")


def number_repeats(df: DataFrame, name: str, order: str, sep: str = ".") -> DataFrame:
    """df with `unique_name`: names that occur more than once get their number of occurrence (W9). Nulls stay null."""
    same = Window.partitionBy(name)
    numbered = F.concat_ws(sep, F.col(name), F.row_number().over(same.orderBy(order)).cast("string"))
    return df.withColumn("unique_name", F.when(F.col(name).isNull(), F.lit(None)).when(F.count("*").over(same) > 1, numbered).otherwise(F.col(name)))


def cap_words(text: Column | str) -> Column:
    """Lower case, then every space-separated word capitalised."""
    return F.initcap(F.lower(text))


def drop_repeated_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells whose count vector no other cell has; of equal cells, in whatever dataset, none is kept (U4).

    Vectors are told apart by two 64-bit order-free digests and their size, so that no cell's whole vector is shuffled
    twice; cells without counts are all equal to one another.
    """
    part = lambda seed: F.xxhash64(F.lit(seed), "gene_id", "count").cast("decimal(38,0)")
    digest = counts.where("count <> 0").groupBy("cell_id").agg(F.sum(part(1)).alias("_a"), F.sum(part(2)).alias("_b"), F.count("*").alias("_n"))
    marked = cells.join(digest, "cell_id", "left")
    single = marked.groupBy("_a", "_b", "_n").agg(F.count("*").alias("_c"), F.min("cell_id").alias("cell_id")).where("_c = 1")
    return cells.join(single.select("cell_id"), "cell_id", "left_semi")


def keep_first(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row of every value of a column."""
    first = df.groupBy(column).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")
