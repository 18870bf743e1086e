"""Similarity between clusters, robust pairs, and project merging."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import stats
from varve.operators.diffexp import benjamini_hochberg
from varve.session import shared_dir


def pearson(x: Column, y: Column) -> Column:
    """r of two columns over a group; null without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_p(r: Column, n: Column) -> Column:
    """The two-sided p of r over n pairs (M22); null below three pairs."""
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(stats.t_two_sided(t, (n - 2).cast("double"))))


def cluster_similarity(features: DataFrame, similarity: Callable[[Column, Column], Column] = pearson, within: Sequence[str] = ()) -> DataFrame:
    """One row per pair cluster1 < cluster2 (M23, J4, A10), or with `within` per pair of clusters that agree in these columns.

    features: (cluster, gene_id, fold, mean, q). similarity compares the folds, similarity_1 the means, by an
    exchangeable aggregate (E1); ocldist and ocldist_fc are Euclidean distances of means and folds; jaccard and
    jaccard2 compare the genes with q <= 0.05 and a fold of at least 1 and 1.5, null if neither cluster has one.
    Clusters are few; pairs meet on the gene, so the work is spread over genes.
    """
    keys = [*within, "gene_id"]
    one = features.select(*keys, *(F.col(c).alias(f"{c}1") for c in ("cluster", "fold", "mean", "q")))
    two = features.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("cluster", "fold", "mean", "q")))
    pairs = one.join(two, keys).where("cluster1 < cluster2")

    def overlap(fold: float) -> Column:
        a, b = (F.coalesce((F.col(f"q{i}") <= 0.05) & (F.col(f"fold{i}") >= fold), F.lit(False)) for i in (1, 2))
        return F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b).cast("double"))

    gap = lambda x: F.sqrt(F.sum((F.col(f"{x}1") - F.col(f"{x}2")) * (F.col(f"{x}1") - F.col(f"{x}2"))))
    return pairs.groupBy(*within, "cluster1", "cluster2").agg(
        F.count("*").alias("n_genes"), similarity(F.col("fold1"), F.col("fold2")).alias("similarity"), similarity(F.col("mean1"), F.col("mean2")).alias("similarity_1"),
        gap("mean").alias("ocldist"), gap("fold").alias("ocldist_fc"), overlap(1.0).alias("jaccard"), overlap(1.5).alias("jaccard2"),
    )


def with_significance(pairs: DataFrame) -> DataFrame:
    """pairs with significance, significance_1 and their adjusted q_val, q_val_1 over all pairs."""
    n = F.col("n_genes")
    tested = pairs.withColumn("significance", pearson_p(F.col("similarity"), n)).withColumn("significance_1", pearson_p(F.col("similarity_1"), n))
    return benjamini_hochberg(benjamini_hochberg(tested, [], "significance", "q_val"), [], "significance_1", "q_val_1")


def describe(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """pairs with each side's descriptors (cluster, name, origin, experiment, sample)."""
    for i in (1, 2):
        pairs = pairs.join(clusters.select(*(F.col(c).alias(f"{c}{i}") for c in clusters.columns)), f"cluster{i}", "left")
    return pairs


def robust_pairs(pairs: DataFrame, min_sd: float = NormalDist().inv_cdf(0.95), max_q: float | None = 0.01) -> DataFrame:
    """Pairs of one origin and different experiments whose clusters are both robust, with z within the origin.

    A cluster is robust if one of its pairs has z >= min_sd and, unless max_q is None, q_val_1 <= max_q. An origin
    with one pair has no z and no robust cluster.
    """
    own = pairs.where("origin1 = origin2 and experiment1 <> experiment2")
    over = Window.partitionBy("origin1")
    z = F.try_divide(F.col("similarity") - F.avg("similarity").over(over), F.stddev_samp("similarity").over(over))
    scored = own.withColumn("z", z)
    good = scored.where((F.col("z") >= min_sd) & (F.col("q_val_1") <= max_q if max_q is not None else F.lit(True)))
    robust = good.select(F.explode(F.array("cluster1", "cluster2")).alias("cluster")).distinct()
    both = scored.join(robust.withColumnRenamed("cluster", "cluster1"), "cluster1", "left_semi")
    return both.join(robust.withColumnRenamed("cluster", "cluster2"), "cluster2", "left_semi")


def mirrored(pairs: DataFrame, one: str = "cluster1", two: str = "cluster2") -> DataFrame:
    """The symmetric relation."""
    swapped = pairs.withColumns({one: F.col(two), two: F.col(one)})
    return pairs.unionByName(swapped.select(*pairs.columns))


def matrix(pairs: DataFrame, value: str, columns: Sequence, one: str = "cluster1", two: str = "cluster2", diagonal: float | None = 1.0) -> DataFrame:
    """Long to wide: a row per cluster, a column per listed cluster."""
    both = mirrored(pairs.select(one, two, value), one, two)
    if diagonal is not None:
        self = both.select(one).distinct().select(F.col(one), F.col(one).alias(two), F.lit(diagonal).alias(value))
        both = both.unionByName(self)
    return both.groupBy(one).pivot(two, list(columns)).agg(F.first(value))


def scaled_distances(pairs: DataFrame) -> DataFrame:
    """pairs with neg_ocldist and neg_ocldist_fc, the distances' negative z-scores over all pairs."""
    ends = pairs.agg(*(f(c).alias(f"_{n}_{c}") for c in ("ocldist", "ocldist_fc") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = pairs.join(F.broadcast(ends))
    for c in ("ocldist", "ocldist_fc"):
        joined = joined.withColumn(f"neg_{c}", -F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).drop(f"_m_{c}", f"_s_{c}")
    return joined


def sample_pair(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs between two samples, either way round."""
    low, high = sorted((a, b))
    return pairs.where((F.least("sample1", "sample2") == low) & (F.greatest("sample1", "sample2") == high))


def degrees(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(cluster, degree) in the network of pairs with similarity above the threshold."""
    ends = pairs.where(F.col("similarity") > threshold).select(F.explode(F.array("cluster1", "cluster2")).alias("cluster"))
    return ends.groupBy("cluster").agg(F.count("*").alias("degree"))


def complete_linkage(pairs: DataFrame, k: int, distance: Column) -> DataFrame:
    """(cluster, branch): complete-linkage clusters cut into k branches, a branch named by its smallest cluster.

    All mutual nearest pairs merge in one round; for complete linkage this gives the same tree as one merge at a time.
    The cut drops the highest merges.
    """
    shared_dir(pairs.sparkSession)
    gaps = pairs.select(F.col("cluster1").alias("a"), F.col("cluster2").alias("b"), distance.alias("d")).checkpoint()
    members = gaps.select(F.explode(F.array("a", "b")).alias("cluster")).distinct().checkpoint()
    merges = None
    while not gaps.isEmpty():
        both = mirrored(gaps, "a", "b")
        near = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.d").alias("d"))
        # of equal distances the smaller partner counts on both sides, so the pair (min, its nearest) is always mutual
        mutual = near.alias("x").join(near.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select("x.a", "x.b", "x.d").checkpoint()
        if mutual.isEmpty():
            mutual = gaps.orderBy("d", "a", "b").limit(1).checkpoint()
        merges = mutual if merges is None else merges.unionByName(mutual).checkpoint()
        to = mutual.select(F.col("b").alias("old"), F.col("a").alias("new"))
        for side in ("a", "b"):
            gaps = gaps.join(to, F.col(side) == F.col("old"), "left").withColumn(side, F.coalesce("new", side)).drop("old", "new")
        gaps = gaps.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d")).checkpoint()
    if merges is None:
        return members.withColumn("branch", F.col("cluster"))
    total = members.count()
    kept = merges.orderBy("d", "a", "b").limit(max(0, total - k)).select(F.col("b").alias("old"), F.col("a").alias("new")).checkpoint()
    out = members.withColumn("branch", F.col("cluster"))
    while True:
        moved = out.join(kept, F.col("branch") == F.col("old"), "left")
        if moved.where("new is not null").isEmpty():
            return out
        out = moved.select("cluster", F.coalesce("new", "branch").alias("branch")).checkpoint()


def merge_clusters(member: DataFrame, dataset: str = "dataset") -> DataFrame:
    """member with `merged`, cluster ids offset by the greatest ids of the datasets before it, in name order."""
    top = member.groupBy(dataset).agg(F.max("cluster").cast("bigint").alias("_top"))
    before = F.sum("_top").over(Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, -1))
    offsets = top.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_top")
    return member.join(offsets, dataset).withColumn("merged", F.col("cluster") + F.col("_off")).drop("_off")


def united_filter(genes: DataFrame) -> DataFrame:
    """(symbol, keep): whether any dataset keeps the gene, symbols matched letter case aside (A13); nulls do not keep."""
    return genes.where("symbol is not null").groupBy(F.lower("symbol").alias("symbol")).agg(F.bool_or(F.coalesce("keep", F.lit(False))).alias("keep"))


def merge_projects(parts: dict[str, dict[str, DataFrame]], orthologs: DataFrame | None = None) -> dict[str, DataFrame]:
    """One set of tables out of several clustered projects.

    parts: project name -> {counts, cells, genes, hvg, member}. Genes are matched by symbol (after `orthologs`, (symbol,
    other), first match) and kept if every project has them; variable genes are united (A12), cluster ids offset.
    """
    names = sorted(parts)
    renamed = {}
    for name in names:
        genes = parts[name]["genes"].select("gene_id", "symbol")
        if orthologs is not None:
            first = orthologs.groupBy(F.lower("symbol").alias("_s")).agg(F.min("other").alias("_o"))
            genes = genes.join(first, F.lower("symbol") == F.col("_s"), "left").select("gene_id", F.coalesce("_o", "symbol").alias("symbol"))
        renamed[name] = genes.groupBy(F.lower("symbol").alias("symbol")).agg(F.min("gene_id").alias("gene_id"))
    shared = None
    for name in names:
        own = renamed[name].select("symbol")
        shared = own if shared is None else shared.intersect(own)
    out: dict[str, DataFrame] = {}
    for table in ("counts", "hvg"):
        for name in names:
            part = parts[name][table].join(renamed[name].join(shared, "symbol", "left_semi"), "gene_id").drop("gene_id")
            part = part.withColumn("project", F.lit(name)) if table == "counts" else part.select("symbol")
            out[table] = part if table not in out else out[table].unionByName(part, allowMissingColumns=True)
    out["hvg"] = out["hvg"].distinct()
    for name in names:
        for table in ("cells", "member"):
            part = parts[name][table].withColumn("project", F.lit(name))
            out[table] = part if table not in out else out[table].unionByName(part, allowMissingColumns=True)
    out["member"] = merge_clusters(out["member"], "project")
    out["genes"] = shared
    return out
