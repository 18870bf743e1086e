"""Queries over vectors: neighbours, graphs, communities and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import calibration, graph, pca
from varve.plans.retail import rounded
from varve.session import Scratch
from varve.sources import views

K = 15


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark, "vectors").save(graph.knn(views.vectors(spark, d), K), "knn")


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_neighbours(spark, d))


def jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.jaccard_edges(_neighbours(spark, d), K), 9)


def modularity_given_labels(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.jaccard_edges(_neighbours(spark, d), K)
    return rounded(graph.modularity(edges, views.vectors(spark, d).select("cell_id", "cluster")), 9)


def louvain_membership(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the vectors' Jaccard graph, all levels."""
    return graph.phenograph(views.vectors(spark, d), K)[1]


def clustering_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two ratios, carried on to a third on three shuffles, on the first 20 components; real runs with their calibration."""
    runs = calibration.cluster_grid(_rows(spark, d), 20, [0.02, 0.025], 3)[0]
    name = F.concat_ws("-", "kind", F.col("rep").cast("string"), F.col("knn_ratio").cast("string")).alias("run_id")
    named = Scratch(spark, "runs").save(runs.select(F.lit("vectors").alias("project"), name, "*"), "runs")
    folds = calibration.calibrated(named, 5).select("run_id", "n_shuffled", "shuffled_mean", "shuffled_max", "fold")
    chosen = calibration.choose_ratio(folds.withColumn("project", F.lit("vectors")), named).select("run_id", F.lit(True).alias("chosen"))
    return named.drop("project").join(folds, "run_id", "left").join(chosen, "run_id", "left").fillna(False, ["chosen"])


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return views.vectors(spark, d).select("cell_id", F.col("pc").alias("v"))


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    return pca.pca(_rows(spark, d), 20)[0]


def pc_drivers(spark: SparkSession, d: str) -> DataFrame:
    return pca.drivers(pca.pca(_rows(spark, d), 20)[1], 0.05)


def pc_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return pca.permutation_test(rows, pca.pca(rows, 20)[2])


_KNN = f"""with v as (select vec_id as cell_id, embedding::double[] as pc, label as cluster from embeddings),
nn as (select a.cell_id, b.cell_id as nbr_id, list_sum(list_transform(list_zip(a.pc, b.pc), lambda x: (x[1] - x[2]) ** 2)) as d2 from v a join v b on a.cell_id <> b.cell_id),
kn as (select cell_id, row_number() over (partition by cell_id order by d2, nbr_id)::int as rank, nbr_id, d2 from nn qualify rank <= {K}),
wy as (select x.cell_id, x.nbr_id, (select count(*) from kn p join kn q on p.nbr_id = q.nbr_id where p.cell_id = x.cell_id and q.cell_id = x.nbr_id) as u from kn x),
ed as (select least(cell_id, nbr_id) as src, greatest(cell_id, nbr_id) as dst, sum(u / ({2 * K} - u) / 2) as w from wy where u > 0 group by 1, 2)
"""
ORACLES = {
    "knn_exact": _KNN + "select cell_id, rank, nbr_id, round(d2, 6) as d2 from kn",
    "jaccard_edges": _KNN + "select src, dst, round(w, 9) as w from ed",
    "modularity_given_labels": _KNN + ", en as (select a.cluster as c1, b.cluster as c2, w from ed join v a on a.cell_id = src join v b on b.cell_id = dst), dg as (select c, sum(w) as deg from (select c1 as c, w from en union all select c2, w from en) group by 1), wi as (select c1 as c, sum(w) as within from en where c1 = c2 group by 1), al as (select sum(w) as tot from en) select round(sum(coalesce(within, 0) / tot - (deg / (2 * tot)) ** 2), 9) as modularity from dg left join wi using (c), al",
}

QUERIES = {f.__name__: f for f in (knn_exact, jaccard_edges, modularity_given_labels, louvain_membership, clustering_runs, pca_scores, pc_drivers, pc_permutation_test)}
