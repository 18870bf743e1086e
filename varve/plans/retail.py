"""Queries over the retail view: customers are cells, parts are genes, market segments are datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.operators import diffexp, expression, pca, pipeline, qc, reduce, similarity
from varve.session import Scratch, table
from varve.sources import views

FRONT, OTHER = "(?i)^small", "(?i)^red"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _data(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.retail_counts(spark, d), views.retail_cells(spark, d), views.retail_genes(spark, d)


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The data with the counts saved, for plans that read them more than once."""
    counts, cells, genes = _data(spark, d)
    scratch = Scratch(spark, "counts")
    counts = scratch.save(counts, "counts")
    scratch.settle()
    return counts, cells, genes


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, genes = _data(spark, d)
    return qc.cell_metrics(counts, cells, {"ribo": qc.gene_set(genes, FRONT), "mito": qc.gene_set(genes, OTHER)})


def qc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_metrics(spark, d).select("cell_id", "numi", "ngenes", "ribo_mean", "ribo_frac", "mito_mean", "mito_frac"))


def qc_filter(spark: SparkSession, d: str) -> DataFrame:
    return qc.passing(_metrics(spark, d), min_genes=10, max_mito=0.2, max_ribo=0.3).select("cell_id", "dataset", "passed")


def qc_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(qc.quantile_table(_metrics(spark, d), ["dataset"], "ngenes", [0.01, 0.25, 0.5, 0.75, 0.99]))


def qc_metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reduce.qc_pairs(_metrics(spark, d), ["numi", "ngenes", "ribo_frac"]))


def marker_cell_filter(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, genes = _data(spark, d)
    large = table(spark, d, "part").where("p_size = 50 and p_brand in ('Brand#1', 'Brand#2')").select(F.col("p_partkey").alias("gene_id"))
    rules = genes.join(large, "gene_id").join(cells.select("dataset").distinct()).select("dataset", F.col("symbol").alias("gene"), F.lit(False).alias("expressed"))
    return qc.marker_filter(counts, cells, genes, rules).select("cell_id", "dataset", "marker_passed")


def gene_filter(spark: SparkSession, d: str) -> DataFrame:
    counts, _, genes = _data(spark, d)
    kept = qc.gene_filter(counts, genes, 20)
    return qc.gene_counts(kept, genes).where("n_cells > 0").select("gene_id", "symbol", "n_cells")


def prefilter_cells(spark: SparkSession, d: str) -> DataFrame:
    counts, _, _ = _data(spark, d)
    return qc.prefilter(counts, 30).groupBy("cell_id").agg(F.count("*").alias("n_genes"))


def subsample_cells(spark: SparkSession, d: str) -> DataFrame:
    """exactly 100 cells, the same on every run."""
    return qc.subsample(views.retail_cells(spark, d), 100, seed=3).select("cell_id", "dataset")


def normalize_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(expression.normalise(views.retail_counts(spark, d)).select("cell_id", "gene_id", "norm"))


def _passed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The normalised counts and the cells that pass the quality filter."""
    counts, cells, _ = _kept(spark, d)
    metrics = qc.passing(qc.cell_metrics(counts, cells), min_genes=10).where("passed")
    kept = metrics.select("cell_id", "dataset", "origin", "experiment")
    return expression.normalise(counts).join(kept.select("cell_id"), "cell_id", "left_semi"), kept


def hvg(spark: SparkSession, d: str) -> DataFrame:
    norm, cells = _passed(spark, d)
    return rounded(expression.variable_genes(norm, cells))


def hvg_union(spark: SparkSession, d: str) -> DataFrame:
    return expression.variable_genes(*_passed(spark, d)).select("gene_id").distinct()


def hvg_shared(spark: SparkSession, d: str) -> DataFrame:
    """Genes variable in both of two datasets, and in neither list alone."""
    found = expression.variable_genes(*_passed(spark, d))
    return found.where("dataset = 'BUILDING'").select("gene_id").intersect(found.where("dataset = 'MACHINERY'").select("gene_id"))


def gene_moments(spark: SparkSession, d: str) -> DataFrame:
    norm, cells = _passed(spark, d)
    return rounded(expression.moments(norm, cells, ["dataset"], F.col("norm")))


def signature_mean(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, genes = _data(spark, d)
    return rounded(expression.signature_mean(expression.normalise(counts), cells, qc.gene_set(genes, FRONT)))


def _signature(spark: SparkSession, d: str) -> DataFrame:
    """The parts of one brand as a signature."""
    return table(spark, d, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("gene_id"))


def similar_genes(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, _ = _kept(spark, d)
    norm = Scratch(spark, "norm").save(expression.normalise(counts), "norm")
    return expression.similar_genes(expression.technical_features(norm, cells), _signature(spark, d), 5)


def controlled_score(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, _ = _kept(spark, d)
    norm = Scratch(spark, "norm").save(expression.normalise(counts), "norm")
    return rounded(expression.controlled_score(norm, cells, _signature(spark, d), 5))


def cell_cycle_scores(spark: SparkSession, d: str) -> DataFrame:
    """M5: the list of stages is that of the parts of the three smallest sizes, in order of their keys."""
    counts, cells, genes = _kept(spark, d)
    norm = Scratch(spark, "norm").save(expression.normalise(counts), "norm")
    small = table(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("gene_id")).join(genes, "gene_id")
    listed = small.select(F.row_number().over(Window.orderBy("gene_id")).alias("at"), F.upper("symbol").alias("symbol"))
    return rounded(expression.cell_cycle_scores(norm, cells, genes, listed, 5))


def ribosomal_score(spark: SparkSession, d: str) -> DataFrame:
    """M4 against the genes' background."""
    counts, cells, genes = _kept(spark, d)
    norm = Scratch(spark, "norm").save(expression.normalise(counts), "norm")
    return rounded(expression.gene_set_score(norm, cells, genes, FRONT, control=True, k=5))


def read_data(spark: SparkSession, d: str) -> DataFrame:
    """M1: the cells of all segments, read as datasets, filtered and merged."""
    counts, cells, genes = _data(spark, d)
    counts = Scratch(spark, "read").save(counts, "counts")
    of = lambda df, name: df.where(F.col("dataset") == name)
    names = [r[0] for r in cells.select("dataset").distinct().collect()]
    parts = {n: (of(counts, n), genes, of(cells, n).select("cell_id")) for n in names}
    return pipeline.read_data(parts, min_genes=10)["cells"].select("cell_id", "dataset", "numi", "ngenes")


def _variable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised counts, cells and the genes that vary most in a segment."""
    scratch = Scratch(spark, "variable")
    norm, cells = (scratch.save(x, n) for x, n in zip(_passed(spark, d), ("norm", "cells"), strict=True))
    scratch.settle()
    return norm, cells, expression.variable_genes(norm, cells, min_z=2.5).select("gene_id").distinct()


def variable_components(spark: SparkSession, d: str) -> DataFrame:
    """The components of the variable genes against shuffled data."""
    return pipeline.components(*_variable(spark, d), max_pcs=50)[2]


def variable_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Variable genes, components, a real and a shuffled clustering, calibrated. Retail data hold no structure, so
    ten components are taken whatever their p. Without a component there is no run."""
    try:
        runs = pipeline.cluster_cells(*_variable(spark, d), ratios=(0.03,), shuffles=1, nearest=1, n_pcs=10, max_pcs=50, reps=2)["calibrated"]
    except pca.NoComponents:
        runs = spark.createDataFrame([], "run_id string, n_clusters int, modularity double, n_shuffled bigint, shuffled_mean double, shuffled_max double, fold double")
    return rounded(runs.select("run_id", "n_clusters", "modularity", "n_shuffled", "shuffled_mean", "shuffled_max", "fold"))


def signature_match(spark: SparkSession, d: str) -> DataFrame:
    """The first gene of every symbol listed, letter case aside, with the symbol capitalised."""
    genes = table(spark, d, "genes").select(F.col("gene_id"), "symbol")
    listed = table(spark, d, "genes").where("n_cells > 100 and symbol is not null").select(F.upper("symbol").alias("symbol"))
    return expression.match_signature(genes, listed).select("symbol", qc.cap_words("symbol").alias("display"), "gene_id")


def _covariates(spark: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    sizes = views.retail_counts(spark, d).groupBy("cell_id").agg(F.ln(F.sum("count")).alias("depth"), F.count("*").cast("double").alias("width"))
    return cells.join(sizes, "cell_id").select("cell_id", "dataset", "depth", "width")


def regress_residuals(spark: SparkSession, d: str) -> DataFrame:
    """M7: what depth and gene count leave of the most variable genes, zeros included, by dataset."""
    norm, cells = _passed(spark, d)
    scratch = Scratch(spark, "residuals")
    norm, cells = scratch.save(norm, "norm"), scratch.save(cells, "cells")
    covariates = scratch.save(_covariates(spark, d, cells), "covariates")
    some = scratch.save(expression.variable_genes(norm, cells, min_z=2.5).select("dataset", "gene_id"), "genes")
    betas = expression.regress_all(norm.join(some, ["dataset", "gene_id"], "left_semi"), covariates, ["depth", "width"])
    return rounded(expression.residuals(norm, covariates, betas, ["depth", "width"]), 5)


def regress_genes(spark: SparkSession, d: str) -> DataFrame:
    """M7: coefficients of every gene on the cell's depth and gene count, by dataset."""
    norm, cells = _passed(spark, d)
    covariates = Scratch(spark, "regress").save(_covariates(spark, d, cells), "covariates")
    betas = expression.regress_all(norm, covariates, ["depth", "width"])
    return betas.select("dataset", "gene_id", *(F.round(F.col("beta")[i], 6).alias(c) for i, c in enumerate(("intercept", "depth", "width"))))


def _sums(spark: SparkSession, d: str, keys: list[str], cluster: str) -> tuple[DataFrame, DataFrame]:
    counts, cells, _ = _kept(spark, d)
    scratch = Scratch(spark, "sums")
    sums, sizes = diffexp.cluster_sums(expression.normalise(counts), cells.withColumn("cluster", F.expr(cluster)), keys)
    return scratch.save(sums, "sums"), scratch.save(sizes, "sizes")


def de_one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    """Every market segment against the others."""
    tests = diffexp.pooled_t(diffexp.one_vs_rest(*_sums(spark, d, [], "dataset"), []))
    return rounded(tests.select("cluster", "gene_id", "n1", "n2", "mean1", "mean2", "logfc", "fold", "t", "ave_expr"), 5)


def de_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """M17 with a contrast per region; the strongest genes of each test (F10 without its p-value)."""
    tests = diffexp.pooled_t(diffexp.one_vs_rest(*_sums(spark, d, ["origin"], "dataset"), ["origin"]))
    return rounded(tests.where("fold >= 1.05").select("origin", "cluster", "gene_id", "logfc", "t"), 5)


def de_moderated(spark: SparkSession, d: str) -> DataFrame:
    tests = diffexp.one_vs_rest(*_sums(spark, d, [], "dataset"), [])
    return diffexp.moderated_t(tests, ["cluster"]).select("cluster", "gene_id", "logfc", "fold", "t", "p", "q", "ave_expr")


def detection_ratios(spark: SparkSession, d: str) -> DataFrame:
    tests = diffexp.detection_ratios(diffexp.one_vs_rest(*_sums(spark, d, [], "dataset"), []))
    return rounded(tests.select("cluster", "gene_id", "ratio1", "ratio2", "ratio"))


def robust_markers(spark: SparkSession, d: str) -> DataFrame:
    """M18 between segments, at bounds that retail data, which hold no real differences, can meet and fail."""
    return diffexp.robust_markers(*_sums(spark, d, [], "dataset"), ["BUILDING"], ["MACHINERY", "HOUSEHOLD"], min_fold=1.02, min_ratio=1.2, max_q=0.9)


def cluster_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reduce.heatmap(*_sums(spark, d, [], "dataset")))


def heatmap_row_order(spark: SparkSession, d: str) -> DataFrame:
    heat = reduce.heatmap(*_sums(spark, d, [], "dataset")).withColumn("mean", F.round("mean", 9))
    return reduce.row_order(heat)


def heatmap_scaled(spark: SparkSession, d: str) -> DataFrame:
    heat = reduce.heatmap(*_sums(spark, d, [], "dataset"))
    return rounded(reduce.scaled(heat, "cluster").select("cluster", "gene_id", "z"), 5)


def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """Segments named by the brands of the parts that stand out in them."""
    genes = views.retail_genes(spark, d)
    tests = diffexp.one_vs_rest(*_sums(spark, d, [], "dataset"), [])
    strong = tests.where("round(fold, 9) >= 1.0").join(genes, "gene_id").select("cluster", F.col("symbol").alias("gene"))
    brands = table(spark, d, "part").join(genes, F.col("p_partkey") == F.col("gene_id"))
    return diffexp.cluster_names(strong, brands.select(F.col("p_brand").alias("type"), F.col("symbol").alias("gene")), tests)


def named_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their segment's name, without one segment."""
    member = views.retail_cells(spark, d).select("cell_id", F.col("dataset").alias("cluster"))
    names = member.select("cluster").distinct().withColumn("name", qc.cap_words("cluster"))
    gone = member.where("cluster = 'FURNITURE'").select("cluster")
    return diffexp.set_names(diffexp.drop_clusters(member, gone), names)


def varying_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes that still vary among the cells of two segments."""
    counts, cells, _ = _data(spark, d)
    member = cells.select("cell_id", F.col("dataset").alias("cluster"))
    kept = diffexp.keep_clusters(member, member.where("cluster in ('BUILDING', 'MACHINERY')"))
    return diffexp.varying_genes(expression.normalise(counts), kept).groupBy("gene_id").agg(F.count("*").alias("n_cells"))


SAMPLE = "concat(origin, '/', dataset)"


def _pairs(spark: SparkSession, d: str, tested: bool = False) -> DataFrame:
    """Pairs of the 25 (region, segment) clusters, origin being the region and experiment the segment.

    The Jaccard columns count the genes by fold alone, as the SQL does, or with `tested` those with q <= 0.05 too.
    """
    tests = diffexp.one_vs_rest(*_sums(spark, d, [], SAMPLE), [])
    q = diffexp.moderated_t(tests, ["cluster"]) if tested else tests.withColumn("q", F.lit(0.0))
    features = q.select("cluster", "gene_id", "fold", F.col("mean1").alias("mean"), "q")
    names = views.retail_cells(spark, d).select(F.expr(SAMPLE).alias("cluster"), "origin", F.col("dataset").alias("experiment"), F.concat(F.lit("s-"), F.expr(SAMPLE)).alias("sample")).distinct()
    return Scratch(spark, "pairs").save(similarity.describe(similarity.cluster_similarity(features), names), "pairs")


def cluster_similarity(spark: SparkSession, d: str) -> DataFrame:
    columns = ["cluster1", "cluster2", "n_genes", "similarity", "similarity_1", "ocldist", "ocldist_fc", "jaccard", "jaccard2"]
    return rounded(_pairs(spark, d).select(*columns), 5)


def cluster_similarity_q(spark: SparkSession, d: str) -> DataFrame:
    """M23 with the q of the moderated test in the Jaccard columns."""
    columns = ["cluster1", "cluster2", "n_genes", "similarity", "similarity_1", "ocldist", "ocldist_fc", "jaccard", "jaccard2"]
    return rounded(_pairs(spark, d, tested=True).select(*columns), 5)


def similarity_significance(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.with_significance(_pairs(spark, d))
    return rounded(found.select("cluster1", "cluster2", "similarity", "significance", "q_val", "significance_1", "q_val_1"), 5)


def robust_similarity(spark: SparkSession, d: str) -> DataFrame:
    """M24 by z alone."""
    found = similarity.robust_pairs(_pairs(spark, d), min_sd=0.5, max_q=None)
    return rounded(found.select("cluster1", "cluster2", "similarity", "z"), 5)


def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Similarities within one region as a square table by segment."""
    own = _pairs(spark, d).where("origin1 = 'ASIA' and origin2 = 'ASIA'").select(F.col("experiment1").alias("one"), F.col("experiment2").alias("two"), "similarity")
    wide = similarity.matrix(own, "similarity", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "one", "two")
    return rounded(wide, 5)


def sample_pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The pair of two samples, either way round."""
    found = similarity.sample_pair(_pairs(spark, d), "s-EUROPE/BUILDING", "s-ASIA/BUILDING")
    return rounded(found.select("cluster1", "cluster2", "similarity", "ocldist_fc"), 5)


def similarity_scaled(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.scaled_distances(_pairs(spark, d))
    return rounded(found.select("cluster1", "cluster2", "neg_ocldist", "neg_ocldist_fc"), 5)


def mitochondrial_score(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, genes = _data(spark, d)
    return rounded(expression.gene_set_score(expression.normalise(counts), cells, genes, OTHER, control=False))


def moderated_f(spark: SparkSession, d: str) -> DataFrame:
    return diffexp.moderated_f(*_sums(spark, d, [], "dataset"))


def top_marker_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """V7: means of the five genes of greatest fold of every segment, in all segments."""
    sums, sizes = _sums(spark, d, [], "dataset")
    tests = diffexp.one_vs_rest(sums, sizes, []).withColumn("fold", F.round("fold", 9))
    leaders = diffexp.top_per_cluster(tests, ["cluster"], 5).select("gene_id").distinct()
    return rounded(reduce.heatmap(sums, sizes).join(leaders, "gene_id", "left_semi").select("cluster", "gene_id", "mean"))


def similarity_degree(spark: SparkSession, d: str) -> DataFrame:
    return similarity.degrees(_pairs(spark, d).withColumn("similarity", F.round("similarity", 9)), 0.0)


def similarity_branches(spark: SparkSession, d: str) -> DataFrame:
    """The clusters cut into eight branches by complete linkage of 1 - similarity."""
    return similarity.complete_linkage(_pairs(spark, d), 8, 1 - F.col("similarity"))


def pair_scatter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reduce.pair_scatter(expression.normalise(views.retail_counts(spark, d)), views.retail_cells(spark, d), 1, 2))


def activation_overlay(spark: SparkSession, d: str) -> DataFrame:
    counts, cells, genes = _data(spark, d)
    return rounded(reduce.activation(expression.normalise(counts), cells, qc.gene_set(genes, FRONT)), 5)


def minmax_violin(spark: SparkSession, d: str) -> DataFrame:
    """V6: quartiles by segment of every gene's values scaled to its least and greatest."""
    norm = expression.normalise(views.retail_counts(spark, d))
    scaled = reduce.min_max(norm, ["gene_id"], "norm")
    return rounded(reduce.quartiles(scaled, ["dataset"], "scaled"))


def group_means(spark: SparkSession, d: str) -> DataFrame:
    """A5: mean and greatest value by segment and gene set."""
    counts, _, genes = _data(spark, d)
    norm = expression.normalise(counts).join(qc.gene_set(genes, FRONT).select("gene_id"), "gene_id", "left_semi")
    return rounded(reduce.by_group(norm, ["dataset"], "norm", F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm")))


def dedupe_all_copies(spark: SparkSession, d: str) -> DataFrame:
    """U4: posts whose word counts no other post has."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), F.coalesce("lang", F.lit("?")).alias("dataset"), "text")
    tokens = docs.select("cell_id", "dataset", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("token"))
    counts = tokens.groupBy("cell_id", "dataset", F.col("token").alias("gene_id")).agg(F.count("*").cast("double").alias("count"))
    return qc.drop_repeated_cells(counts, docs.select("cell_id", "dataset"))


_BASE = """with rc as (select c_custkey as cell_id, c_mktsegment as dataset, r_name as origin, n_name as experiment from customer
             join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cnt as (select o_custkey as cell_id, l_partkey as gene_id, sum(l_quantity) as cnt from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
c as (select cnt.cell_id, gene_id, dataset, cnt from cnt join rc using (cell_id) where cnt <> 0),
g as (select p_partkey as gene_id, replace(p_name, ' ', '-') || '-' || p_partkey as symbol from part),
tot as (select cell_id, sum(cnt) as numi, count(*) as ngenes from c group by 1),
nrm as (select c.cell_id, gene_id, dataset, ln(1e4 * cnt / numi + 1) as norm from c join tot using (cell_id)),
front as (select gene_id from g where regexp_matches(symbol, '(?i)^small')),
met as (select rc.cell_id, rc.dataset, coalesce(numi, 0.0) as numi, coalesce(ngenes, 0) as ngenes,
  coalesce(r, 0) / (select count(*) from front) as ribo_mean, coalesce(r, 0) / nullif(numi, 0) as ribo_frac,
  coalesce(m, 0) / (select count(*) from g where regexp_matches(symbol, '(?i)^red')) as mito_mean, coalesce(m, 0) / nullif(numi, 0) as mito_frac
  from rc left join tot using (cell_id) left join (select cell_id, sum(cnt) filter (where regexp_matches(symbol, '(?i)^small')) as r,
       sum(cnt) filter (where regexp_matches(symbol, '(?i)^red')) as m from c join g using (gene_id) group by 1) using (cell_id)),
"""
_OK = """cut as (select dataset, quantile_cont(ngenes, 0.98) as qg, quantile_cont(numi, 0.98) as qu from met group by 1),
ok as (select cell_id, dataset from met join cut using (dataset) where ngenes >= 10 and ngenes <= qg and numi <= qu),
np as (select nrm.* from nrm semi join ok using (cell_id)),
"""
_HVG = (
    _OK
    + """sz as (select dataset, count(*)::double as n from ok group by 1),
s as (select dataset, gene_id, sum(exp(norm) - 1) as s, sum((exp(norm) - 1) * (exp(norm) - 1)) as q, count(*) as p from np group by 1, 2),
lv as (select dataset, gene_id, p / n as frac, ln(s / n + 1) as mean, case when n > 1 and (q - s * s / n) > 0 then ln((q - s * s / n) / (n - 1) / (s / n)) end as dispersion from s join sz using (dataset)),
bn as (select *, case when max(mean) over w > min(mean) over w then least(20, greatest(1, ceil((mean - min(mean) over w) / ((max(mean) over w - min(mean) over w) / 20)))) else 1 end::int as bin
       from lv window w as (partition by dataset)),
zz as (select *, coalesce((dispersion - avg(dispersion) over b) / nullif(stddev_samp(dispersion) over b, 0), 0) as z from bn window b as (partition by dataset, bin)),
hv as (select * from zz where mean >= 0.05 and z >= 1)
"""
)


def _de(cluster: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    using = f"using ({keys})" if keys else "on true"
    on = f"({keys}, cluster, gene_id)" if keys else "(cluster, gene_id)"
    return f"""mb as (select cell_id, {k}{cluster} as cluster from rc),
sm as (select {k}cluster, gene_id, sum(norm) as s, sum(norm * norm) as ss, count(*) as nnz from nrm join mb using (cell_id) group by all),
sz as (select {k}cluster, count(*) as n from mb group by all),
wh as (select {k}gene_id, sum(s) as ts, sum(ss) as tss, sum(nnz) as tn from sm group by all),
nt as (select {k}sum(n) as tot_n from sz {"group by " + keys if keys else ""}),
fl as (select sz.*, wh.gene_id, ts, tss, tn, tot_n from sz join nt {using} join wh {using}),
f2 as (select {k}cluster, gene_id, n, tot_n, coalesce(s, 0) as s, coalesce(ss, 0) as ss, coalesce(nnz, 0) as nnz, ts, tss, tn from fl left join sm using {on} where tot_n > n),
te as (select *, n::bigint as n1, (tot_n - n)::bigint as n2, s / n as mean1, (ts - s) / (tot_n - n) as mean2, s / n - (ts - s) / (tot_n - n) as logfc,
       greatest(0, tss - s * s / n - (ts - s) * (ts - s) / (tot_n - n)) / (tot_n - 2) as s2, ts / tot_n as ave_expr from f2)
"""


_SIM = (
    _de("origin || '/' || dataset")
    + """, ft as (select cluster, gene_id, exp(logfc) as fold, mean1 as mean from te),
pr as (select a.cluster as cluster1, b.cluster as cluster2, count(*) as n_genes,
  case when stddev_pop(a.fold) > 0 and stddev_pop(b.fold) > 0 then corr(a.fold, b.fold) end as similarity, case when stddev_pop(a.mean) > 0 and stddev_pop(b.mean) > 0 then corr(a.mean, b.mean) end as similarity_1,
  sqrt(sum((a.mean - b.mean) ** 2)) as ocldist, sqrt(sum((a.fold - b.fold) ** 2)) as ocldist_fc,
  count(*) filter (where a.fold >= 1 and b.fold >= 1) / nullif(count(*) filter (where a.fold >= 1 or b.fold >= 1), 0) as jaccard,
  count(*) filter (where a.fold >= 1.5 and b.fold >= 1.5) / nullif(count(*) filter (where a.fold >= 1.5 or b.fold >= 1.5), 0) as jaccard2
  from ft a join ft b using (gene_id) where a.cluster < b.cluster group by 1, 2),
pd as (select *, split_part(cluster1, '/', 1) as origin1, split_part(cluster2, '/', 1) as origin2, split_part(cluster1, '/', 2) as experiment1, split_part(cluster2, '/', 2) as experiment2 from pr)
"""
)
_FEATURES = """sg as (select gene_id, sum(norm) as s, sum(norm * norm) as q from nrm group by 1),
nn as (select count(*)::double as n from rc),
st as (select gene_id, s / n as mean, greatest(0, (q - s * s / n) / (n - 1)) as var from sg, nn),
te as (select gene_id, coalesce((mean - avg(mean) over ()) / nullif(stddev_samp(mean) over (), 0), 0) as m, coalesce((var - avg(var) over ()) / nullif(stddev_samp(var) over (), 0), 0) as v from st),
sig as (select p_partkey as gene_id from part where p_brand = 'Brand#3'),
nr as (select a.gene_id, b.gene_id as other, row_number() over (partition by a.gene_id order by (b.m - a.m) * (b.m - a.m) + (b.v - a.v) * (b.v - a.v), b.gene_id)::int as rank
       from te a semi join sig on a.gene_id = sig.gene_id join te b on a.gene_id <> b.gene_id qualify rank <= 5)
"""


def correlation_p(r: str, n: str) -> str:
    """The two-sided p of a correlation over n pairs, by the finite series of Student's t for whole degrees of freedom n - 2."""
    c2, m = f"ln(greatest(1 - {r} * {r}, 1e-300))", f"({n} - 2)"
    even = f"abs({r}) * list_sum(list_transform(range(0, ({m} // 2)::bigint), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + j * {c2})))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, (({m} - 1) // 2)::bigint), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5) + (j + 0.5) * {c2}))), 0))"
    return f"case when {r} is null or {n} < 3 then null when abs({r}) >= 1 then 0.0 else greatest(0.0, 1 - (case when {m} % 2 = 0 then {even} else {odd} end)) end"


def _adjusted(p: str, q: str, source: str) -> str:
    """(cluster1, cluster2, q): adjusted p-values over all rows of the source."""
    raw = f"select cluster1, cluster2, {p} as p, {p} * count(*) over () / count(*) over (order by {p} range between unbounded preceding and current row) as raw from {source} where {p} is not null"
    return f"(select cluster1, cluster2, least(1.0, min(raw) over (order by p range between current row and unbounded following)) as {q} from ({raw}))"


_REGRESS = """cv as (select cell_id, ok.dataset, ln(numi) as x, ngenes::double as y from ok join tot using (cell_id)),
ds as (select dataset, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) - sum(x) ** 2 / count(*) as sxx, sum(y * y) - sum(y) ** 2 / count(*) as syy, sum(x * y) - sum(x) * sum(y) / count(*) as sxy from cv group by 1),
gp as (select dataset, gene_id, sum(norm) as s, sum(norm * x) as gx, sum(norm * y) as gy from np join cv using (cell_id, dataset) group by 1, 2),
cs as (select dataset, gene_id, s, n, sx, sy, ((gx - s * sx / n) * syy - (gy - s * sy / n) * sxy) / (sxx * syy - sxy ** 2) as b1, ((gy - s * sy / n) * sxx - (gx - s * sx / n) * sxy) / (sxx * syy - sxy ** 2) as b2 from gp join ds using (dataset)),
be as (select dataset, gene_id, s / n - b1 * sx / n - b2 * sy / n as b0, b1, b2 from cs),
"""


def _scores(sets: str, columns: str) -> str:
    """Scores against the background of every named set (name, gene_id), five neighbours a gene."""
    body = f"""sets as ({sets}),
nb as (select name, a.gene_id, b.gene_id as other from sets join te a using (gene_id) join te b on a.gene_id <> b.gene_id
  qualify row_number() over (partition by name, a.gene_id order by (b.m - a.m) * (b.m - a.m) + (b.v - a.v) * (b.v - a.v), b.gene_id) <= 5),
bk as (select distinct nb.name, other as gene_id from nb anti join sets on nb.name = sets.name and nb.other = sets.gene_id),
wt as (select name, gene_id, 1.0 / count(*) over (partition by name) as w from sets union all select name, gene_id, -1.0 / count(*) over (partition by name) from bk),
sm as (select cell_id, name, sum(norm * w) as score from nrm join wt using (gene_id) group by 1, 2)
"""
    return _q(f"select rc.cell_id, {columns} from rc left join sm using (cell_id) group by 1", _FEATURES.split("sig as")[0], body)


def _q(body: str, *parts: str) -> str:
    return (_BASE + "".join(parts)).rstrip().rstrip(",") + "\n" + body


ORACLES = {
    "qc_metrics": _q("select cell_id, round(numi, 6) as numi, ngenes, round(ribo_mean, 6) as ribo_mean, round(ribo_frac, 6) as ribo_frac, round(mito_mean, 6) as mito_mean, round(mito_frac, 6) as mito_frac from met"),
    "qc_filter": _q("select cell_id, dataset, coalesce(ngenes >= 10 and ngenes <= qg and numi <= qu and mito_frac <= 0.2 and ribo_frac <= 0.3, false) as passed from met join (select dataset, quantile_cont(ngenes, 0.98) as qg, quantile_cont(numi, 0.98) as qu from met group by 1) using (dataset)"),
    "qc_quantiles": _q("select dataset, p::double as p, round(quantile_cont(ngenes, 0.01) filter (where p = 0.01), 6) as value from met, (select 0.01 as p) group by dataset, p union all select dataset, 0.25, round(quantile_cont(ngenes, 0.25), 6) from met group by 1 union all select dataset, 0.5, round(quantile_cont(ngenes, 0.5), 6) from met group by 1 union all select dataset, 0.75, round(quantile_cont(ngenes, 0.75), 6) from met group by 1 union all select dataset, 0.99, round(quantile_cont(ngenes, 0.99), 6) from met group by 1"),
    "qc_metric_pairs": _q("select cell_id, 'numi' as a, 'ngenes' as b, round(numi, 6) as x, round(ngenes::double, 6) as y from met union all select cell_id, 'numi', 'ribo_frac', round(numi, 6), round(ribo_frac, 6) from met union all select cell_id, 'ngenes', 'ribo_frac', round(ngenes::double, 6), round(ribo_frac, 6) from met"),
    "marker_cell_filter": _q("select rc.cell_id, rc.dataset, not exists (select 1 from c where c.cell_id = rc.cell_id and gene_id in (select p_partkey from part where p_size = 50 and p_brand in ('Brand#1', 'Brand#2')) and cnt > 0) as marker_passed from rc"),
    "gene_filter": _q("select gene_id, symbol, count(*) as n_cells from c join g using (gene_id) group by 1, 2 having count(*) >= 20"),
    "prefilter_cells": _q("select cell_id, count(*) as n_genes from c group by 1 having count(*) >= 30"),
    "normalize_log": _q("select cell_id, gene_id, round(norm, 6) as norm from nrm"),
    "hvg": _q("select dataset, gene_id, round(mean, 6) as mean, round(dispersion, 6) as dispersion, bin, round(z, 6) as z from hv", _HVG),
    "hvg_union": _q("select distinct gene_id from hv", _HVG),
    "hvg_shared": _q("select gene_id from hv where dataset = 'BUILDING' intersect select gene_id from hv where dataset = 'MACHINERY'", _HVG),
    "gene_moments": _q("select dataset, gene_id, n, round(sum(norm) / n, 6) as mean, round(case when n > 1 then greatest(0, (sum(norm * norm) - sum(norm) * sum(norm) / n) / (n - 1)) end, 6) as var, round(count(*) / n, 6) as frac from np join (select dataset, count(*)::double as n from ok group by 1) using (dataset) group by dataset, gene_id, n", _OK),
    "signature_mean": _q("select rc.cell_id, round(coalesce(sum(norm) filter (where front.gene_id is not null), 0) / (select count(*) from front), 6) as score from rc left join nrm using (cell_id) left join front using (gene_id) group by 1"),
    "similar_genes": _q("select gene_id, rank, other from nr", _FEATURES),
    "controlled_score": _q("select rc.cell_id, round(coalesce(sum(norm) filter (where nrm.gene_id in (select gene_id from sig)), 0) / (select count(*) from sig) - coalesce(sum(norm) filter (where nrm.gene_id in (select gene_id from bk)), 0) / (select count(*) from bk), 6) as score from rc left join nrm using (cell_id) group by 1", _FEATURES, ", bk as (select distinct other as gene_id from nr where other not in (select gene_id from sig))\n"),
    "signature_match": "with l as (select distinct upper(symbol) as symbol from genes where n_cells > 100 and symbol is not null), f as (select lower(symbol) as s, min(gene_id) as gene_id from genes where symbol is not null group by 1) select symbol, upper(symbol[1]) || lower(symbol[2:]) as display, gene_id from l join f on lower(symbol) = s",
    "de_one_vs_rest": _q("select cluster, gene_id, n1, n2, round(mean1, 5) as mean1, round(mean2, 5) as mean2, round(logfc, 5) as logfc, round(exp(logfc), 5) as fold, round(logfc / nullif(sqrt(s2 * (1 / n1 + 1 / n2)), 0), 5) as t, round(ave_expr, 5) as ave_expr from te", _de("dataset")),
    "de_by_origin": _q("select origin, cluster, gene_id, round(logfc, 5) as logfc, round(logfc / nullif(sqrt(s2 * (1 / n1 + 1 / n2)), 0), 5) as t from te where exp(logfc) >= 1.05", _de("dataset", "origin")),
    "detection_ratios": _q("select cluster, gene_id, round(nnz / n1, 6) as ratio1, round((tn - nnz) / n2, 6) as ratio2, round(case when tn > nnz then (nnz / n1) / ((tn - nnz) / n2) when nnz > 0 then 'inf'::double end, 6) as ratio from te", _de("dataset")),
    "cluster_heatmap": _q("select cluster, gene_id, round(mean1, 6) as mean, round(exp(mean1), 6) as exp_mean, round(nnz / n, 6) as detection from te", _de("dataset")),
    "heatmap_row_order": _q("select gene_id, cluster from te qualify row_number() over (partition by gene_id order by round(mean1, 9) desc, cluster) = 1", _de("dataset")),
    "heatmap_scaled": _q("select cluster, gene_id, round((mean1 - avg(mean1) over (partition by cluster)) / stddev_samp(mean1) over (partition by cluster), 5) as z from te", _de("dataset")),
    "cluster_names": _q("select cluster, case when count(*) over (partition by name) > 1 then name || '_' || row_number() over (partition by name order by cluster) else name end as name from (select cluster, coalesce(string_agg(type, '_' order by e desc, type), 'Unknown') as name from (select distinct cluster from te) left join ex using (cluster) group by 1)",
        _de("dataset"), ", ty as (select p_brand as type, p_partkey as gene_id from part), ex as (select cluster, type, count(*) - any_value(need) / 2 as e from te join ty using (gene_id) join (select type, count(*) as need from ty group by 1) using (type) where round(exp(logfc), 9) >= 1 group by 1, 2 having count(*) - any_value(need) / 2 > 0)\n"),
    "named_cells": _q("select cell_id, dataset as cluster, upper(dataset[1]) || lower(dataset[2:]) as name from rc where dataset <> 'FURNITURE'"),
    "varying_genes": _q("select gene_id, count(*) as n_cells from nrm where dataset in ('BUILDING', 'MACHINERY') group by 1 having (sum(norm * norm) - sum(norm) * sum(norm) / (select count(*) from rc where dataset in ('BUILDING', 'MACHINERY'))) / (select count(*) - 1 from rc where dataset in ('BUILDING', 'MACHINERY')) > 1e-12"),
    "cluster_similarity": _q("select cluster1, cluster2, n_genes, round(similarity, 5) as similarity, round(similarity_1, 5) as similarity_1, round(ocldist, 5) as ocldist, round(ocldist_fc, 5) as ocldist_fc, round(jaccard, 5) as jaccard, round(jaccard2, 5) as jaccard2 from pr", _SIM),
    "robust_similarity": _q("select cluster1, cluster2, round(similarity, 5) as similarity, round(z, 5) as z from zs where cluster1 in (select cl from rb) and cluster2 in (select cl from rb)", _SIM, ", zs as (select *, (similarity - avg(similarity) over (partition by origin1)) / stddev_samp(similarity) over (partition by origin1) as z from pd where origin1 = origin2 and experiment1 <> experiment2), rb as (select cluster1 as cl from zs where z >= 0.5 union select cluster2 from zs where z >= 0.5)\n"),
    "similarity_matrix": _q("""select one, round(max(v) filter (where two = 'AUTOMOBILE'), 5) as "AUTOMOBILE", round(max(v) filter (where two = 'BUILDING'), 5) as "BUILDING", round(max(v) filter (where two = 'FURNITURE'), 5) as "FURNITURE", round(max(v) filter (where two = 'HOUSEHOLD'), 5) as "HOUSEHOLD", round(max(v) filter (where two = 'MACHINERY'), 5) as "MACHINERY"
        from (select experiment1 as one, experiment2 as two, similarity as v from pd where origin1 = 'ASIA' and origin2 = 'ASIA' union all select experiment2, experiment1, similarity from pd where origin1 = 'ASIA' and origin2 = 'ASIA' union all select distinct dataset, dataset, 1.0 from rc where origin = 'ASIA') group by 1""", _SIM),
    "sample_pair_matrix": _q("select cluster1, cluster2, round(similarity, 5) as similarity, round(ocldist_fc, 5) as ocldist_fc from pr where cluster1 = 'ASIA/BUILDING' and cluster2 = 'EUROPE/BUILDING'", _SIM),
    "similarity_scaled": _q("select cluster1, cluster2, round(-(ocldist - avg(ocldist) over ()) / stddev_samp(ocldist) over (), 5) as neg_ocldist, round(-(ocldist_fc - avg(ocldist_fc) over ()) / stddev_samp(ocldist_fc) over (), 5) as neg_ocldist_fc from pr", _SIM),
    "mitochondrial_score": _q("select rc.cell_id, round(coalesce(sum(norm) filter (where nrm.gene_id in (select gene_id from g where regexp_matches(symbol, '(?i)^red'))), 0) / (select count(*) from g where regexp_matches(symbol, '(?i)^red')), 6) as score from rc left join nrm using (cell_id) group by 1"),
    "top_marker_heatmap": _q("select cluster, gene_id, round(mean1, 6) as mean from te where gene_id in (select gene_id from (select gene_id, row_number() over (partition by cluster order by round(exp(logfc), 9) desc, gene_id) as place from te) where place <= 5)", _de("dataset")),
    "subsample_cells": "select c_custkey as cell_id, c_mktsegment as dataset from customer order by md5('3-' || c_custkey), c_custkey limit 100",
    "regress_genes": _q("select dataset, gene_id, round(b0, 6) as intercept, round(b1, 6) as depth, round(b2, 6) as width from be", _OK, _REGRESS),
    "regress_residuals": _q("select cv.cell_id, be.gene_id, round(coalesce(norm, 0) - b0 - b1 * x - b2 * y, 5) as residual from cv join be using (dataset) join z2 using (dataset, gene_id) left join np on np.cell_id = cv.cell_id and np.gene_id = be.gene_id",
        _HVG.replace("hv as (select * from zz where mean >= 0.05 and z >= 1)", "z2 as (select dataset, gene_id from zz where mean >= 0.05 and z >= 2.5),"), _REGRESS),
    "cell_cycle_scores": _scores("select unnest(case when nth <= 43 then ['s', 'a'] when nth <= 98 then ['g', 'a'] else [] end) as name, gene_id from (select p_partkey as gene_id, row_number() over (order by p_partkey) as nth from part where p_size <= 3)",
        ", ".join(f"round(coalesce(max(score) filter (where name = '{n}'), 0), 6) as {c}" for n, c in (("s", "s_stage"), ("g", "g2m_stage"), ("a", "aggregate_s_g2m_stage")))),
    "ribosomal_score": _scores("select 'r' as name, gene_id from front", "round(coalesce(max(score), 0), 6) as score"),
    "read_data": _q("select ok.cell_id + (dense_rank() over (order by ok.dataset) - 1) * (max(ok.cell_id) over () + 1) as cell_id, ok.dataset, numi, ngenes from ok join tot using (cell_id)", _OK),
    "similarity_significance": _q(f"select cluster1, cluster2, round(similarity, 5) as similarity, round(significance, 5) as significance, round(q_val, 5) as q_val, round(significance_1, 5) as significance_1, round(q_val_1, 5) as q_val_1 from sp left join {_adjusted('significance', 'q_val', 'sp')} using (cluster1, cluster2) left join {_adjusted('significance_1', 'q_val_1', 'sp')} using (cluster1, cluster2)",
        _SIM, f", sp as (select *, {correlation_p('similarity', 'n_genes')} as significance, {correlation_p('similarity_1', 'n_genes')} as significance_1 from pr)\n"),
    "similarity_degree": _q("select cluster, count(*) as degree from (select cluster1 as cluster from pr where round(similarity, 9) > 0 union all select cluster2 from pr where round(similarity, 9) > 0) group by 1", _SIM),
    "pair_scatter": _q("select rc.cell_id, round(coalesce(max(norm) filter (where gene_id = 1), 0), 6) as x, round(coalesce(max(norm) filter (where gene_id = 2), 0), 6) as y from rc left join nrm using (cell_id) group by 1"),
    "activation_overlay": _q("select cell_id, round((score - (select avg(score) from sc)) / (select stddev_samp(score) from sc), 5) as z from sc where score > (select quantile_cont(score, 0.9) from sc)", "sc as (select rc.cell_id, coalesce(sum(norm) filter (where front.gene_id is not null), 0) / (select count(*) from front) as score from rc left join nrm using (cell_id) left join front using (gene_id) group by 1)\n"),
    "minmax_violin": _q("select dataset, count(*) as n, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as q50, round(quantile_cont(x, 0.75), 6) as q75 from (select dataset, (norm - min(norm) over (partition by gene_id)) / nullif(max(norm) over (partition by gene_id) - min(norm) over (partition by gene_id), 0) as x from nrm) where x is not null group by 1"),
    "group_means": _q("select dataset, round(avg(norm), 6) as mean_norm, round(max(norm), 6) as max_norm from nrm semi join front using (gene_id) group by 1"),
    "dedupe_all_copies": "with t as (select doc_id, coalesce(lang, '?') as dataset, list_sort(regexp_extract_all(lower(text), '[a-z]+')) as toks from documents), u as (select doc_id, dataset, coalesce(toks, []) as toks from t) select doc_id as cell_id, dataset from u where toks in (select toks from u group by 1 having count(*) = 1)",
}

QUERIES = {
    f.__name__: f
    for f in (
        qc_metrics, qc_filter, qc_quantiles, qc_metric_pairs, marker_cell_filter, gene_filter, prefilter_cells, subsample_cells, normalize_log, hvg, hvg_union, hvg_shared, gene_moments,
        signature_mean, similar_genes, controlled_score, cell_cycle_scores, ribosomal_score, read_data, variable_components, variable_clusters, signature_match, regress_genes, regress_residuals, de_one_vs_rest, de_by_origin, de_moderated, detection_ratios, robust_markers, cluster_heatmap,
        heatmap_row_order, heatmap_scaled, cluster_names, named_cells, varying_genes, cluster_similarity, cluster_similarity_q, similarity_significance, robust_similarity, similarity_matrix,
        sample_pair_matrix, similarity_scaled, mitochondrial_score, moderated_f, top_marker_heatmap, similarity_degree, similarity_branches, pair_scatter, activation_overlay, minmax_violin, group_means, dedupe_all_copies,
    )
}
