"""Queries over the single-cell tables: cells, confounders, genes, diffexp, runs and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.model import current
from varve.operators import calibration, diffexp, expression, qc, reduce, similarity
from varve.plans.retail import correlation_p, rounded
from varve.session import Scratch, table
from varve.sources import views


def _confounders(spark: SparkSession, d: str) -> DataFrame:
    """The current confounders of known cells with a dataset, values that are NaN or not above zero as null."""
    rows = current(table(spark, d, "confounders"), ["cell_id"], "loaded_at").drop("loaded_at", "measured_on")
    fine = rows.withColumn("numi", F.when((F.col("numi") > 0) & ~F.isnan("numi"), F.col("numi"))).withColumn("ngenes", F.when(F.col("ngenes") > 0, F.col("ngenes")))
    for c in ("mito_frac", "ribo_frac"):
        fine = fine.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return fine.join(views.single_cells(spark, d).where("dataset is not null"), "cell_id")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """The current tests of diffexp, contrast groups spelled alike."""
    rows = table(spark, d, "diffexp").withColumn("contrast_group", F.lower(F.trim("contrast_group")))
    return current(rows, ["contrast_group", "cluster_id", "gene_id"], "computed_at").drop("computed_at")


def cells_qc_filter(spark: SparkSession, d: str) -> DataFrame:
    passed = qc.passing(_confounders(spark, d), min_genes=500, max_mito=0.1, max_ribo=0.35)
    return passed.select("cell_id", "dataset", F.col("passed"))


def cells_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(qc.quantile_table(_confounders(spark, d), ["dataset"], "numi", [0.01, 0.5, 0.98]))


def confounder_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """V2: quartiles of mito_frac by origin."""
    return rounded(reduce.quartiles(_confounders(spark, d), ["origin"], "mito_frac"))


def regress_confounder(spark: SparkSession, d: str) -> DataFrame:
    """M7 with one covariate: gene counts on depth, by dataset."""
    rows = _confounders(spark, d).select("cell_id", "dataset", F.ln("numi").alias("depth"), F.ln("ngenes").alias("width"))
    return rounded(expression.regress_one(rows, ["dataset"], "width", "depth").select("cell_id", "dataset", "residual"), 5)


def add_confounders(spark: SparkSession, d: str) -> DataFrame:
    """M6: the confounders with a user's column, the cells' number of clustering runs."""
    runs = views.highest_level(spark, d).groupBy("cell_id").agg(F.countDistinct("run_id").alias("n_runs"))
    return expression.add_confounders(_confounders(spark, d).select("cell_id", "ngenes"), n_runs=runs)


def gene_set_select(spark: SparkSession, d: str) -> DataFrame:
    genes = table(spark, d, "genes")
    ribo = qc.gene_set(genes, qc.RIBOSOMAL).select("gene_id", "symbol", F.lit("ribosomal").alias("gene_set"))
    return ribo.unionByName(qc.gene_set(genes, qc.MITOCHONDRIAL).select("gene_id", "symbol", F.lit("mitochondrial").alias("gene_set")))


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return qc.number_repeats(table(spark, d, "genes"), "symbol", "gene_id").select("gene_id", "symbol", "unique_name")


def capitalise_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genes").select("gene_id", qc.cap_words("symbol").alias("symbol"), F.upper("symbol").alias("upper_symbol"))


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p-values of every contrast group and cluster."""
    tests = _tests(spark, d).select("contrast_group", "cluster_id", "gene_id", "p")
    return diffexp.benjamini_hochberg(tests, ["contrast_group", "cluster_id"], "p", "adjusted").drop("p")


def significant_tests(spark: SparkSession, d: str) -> DataFrame:
    return diffexp.significant(_tests(spark, d)).select("contrast_group", "cluster_id", "gene_id", "fold", "q")


def two_sided_tests(spark: SparkSession, d: str) -> DataFrame:
    """F11, with the mitochondrial genes annotated."""
    listed = qc.gene_set(table(spark, d, "genes"), qc.MITOCHONDRIAL).select("gene_id", F.lit(True).alias("listed"))
    tests = _tests(spark, d).join(listed, "gene_id", "left")
    return diffexp.two_sided(tests, annotate=F.coalesce("listed", F.lit(False))).select("contrast_group", "cluster_id", "gene_id", "fold", "q")


def complete_tests(spark: SparkSession, d: str) -> DataFrame:
    """tests without null or NaN; infinite values stay."""
    return _tests(spark, d).dropna("any").select("contrast_group", "cluster_id", "gene_id")


def top_n_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return diffexp.top_per_cluster(_tests(spark, d), ["contrast_group", "cluster_id"], 10).select("contrast_group", "cluster_id", "place", "gene_id", "fold")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, project, cell_id, cluster, dataset) of the real runs' highest levels."""
    runs = table(spark, d, "runs").where("kind = 'real'").select("run_id", "project").distinct()
    rows = views.highest_level(spark, d).groupBy("run_id", "cell_id").agg(F.min("cluster").alias("cluster"))
    return rows.join(runs, "run_id").join(views.single_cells(spark, d).select("cell_id", "dataset"), "cell_id", "left")


def confusion_table(spark: SparkSession, d: str) -> DataFrame:
    """Cells by run, cluster and dataset, with their share of the cluster."""
    rows = _placed(spark, d).withColumn("run_cluster", F.concat_ws(":", "run_id", F.col("cluster").cast("string")))
    return rounded(reduce.contingency(rows, "run_cluster", "dataset"))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).groupBy("run_id", "cluster").agg(F.count("*").alias("n_cells"))


def merge_cluster_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of every project's first real run under ids that do not clash."""
    rows = _placed(spark, d)
    first = rows.groupBy("project").agg(F.min("run_id").alias("run_id"))
    own = rows.join(first, ["project", "run_id"]).select("project", "cell_id", "cluster")
    return similarity.merge_clusters(own, "project").select("project", "cell_id", "cluster", "merged")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """runs with the cluster count seen in membership where theirs is null or out of date."""
    seen = views.highest_level(spark, d).groupBy("run_id").agg(F.countDistinct("cluster").cast("int").alias("seen"))
    return table(spark, d, "runs").distinct().join(seen, "run_id", "left").withColumn("n_clusters", F.coalesce("seen", "n_clusters")).drop("seen")


def calibration_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Real runs against the shuffled runs of the most similar cluster count."""
    return rounded(calibration.calibrated(_runs(spark, d), 2))


def modularity_by_count(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.modularity_by_count(_runs(spark, d)))


def chosen_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Every project's smallest ratio whose modularity is twice the shuffled one."""
    runs = _runs(spark, d)
    return calibration.choose_ratio(calibration.calibrated(runs, 2), runs)


def distinct_pcs(spark: SparkSession, d: str) -> DataFrame:
    """Of cells with equal scores the one of smallest id."""
    rows = current(table(spark, d, "pcs"), ["cell_id"], "computed_at").where("pc is not null")
    return qc.keep_first(rows, "pc", "cell_id").select("cell_id", F.size("pc").alias("n_scores"))


def united_gene_filter(spark: SparkSession, d: str) -> DataFrame:
    return similarity.united_filter(table(spark, d, "genes"))


def embedding_table(spark: SparkSession, d: str) -> DataFrame:
    """V1, V3: the first two scores of every cell, equal ones once and unusable ones (NaN) null, with its confounders and dataset."""
    rows = current(table(spark, d, "pcs"), ["cell_id"], "computed_at").where("size(pc) >= 2")
    first = qc.keep_first(rows, "pc", "cell_id").select("cell_id", F.nanvl(F.col("pc")[0], F.lit(None)).alias("x"), F.nanvl(F.col("pc")[1], F.lit(None)).alias("y"))
    return first.join(_confounders(spark, d).select("cell_id", "dataset", "numi", "ngenes"), "cell_id", "left")


def _test_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a contrast group's clusters by their tested genes: fold, average expression and q are those of diffexp."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    tests = _tests(spark, d).where(finite("fold") & finite("ave_expr"))
    features = tests.select("contrast_group", F.col("cluster_id").alias("cluster"), "gene_id", "fold", F.col("ave_expr").alias("mean"), "q")
    return Scratch(spark, "test-pairs").save(similarity.cluster_similarity(features, within=["contrast_group"]), "pairs")


def test_similarity(spark: SparkSession, d: str) -> DataFrame:
    """M23 within every contrast group, the Jaccard columns by q <= 0.05 and fold."""
    return rounded(_test_pairs(spark, d), 5)


def robust_similarity_q(spark: SparkSession, d: str) -> DataFrame:
    """M24 with the adjusted p-value of the means' correlation, every contrast group being an origin and its clusters experiments."""
    pairs = _test_pairs(spark, d).where("n_genes >= 3").withColumns({"cluster1": F.concat_ws("/", "contrast_group", "cluster1"), "cluster2": F.concat_ws("/", "contrast_group", "cluster2")})
    named = pairs.withColumns({"origin1": F.col("contrast_group"), "origin2": F.col("contrast_group"), "experiment1": F.col("cluster1"), "experiment2": F.col("cluster2")})
    found = similarity.robust_pairs(similarity.with_significance(named), min_sd=1.0, max_q=0.9)
    return rounded(found.select("cluster1", "cluster2", "n_genes", "similarity", "similarity_1", "significance_1", "q_val_1", "z"), 5)


def cluster_names_q(spark: SparkSession, d: str) -> DataFrame:
    """M19 by fold and q: clusters of every contrast group named by the gene families of which more than half are significant."""
    genes = table(spark, d, "genes").where("symbol is not null")
    name = F.concat_ws("/", "contrast_group", F.col("cluster_id").cast("string")).alias("cluster")
    tests = _tests(spark, d)
    strong = diffexp.significant(tests).join(genes, "gene_id").select(name, F.col("symbol").alias("gene"))
    return diffexp.cluster_names(strong, genes.select(F.lower(F.substring("symbol", 1, 4)).alias("type"), F.col("symbol").alias("gene")), tests.select(name))


_CONF = """with la as (select cell_id, max_by(struct_pack(numi := numi, ngenes := ngenes, mito := mito_frac, ribo := ribo_frac), loaded_at) as v from confounders group by 1),
so as (select cell_id, max(dataset) as dataset, max(origin) as origin from cells group by 1),
cf as (select cell_id, dataset, origin, case when v.numi > 0 and not isnan(v.numi) then v.numi end as numi, case when v.ngenes > 0 then v.ngenes end as ngenes,
  case when not isnan(v.mito) then v.mito end as mito_frac, case when not isnan(v.ribo) then v.ribo end as ribo_frac from la join so using (cell_id) where dataset is not null)
"""
_TESTS = """with t0 as (select lower(trim(contrast_group)) as contrast_group, cluster_id, gene_id, max_by(struct_pack(logfc := logfc, fold := fold, t := t, p := p, q := q, a := ave_expr), computed_at) as v from diffexp group by 1, 2, 3),
ts as (select contrast_group, cluster_id, gene_id, v.logfc as logfc, v.fold as fold, v.t as t, v.p as p, v.q as q, v.a as ave_expr from t0)
"""
_PLACED = """with tl as (select run_id, max(lvl) as lvl from membership group by 1),
hl as (select run_id, cell_id, cluster_id as cluster from membership join tl using (run_id, lvl) where cluster_id is not null),
rl as (select distinct run_id, project from runs where kind = 'real'),
so as (select cell_id, max(dataset) as dataset from cells group by 1),
pl as (select run_id, project, cell_id, min(cluster) as cluster, any_value(dataset) as dataset from hl join rl using (run_id) left join so using (cell_id) group by 1, 2, 3),
rn as (select distinct run_id, project, kind, knn_ratio, modularity, coalesce(k, n_clusters) as n_clusters from runs left join (select run_id, count(distinct cluster)::int as k from hl group by 1) using (run_id))
"""
_CAL = (
    _PLACED
    + """, nr as (select r.project, r.run_id, s.modularity as m, row_number() over (partition by r.project, r.run_id order by abs(r.n_clusters - s.n_clusters), s.run_id) as pc
  from rn r join rn s on r.project = s.project and r.kind = 'real' and s.kind = 'shuffled' where r.n_clusters is not null and r.modularity is not null and s.n_clusters is not null and s.modularity is not null),
ca as (select project, run_id, n_clusters, modularity, n_shuffled, shuffled_mean, shuffled_max, modularity / nullif(shuffled_mean, 0) as fold from rn
  left join (select project, run_id, count(*) as n_shuffled, avg(m) as shuffled_mean, max(m) as shuffled_max from nr where pc <= 2 group by 1, 2) using (project, run_id)
  where kind = 'real' and n_clusters is not null and modularity is not null)
"""
)

_TEST_PAIRS = (
    _TESTS
    + """, ft as (select contrast_group, cluster_id as cluster, gene_id, fold, ave_expr as mean, coalesce(q <= 0.05, false) as sig from ts where isfinite(fold) and isfinite(ave_expr)),
tp as (select a.contrast_group, a.cluster as cluster1, b.cluster as cluster2, count(*) as n_genes,
  case when stddev_pop(a.fold) > 0 and stddev_pop(b.fold) > 0 then corr(a.fold, b.fold) end as similarity, case when stddev_pop(a.mean) > 0 and stddev_pop(b.mean) > 0 then corr(a.mean, b.mean) end as similarity_1,
  sqrt(sum((a.mean - b.mean) ** 2)) as ocldist, sqrt(sum((a.fold - b.fold) ** 2)) as ocldist_fc,
  count(*) filter (where a.sig and a.fold >= 1 and b.sig and b.fold >= 1) / nullif(count(*) filter (where (a.sig and a.fold >= 1) or (b.sig and b.fold >= 1)), 0) as jaccard,
  count(*) filter (where a.sig and a.fold >= 1.5 and b.sig and b.fold >= 1.5) / nullif(count(*) filter (where (a.sig and a.fold >= 1.5) or (b.sig and b.fold >= 1.5)), 0) as jaccard2
  from ft a join ft b using (contrast_group, gene_id) where a.cluster < b.cluster group by 1, 2, 3)
"""
)

ORACLES = {
    "test_similarity": _TEST_PAIRS + "select contrast_group, cluster1, cluster2, n_genes, round(similarity, 5) as similarity, round(similarity_1, 5) as similarity_1, round(ocldist, 5) as ocldist, round(ocldist_fc, 5) as ocldist_fc, round(jaccard, 5) as jaccard, round(jaccard2, 5) as jaccard2 from tp",
    "robust_similarity_q": _TEST_PAIRS + f""", sp as (select contrast_group || '/' || cluster1 as cluster1, contrast_group || '/' || cluster2 as cluster2, contrast_group, n_genes, similarity, similarity_1, {correlation_p("similarity_1", "n_genes")} as significance_1 from tp where n_genes >= 3),
sq as (select *, significance_1 * count(*) over () / count(*) over (order by significance_1 range between unbounded preceding and current row) as raw from sp where significance_1 is not null),
sa as (select cluster1, cluster2, least(1.0, min(raw) over (order by significance_1 range between current row and unbounded following)) as q_val_1 from sq),
zs as (select sp.*, q_val_1, (similarity - avg(similarity) over (partition by contrast_group)) / nullif(stddev_samp(similarity) over (partition by contrast_group), 0) as z from sp left join sa using (cluster1, cluster2)),
rb as (select cluster1 as cl from zs where z >= 1 and q_val_1 <= 0.9 union select cluster2 from zs where z >= 1 and q_val_1 <= 0.9)
select cluster1, cluster2, n_genes, round(similarity, 5) as similarity, round(similarity_1, 5) as similarity_1, round(significance_1, 5) as significance_1, round(q_val_1, 5) as q_val_1, round(z, 5) as z from zs where cluster1 in (select cl from rb) and cluster2 in (select cl from rb)""",
    "cluster_names_q": _TESTS + """, gs as (select gene_id, lower(symbol) as gene, lower(symbol[1:4]) as type from genes where symbol is not null),
ru as (select distinct type, gene from gs), nd as (select type, count(*) as need from ru group by 1),
st as (select distinct contrast_group || '/' || cluster_id as cluster, gene from ts join gs using (gene_id) where q <= 0.05 and fold >= 1.5),
ex as (select cluster, type, count(*) - any_value(need) / 2 as e from st join ru using (gene) join nd using (type) group by 1, 2 having count(*) - any_value(need) / 2 > 0),
na as (select cluster, coalesce(string_agg(type, '_' order by e desc, type), 'Unknown') as name from (select distinct contrast_group || '/' || cluster_id as cluster from ts) left join ex using (cluster) group by 1)
select cluster, case when count(*) over (partition by name) > 1 then name || '_' || row_number() over (partition by name order by cluster) else name end as name from na""",
    "united_gene_filter": "select lower(symbol) as symbol, bool_or(coalesce(keep, false)) as keep from genes where symbol is not null group by 1",
    "embedding_table": _CONF + ", pc0 as (select cell_id, max_by(pc, computed_at) as pc from pcs group by 1), pc1 as (select min(cell_id) as cell_id, pc from pc0 where len(pc) >= 2 group by pc) select cell_id, case when not isnan(pc[1]) then pc[1] end as x, case when not isnan(pc[2]) then pc[2] end as y, dataset, numi, ngenes from pc1 left join cf using (cell_id)",
    "cells_qc_filter": _CONF + "select cell_id, dataset, coalesce(ngenes >= 500 and ngenes <= qg and numi <= qu and mito_frac <= 0.1 and ribo_frac <= 0.35, false) as passed from cf join (select dataset, quantile_cont(ngenes, 0.98) as qg, quantile_cont(numi, 0.98) as qu from cf group by 1) using (dataset)",
    "cells_quantiles": _CONF + "select dataset, p::double as p, round(case p when 0.01 then a when 0.5 then b else c end, 6) as value from (select dataset, quantile_cont(numi, 0.01) as a, quantile_cont(numi, 0.5) as b, quantile_cont(numi, 0.98) as c from cf where numi is not null group by 1), (values (0.01), (0.5), (0.98)) v(p)",
    "confounder_quartiles": _CONF + "select origin, count(*) as n, round(quantile_cont(mito_frac, 0.25), 6) as q25, round(quantile_cont(mito_frac, 0.5), 6) as q50, round(quantile_cont(mito_frac, 0.75), 6) as q75 from cf where mito_frac is not null group by 1",
    "regress_confounder": _CONF + "select cell_id, dataset, round(y - my - coalesce(b, 0) * (x - mx), 5) as residual from (select cell_id, dataset, ln(ngenes) as y, ln(numi) as x from cf) join (select dataset, avg(ln(ngenes)) as my, avg(ln(numi)) as mx, regr_slope(ln(ngenes), ln(numi)) as b from cf where ngenes is not null and numi is not null group by 1) using (dataset)",
    "add_confounders": _CONF + ", tl as (select run_id, max(lvl) as lvl from membership group by 1), hl as (select cell_id, count(distinct run_id) as n_runs from membership join tl using (run_id, lvl) where cluster_id is not null group by 1) select cell_id, ngenes, n_runs from cf left join hl using (cell_id)",
    "gene_set_select": "select gene_id, symbol, 'ribosomal' as gene_set from genes where regexp_matches(symbol, '(?i)^rp[ls]') union all select gene_id, symbol, 'mitochondrial' from genes where regexp_matches(symbol, '(?i)^mt-')",
    "duplicate_names": "select gene_id, symbol, case when symbol is null then null when count(*) over (partition by symbol) > 1 then symbol || '.' || row_number() over (partition by symbol order by gene_id) else symbol end as unique_name from genes",
    "capitalise_symbols": "select gene_id, upper(symbol[1]) || lower(symbol[2:]) as symbol, upper(symbol) as upper_symbol from genes",
    "bh_adjust": _TESTS + ", rk as (select *, p * count(*) over g / rank() over (partition by contrast_group, cluster_id order by p) as r0, p * count(*) over g / (count(*) over (partition by contrast_group, cluster_id order by p range between unbounded preceding and current row)) as raw from ts where p is not null and not isnan(p) window g as (partition by contrast_group, cluster_id)) select contrast_group, cluster_id, gene_id, adjusted from ts left join (select contrast_group, cluster_id, gene_id, least(1.0, min(raw) over (partition by contrast_group, cluster_id order by p range between current row and unbounded following)) as adjusted from rk) using (contrast_group, cluster_id, gene_id)",
    "significant_tests": _TESTS + "select contrast_group, cluster_id, gene_id, fold, q from ts where q <= 0.05 and fold >= 1.5",
    "two_sided_tests": _TESTS + "select contrast_group, cluster_id, gene_id, fold, q from ts where ((fold >= 1.5 or fold <= 1 / 1.5) and q <= 0.05) or gene_id in (select gene_id from genes where regexp_matches(symbol, '(?i)^mt-'))",
    "complete_tests": _TESTS + "select contrast_group, cluster_id, gene_id from ts where contrast_group is not null and logfc is not null and not isnan(logfc) and fold is not null and not isnan(fold) and t is not null and not isnan(t) and p is not null and not isnan(p) and q is not null and not isnan(q) and ave_expr is not null and not isnan(ave_expr)",
    "top_n_per_cluster": _TESTS + "select contrast_group, cluster_id, place, gene_id, fold from (select *, row_number() over (partition by contrast_group, cluster_id order by fold desc, gene_id)::int as place from ts where fold is not null and not isnan(fold)) where place <= 10",
    "confusion_table": _PLACED + "select run_id || ':' || cluster as run_cluster, dataset, count(*) as n, round(count(*) / sum(count(*)) over (partition by run_id || ':' || cluster), 6) as share from pl where dataset is not null group by 1, 2",
    "cluster_sizes": _PLACED + "select run_id, cluster, count(*) as n_cells from pl group by 1, 2",
    "merge_cluster_offsets": _PLACED + ", ow as (select project, cell_id, cluster from pl semi join (select project, min(run_id) as run_id from pl group by 1) f using (project, run_id)), tp as (select project, max(cluster)::bigint as top from ow group by 1), of as (select project, coalesce(sum(top) over (order by project rows between unbounded preceding and 1 preceding), 0)::bigint as o from tp) select project, cell_id, cluster, (cluster + o)::bigint as merged from ow join of using (project)",
    "calibration_nearest": _CAL + "select project, run_id, n_clusters, round(modularity, 6) as modularity, n_shuffled, round(shuffled_mean, 6) as shuffled_mean, round(shuffled_max, 6) as shuffled_max, round(fold, 6) as fold from ca",
    "modularity_by_count": _PLACED + "select n_clusters, round(avg(modularity) filter (where kind = 'real'), 6) as real_mean, round(stddev_samp(modularity) filter (where kind = 'real'), 6) as real_sd, round(avg(modularity) filter (where kind = 'shuffled'), 6) as shuffled_mean, round(stddev_samp(modularity) filter (where kind = 'shuffled'), 6) as shuffled_sd, round(avg(modularity) filter (where kind = 'real') / nullif(avg(modularity) filter (where kind = 'shuffled'), 0), 6) as fold from rn where n_clusters is not null group by 1",
    "chosen_ratio": _CAL + "select project, run_id, knn_ratio from ca join (select distinct run_id, knn_ratio from rn) using (run_id) where fold > 2 qualify row_number() over (partition by project order by knn_ratio, run_id) = 1",
    "distinct_pcs": "with c as (select cell_id, max_by(pc, computed_at) as pc from pcs group by 1) select min(cell_id) as cell_id, len(pc)::int as n_scores from c where pc is not null group by pc",
}

QUERIES = {
    f.__name__: f
    for f in (
        cells_qc_filter, cells_quantiles, confounder_quartiles, regress_confounder, add_confounders, gene_set_select, duplicate_names, capitalise_symbols, bh_adjust, significant_tests,
        two_sided_tests, complete_tests, top_n_per_cluster, confusion_table, cluster_sizes, merge_cluster_offsets, calibration_nearest, modularity_by_count, chosen_ratio, distinct_pcs, united_gene_filter, embedding_table, test_similarity, robust_similarity_q, cluster_names_q,
    )
}
