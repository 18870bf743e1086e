"""The registered queries of the numbered problems and the SQL some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import clusters
from varve.llm import cutoffs as cut
from varve.llm import leaks, neighbours, packing, percentiles, spam, tables, topn
from varve.session import Scratch, table


def _p1_tests(spark: SparkSession, d: str) -> DataFrame:
    ties = [F.col("q").asc_nulls_last(), F.col("gene_id").asc()]
    return topn.top_n(tables.current_tests(spark, d), ["contrast_group", "cluster_id"], "logfc", ties, 10, keep=["q"], version=(["gene_id"], "computed_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_tests(spark, d).select("contrast_group", "cluster_id", "gene_id")


def p1_top_tests(spark: SparkSession, d: str) -> DataFrame:
    return _p1_tests(spark, d).select("contrast_group", "cluster_id", "place", "gene_id", "logfc", "q")


def p1_top_three(spark: SparkSession, d: str) -> DataFrame:
    """The three best tests of the clusters of contrast group `all`, from a layout that is built once and asked twice: first for
    the ten best of every group, as p1_found is, then for these, of which only few row groups are read."""
    scratch, ties = Scratch(spark, "p1"), [F.col("q").asc_nulls_last(), F.col("gene_id").asc()]
    tests = tables.current_tests(spark, d)
    layout = topn.build(tests, ["contrast_group", "cluster_id"], "logfc", ties, keep=["q"], version=(["gene_id"], "computed_at"), path=scratch.path("layout"))
    ten, _ = topn.top(spark, layout, 10)
    three, _ = topn.top(spark, layout, 3, ten.where("contrast_group = 'all'").select("contrast_group", "cluster_id"))
    return three.select("contrast_group", "cluster_id", "place", "gene_id")


P1_SQL = """
with newest as (select lower(trim(contrast_group)) contrast_group, cluster_id, gene_id, max_by(struct_pack(l := logfc, q := q), computed_at) v
                from diffexp group by 1, 2, 3),
placed as (select contrast_group, cluster_id, gene_id, v.l as logfc, v.q as q,
                  row_number() over (partition by contrast_group, cluster_id order by v.l desc, v.q asc nulls last, gene_id) as place
           from newest where v.l is not null and isfinite(v.l))
select {} from placed where place <= 10"""


def _p2_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.usable_vectors(table(spark, d, "pcs"), "cell_id", "pc", 20, "computed_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.knn(_p2_vectors(spark, d), 5)
    return found.select(F.least("id", "other").alias("cell_a"), F.greatest("id", "other").alias("cell_b")).distinct()


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every cell whose id is divisible by 100, found by greedy search of the graph of all cells.

    The walk goes by single-precision distances; of the nodes it ends with, the nearest are told by double ones.
    """
    scratch = Scratch(spark, "p2-search")
    rows = scratch.save(_p2_vectors(spark, d), "rows")
    vectors = scratch.save(neighbours.distinct_vectors(rows, 6), "distinct")
    asked = rows.where("id % 100 = 0")
    near = neighbours.search(asked, neighbours.build(vectors), 12).select("id", "other")
    gap = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    met = near.join(vectors.select(F.col("id").alias("other"), F.col("v").alias("w"), "same"), "other").join(asked, "id")
    every = met.select("id", gap.alias("d2"), F.explode("same").alias("other")).where("id <> other")
    best = F.slice(F.sort_array(F.collect_list(F.struct("d2", "other"))), 1, 5)
    out = every.groupBy("id").agg(best.alias("b")).select("id", F.posexplode("b").alias("place", "x"))
    return out.select(F.col("id").alias("cell_id"), (F.col("place") + 1).alias("place"), F.col("x.other").alias("neighbour"), F.round("x.d2", 6).alias("d2"))


P2_SQL = """with newest as (select cell_id, max_by(pc, computed_at) as pc from pcs where cell_id is not null group by 1),
v as (select cell_id, pc from newest where len(pc) = 20 and len(list_filter(pc, lambda x: x is null or isnan(x))) = 0 and len(list_filter(pc, lambda x: x <> 0)) > 0),
gaps as (select a.cell_id as a, b.cell_id as b, list_sum(list_transform(list_zip(a.pc, b.pc), lambda x: (x[1] - x[2]) ** 2)) as d2 from v a join v b on a.cell_id <> b.cell_id {}),
near as (select a, b, d2, row_number() over (partition by a order by d2, b)::int as place from gaps qualify place <= 5)
"""
P2_FOUND_SQL = P2_SQL.format("") + "select distinct least(a, b) as cell_a, greatest(a, b) as cell_b from near"
P2_SEARCH_SQL = P2_SQL.format("and a.cell_id % 100 = 0") + "select a as cell_id, place, b as neighbour, round(d2, 6) as d2 from near"


def _targets(spark: SparkSession, d: str, values: DataFrame) -> DataFrame:
    """(dataset, field_name, keep_pct) by the datasets' origins."""
    goals = table(spark, d, "cutoff_targets").groupBy("origin", "field_name").agg(F.max("keep_pct").alias("keep_pct"))
    sources = values.groupBy("dataset").agg(F.max("origin").alias("origin"))
    return sources.join(goals, "origin").select("dataset", "field_name", "keep_pct")


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "p3")
    values = scratch.save(tables.cell_values(spark, d), "values")
    tree = cut.CountTree(spark, scratch.path("tree"), ["dataset", "field_name"])
    return values, cut.cutoffs(values, _targets(spark, d, values), tree.keys, "score", tree)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values, cutoffs = _p3(spark, d)
    beyond = values.join(cutoffs.select("dataset", "field_name", "cutoff"), ["dataset", "field_name"]).where("score > cutoff")
    return beyond.select("dataset", "field_name", "cell_id")


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cutoff_rows(_p3(spark, d)[1])


def _cutoff_rows(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.select("dataset", "field_name", F.col("keep_pct").cast("int").alias("keep_pct"), F.col("n").alias("n_values"), "cutoff", F.col("kept").alias("n_kept"))


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """p3_cutoffs from a tree that got its records in two batches: first what was loaded by the middle of the loading
    times, then the later loads, the values they supersede being taken back."""
    scratch, keys = Scratch(spark, "p3"), ["dataset", "field_name"]
    loads = table(spark, d, "confounders")
    middle = loads.agg(F.timestamp_micros(((F.min(F.unix_micros("loaded_at")) + F.max(F.unix_micros("loaded_at"))) / 2).cast("long")).alias("middle"))
    early = scratch.save(tables.cell_values(spark, d, loads=loads.join(F.broadcast(middle)).where("loaded_at <= middle")), "early")
    values, tree = scratch.save(tables.cell_values(spark, d), "values"), cut.CountTree(spark, scratch.path("tree"), keys)
    same = [*keys, "cell_id", "score"]
    tree.add(early, "score")
    tree.add(values.join(early, same, "left_anti"), "score")
    tree.add(early.join(values, same, "left_anti"), "score", -1)
    return _cutoff_rows(cut.cutoffs(values, _targets(spark, d, values), keys, "score", tree, add=False))


VALUES_SQL = """
latest as (select cell_id, max_by(struct_pack(numi := numi, ngenes := ngenes, day := measured_on), loaded_at) c from confounders group by 1),
source as (select cell_id, max(dataset) dataset, max(origin) origin from cells where dataset is not null group by 1),
val as (select * from (select cell_id, dataset, origin, c.day as day, 'numi' as field_name, c.numi as score from latest join source using (cell_id)
                       union all select cell_id, dataset, origin, c.day, 'ngenes', c.ngenes::double from latest join source using (cell_id))
        where score > 0 and not isnan(score))"""
P3_SQL = f"""with {VALUES_SQL},
runs as (select dataset, field_name, any_value(origin) origin, score, sum(count(*)) over (partition by dataset, field_name order by score) up,
                sum(count(*)) over (partition by dataset, field_name) n from val group by dataset, field_name, score),
cutoff as (select dataset, field_name, keep_pct, min(score) as cutoff, any_value(n)::bigint as n_values, min(up)::bigint as n_kept
           from runs join cutoff_targets using (origin, field_name) where 100 * up >= keep_pct * n group by all)
"""
P3_FOUND_SQL = P3_SQL + "select dataset, field_name, cell_id from val join cutoff using (dataset, field_name) where score > cutoff"
P3_CUTOFFS_SQL = P3_SQL + "select dataset, field_name, keep_pct::int as keep_pct, n_values, cutoff, n_kept from cutoff"

P4_PROBS = (0.1, 0.5, 0.9)


def _p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every value twice: for its dataset (day null) and for its day; a value without a day only for its dataset."""
    values = tables.cell_values(spark, d, ("measured_on",))
    levels = F.explode(F.array_distinct(F.array(F.lit(None).cast("date"), F.col("measured_on"))))
    return values.select("dataset", "field_name", levels.alias("day"), "score", "cell_id")


def _p4_wide(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles.percentiles(_p4_levels(spark, d), ["dataset", "field_name", "day"], "score", P4_PROBS, ["cell_id"])
    at = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in P4_PROBS]
    return Scratch(spark, "p4").save(found.groupBy("dataset", "field_name", "day").agg(F.max("n").alias("n_values"), *at), "percentiles")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wide = _p4_wide(spark, d)
    names = [f"p{round(100 * p)}" for p in P4_PROBS]
    judged = wide.where("day is not null and n_values >= 25")
    enough = judged.groupBy("dataset", "field_name").agg(F.count("*").alias("days")).where("days >= 10")
    whole = wide.where("day is null").select("dataset", "field_name", *(F.col(c).alias(f"all_{c}") for c in names))
    off = [(F.col(c) >= 1.5 * F.col(f"all_{c}")) | (F.col(c) * 1.5 <= F.col(f"all_{c}")) for c in names]
    cases = judged.join(enough, ["dataset", "field_name"], "left_semi").join(whole, ["dataset", "field_name"]).where(off[0] | off[1] | off[2])
    return cases.select("dataset", F.date_format("day", "yyyy-MM-dd").alias("measured_on"), "field_name")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every dataset (measured_on null) and of every measuring day in it."""
    wide = _p4_wide(spark, d)
    return wide.select("dataset", F.date_format("day", "yyyy-MM-dd").alias("measured_on"), "field_name", "n_values", *(F.round(f"p{round(100 * p)}", 6).alias(f"p{round(100 * p)}") for p in P4_PROBS))


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """Dataset percentiles combined from its days' summaries, with the bound of their rank error."""
    values = tables.cell_values(spark, d, ("measured_on",))
    days = Scratch(spark, "p4").save(percentiles.summaries(values, ["dataset", "measured_on", "field_name"], "score", 50), "days")
    return percentiles.combine(days, ["dataset", "field_name"], P4_PROBS)


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the combined percentiles keep their bound: the shares of values below and up to each are counted."""
    keys = ["dataset", "field_name"]
    values = tables.cell_values(spark, d).select(*keys, "score")
    combined = Scratch(spark, "p4").save(p4_combined(spark, d), "combined")
    met = values.join(combined, keys).groupBy(*keys, "p").agg(F.first("n").alias("n_values"), F.first("error").alias("e"), F.count_if(F.col("score") < F.col("value")).alias("below"), F.count_if(F.col("score") <= F.col("value")).alias("up"))
    within = (F.col("below") / F.col("n_values") <= F.col("p") + F.col("e")) & (F.col("up") / F.col("n_values") >= F.col("p") - F.col("e"))
    return met.select(*keys, "p", "n_values", within.alias("within"))


P4_LEVELS_SQL = f"""with {VALUES_SQL},
lvl as (select dataset, field_name, null::date as day, score from val union all select dataset, field_name, day, score from val where day is not null),
wide as (select dataset, field_name, day, count(*) n_values, quantile_cont(score, 0.1) p10, quantile_cont(score, 0.5) p50, quantile_cont(score, 0.9) p90
         from lvl group by all)
"""
P4_PERCENTILES_SQL = P4_LEVELS_SQL + "select dataset, strftime(day, '%Y-%m-%d') as measured_on, field_name, n_values, round(p10, 6) p10, round(p50, 6) p50, round(p90, 6) p90 from wide"
P4_BOUNDS_SQL = f"with {VALUES_SQL} select dataset, field_name, p::double as p, count(*) as n_values, true as within from val, (values (0.1), (0.5), (0.9)) t(p) group by all"
P4_FOUND_SQL = P4_LEVELS_SQL + """,
judged as (select *, count(*) over (partition by dataset, field_name) as n_days from wide where day is not null and n_values >= 25)
select j.dataset, strftime(j.day, '%Y-%m-%d') as measured_on, j.field_name from judged j join wide w on w.day is null and w.dataset = j.dataset and w.field_name = j.field_name
where j.n_days >= 10 and (j.p10 >= 1.5 * w.p10 or j.p10 * 1.5 <= w.p10 or j.p50 >= 1.5 * w.p50 or j.p50 * 1.5 <= w.p50 or j.p90 >= 1.5 * w.p90 or j.p90 * 1.5 <= w.p90)"""


def _p5_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "p5")
    real = table(spark, d, "runs").where("kind = 'real'").select("run_id", "project").distinct()
    member = table(spark, d, "membership")
    top = member.groupBy("run_id").agg(F.max("lvl").alias("lvl"))
    rows = scratch.save(member.join(top, ["run_id", "lvl"]).join(real, "run_id").select("project", "run_id", "cell_id", "cluster_id"), "rows")
    split = rows.groupBy("run_id").agg(F.min("cluster_id").alias("a"), F.max("cluster_id").alias("b")).where("a < b")
    nodes, members = clusters.label_lists(rows.join(split, "run_id", "left_semi"), "project", "cell_id", "run_id", "cluster_id")
    nodes, members = scratch.save(nodes, "nodes"), scratch.save(members, "members")
    return scratch.save(clusters.groups(nodes, members, 60), "groups"), nodes


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    placed = _p5_groups(spark, d)[0]
    return placed.where("record <> lead").select(F.col("lead").alias("cell_a"), F.col("record").alias("cell_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every group of at least two cells with its size and its three most typical cells."""
    placed, nodes = _p5_groups(spark, d)
    best = clusters.typical(placed.where("size > 1"), nodes, 3)
    return best.select(F.col("scope").alias("project"), F.col("lead").alias("group_cell"), F.col("size").alias("n_cells"), "place", F.col("record").alias("cell_id"), F.round("likeness", 6).alias("likeness"))


P5_SQL = """with recursive top as (select run_id, max(lvl) as lvl from membership group by 1),
actual as (select distinct run_id, project from runs where kind = 'real'),
held as (select project, run_id, cell_id, cluster_id from membership join top using (run_id, lvl) join actual using (run_id)),
split as (select run_id from held group by 1 having min(cluster_id) < max(cluster_id)),
lab as (select project, run_id, cell_id, min(cluster_id) as l from held semi join split using (run_id) where cluster_id is not null and cell_id is not null group by 1, 2, 3),
alike as (select a.project, a.cell_id as a, b.cell_id as b from lab a join lab b using (project, run_id) group by 1, 2, 3 having 100 * count(*) filter (where a.l = b.l) >= 60 * count(*)),
reach as (select project, a, b from alike union select r.project, r.a, e.b from reach r join alike e on r.project = e.project and r.b = e.a),
grp as (select project, b as cell_id, min(a) as lead from reach group by 1, 2)
"""
P5_FOUND_SQL = P5_SQL + "select lead as cell_a, cell_id as cell_b from grp where lead <> cell_id"
P5_GROUPS_SQL = P5_SQL + """,
sized as (select project, lead, count(*) as n_cells from grp group by 1, 2 having count(*) > 1),
own as (select project, lead, n_cells, cell_id, run_id, l from grp join sized using (project, lead) join lab using (project, cell_id)),
same as (select *, count(*) over (partition by project, lead, run_id, l) as s, count(*) over (partition by project, lead, run_id) as e from own),
rated as (select project, lead, n_cells, cell_id, sum(s) / sum(e) as likeness from same group by 1, 2, 3, 4),
placed as (select *, row_number() over (partition by project, lead order by likeness desc, cell_id)::int as place from rated)
select project, lead as group_cell, n_cells, place, cell_id, round(likeness, 6) as likeness from placed where place <= 3"""


def p6_containers(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """Every post, or piece of one, with its tokens and its container of 2,048 tokens."""
    sizes = packing.token_counts(table(spark, d, "documents"), vocabulary)
    return packing.pack(sizes, 2048)


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row that is the same for every right packing: posts, those with all their tokens placed once, and the containers over
    2,048 tokens, posts cut without need and pieces cut short, of which there must be none."""
    scratch = Scratch(spark, "p6")
    sizes = scratch.save(packing.token_counts(table(spark, d, "documents"), "/opt/tokenizers/byte_bpe_50k.json"), "sizes")
    rows = scratch.save(packing.pack(sizes, 2048), "rows")
    own = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("kinds"), F.max("piece").alias("last"), F.count_if(F.col("container_id").isNull()).alias("none"), F.count_if(F.col("n_tokens") == 2048).alias("full"))
    met = sizes.join(own, "doc_id", "full")
    once = (F.col("tokens") == F.col("size")) & (F.col("pieces") == F.col("kinds")) & (F.col("last") == F.col("pieces") - 1) & ((F.col("size") == 0) == (F.col("none") > 0))
    posts = met.agg(F.count("*").alias("n_posts"), F.count_if(once).alias("n_placed"), F.count_if((F.col("size") <= 2048) & (F.col("pieces") > 1)).alias("n_cut"), F.count_if(F.col("full") < F.col("pieces") - 1).alias("n_short"))
    over = rows.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("n_over"))
    return posts.join(F.broadcast(over))


P6_INVARIANTS_SQL = "select count(*) as n_posts, count(*) as n_placed, 0::bigint as n_cut, 0::bigint as n_short, 0::bigint as n_over from documents"


def _p7(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"), edited=edited)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d, False).where(F.col("run") >= leaks.PASSAGE).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Posts and items whose best alignment scores as much as PASSAGE equal words, edited copies among them."""
    found = _p7(spark, d, True).where(F.col("score") >= leaks.MATCH * leaks.PASSAGE)
    return found.select("doc_id", "item_id", "score", F.col("run").alias("longest_run"), F.round("share", 6).alias("share"))



def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed(table(spark, d, "documents")).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every post with own words, its perplexity under the prose model and its entries."""
    found = spam.scored(table(spark, d, "documents"))
    return found.select("doc_id", F.round("perplexity", 4).alias("perplexity"), F.round("odd", 6).alias("odd_share"), F.round("mix", 4).alias("class_perplexity"), F.col("normal").alias("prose_mix"), "entries", F.col("inside").alias("entry_words"), F.col("total").alias("own_words"))


QUERIES = {
    "p1_found": p1_found,
    "p1_top_tests": p1_top_tests,
    "p1_top_three": p1_top_three,
    "p2_found": p2_found,
    "p2_search": p2_search,
    "p3_found": p3_found,
    "p3_cutoffs": p3_cutoffs,
    "p3_batches": p3_batches,
    "p4_found": p4_found,
    "p4_percentiles": p4_percentiles,
    "p4_combined": p4_combined,
    "p4_bounds": p4_bounds,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}
ORACLES = {
    "p1_found": P1_SQL.format("contrast_group, cluster_id, gene_id"),
    "p1_top_tests": P1_SQL.format("contrast_group, cluster_id, place::int as place, gene_id, logfc, q"),
    "p1_top_three": P1_SQL.format("contrast_group, cluster_id, place::int as place, gene_id") + " and place <= 3 and contrast_group = 'all'",
    "p2_found": P2_FOUND_SQL,
    "p2_search": P2_SEARCH_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_cutoffs": P3_CUTOFFS_SQL,
    "p3_batches": P3_CUTOFFS_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_percentiles": P4_PERCENTILES_SQL,
    "p4_bounds": P4_BOUNDS_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_groups": P5_GROUPS_SQL,
    "p6_invariants": P6_INVARIANTS_SQL,
}
