"""Problems 1 to 5 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("varve.llm")

from varve.llm import clusters, cutoffs, neighbours, percentiles, topn  # noqa: E402
from varve.session import Scratch  # noqa: E402

NAN, INF = float("nan"), float("inf")


def _top(df, **how):
    return topn.top_n(df, ["g", "h"], "s", [F.col("q").asc_nulls_last(), F.col("id").asc()], 3, keep=["q", "id"], **how)


SCHEMA = "g string, h int, id int, s double, q double, at int, path string, place int"


def test_top_n_with_ties_nulls_and_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"g{rng.integers(40)}", 1 if rng.random() < 0.9 else None, i, [None, NAN, INF, -INF][i % 29 % 4] if i % 29 < 4 else float(rng.integers(30)), None if i % 7 == 0 else float(rng.integers(5)), 0, "x", 9) for i in range(4000)]
    got = {}
    for r in _top(spark.createDataFrame(rows, SCHEMA), row_group_rows=50).collect():
        got.setdefault((r.g, r.h), {})[r.place] = r.id
    want = {}
    for g, h, i, s, q, *_ in rows:
        if s is not None and np.isfinite(s):
            want.setdefault((g, h), []).append((-s, q is None, q or 0, i))
    assert got == {k: {p + 1: x[3] for p, x in enumerate(sorted(v)[:3])} for k, v in want.items()}


def test_top_n_counts_newest_versions_only(spark):
    rows = [("a", 1, 1, 9.0, 0.1, 1, "", 0), ("a", 1, 1, None, 0.1, 2, "", 0), ("a", 1, 2, 3.0, None, 1, "", 0), ("a", 1, 2, 3.0, None, 1, "", 0), ("a", 1, 3, 3.0, 0.5, 1, "", 0), ("b", 1, 1, NAN, 0.1, 1, "", 0)]
    got = _top(spark.createDataFrame(rows, SCHEMA), version=(["id"], "at")).orderBy("place").collect()
    assert [(r.g, r.id) for r in got] == [("a", 3), ("a", 2)]


def test_row_groups_below_the_floor_are_skipped(spark):
    rows = spark.range(40000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), F.lit(1).alias("h"), F.col("id").cast("int").alias("id"), (F.col("id") * 7919 % 40009).cast("double").alias("s"))
    layout = topn.build(rows, ["g", "h"], "s", [F.col("id")], keep=["id"], row_group_rows=500)
    best = sorted(((i * 7919 % 40009, i) for i in range(40000) if i % 4), reverse=True)
    for n in (3, 20):
        found, told = topn.top(spark, layout, n)
        assert [r.id for r in found.where("g = 'hot'").orderBy("place").collect()] == [i for _, i in best[:n]]
        assert found.count() == 11 * n and told["read"] < told["row_groups"] / 2
    asked = spark.createDataFrame([("hot", 1), ("none", 1)], "g string, h int")
    found, fewer = topn.top(spark, layout, 20, asked)
    assert found.count() == 20 and fewer["read"] <= told["read"]
    assert topn.top(spark, layout, 20, asked.limit(0))[0].count() == 0


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert _top(empty).count() == 0 and _top(empty, version=(["id"], "at")).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(empty, [], "s", [], 3)


def _exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i, own in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = INF
        out[int(own)] = [int(ids[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def _found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.id, {})[r.place] = r.other
    return {i: [v[p] for p in sorted(v)] for i, v in got.items()}


def test_neighbours_with_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 3, [1.0, 2.0, 3.0] if i % 3 == 0 else np.round(rng.normal(size=3) * 5 + 10 * (i % 4), 2).tolist()) for i in rng.permutation(900)]
    got, want = _found(neighbours.knn(spark.createDataFrame(rows, "id bigint, v array<double>"), 5)), _exact(rows, 5)
    same = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert same >= 0.99 * sum(map(len, want.values()))
    hot = sorted(i for i, v in rows if v == [1.0, 2.0, 3.0])
    assert all(got[i] == [h for h in hot if h != i][:5] for i in hot)


def test_hubs_and_full_leaves_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(12)
    spokes = rng.normal(size=(300, 8))
    x = np.concatenate([np.zeros((1, 8)) + 1e-3, spokes / np.linalg.norm(spokes, axis=1, keepdims=True)])  # all near the first
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    monkeypatch.setattr(neighbours, "HUB", 16)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 40)
    index = neighbours.build(rows)
    sizes = neighbours._gatherings(index.graph.withColumn("new", F.transform("ids", lambda _: F.lit(True)))).groupBy("at", "pair").count()
    assert sizes.where("pair > 0").count() and sizes.agg(F.max("count")).first()[0] <= 64
    near, want = {r.id: r.ids[:5] for r in index.graph.collect()}, _exact([(i, v) for i, v in enumerate(x)], 5)
    assert sum(len(set(near[i]) & set(want[i])) for i in want) >= 0.95 * 5 * len(x)
    with pytest.raises(RuntimeError):
        neighbours.build(rows, rounds=1, settled=0.0)


def test_search_finds_the_neighbours_of_foreign_queries(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(60, 6)) * 100  # far apart, so that the graph falls into parts
    x, q = rng.normal(size=(1500, 6)) + spots[rng.integers(60, size=1500)], rng.normal(size=(30, 6)) + spots[rng.integers(60, size=30)]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    index = neighbours.build(base)
    got = _found(neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id bigint, v array<double>"), index, 5))
    want = [set(np.argsort(((x - v) ** 2).sum(1))[:5].tolist()) for v in q]
    assert sum(len(set(got[i]) & want[i]) for i in range(30)) >= 0.9 * 150
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<double>")
    assert neighbours.search(queries, neighbours.build(queries.limit(0)), 5).count() == 0


def test_usable_vectors_and_few_rows(spark):
    rows = [(1, [1.0, 2.0], 1, 0), (1, [5.0, 5.0], 2, 0), (2, None, 1, 0), (3, [1.0], 1, 0), (4, [0.0, -0.0], 1, 0), (5, [1.0, NAN], 1, 0), (6, [1.0, None], 1, 0), (None, [1.0, 1.0], 1, 0), (7, [1.0, 2.0], 1, 0), (7, [1.0, 2.0], 1, 0), (8, [INF, 1.0], 1, 0)]
    df = spark.createDataFrame(rows, "key bigint, vec array<double>, at int, id int")
    usable = neighbours.usable_vectors(df, "key", "vec", 2, "at")
    assert {r.id: r.v for r in usable.collect()} == {1: [5.0, 5.0], 7: [1.0, 2.0]}
    assert _found(neighbours.knn(usable, 5)) == {1: [7], 7: [1]}
    assert neighbours.knn(usable.limit(0), 5).count() == 0 and neighbours.knn(usable.limit(1), 5).count() == 0


def _cutoffs(spark, rows, targets, batches=1, name="t"):
    df = spark.createDataFrame(rows, "src string, score double, n int, leaf string")
    tree = cutoffs.CountTree(spark, Scratch(spark, name).path("tree"), ["src"])
    for b in range(batches):
        tree.add(df.where(F.pmod(F.hash("score"), F.lit(batches)) == b), "score")
    return {r.src: r for r in cutoffs.cutoffs(df, spark.createDataFrame(targets, "src string, keep_pct int, n int"), ["src"], "score", tree, add=False).collect()}, tree, df


def test_cutoffs_match_sorting(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{rng.integers(3)}", float(v), 0, "") for v in np.concatenate([rng.integers(1, 50, 500), rng.lognormal(3, 2, 500), -rng.lognormal(0, 1, 200), [0.0, 1e300, 1e-300]])]
    rows += [("s0", None, 0, ""), ("s1", NAN, 0, ""), ("none", 1.0, 0, "")]
    for batches, pct in ((1, 37), (4, 95), (2, 0), (2, 100)):
        got, *_ = _cutoffs(spark, rows, [("s0", pct, 1), ("s1", pct, 1), ("s2", None, 1), ("far", 5, 1)], batches)
        assert set(got) == {"s0", "s1"}
        for s in got:
            v = sorted(x for k, x, *_ in rows if k == s and x is not None and x == x)
            cut = next(x for x in v if 100 * sum(y <= x for y in v) >= pct * len(v))
            assert (got[s].cutoff, got[s].kept, got[s].n) == (cut, sum(y <= cut for y in v), len(v))


def test_tree_takes_batches_back_and_reads_nothing(spark):
    rows = [("a", float(i % 10 + 1), 0, "") for i in range(100)]
    got, tree, df = _cutoffs(spark, rows, [("a", 50, 0)], 1)
    gone = df.where("score > 5")
    tree.add(gone, "score", -1)
    again = cutoffs.cutoffs(df.where("score <= 5"), spark.createDataFrame([("a", 50)], "src string, keep_pct int"), ["src"], "score", tree, add=False).first()
    assert got["a"].cutoff == 5.0 and (again.cutoff, again.kept, again.n) == (3.0, 30, 50)
    assert _cutoffs(spark, [], [("a", 50, 0)])[0] == {}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"k{rng.integers(5)}", None if i % 50 == 0 else NAN if i % 51 == 0 else float(rng.integers(40)) if i % 2 else float(rng.normal()), 1) for i in range(3000)]
    df = spark.createDataFrame(rows + [("bare", None, 1)], "k string, x double, _row int")
    got = {(r.k, r.p): (r.n, r.value) for r in percentiles.percentiles(df, ["k"], "x", [0, 0.1, 0.5, 0.9, 1]).collect()}
    for k in {r[0] for r in rows}:
        v = [x for key, x, _ in rows if key == k and x is not None and x == x]
        for p in (0, 0.1, 0.5, 0.9, 1):
            assert got[k, p][0] == len(v) and got[k, p][1] == pytest.approx(np.quantile(v, p))
    assert ("bare", 0.5) not in got and percentiles.percentiles(df.limit(0), ["k"], "x", [0.5]).count() == 0


def test_a_hot_value_is_dealt_over_files(spark):
    from varve.operators import order_statistics

    rows = spark.range(60000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1000 / 100).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, pieces = order_statistics.located(rows.repartition(8), ["k"], "x")
        sizes = sorted(r.c for r in pieces.groupBy("_file").agg(F.sum("_cnt").alias("c")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 3 and sizes[-1] <= 2 * sum(sizes) / len(sizes)
    got = {(r.k, r.p): r.value for r in percentiles.percentiles(rows, ["k"], "x", [0.3, 0.5, 0.699, 0.7, 0.9]).collect()}
    v = rows.toPandas()
    assert all(got[k, p] == pytest.approx(np.quantile(v.x[v.k == k], p)) for k in (0, 1) for p in (0.3, 0.5, 0.699, 0.7, 0.9))


def test_combined_summaries_keep_their_bound(spark):
    rng = np.random.default_rng(6)
    rows = [("d", int(day), float(v)) for day in range(12) for v in rng.lognormal(day % 3, 1, int(rng.integers(1, 400)))]
    df = spark.createDataFrame(rows, "d string, day int, x double")
    days = percentiles.summaries(df, ["d", "day"], "x", 20)
    v = np.sort([r[2] for r in rows])
    for r in percentiles.combine(days, ["d"], [0.1, 0.5, 0.9]).collect():
        rank = np.searchsorted(v, r.value, side="right") / len(v)
        assert r.n == len(v) and abs(rank - r.p) <= r.error + 1 / len(v)


def _components(rows, percent):
    runs = sorted({(s, r) for s, _, r, _ in rows})
    label = {}
    for s, c, r, x in rows:
        if x is not None:
            label[s, c, r] = min(x, label.get((s, c, r), x))
    cells = sorted({(s, c) for s, c, _ in label})
    root = {c: c for c in cells}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(cells):
        for b in cells[i + 1 :]:
            if a[0] == b[0]:
                both = [(label[(*a, r)], label[(*b, r)]) for s, r in runs if s == a[0] and (*a, r) in label and (*b, r) in label]
                if both and 100 * sum(x == y for x, y in both) >= percent * len(both):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {(s, c): find((s, c))[1] for s, c in cells}


@pytest.mark.parametrize("chunk", [4, 1024])
def test_groups_are_the_components_of_being_alike(spark, monkeypatch, chunk):
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    rows = []
    for s, runs in (("p", 7), ("q", 3), ("one", 1)):
        for c in range(60):
            true = c % 5 if c % 3 else 9
            for r in range(runs):
                if rng.random() > 0.15:
                    rows.append((s, c, f"r{r}", None if rng.random() < 0.05 else int(true) if rng.random() > 0.3 else int(rng.integers(6))))
    rows += rows[:40] + [("p", 900, "r0", None)]
    nodes, members = clusters.label_lists(spark.createDataFrame(rows, "scope string, cell bigint, run string, label int"), "scope", "cell", "run", "label")
    got = {(r.scope, r.record): (r.lead, r.size) for r in clusters.groups(nodes, members, 60).collect()}
    want = _components(rows, 60)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == sum(w == want[k] and x[0] == k[0] for x, w in want.items()) for k, v in got.items())


def test_chains_and_stars_merge_in_few_rounds(spark):
    star = [("s", 500, 500 + i if i % 2 else 500 - i, 0.6 + 0.0007 * i) for i in range(1, 400)]
    links = spark.createDataFrame([(s, min(a, b), max(a, b), x) for s, a, b, x in star] + [("t", 1, 2, 0.59)], "scope string, a bigint, b bigint, like double")
    got = clusters.average_linkage(links, 0.6, step=clusters.STEP, rounds=40)
    assert got.select("cluster").distinct().count() == 1 and got.count() == 400
    assert clusters.average_linkage(links.limit(0), 0.6).count() == 0


def _merged(pairs, threshold, over):
    """Average linkage of one scope, one best pair at a time."""
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    group, links = {x: {x} for x in names}, {frozenset((a, b)): s for a, b, s in pairs}

    def average(p, q):
        own = [links[frozenset((x, y))] for x in group[p] for y in group[q] if frozenset((x, y)) in links]
        return (sum(own) / (len(own) if over == "links" else len(group[p]) * len(group[q]))) if own else -1

    while True:
        best = max(((average(p, q), -p, -q) for p in group for q in group if p < q), default=(-1,))
        if best[0] < threshold:
            return {x: p for p, own in group.items() for x in own}
        group[-best[1]] |= group.pop(-best[2])


@pytest.mark.parametrize("over", ["links", "pairs"])
def test_linkage_is_that_of_one_merge_at_a_time(spark, over):
    rng = np.random.default_rng(11)
    blobs = [(a, b, round(float(rng.uniform(0.55, 1)), 6)) for k in (0, 20, 40) for a in range(k, k + 10) for b in range(a + 1, k + 10) if rng.random() < 0.7]
    loose = [(int(a), int(b), round(float(rng.uniform(0.3, 0.8)), 6)) for a, b in {tuple(sorted(rng.choice(50, 2, replace=False))) for _ in range(60)} if not any(x[:2] == (a, b) for x in blobs)]
    rows = [("p", a, b, s) for a, b, s in blobs + loose] + [("q", 1, 2, 0.9), ("q", 2, 3, float("nan")), ("q", 3, 4, None)]
    got = {(r.scope, r.node): r.cluster for r in clusters.average_linkage(spark.createDataFrame(rows, "scope string, a bigint, b bigint, like double"), 0.6, over=over).collect()}
    want = _merged(blobs + loose, 0.6, over)
    assert {n: c for (s, n), c in got.items() if s == "p"} == {n: c for n, c in want.items() if ("p", n) in got}
    assert {n: c for (s, n), c in got.items() if s == "q"} == {1: 1, 2: 1}


def test_averages_stop_a_merge_that_one_link_would_make(spark):
    dense = [("p", a, b, 0.9) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)]
    bridge = [("p", 4, 10, 0.85)] + [("p", a, b, 0.1) for a in range(5) for b in range(10, 15) if (a, b) != (4, 10)]
    links = lambda rows: spark.createDataFrame(rows, "scope string, a bigint, b bigint, like double")
    single = {r.cluster for r in clusters.average_linkage(links(dense + bridge[:1]), 0.6).collect()}
    for over, rows in (("links", dense + bridge), ("pairs", dense + bridge[:1])):
        got = {r.node: r.cluster for r in clusters.average_linkage(links(rows), 0.6, over=over).collect()}
        assert len(set(got.values())) == 2 and len(single) == 1
        assert all(got[a] == got[b] for k in (range(5), range(10, 15)) for a in k for b in k)


def test_typical_records(spark):
    rows = [("p", c, f"r{r}", 1 if c < 4 else 2) for c in range(5) for r in range(4)] + [("p", 9, f"r{r}", 1 if r < 3 else 7) for r in range(4)]
    nodes, members = clusters.label_lists(spark.createDataFrame(rows, "scope string, cell bigint, run string, label int"), "scope", "cell", "run", "label")
    placed = clusters.groups(nodes, members, 60)
    got = [(r.lead, r.size, r.place, r.record) for r in clusters.typical(placed, nodes, 2).orderBy("lead", "place").collect()]
    assert got == [(0, 5, 1, 0), (0, 5, 2, 1), (4, 1, 1, 4)]
    empty = spark.createDataFrame([], "scope string, cell bigint, run string, label int")
    nodes, members = clusters.label_lists(empty, "scope", "cell", "run", "label")
    assert clusters.groups(nodes, members, 60).count() == 0
