"""Core operators against brute force and hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions import stats
from varve.model import Project, current, first_match
from varve.operators import calibration, diffexp, expression, graph, packed, pca, qc, reduce, similarity
from varve.plans import retail
from varve.sources import matrices


@pytest.fixture(scope="module")
def tiny(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, None)], "cell_id bigint, dataset string")
    counts = spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "a", 1.0), (2, 1, "a", 2.0), (2, 2, "a", 1.0), (3, 1, "a", 5.0), (4, 2, "b", 3.0), (4, 3, "b", 1.0)], "cell_id bigint, gene_id int, dataset string, count double")
    genes = spark.createDataFrame([(1, "Rps1"), (2, "mt-Co"), (3, "RPS1"), (4, None)], "gene_id int, symbol string")
    return counts, cells, genes


def test_cell_metrics_keep_cells_without_counts(tiny):
    counts, cells, genes = tiny
    got = {r.cell_id: r for r in qc.cell_metrics(counts, cells, {"mito": qc.gene_set(genes, qc.MITOCHONDRIAL)}).collect()}
    assert len(got) == 6 and got[1].numi == 3 and got[1].mito_frac == pytest.approx(1 / 3)
    assert got[5].numi == 0 and got[5].ngenes == 0 and got[5].mito_frac is None


def test_filter_fails_nulls_and_keeps_null_dataset(tiny):
    counts, cells, genes = tiny
    metrics = qc.cell_metrics(counts, cells, {"mito": qc.gene_set(genes, qc.MITOCHONDRIAL)})
    got = {r.cell_id: r.passed for r in qc.passing(metrics, min_genes=1, genes_quantile=1.0, umis_quantile=1.0, max_mito=0.5).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_all_copies_are_dropped(tiny):
    counts, cells, _ = tiny
    assert {r.cell_id for r in qc.drop_repeated_cells(counts, cells).collect()} == {3, 4}


def test_marker_filter_ignores_unknown_genes(spark, tiny):
    counts, cells, genes = tiny
    rules = spark.createDataFrame([("a", "mt-Co", True), ("a", "none", False), ("b", "Rps1", False), ("b", "Rps1", None)], "dataset string, gene string, expressed boolean")
    got = {r.cell_id: r.marker_passed for r in qc.marker_filter(counts, cells, genes, rules).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_repeats_are_numbered(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id int, name string")
    assert [r.unique_name for r in qc.number_repeats(df, "name", "id").orderBy("id").collect()] == ["x.1", "x.2", "y", None, None]


def test_subsample_is_exact_and_stable(tiny):
    cells = tiny[1]
    one = {r.cell_id for r in qc.subsample(cells, 3, 1).collect()}
    assert len(one) == 3 and one == {r.cell_id for r in qc.subsample(cells.repartition(7), 3, 1).collect()}
    assert qc.subsample(cells, 99).count() == 6


def test_normalise_and_moments_count_zeros(tiny):
    counts, cells, _ = tiny
    norm = expression.normalise(counts)
    value = {(r.cell_id, r.gene_id): r.norm for r in norm.collect()}
    assert value[1, 1] == pytest.approx(math.log1p(1e4 * 2 / 3))
    got = {r.gene_id: r for r in expression.moments(norm, cells.where("dataset = 'a'"), [], F.col("norm")).collect()}
    assert got[2].n == 3 and got[2].frac == pytest.approx((2 + 1) / 3)  # gene 2 also in a cell outside


def test_variable_genes_without_variance(spark):
    cells = spark.createDataFrame([(i, "a") for i in range(4)], "cell_id bigint, dataset string")
    norm = spark.createDataFrame([(i, 1, "a", 1.0) for i in range(4)] + [(0, 2, "a", 3.0)], "cell_id bigint, gene_id int, dataset string, norm double")
    got = expression.variable_genes(norm, cells, min_mean=0.0, min_z=-10).collect()
    assert {r.gene_id: r.z for r in got} == {1: 0.0, 2: 0.0}
    assert expression.variable_genes(norm.limit(0), cells.limit(0)).count() == 0


def test_controlled_score_excludes_own_genes(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (30, 12)).astype(float)
    norm = spark.createDataFrame([(i, j, "a", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]], "cell_id bigint, gene_id int, dataset string, norm double")
    cells = spark.createDataFrame([(i, "a") for i in range(30)], "cell_id bigint, dataset string")
    signature = spark.createDataFrame([(0,), (1,)], "gene_id int")
    got = np.array([r.score for r in expression.controlled_score(norm, cells, signature, 3).orderBy("cell_id").collect()])
    f = np.stack([x.mean(0), x.var(0, ddof=1)], 1)
    f = (f - f.mean(0)) / f.std(0, ddof=1)
    back = set()
    for g in (0, 1):
        d = ((f - f[g]) ** 2).sum(1)
        d[g] = np.inf
        back |= set(np.lexsort((np.arange(12), d))[:3])
    back -= {0, 1}
    assert np.allclose(got, x[:, [0, 1]].mean(1) - x[:, sorted(back)].mean(1))


@pytest.mark.parametrize("kind", ["spread", "tied", "few"])
def test_similar_genes_match_brute_force(spark, kind):
    rng = np.random.default_rng(13)
    n = 4 if kind == "few" else 300
    f = np.round(rng.lognormal(0, 1.5, (n, 2)), 1) if kind == "tied" else rng.lognormal(0, 1.5, (n, 2))
    if kind == "tied":
        f[20:200] = f[0]
    features = spark.createDataFrame([(i, float(m), float(v)) for i, (m, v) in enumerate(f)] + [(9000, float("nan"), 0.0), (9001, None, 0.0)], "gene_id int, m double, v double")
    asked = spark.createDataFrame([(i,) for i in [*range(0, n, 3), 8000]], "gene_id int")
    got = {}
    for r in expression.similar_genes(features, asked, 6).collect():
        got.setdefault(r.gene_id, {})[r["rank"]] = r.other
    for i in range(0, n, 3):
        d = (f[:, 0] - f[i, 0]) ** 2 + (f[:, 1] - f[i, 1]) ** 2
        want = [int(j) for j in np.lexsort((np.arange(n), d)) if j != i][:6]
        assert [got[i][p + 1] for p in range(len(want))] == want
    assert expression.similar_genes(features.limit(0), asked, 6).count() == 0


def test_regression_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(20, 2))
    y = np.where(rng.random(20) < 0.5, 0.0, 1 + c @ [0.5, -1])
    norm = spark.createDataFrame([(i, 7, float(y[i])) for i in range(20) if y[i]], "cell_id bigint, gene_id int, norm double")
    cov = spark.createDataFrame([(i, "a", float(c[i, 0]), float(c[i, 1])) for i in range(20)], "cell_id bigint, dataset string, u double, v double")
    betas = expression.regress_all(norm, cov, ["u", "v"])
    want = np.linalg.lstsq(np.column_stack([np.ones(20), c]), y, rcond=None)[0]
    assert np.allclose(betas.first().beta, want)
    got = np.array([r.residual for r in expression.residuals(norm, cov, betas, ["u", "v"]).orderBy("cell_id").collect()])
    assert np.allclose(got, y - np.column_stack([np.ones(20), c]) @ want)


def test_regression_keeps_the_digits_of_far_off_covariates(spark):
    rng = np.random.default_rng(31)
    c = np.column_stack([1e5 + rng.normal(size=60), rng.normal(size=60)])
    y = np.where(rng.random(60) < 0.5, 0.0, 2 + (c - [1e5, 0]) @ [0.5, -1])
    norm = spark.createDataFrame([(i, 7, float(y[i])) for i in range(60) if y[i]], "cell_id bigint, gene_id int, norm double")
    cov = spark.createDataFrame([(i, "a", float(c[i, 0]), float(c[i, 1])) for i in range(60)], "cell_id bigint, dataset string, u double, v double")
    near = c - c.mean(0)
    slopes = np.linalg.lstsq(near, y - y.mean(), rcond=None)[0]
    assert np.allclose(expression.regress_all(norm, cov, ["u", "v"]).first().beta, [y.mean() - slopes @ c.mean(0), *slopes], rtol=1e-9)


@pytest.mark.parametrize("ties", [diffexp.TIES, 3])
def test_benjamini_hochberg(spark, monkeypatch, ties):
    monkeypatch.setattr(diffexp, "TIES", ties)
    monkeypatch.setattr(diffexp, "TIED", 60)
    rng = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else "g" if i % 3 else "h", i, None if i == 5 else float("nan") if i == 6 else float(np.round(rng.random() ** 4, 3))) for i in range(200)]
    got = {r.id: r.q for r in diffexp.benjamini_hochberg(spark.createDataFrame(rows, "k string, id int, p double"), ["k"], "p").collect()}
    assert len(got) == 200 and got[5] is None and got[6] is None
    for key in (None, "g", "h"):
        own = [(i, p) for k, i, p in rows if k == key and p is not None and p == p]
        own.sort(key=lambda x: x[1])
        low, n = 1.0, len(own)
        want = {}
        for rank in range(n, 0, -1):
            i, p = own[rank - 1]
            low = min(low, p * n / rank)
            want[i] = low
        assert all(got[i] == pytest.approx(q) for i, q in want.items())
    assert diffexp.benjamini_hochberg(spark.createDataFrame([], "k string, id int, p double"), ["k"], "p").count() == 0


def test_tails_and_gamma_functions():
    assert stats.beta_tail(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    n, t = 4.0, 2.0
    grid = np.linspace(0, t, 200001)
    density = math.gamma(2.5) / (math.sqrt(4 * math.pi) * math.gamma(2)) * (1 + grid**2 / n) ** -2.5
    assert stats.beta_tail(n / 2, 0.5, n / (n + t * t)) == pytest.approx(1 - 2 * np.trapezoid(density, grid), abs=1e-8)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649015329) and stats.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert stats.trigamma(stats.trigamma_inverse(0.3)) == pytest.approx(0.3)


def test_moderated_t_shrinks_towards_the_prior(spark):
    rng = np.random.default_rng(3)
    sd = np.sqrt(1 / rng.gamma(4, 1 / 4, 300))
    x = rng.normal(size=(12, 300)) * sd
    cells = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(12)], "cell_id bigint, cluster string")
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(300)], "cell_id bigint, gene_id int, norm double")
    sums, sizes = diffexp.cluster_sums(values, cells, [])
    tests = diffexp.one_vs_rest(sums, sizes, []).where("cluster = 'a'")
    plain = {r.gene_id: r for r in diffexp.pooled_t(tests).collect()}
    a, b = x[:6], x[6:]
    s2 = (a.var(0, ddof=1) + b.var(0, ddof=1)) / 2
    assert plain[0].t == pytest.approx((a.mean(0) - b.mean(0))[0] / math.sqrt(s2[0] / 3))
    e = np.log(s2) - stats.digamma(5.0) + math.log(5.0)
    d0 = 2 * stats.trigamma_inverse(e.var(ddof=1) - float(stats.trigamma(5.0)))
    s02 = math.exp(e.mean() + stats.digamma(d0 / 2) - math.log(d0 / 2))
    row = {r.gene_id: r for r in diffexp.moderated_t(tests, ["cluster"]).collect()}[4]
    shrunk = (d0 * s02 + 10 * s2[4]) / (d0 + 10)
    assert row.t == pytest.approx((a.mean(0) - b.mean(0))[4] / math.sqrt(shrunk / 3), rel=1e-6)
    assert 4 < d0 < 20 and 0 < row.p <= row.q <= 1


def test_cluster_names_need_more_than_half(spark):
    hits = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "a"), ("3", "z")], "cluster string, gene string")
    types = spark.createDataFrame([("T", "a"), ("T", "b"), ("S", "b")], "type string, gene string")
    clusters = spark.createDataFrame([("1",), ("2",), ("3",)], "cluster string")
    got = {r.cluster: r.name for r in diffexp.cluster_names(hits, types, clusters).collect()}
    assert got == {"1": "T_S", "2": "Unknown_1", "3": "Unknown_2"}


def test_exact_neighbours_with_ties(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[10] = x[20] = x[30]
    points = spark.createDataFrame([(i, x[i].tolist()) for i in range(150)] + [(999, None)], "cell_id bigint, pc array<double>")
    got = {(r.cell_id, r["rank"]): r.nbr_id for r in graph.knn(points, 4).collect()}
    for i in range(150):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(150), d))[:4].tolist()
    assert graph.knn(points.limit(0), 3).count() == 0


def test_units_out_of_reach_are_skipped_without_loss(spark, monkeypatch):
    monkeypatch.setattr(graph, "UNIT", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 2)) + c for c in ([0, 0], [50, 0], [0, 80])])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, pc array<double>")
    got = {(r.cell_id, r.nbr_id) for r in graph.knn(points, 3).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(180) for j in np.argsort(d[i])[:3]}


def test_communities_of_planted_blobs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(25, 4)) + c for c in (np.zeros(4), np.full(4, 30.0), np.full(4, -30.0))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, pc array<double>")
    edges, member = graph.phenograph(points, 8)
    top = member.where(F.col("level") == member.agg(F.max("level")).first()[0])
    label = {r.cell_id: r.cluster for r in top.collect()}
    assert all(len({label[i] for i in range(b, b + 25)} & {label[i] for i in range(75) if not b <= i < b + 25}) == 0 for b in (0, 25, 50))
    quality = graph.modularity(edges, top).first()[0]
    single = graph.modularity(edges, top.withColumn("cluster", F.col("cell_id"))).first()[0]
    assert quality > max(single, 0.5)
    with pytest.raises(ValueError):
        graph.phenograph(points.limit(3), 2)


def test_communities_settle(spark):
    n = 150
    links = [(i, (i + 1) % n) for i in range(n)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in links], "src bigint, dst bigint, w double")
    rows = graph.louvain(edges).collect()
    label = {r.cell_id: r.cluster for r in rows if r.level == 1}
    for i in range(n):
        def gain(c, i=i):
            return sum(label[j % n] == c for j in (i - 1, i + 1)) - 2 * 2 * sum(label[j] == c for j in range(n) if j != i) / (2 * n)

        assert max(gain(label[(i + s) % n]) for s in (-1, 1)) <= gain(label[i]) + 1e-9
    top = {r.cell_id: r.cluster for r in rows if r.level == max(r.level for r in rows)}
    sizes = {c: sum(v == c for v in top.values()) for c in set(top.values())}
    assert all(top[a] == top[b] or 1 / n <= 2 * sizes[top[a]] * sizes[top[b]] / n**2 + 1e-9 for a, b in links)


def test_components_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    x = np.column_stack([x, np.ones(40)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, v array<double>")
    scores, loadings, shares = pca.pca(df, 100)
    z = (x[:, :5] - x[:, :5].mean(0)) / x[:, :5].std(0, ddof=1)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(shares, values[:4] / values[:4].sum())
    got = np.array([r.pc for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got[:, 0]), np.abs(z @ np.linalg.svd(z)[2][0]))
    assert loadings.where("feature = 5").count() == 0
    test = pca.permutation_test(df, shares, reps=3).orderBy("pc").collect()
    assert test[-1].p == 1.0 and all(a.p <= b.p for a, b in zip(test, test[1:], strict=False))


def test_components_of_many_features_need_no_square_of_them(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("features x features numbers")

    monkeypatch.setattr(pca, "_products", refuse)
    rng = np.random.default_rng(32)
    n, p = 150, 1300
    x = np.where(rng.random((n, p)) < 0.1, rng.gamma(2.0, 1.0, (n, p)), 0.0)
    x[: n // 3, :200] *= 3
    x[:, 7], x[5] = 0, 0
    norm = spark.createDataFrame([(i, 10 * j, float(x[i, j])) for i in range(n) for j in range(p) if x[i, j]], "cell_id bigint, gene_id int, norm double")
    genes = spark.createDataFrame([(10 * j,) for j in range(p)], "gene_id int")
    df = pca.sparse_vectors(norm, spark.range(n).select(F.col("id").alias("cell_id")), genes)
    assert all(np.array_equal(v, x[i]) for i, v in pca.dense(df).collect())
    scores, loadings, shares = pca.pca(df, 12)
    z = np.delete(x, 7, 1)
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    _, s, t = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(shares, s[:11] ** 2 / (s[:11] ** 2).sum())
    got = np.array([r.pc for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ t[:11].T), rtol=1e-5, atol=1e-6)
    assert np.allclose(np.abs([r.loading for r in loadings.where("pc = 2").orderBy("feature").collect()]), np.abs(t[1])) and loadings.where("feature = 7").count() == 0
    test = pca.permutation_test(df, shares, reps=3).orderBy("pc").collect()
    hits = np.zeros(11)
    for rep in range(3):
        moved = np.zeros((n, p))
        for i in range(n):
            at = np.flatnonzero(x[i])
            moved[i, pca._moved(np.array([i]), np.array([len(at)]), at, p, (1, rep))] = x[i, at]
        moved = moved[:, moved.std(0) > 0]
        values = np.linalg.svd((moved - moved.mean(0)) / moved.std(0, ddof=1), compute_uv=False)[:11] ** 2
        hits += values / values.sum() >= shares
    hits[-1] = 3
    assert [r.p for r in test] == pytest.approx(np.maximum.accumulate(hits / 3).tolist())
    first = pca.shuffled_scores(df, 3, 1).orderBy("cell_id").collect()
    assert first == pca.shuffled_scores(df.repartition(3), 3, 1).orderBy("cell_id").collect() or np.allclose([r.pc for r in first], [r.pc for r in pca.shuffled_scores(df.repartition(3), 3, 1).orderBy("cell_id").collect()])
    with pytest.raises(ValueError):
        pca.pca(df.limit(1), 12)


def test_repeated_components_are_all_found():
    rng = np.random.default_rng(33)
    one = np.where(rng.random((60, 40)) < 0.2, 1.0, 0.0)
    x = np.kron(np.eye(30), one)
    got, vectors = pca._leading(lambda v: x.T @ (x @ v), 1200, 49, 1e-9)
    want = np.linalg.eigvalsh(x.T @ x)[::-1][:49]
    assert np.allclose(got, want) and np.allclose(x.T @ (x @ vectors), vectors * got) and np.allclose(vectors.T @ vectors, np.eye(49))


def test_shuffled_runs_cluster_a_pca_of_the_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 6)) + np.arange(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, v array<double>")
    met = []
    real = calibration.graph.phenograph
    monkeypatch.setattr(calibration.graph, "phenograph", lambda points, k: (met.append(np.array([r.pc for r in points.orderBy("cell_id").collect()])), real(points, k))[1])
    runs, _ = calibration.cluster_analysis(df, 2, [0.2], 1)
    assert runs.where("kind = 'shuffled'").count() == 1 and len(met) == 2
    moved = np.stack([np.random.default_rng([1, 0, i]).permutation(v) for i, v in enumerate(x)])
    for data, got in zip((x, moved), met, strict=True):
        z = (data - data.mean(0)) / data.std(0, ddof=1)
        assert np.allclose(np.abs(got), np.abs(z @ np.linalg.svd(z)[2][:2].T))


def test_many_graphs_settle_as_each_alone(spark):
    rng = np.random.default_rng(21)
    rows = []
    for name, n in (("a", 16), ("b", 12)):
        for i in range(n):
            for j in range(i + 1, n):
                if rng.random() < (0.5 if i % 4 == j % 4 else 0.05):
                    rows.append((name, i, j, float(rng.integers(1, 5))))
    rows += [("d", 1, 2, 0.0), (None, 1, 2, 1.0)]
    edges = spark.createDataFrame(rows, "run string, src bigint, dst bigint, w double")
    got = graph.louvain(edges, "run")
    assert got.columns == ["run", "level", "cell_id", "cluster"]
    quality = {r.run: r.modularity for r in graph.modularity(edges.where("run <> 'd'"), got.where("level = 1"), "run").collect()}
    for name in "ad":
        alone = graph.louvain(edges.where(F.col("run") == name))
        assert sorted(map(tuple, alone.collect())) == sorted(tuple(r)[1:] for r in got.where(F.col("run") == name).collect())
        if name != "d":
            assert quality[name] == pytest.approx(graph.modularity(edges.where(F.col("run") == name), alone.where("level = 1")).first()[0])
    assert got.where("run is null").count() == 0 and graph.louvain(edges.limit(0), "run").count() == 0


def test_grid_holds_the_run_made_alone(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(24, 3)) @ rng.normal(size=(3, 6)) + 3 * (np.arange(24) % 3)[:, None] * rng.normal(size=6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, v array<double>")
    runs, members = calibration.cluster_grid(df, 3, [0.15, 0.25], 1)
    assert runs.count() == 4
    run, member = calibration.cluster_run(pca.shuffled_scores(df, 3, 1), 0.15, "shuffled", 1)
    alone, chosen = run.first(), "kind = 'shuffled' and rep = 1 and knn_ratio = 0.15"
    same = runs.where(chosen).first()
    assert same.n_clusters == alone.n_clusters and same.modularity == pytest.approx(alone.modularity)
    both = [{(r.level, r.cell_id, r.cluster) for r in t.collect()} for t in (member, members.where(chosen))]
    assert both[0] == both[1] and both[0]
    with pytest.raises(ValueError):
        calibration.cluster_grid(df, 3, [0.99], 1)


def test_graphs_of_many_neighbours_are_packed_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = np.round(rng.normal(size=(90, 3)) @ rng.normal(size=(3, 6)) + 3 * (np.arange(90) % 3)[:, None] * rng.normal(size=6), 1)
    x[7] = x[40] = x[80]
    df = spark.createDataFrame([(7 * i - 50, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, v array<double>")
    plain = calibration.cluster_grid(df, 3, [0.15, 0.3], 1)
    monkeypatch.setattr(packed, "WIDE", 10)
    monkeypatch.setattr(packed, "ROWS", 16)
    for name in ("knn", "jaccard_edges"):  # these have a row for every neighbour, or for more
        monkeypatch.setattr(graph, name, None)
    wide = calibration.cluster_grid(df, 3, [0.15, 0.3], 1)
    runs = [{(r.kind, r.rep, r.knn_ratio): (r.n_clusters, r.modularity) for r in t[0].collect()} for t in (plain, wide)]
    assert len(runs[0]) == 4 and runs[0].keys() == runs[1].keys()
    for key, (n, q) in runs[0].items():
        assert runs[1][key] == (n, pytest.approx(q))
    members = [sorted(map(tuple, t[1].collect())) for t in (plain, wide)]
    assert members[0] == members[1] and len({m[5] for m in members[0]}) > 2


def test_shared_bits_of_long_rows():
    rng = np.random.default_rng(24)
    rows, line = rng.integers(0, 2**64, (3, 2104), dtype=np.uint64), np.full(2104, 2**64 - 1, np.uint64)
    rows[1] = line
    got = packed.shared_bits(2104, 2)(rows, np.array([2, 1, 0, 1]), line)
    assert got.tolist() == [sum(int(w).bit_count() for w in rows[i]) for i in (2, 1, 0, 1)]


def test_similarity_helpers(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.2), ("b", "c", 0.1)], "cluster1 string, cluster2 string, similarity double")
    assert {r.cluster: r.degree for r in similarity.degrees(pairs).collect()} == {"a": 2, "b": 1, "c": 1}
    wide = {r.cluster1: r.asDict() for r in similarity.matrix(pairs, "similarity", ["a", "b", "c"]).collect()}
    assert wide["b"]["a"] == 0.9 and wide["a"]["a"] == 1.0
    branches = {r.cluster: r.branch for r in similarity.complete_linkage(pairs, 2, 1 - F.col("similarity")).collect()}
    assert branches["a"] == branches["b"] != branches["c"]


def test_jaccard_of_tested_genes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sizes = spark.createDataFrame([("A/x", 20), ("A/y", 25), ("B/x", 30)], "cluster string, n bigint")
    rows = []
    for g in range(40):
        for c, n in (("A/x", 20), ("A/y", 25), ("B/x", 30)):
            v = np.maximum(rng.normal(1 + (2 if rng.random() < 0.3 else 0), 0.8, n), 0)
            rows.append((c, g, float(v.sum()), float((v**2).sum()), int((v > 0).sum())))
    sums = spark.createDataFrame(rows, "cluster string, gene_id bigint, s double, ss double, nnz bigint")
    names = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "origin string, dataset string")
    monkeypatch.setattr(retail, "_sums", lambda *a: (sums, sizes))
    monkeypatch.setattr(retail.views, "retail_cells", lambda *a: names)
    tests = diffexp.moderated_t(diffexp.one_vs_rest(sums, sizes, []), ["cluster"]).collect()
    assert any(t.q <= 0.05 for t in tests) and any(t.q > 0.05 and t.fold >= 1 for t in tests)
    got = retail.cluster_similarity_q(spark, "").collect()
    assert len(got) == 3
    for r in got:
        for column, fold in (("jaccard", 1.0), ("jaccard2", 1.5)):
            a, b = ({t.gene_id for t in tests if t.cluster == c and t.q <= 0.05 and t.fold >= fold} for c in (r.cluster1, r.cluster2))
            assert r[column] == (round(len(a & b) / len(a | b), 5) if a | b else None)


def test_similarity_without_variance_and_within_groups(spark):
    rows = [("g", "a", 1, 1.0, 2.0, 0.01), ("g", "b", 1, 2.0, 3.0, None), ("g", "c", 2, 1.0, 1.0, 0.5), ("h", "a", 1, 1.0, 2.0, 0.01), (None, "b", 1, 1.0, 1.0, 0.1)]
    features = spark.createDataFrame(rows, "k string, cluster string, gene_id int, fold double, mean double, q double")
    one = similarity.cluster_similarity(features, within=["k"]).collect()
    assert [(r.k, r.cluster1, r.cluster2, r.n_genes, r.similarity, r.jaccard, r.jaccard2) for r in one] == [("g", "a", "b", 1, None, 0.0, None)]
    assert similarity.cluster_similarity(features.limit(0)).count() == 0


def test_offsets_and_choice_of_ratio(spark):
    member = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 3, 1), ("c", 4, 2)], "dataset string, cell_id bigint, cluster int")
    assert {r.cell_id: r.merged for r in similarity.merge_clusters(member).collect()} == {1: 1, 2: 3, 3: 4, 4: 6}
    grid = calibration.run_grid(spark, [0.1, 0.05], 2)
    assert grid.where("kind = 'real'").count() == 2 and grid.where("rep = 1").count() == 2
    assert calibration.run_grid(spark, [0.1], 1).count() == 2


def test_matrix_readers(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n3 2 3\n1 1 5\n3 2 7\n3 2 1\n")
    (tmp_path / "genes.tsv").write_text("e1\tA\ne2\tB\ne3\tC\n")
    (tmp_path / "barcodes.tsv").write_text("x-1\ny-1\n")
    counts, genes, cells = matrices.read_matrix_market(spark, str(tmp_path), "d")
    assert {(r.cell_id, r.gene_id, r["count"]) for r in counts.collect()} == {(1, 1, 5.0), (2, 3, 8.0)}
    assert {r.gene_id: r.symbol for r in genes.collect()} == {1: "A", 2: "B", 3: "C"} and cells.count() == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # many blocks, and entries like the size line
    try:
        (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n30 2 30\n" + "".join(f"{i} 2 {i}\n" for i in range(1, 31)))
        (tmp_path / "barcodes.tsv").write_text("".join(f"cell{i}-1\n" for i in range(50)))
        counts, _, cells = matrices.read_matrix_market(spark, str(tmp_path), "d")
        assert {(r.gene_id, r["count"]) for r in counts.collect()} == {(i, float(i)) for i in range(1, 31)}
        assert {r.cell_id: r.barcode for r in cells.collect()} == {i + 1: f"cell{i}-1" for i in range(50)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "dense.txt").write_text("c1 c1 c2\nG1 0 2 0\nG2 1.5 0 3\n")
    counts, genes, cells = matrices.read_text_matrix(spark, str(tmp_path / "dense.txt"), "d")
    assert {(r.cell_id, r.gene_id, r["count"]) for r in counts.collect()} == {(2, 1, 2.0), (1, 2, 1.5), (3, 2, 3.0)}
    assert cells.count() == 3
    (tmp_path / "list.txt").write_text("S1\n\nS2\n")
    assert [tuple(r) for r in matrices.read_gene_list(spark, str(tmp_path / "list.txt")).orderBy("at").collect()] == [(1, "S1"), (2, "S2")]


def test_project_stages_follow_their_parameters(spark, tmp_path):
    project = Project.create(spark, ["a", "b"], str(tmp_path), label="x")
    assert project.name == "x_merged.a.b"
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert project.stage("s", make, k=1).count() == 3 and project.stage("s", make, k=1).count() == 3 and len(made) == 1
    project.stage("s", make, k=2)
    assert len(made) == 2


def test_lookups_and_current_rows(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "k int, v string, at int")
    assert {r.k: r.v for r in current(df, ["k"], "at").collect()} == {1: "y", 2: None}
    assert {r.k: r.v for r in first_match(df, "k", "at").collect()} == {1: "x", 2: None}


def test_scatter_jitter_does_not_depend_on_partitions(tiny):
    counts, cells, _ = tiny
    norm = expression.normalise(counts)
    one = {r.cell_id: (r.x, r.y) for r in reduce.pair_scatter(norm, cells, 1, 2, seed=4).collect()}
    two = {r.cell_id: (r.x, r.y) for r in reduce.pair_scatter(norm.repartition(5), cells.repartition(3), 1, 2, seed=4).collect()}
    assert one == two and one[1][0] > 0


def test_moderated_f_of_two_groups_is_the_squared_t(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10, 80)) * rng.gamma(3, 1, 80)
    cells = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(10)], "cell_id bigint, cluster string")
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(10) for j in range(80)], "cell_id bigint, gene_id int, norm double")
    sums, sizes = diffexp.cluster_sums(values, cells, [])
    f = {r.gene_id: r for r in diffexp.moderated_f(sums, sizes).collect()}
    t = {r.gene_id: r for r in diffexp.moderated_t(diffexp.one_vs_rest(sums, sizes, []).where("cluster = 'a'"), ["cluster"]).collect()}
    assert all(f[g].f == pytest.approx(t[g].t ** 2) and f[g].p == pytest.approx(t[g].p, abs=1e-8) for g in range(80))


def test_read_data_and_summary(spark):
    from varve.operators import pipeline

    genes = spark.createDataFrame([(j, f"G{j}") for j in range(8)] + [(8, "G0"), (9, "mt-A")], "gene_id int, symbol string")

    def part(seed):
        x = np.random.default_rng(seed).poisson(3, (20, 10))
        x[0] = x[1]
        x[2] = 0
        x[3, 9] = 500
        rows = [(i, j, "", float(x[i, j])) for i in range(20) for j in range(10) if x[i, j]]
        return spark.createDataFrame(rows, "cell_id bigint, gene_id int, dataset string, count double"), genes, spark.createDataFrame([(i,) for i in range(20)], "cell_id bigint")

    got = pipeline.read_data({"b": part(1), "a": part(2)}, min_genes=3, genes_quantile=1.0, umis_quantile=1.0, max_mito=0.5)
    assert got["cells"].count() == 32 and got["genes"].where("symbol in ('G0.1', 'G0.2')").count() == 2
    assert got["cells"].select("cell_id").distinct().count() == 32
    clustered = got["cells"].withColumn("cluster", F.when(F.col("cell_id") % 2 == 0, "even").otherwise("odd"))
    for contrast, tests in (("all", 20), ("datasets", 40)):
        out = pipeline.summarize(got["counts"], clustered, got["confounders"], contrast=contrast, top=2)
        assert out["tests"].count() == tests and out["heatmap"].count() == 20 and out["sizes"].count() == 4
    with pytest.raises(ValueError):
        pipeline.read_data({"a": part(1), "b": (part(2)[0], genes.where("gene_id < 9"), part(2)[2])}, min_genes=3)


def test_projects_are_saved_and_merged(spark, tmp_path):
    from varve.model import load_project, save_project

    def tables(shift, symbols):
        return {
            "counts": spark.createDataFrame([(1, 1, 2.0), (2, 2, 1.0)], "cell_id bigint, gene_id int, count double"), "cells": spark.createDataFrame([(1, "d"), (2, "d")], "cell_id bigint, dataset string"),
            "genes": spark.createDataFrame(list(enumerate(symbols, 1)), "gene_id int, symbol string"), "hvg": spark.createDataFrame([(1,)], "gene_id int"), "member": spark.createDataFrame([(1, shift), (2, shift + 1)], "cell_id bigint, cluster int"),
        }

    project = Project.create(spark, ["a"], str(tmp_path)).having(**tables(1, ["X", "Y"]))
    save_project(project)
    again = load_project(spark, str(tmp_path), "a", list(project.tables))
    merged = similarity.merge_projects({"a": again.tables, "b": tables(1, ["H1", "y"])}, spark.createDataFrame([("h1", "x"), ("H1", "z")], "symbol string, other string"))
    assert {r.symbol for r in merged["genes"].collect()} == {"x", "y"} and {r.symbol for r in merged["hvg"].collect()} == {"x"}
    assert {(r.project, r.cell_id): r.merged for r in merged["member"].collect()} == {("a", 1): 1, ("a", 2): 2, ("b", 1): 3, ("b", 2): 4}
    united = similarity.united_filter(spark.createDataFrame([("A", None), ("a", True), ("b", None), (None, True)], "symbol string, keep boolean"))
    assert {r.symbol: r.keep for r in united.collect()} == {"a": True, "b": False}


def test_tasks_get_the_package_from_spark(spark, tmp_path):
    import __spark_entry__ as entry

    entry._ship(spark)
    entry._ship(spark)
    assert any("varve" in name for name in spark.sparkContext._python_includes)


def test_from_variable_genes_to_clusters(spark):
    from varve.operators import pipeline

    rng = np.random.default_rng(14)
    n, p = 90, 40
    kind = np.arange(n) % 3
    lift = np.zeros((3, p))
    for k in range(3):
        lift[k, k * 8 : k * 8 + 8] = 3
    x = rng.poisson(np.exp(0.5 + lift[kind] * 0.6))
    counts = spark.createDataFrame([(i, j, "d", float(x[i, j])) for i in range(n) for j in range(p) if x[i, j]], "cell_id bigint, gene_id int, dataset string, count double")
    cells = spark.createDataFrame([(i, "d") for i in range(n)], "cell_id bigint, dataset string")
    norm = expression.normalise(counts)
    genes = expression.variable_genes(norm, cells, min_mean=0.05, min_z=-5)
    features, loadings, test, chosen = pipeline.components(norm, cells, genes, max_pcs=12, reps=4)
    value = {(r.cell_id, r.gene_id): r.norm for r in norm.collect()}
    listed = sorted(r.gene_id for r in genes.collect())
    assert all(v == [value.get((i, g), 0.0) for g in listed] for i, v in features.collect())
    assert 2 <= chosen <= 5 and {r.gene_id for r in loadings.collect()} <= set(listed)
    first = {r.gene_id for r in loadings.where("pc = 1 and abs(loading) > 0.2").collect()}
    assert first and first <= set(range(24))
    out = pipeline.cluster_cells(norm, cells, genes, ratios=(0.2, 0.3), shuffles=1, max_pcs=12, reps=4)
    label = {r.cell_id: r.cluster for r in out["member"].collect()}
    assert len(label) == n and all(len({int(kind[i]) for i in range(n) if label[i] == c}) == 1 for c in set(label.values()))
    assert out["calibrated"].where("fold > 1").count() == 2 and out["runs"].where("kind = 'shuffled'").count() >= 2
    with pytest.raises(ValueError):
        pipeline.cluster_cells(norm, cells, genes, max_pcs=12, reps=2, threshold=-1.0)


def test_shuffle_files_of_finished_plans_are_removed(spark, tmp_path):
    import time

    from varve.session import Scratch

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    scratch = Scratch(spark, "settle")
    for i in range(6):
        scratch.save(spark.range(10_000).groupBy((F.col("id") % (977 + i)).alias("k")).count(), "sums")
    held = files()
    scratch.settle()
    for _ in range(100):
        if files() < held:
            break
        time.sleep(0.1)
    assert files() < held and spark.read.parquet(scratch.last["sums"]).count() == 982


def test_no_variable_genes_give_no_components(spark, monkeypatch):
    from varve.operators import pipeline

    cells = spark.createDataFrame([(i,) for i in range(6)], "cell_id bigint")
    norm = spark.createDataFrame([(i, g, 1.0 + i * (g == 2)) for i in range(6) for g in (1, 2)], "cell_id bigint, gene_id int, norm double")
    for genes in ([], [(1,)], [(2,)]):  # none, one that doesn't vary, only one
        chosen = spark.createDataFrame(genes, "gene_id int")
        features, loadings, test, count = pipeline.components(norm, cells, chosen, max_pcs=5, reps=2)
        assert features.count() == 6 and test.dtypes == [("pc", "int"), ("var_share", "double"), ("p", "double")]
        assert loadings.columns == ["gene_id", "pc", "loading"] and (loadings.count(), test.count(), count) == (0, 0, 0)
        with pytest.raises(ValueError, match="varying features"):
            pipeline.cluster_cells(norm, cells, chosen, ratios=(0.3,), n_pcs=2, shuffles=1, max_pcs=5, reps=2)
    monkeypatch.setattr(retail, "_variable", lambda spark, d: (norm, cells, chosen.limit(0)))
    assert retail.variable_components(spark, "").count() == 0 and retail.variable_clusters(spark, "").count() == 0


def test_cell_cycle_scores(spark):
    rng = np.random.default_rng(15)
    x = rng.gamma(1.0, 1.0, (20, 140)) * (rng.random((20, 140)) < 0.6)  # no two genes tie
    norm = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(140) if x[i, j]], "cell_id bigint, gene_id int, norm double")
    cells = spark.createDataFrame([(i,) for i in range(20)], "cell_id bigint")
    genes = spark.createDataFrame([(j, f"Gene{j}") for j in range(140)], "gene_id int, symbol string")
    listed = spark.createDataFrame([(j + 1, f"GENE{j}") for j in range(99)] + [(5, "unknown")], "at int, symbol string")
    f = np.stack([x.mean(0), x.var(0, ddof=1)], 1)
    f = (f - f.mean(0)) / f.std(0, ddof=1)

    def score(own):
        back = set()
        for g in own:
            d = ((f - f[g]) ** 2).sum(1)
            d[g] = np.inf
            back |= set(np.lexsort((np.arange(140), d))[:3].tolist())
        return x[:, own].mean(1) - x[:, sorted(back - set(own))].mean(1)

    got = expression.cell_cycle_scores(norm, cells, genes, listed, 3).orderBy("cell_id").toPandas()
    for column, own in (("s_stage", range(43)), ("g2m_stage", range(43, 98)), ("aggregate_s_g2m_stage", range(98))):
        assert np.allclose(got[column], score(list(own)))


def test_projects_are_found_named_and_filtered(spark, tmp_path):
    from varve import model
    from varve.operators import pipeline

    counts = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (3, 1, 2.0), (4, 1, 2.0), (4, 2, 1.0)], "cell_id bigint, gene_id int, count double")
    tables = {
        "counts": counts, "cells": spark.createDataFrame([(i,) for i in range(1, 5)], "cell_id bigint"), "genes": spark.createDataFrame([(1, True), (2, True), (3, False)], "gene_id int, keep boolean"),
        "member": spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "cell_id bigint, cluster int"), "hvg": spark.createDataFrame([(1,)], "gene_id int"), "tests": counts,
    }
    project = model.Project.create(spark, ["a"], str(tmp_path)).having(**tables)
    model.save_project(project)
    assert model.saved_projects(spark, str(tmp_path)) == {"a": sorted(tables)} and model.saved_projects(spark, str(tmp_path / "none")) == {}
    assert set(model.load_project(spark, str(tmp_path), "a").tables) == set(tables)
    named = model.save_names(project, spark.createDataFrame([(1, "T"), (2, "B")], "cluster int, name string"))
    assert {r.name for r in model.load_names(project)["cluster_names"].collect()} == {r.name for r in named["cluster_names"].collect()} == {"T", "B"}
    assert {r.name for r in model.remove_names(named)["cluster_names"].collect()} == {"1", "2", "3"}
    left = pipeline.filter_project(project, spark.createDataFrame([(1,), (2,)], "cluster int"))
    assert left["cells"].count() == 3 and left["counts"].count() == 3 and "hvg" not in left.tables and "tests" not in left.tables
    assert {r.gene_id: r.keep for r in left["genes"].collect()} == {1: True, 2: False, 3: False}


def test_complete_linkage_is_that_of_one_merge_at_a_time(spark):
    rng = np.random.default_rng(16)
    d = np.round(rng.random((14, 14)), 4)
    d = (d + d.T) / 2
    pairs = spark.createDataFrame([(f"c{i:02d}", f"c{j:02d}", float(d[i, j])) for i in range(14) for j in range(i + 1, 14)], "cluster1 string, cluster2 string, distance double")
    groups = [{i} for i in range(14)]
    while len(groups) > 5:
        _, a, b = min((max(d[i, j] for i in g for j in h), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y)
        groups[a] |= groups.pop(b)
    got = {r.cluster: r.branch for r in similarity.complete_linkage(pairs, 5, F.col("distance")).collect()}
    assert got == {f"c{i:02d}": f"c{min(g):02d}" for g in groups for i in g}
