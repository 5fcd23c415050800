"""Operators against numpy, by hand, and by their invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.functions import kernels
from netweave.operators import centrality, expression, hierarchy, matrix, modules, networks, plotdata, spectral
from netweave.sources import groups


def edges_of(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(w)) for i, j, w in cells], "src long, dst long, weight double")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def symmetric(n, seed):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)), 1)
    return a + a.T


def cells(a):
    return [(i, j, a[i, j]) for i in range(len(a)) for j in range(len(a)) if a[i, j]]


def test_edge_matrices_and_membership(spark, tmp_path):
    (tmp_path / "pw_mtx_G-1.csv").write_text(",entrez_a,entrez_b,entrez_c\nentrez_a,,1.0,\nentrez_b,,,2.0\nentrez_c,,,\n")
    (tmp_path / "pw_mtx_G-2.csv").write_text(',"x/1",y\n"x/1",1,0\ny,,\n')
    members, edges = groups.read_groups(spark, str(tmp_path))
    assert sorted(map(tuple, members.collect())) == [("G-1", "a", 0), ("G-1", "b", 1), ("G-1", "c", 2), ("G-2", "x/1", 0), ("G-2", "y", 1)]
    assert sorted(map(tuple, edges.collect())) == [("G-1", "a", "b", 1.0), ("G-1", "b", "c", 2.0), ("G-2", "x/1", "x/1", 1.0)]
    assert [r[0] for r in groups.group_names(members).collect()] == ["G-1", "G-2"]
    (tmp_path / "one.txt").write_text("name,f1,f2\np,1,\nq,0,3\n")
    alone, none = groups.read_groups(spark, str(tmp_path / "one.txt"))
    assert sorted(map(tuple, alone.collect())) == [("p", "f1"), ("q", "f2")] and none is None
    with pytest.raises(ValueError):
        groups.read_groups(spark, str(tmp_path / "absent"))


def test_coded_network_mirrors_and_removes(spark):
    coded = spark.createDataFrame([("p", "a", "b", 1.0), ("p", "b", "c", 2.0), ("p", "c", "b", 1.0), ("p", "d", "d", 1.0)], "pathway string, src string, dst string, code double")
    both = {(r.src, r.dst) for r in networks.coded_network(coded).collect()}
    assert both == {("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")}
    assert {(r.src, r.dst) for r in networks.coded_network(coded, directed=False).collect()} == {("b", "c"), ("c", "b"), ("d", "d")}


def test_golden_degree_and_rank(spark):
    # a chain of three whose middle edge goes both ways, and a leaky graph: two nodes feed a third that feeds nothing
    members = spark.createDataFrame([("p", x) for x in "abc"], "pathway string, feature string")
    coded = spark.createDataFrame([("p", "a", "b", 2.0), ("p", "a", "c", 2.0)], "pathway string, src string, dst string, code double")
    features = members.select("feature")
    fitted = expression.CentralityExpression(members, features, edges=coded).fit()
    assert {r.feature: round(r.weight, 6) for r in fitted.weights.collect()} == {"a": 0.5, "b": 0.25, "c": 0.25}
    ranked = expression.CentralityExpression(members, features, "page_rank", edges=coded).fit()
    assert {r.feature: round(r.weight, 6) for r in ranked.weights.collect()} == {"a": 0.486486, "b": 0.256757, "c": 0.256757}


@pytest.mark.parametrize("in_rank", [False, True])
def test_page_rank_is_the_eigenvector(spark, in_rank):
    rng = np.random.default_rng(3)
    a = (rng.random((9, 9)) < 0.25) * rng.random((9, 9))
    a[7] = a[:, 7] = 0
    own = a if in_rank else a.T
    live = np.flatnonzero(own.sum(axis=0) != 0)
    m = own[np.ix_(live, live)]
    total = m.sum(axis=0)
    g = 0.85 * np.divide(m, total, out=np.zeros_like(m), where=total != 0) + 0.15 / len(live)
    values, vectors = np.linalg.eig(g)
    v = vectors[:, np.abs(values - 1).argmin()].real
    want = np.zeros(9)
    want[live] = v / v.sum()
    got = {r.node: r.score for r in centrality.page_rank(edges_of(spark, cells(a)), nodes_of(spark, 9), in_rank, tolerance=1e-8).collect()}
    assert np.allclose([got[k] for k in range(9)], want, atol=1e-6)
    assert np.allclose(kernels.page_rank(a, in_rank), want, atol=1e-8)


def test_leading_vector_components_and_single_node(spark):
    a = symmetric(7, 1)
    got = centrality.leading_eigenvector(edges_of(spark, cells(a)), nodes_of(spark, 7)).orderBy("node").collect()
    assert np.allclose([r.score for r in got], np.abs(np.linalg.eigh(a)[1][:, -1]), atol=1e-6)
    parts = centrality.connected_components(edges_of(spark, [(0, 1, 1), (2, 1, 1), (4, 5, 1), (5, 5, 1)]), nodes_of(spark, 7)).collect()
    assert {r.node: r.component for r in parts} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    chain = centrality.connected_components(edges_of(spark, [(i, i + 1, 1) for i in range(40)]), nodes_of(spark, 41))
    assert chain.select("component").distinct().count() == 1
    assert centrality.degree(edges_of(spark, [(0, 0, 5)]), nodes_of(spark, 1)).collect()[0].score == 0


def test_column_products_both_ways(spark):
    rows = [(s, f, float((s * 7 + f * 3) % 5)) for s in range(20) for f in range(6) if (s + f) % 4]
    m = spark.createDataFrame(rows, "subject long, feature long, value double")
    dense = {(r.f1, r.f2): r.dot for r in matrix.column_products(m).where("dot <> 0").collect()}
    joined = {(r.f1, r.f2): r.dot for r in matrix.column_products(m, dense_features=2).where("dot <> 0").collect()}
    assert dense == joined


def test_options_that_do_not_exist(spark):
    m = spark.createDataFrame([(0, 0, 1.0)], "subject long, feature long, value double")
    for call in (lambda: networks.adjacency(m, "parcor"), lambda: spectral.cluster_laplace(m, m, stop="loo_svm"), lambda: hierarchy.cluster_linkage(m, distance="norm_cut"), lambda: kernels.linkage(np.zeros((2, 2)), "dynamic")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        matrix.validate(spark.createDataFrame([(0, 0, float("nan"))], "subject long, feature long, value double"))
    with pytest.raises(KeyError):
        matrix.with_metadata(m, m.where("subject < 0").select("subject"))
    with pytest.raises(ValueError):
        expression.rank_groups(m, m, m, [99])


def test_fisher_needs_four_subjects(spark):
    m = spark.createDataFrame([(s, f, float(s + f), s % 2) for s in range(6) for f in range(3)], "subject long, feature long, value double, label int")
    assert all(r.weight is None for r in networks.fisher_difference(m).collect())


def test_seeded_draw():
    assert [x for _, x in expression.null_sets(list("abcdefghij"), 4, 1)] == ["c", "i", "e", "j"]


@pytest.mark.parametrize("method", sorted(kernels.UPDATES))
def test_linkage_heights(method):
    points = np.random.default_rng(5).random((12, 3))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    z = kernels.linkage(d, method)
    assert len(z) == 11 and z[-1, 3] == 12 and sorted(kernels.leaf_order(z)) == list(range(12))
    clusters = {i: [i] for i in range(12)}
    for k, (left, right, height, size) in enumerate(z):
        a, b = clusters.pop(int(left)), clusters.pop(int(right))
        assert len(a) + len(b) == size
        across = d[np.ix_(a, b)]
        if method in ("single", "complete", "average"):
            assert math.isclose(height, {"single": across.min, "complete": across.max, "average": across.mean}[method]())
        if method == "centroid":
            assert math.isclose(height, np.linalg.norm(points[a].mean(axis=0) - points[b].mean(axis=0)))
        clusters[12 + k] = a + b
    for n in (1, 3, 12):
        assert len(set(kernels.cut(z, n_clusters=n))) == n


def test_support_vector_is_optimal():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), np.where(rng.random(40) < 0.5, -1.0, 1.0)
    w = kernels.support_vector(x, y)
    a = np.hstack([x, np.ones((40, 1))])
    loss = lambda w: 0.5 * w @ w + (np.maximum(1 - y * (a @ w), 0) ** 2).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=6) * 1e-3) for _ in range(50))
    assert kernels.balanced_rate(np.array([0, 0, 1]), np.array([0, 1, 1])) == 0.75


def test_partition_and_hierarchy(spark):
    a = np.zeros((8, 8))
    for block in (range(4), range(4, 8)):
        for i in block:
            for j in block:
                a[i, j] = (i != j) * (1 + 0.01 * (i + j))
    a[0, 7] = a[7, 0] = 0.05
    e, n = edges_of(spark, cells(a)), nodes_of(spark, 8)
    sides = {r.node: r.side for r in spectral.laplace_partition(e, n).collect()}
    assert {frozenset(k for k in sides if sides[k] == s) for s in "AB"} == {frozenset(range(4)), frozenset(range(4, 8))}
    full = spectral.cluster_laplace(e, n).collect()
    assert len({r.path for r in full}) == 15 and sorted(r.node for r in full if r.is_leaf) == list(range(8))
    clusters = spark.createDataFrame([(r.path, r.node) for r in full], "path string, node long")
    z = hierarchy.cluster_linkage(clusters, e, "avg_cut").orderBy("step").collect()
    assert [r.step for r in z] == list(range(7)) and z[-1].size == 8
    members = {}
    for r in full:
        members.setdefault(r.path, []).append(r.node)
    left, right = members["A"], members["B"]
    far = sum(math.sqrt(2 * (1 - a[i, j])) for i in left for j in right)
    assert math.isclose(z[-1].height, far / len(left) + far / len(right))
    assert [r.height for r in hierarchy.cluster_linkage(clusters).orderBy("step").collect()] == [float(r.size) for r in z]
    with pytest.raises(ValueError):
        hierarchy.cluster_linkage(clusters.where("path <> ''"))
    w = [r.eigenvalue for r in spectral.spectrum(e, n).orderBy("rank").collect()]
    assert np.allclose(w, np.linalg.eigvalsh(np.diag(a.sum(axis=0)) - a), atol=1e-9)


def test_eigengenes_and_components(spark):
    x = np.random.default_rng(2).normal(size=(15, 5))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(15) for j in range(5)], "subject long, feature long, value double")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1)], "feature long, cluster int")
    got = hierarchy.eigengenes(m, clusters).orderBy("cluster", "subject").collect()
    u = np.linalg.svd(x[:, :3])[0][:, 0]
    own = np.array([r.value for r in got if r.cluster == 0])
    assert np.allclose(np.abs(own), np.abs(u), atol=1e-9)
    assert np.allclose(np.abs([r.value for r in got if r.cluster == 1]), np.abs(x[:, 3] / np.linalg.norm(x[:, 3])))
    scores, ratios = plotdata.principal_components(m)
    centred = x - x.mean(axis=0)
    s = np.linalg.svd(centred)[1] ** 2
    assert np.allclose([r.ratio for r in ratios.orderBy("component").collect()], (s / s.sum())[:2])


def test_modules_find_the_telling_features(spark):
    rng = random.Random(1)
    rows = [(s, f, rng.gauss(0, 1) + (2.5 * (s % 2) if f < 3 else 0), s % 2) for s in range(30) for f in range(8)]
    m = spark.createDataFrame(rows, "subject long, feature long, value double, label int")
    e = spectral.stored(networks.correlation(matrix.standard_scale(m)))
    leaves, tree = modules.find_modules(m, e, loo=True)
    parts = [r.node for r in leaves.collect()]
    assert parts and len(parts) == len(set(parts))
    told = {r.path: r for r in tree.collect()}
    assert all(0 <= r.bsr <= 1 for r in told.values()) and told[""].size == 8
    assert modules.report(tree, m).count() == sum(r.is_leaf for r in told.values())


@pytest.mark.parametrize("loo", [False, True])
def test_machines_by_sums_equal_those_of_one_task(spark, loo):
    rng = random.Random(3)
    rows = [(s, f, rng.gauss(0, 1) + (0.8 * (s % 2) if f < 2 else 0), s % 2) for s in range(60) for f in range(6)]
    rows += [(s, f, float(s), int(s == 101)) for s in range(100, 104) for f in range(6, 8)]  # one subject of a class
    rows += [(200, 8, 1.0, 1), (201, 9, 1.0, 1), (202, 9, 2.0, 1)]  # a subject alone, and one class alone
    m = spark.createDataFrame(rows, "subject long, feature long, value double, label int").repartition(5)
    paths = ["A"] * 3 + ["B"] * 3 + ["C"] * 2 + ["D", "E"]
    members = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, node long")
    told = [sorted(map(tuple, modules.predictions(m, members, loo, dense_cells=n).select("path", "subject", "label", "predicted").collect())) for n in (10**6, 1)]
    assert told[0] == told[1] and len(told[0]) == 2 * 60 + 4 + 1 + 2


def test_layouts_cuts_and_centres(spark):
    a = symmetric(9, 5)
    e, n = edges_of(spark, cells(a)), nodes_of(spark, 9)
    labels = spark.createDataFrame([(k, f"n{k}") for k in range(8)], "node long, label string")
    for layout in plotdata.LAYOUTS:
        got = plotdata.display_layout(e, n, layout, labels).orderBy("node").collect()
        assert [r.label for r in got] == [f"n{k}" for k in range(8)] + ["8"] and max(r.size for r in got) == 1.0
        assert all(abs(r.x) <= 1.001 and abs(r.y) <= 1.001 for r in got) and len({(r.x, r.y) for r in got}) == 9
    pair = edges_of(spark, cells(np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))))
    at = np.array([(r.x, r.y) for r in plotdata.display_layout(pair, nodes_of(spark, 8), "spring").orderBy("node").collect()])
    far = np.linalg.norm(at[:, None] - at[None], axis=2)
    assert far[:4, 4:].min() > far[:4, :4].max()
    with pytest.raises(ValueError):
        plotdata.display_layout(e, n, "random")
    z = hierarchy.linkage(e, n)
    many = hierarchy.cut_trees(z, [2, 4], [0.5])
    for cut, how in ((2.0, {"n_clusters": 2}), (4.0, {"n_clusters": 4}), (0.5, {"height": 0.5})):
        assert sorted((r.item, r.cluster) for r in many.where(F.col("cut") == cut).collect()) == sorted(map(tuple, hierarchy.cut_tree(z, **how).collect()))
    clusters = nodes_of(spark, 9).select("node", (F.col("node") % 2).alias("cluster"))
    for name, kernel in (("page_rank", kernels.page_rank), ("large_evec", kernels.leading_vector)):
        got = {r.cluster: r.node for r in centrality.cluster_centers(e, clusters, name)[0].collect()}
        assert got == {k: k + 2 * int(np.argmax(kernel(a[k::2, k::2]))) for k in (0, 1)}
    lopsided = edges_of(spark, [(0, 1, 1.0)])
    with pytest.raises(Exception, match="symmetric"):
        spectral.laplace_partition(lopsided, nodes_of(spark, 2)).collect()


def test_layered_scores(spark):
    layers = spark.createDataFrame([(t, s, f, float((t + 2 * s + 3 * f * s) % 5)) for t in range(3) for s in range(6) for f in range(4)], "t int, subject int, feature int, value double")
    nodes = layers.select("t", F.col("feature").alias("node")).distinct()
    supra = spectral.stored(networks.supra_adjacency(layers, "correlation"))
    a = np.zeros((12, 12))
    for r in supra.collect():
        a[r.src_t * 4 + r.src, r.dst_t * 4 + r.dst] = r.weight
    for name, kernel in (("page_rank", kernels.page_rank), ("large_evec", kernels.leading_vector)):
        got = [r.score for r in centrality.supra_scores(supra, nodes, name).orderBy("node").collect()]
        assert np.allclose(got, np.abs(kernel(a)).reshape(3, 4).sum(axis=0), atol=1e-6), name
    with pytest.raises(ValueError):
        centrality.supra_scores(supra, nodes, "closeness")


def test_pipeline_of_stages(spark):
    from pyspark.ml import Pipeline

    from netweave.operators import stages

    m = spark.createDataFrame([(s, f, float(s * f % 5)) for s in range(6) for f in range(4)], "subject long, feature long, value double")
    members = spark.createDataFrame([("p", 0), ("p", 1), ("q", 2), ("q", 3)], "pathway string, feature long")
    settings = expression.LinearExpression(members, m.select("feature").distinct())
    piped = Pipeline(stages=[stages.scaling(), stages.ExpressionEstimator(settings)]).fit(m).transform(m)
    plain = settings.fit().transform(matrix.standard_scale(m))
    assert sorted(map(tuple, piped.collect())) == sorted(map(tuple, plain.collect()))


def test_machines_left_out_in_blocks(spark):
    from netweave.operators import machines

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), np.arange(40) % 2
    packed = spark.createDataFrame([("", i, int(y[i]), x[i].tolist()) for i in range(40)], "path string, subject long, label int, values array<double>")
    got = {r.subject: r.predicted for r in machines.judged(packed, loo=True, together=7).collect()}
    assert got == {i: int(kernels.predict(np.delete(x, i, 0), np.delete(y, i), x[i : i + 1])[0]) for i in range(40)}
    whole = machines.Machine("", np.zeros(4))
    machines.fit(packed, [whole])
    assert np.allclose(whole.weights, kernels.support_vector(x, np.where(y == 1, 1.0, -1.0)), atol=1e-8)
    with pytest.raises(ValueError):
        modules.rates(packed, "f1")


def test_order_of_rows_does_not_matter(spark):
    rows = [(s, f, float((s * f + s) % 7)) for s in range(12) for f in range(5)]
    one, two = (spark.createDataFrame(random.Random(k).sample(rows, len(rows)), "subject long, feature long, value double").repartition(k + 1) for k in (1, 2))
    first, second = (sorted((r.src, r.dst, round(r.weight, 9)) for r in networks.topological_overlap(networks.correlation(m)).collect()) for m in (one, two))
    assert first == second and all(0 <= w <= 1 for *_, w in first)


def test_stream_of_layers_equals_batch(spark, sf_dir, tmp_path):
    from netweave.streaming.layers import numbered, windowed_layers

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "events"))
    stream = windowed_layers(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts", "user_id", "event_type", "value")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("layers").start()
    run.processAllAvailable()
    run.stop()
    batch = windowed_layers(events, "ts", "user_id", "event_type", "value")
    key = lambda r: (str(r.start), r.subject, r.feature, round(r.value, 6))
    assert sorted(map(key, spark.table("layers").collect())) == sorted(map(key, batch.collect()))
    assert numbered(batch).agg(F.min("t")).first()[0] == 0


def test_matrix_and_metadata_files(spark, tmp_path):
    from netweave.sources.groups import read_matrix, read_metadata

    (tmp_path / "m.csv").write_text("SampleID,a_at,b/x,c\ns1,1.5,,3\ns2,0,2,-1e3\n")
    (tmp_path / "meta.csv").write_text(",class\ns1,control\ns2,late\n")
    cells = sorted(map(tuple, read_matrix(spark, f"{tmp_path}/m.csv").collect()))
    assert cells == [("s1", "a_at", 1.5), ("s1", "c", 3.0), ("s2", "a_at", 0.0), ("s2", "b/x", 2.0), ("s2", "c", -1000.0)]
    assert sorted(map(tuple, read_metadata(spark, f"{tmp_path}/meta.csv", "class").collect())) == [("s1", 0), ("s2", 1)]
    with pytest.raises(KeyError):
        read_metadata(spark, f"{tmp_path}/meta.csv", "other")
