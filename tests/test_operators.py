"""Operators against plain Python and by their properties."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import special
from cairn.functions import vectors as V
from cairn.operators import density, graphs, hierarchy, joins, knn, statistics, synthetic
from cairn.operators import metric as metric_search
from cairn.operators import transforms as T
from cairn.operators import metric as metric_search
from cairn.sources import delimited, fcs
from cairn.sources.catalog import Catalog
from cairn.streaming.classify import classified


def points_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.length(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b")), V.manhattan(F.col("a"), F.col("b")), V.unit(F.col("a"))).collect()
    assert got[0][0] == 5 and got[0][1] == pytest.approx(0.96) and got[0][2] == pytest.approx(math.sqrt(2)) and got[0][3] == 2 and got[0][4] == [0.6, 0.8]
    assert got[1][1] == 0 and got[1][4] == [0.0, 0.0]
    odd = spark.createDataFrame([([float("nan"), None, 1.0],)], "a array<double>").select(V.cleaned(F.col("a"))).first()[0]
    assert odd == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        V.metric("none")


@pytest.mark.parametrize("metric", ["angular", "euclidean"])
def test_knn_blocks_and_cells_equal_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(60, 5)), np.zeros((1, 5)), np.ones((3, 5))])
    pts = points_of(spark, rows)
    d = np.round(knn.distances(rows, rows, metric), 12)
    np.fill_diagonal(d, 0)
    want = {(i, r + 1): j for i in range(len(rows)) for r, j in enumerate(sorted(range(len(rows)), key=lambda j: (i != j, d[i, j], j))[:7])}
    assert {(r.i, r.rank): r.j for r in knn.knn(pts, 7, metric, block_rows=10).collect()} == want
    for pivots, block_rows in ((6, 1000), (6, 9), (1, 20)):
        assert {(r.i, r.rank): r.j for r in metric_search.nearest_in_metric(pts, 7, metric, block_rows=block_rows, pivots=pivots).collect()} == want
    assert knn.knn(points_of(spark, rows[:3]), 7, metric).count() == 9


def test_density_clusters_find_two_groups(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal([8, 0, 0], 0.5, (60, 3)), rng.normal([0, 8, 0], 0.5, (60, 3))])
    found = {r.id: r.cluster for r in density.clusters(points_of(spark, rows), 20, 20, "euclidean").collect()}
    assert len({found[i] for i in range(60)}) == 1 and len({found[i] for i in range(60, 120)}) == 1 and found[0] != found[60]


def test_links_have_no_cycles_with_equal_densities(spark):
    links = density.roots_of(density.parents(knn.knn(points_of(spark, np.ones((9, 3))), 5), density.densities(knn.knn(points_of(spark, np.ones((9, 3))), 5), 3), 5))
    assert {r.root for r in links.collect()} == {0}


def test_ranges_sweeps_and_elbow():
    assert density.default_range(64, 500) == {"k_max": 103, "k_min": 3, "reach": 32}
    assert density.sweep(10, 2, 5) == [10, 8, 6, 4, 2]
    counts = {k: int(200 * math.exp(-k / 4)) + 20 - k // 10 for k in range(2, 60, 3)}
    assert 5 <= density.elbow(counts) <= 30 and density.elbow({3: 1, 4: 1}) == 4


def test_mahalanobis_merge_blocks_singletons():
    stats = [{"cluster": c, "n": n, "sums": [m * n], "squares": [(m * m + 1) * n]} for c, n, m in ((1, 50, 0.0), (2, 50, 1.0), (3, 50, 40.0), (4, 1, 0.5))]
    assert density.merge_by_mahalanobis(stats) == {1: 1, 2: 1, 3: 3, 4: 4}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-5, 5)] * 3), min_size=1, max_size=14), st.sampled_from(hierarchy.LINKAGES))
def test_linkage_properties(rows, method):
    x = np.array(rows, float)
    merges = hierarchy.linkage(x, method, "euclidean")
    assert len(merges) == len(rows) - 1
    heights = [m[2] for m in merges]
    assert heights == sorted(heights)  # no inversions for these linkages
    if merges:
        assert merges[-1][3] == len(rows)
    if method == "minimal" and merges:
        d = knn.distances(x, x, "euclidean")
        left, tree = {0}, []
        while len(left) < len(rows):
            w, j = min((d[i, j], j) for i in left for j in range(len(rows)) if j not in left)
            left.add(j)
            tree.append(w)
        assert np.allclose(sorted(tree), heights, atol=1e-6)
    for t in (0.5, 2.0, 100.0):
        groups = hierarchy.cut(merges, len(rows), t)
        assert len({i for g in groups for i in g}) == sum(map(len, groups))
        assert all(len(g) < len(rows) for g in groups)


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forests_equal_kruskal(spark, seed):
    """Ties, several components, loops and repeated edges."""
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), float(rng.integers(0, 4))) for a, b in rng.integers(0, 30, (45, 2))] + [(100, 101, -1.0), (101, 100, -1.0), (7, 7, 9.0)]
    parent, want = {}, set()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, w))
    assert {tuple(r) for r in graphs.spanning_tree(spark.createDataFrame(rows, "a long, b long, weight double")).collect()} == want
    assert graphs.spanning_tree(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_spanning_tree_and_components(spark):
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(a, b, float(rng.random())) for a in range(8) for b in range(a + 1, 8)], "a long, b long, weight double")
    tree = graphs.spanning_tree(edges)
    assert tree.count() == 7 and graphs.components(tree).select("component").distinct().count() == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.id: r.component for r in graphs.components(chain).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
    assert graphs.subgraph(chain, 101).count() == 2
    far = {r.id: r.dist for r in graphs.shortest_paths(chain.withColumn("weight", F.lit(1.0)), 0).collect()}
    assert far[40] == 40 and 100 not in far


def test_layout_is_repeatable():
    edges = [(0, 1, 1.0), (1, 2, 1.0)]
    assert graphs.force_layout([0, 1, 2], edges) == graphs.force_layout([0, 1, 2], edges)


def test_gml(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string"), spark.createDataFrame([(1, 2)], "a long, b long")
    graphs.write_gml(str(tmp_path / "g.gml"), nodes, edges)
    assert "edge [ source 1 target 2 weight 1.0 ]" in (tmp_path / "g.gml").read_text()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms())
def test_hungarian_is_optimal(n, m, rng):
    from itertools import permutations

    cost = np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)], float)
    got = sum(cost[i, j] for i, j in statistics.hungarian(cost))
    small = cost if n <= m else cost.T
    assert got == min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))


def test_special_functions():
    assert special.bessel_i(0, 1.0) == pytest.approx(1.2660658777520084)
    assert special.bessel_i(2.5, 3.0) == pytest.approx(1.5153, rel=0.1)
    assert special.chi_square_density(2, 1.0) == pytest.approx(0.5 * math.exp(-0.5))
    assert special.chi_density(1, 1.0) == pytest.approx(math.sqrt(2 / math.pi) * math.exp(-0.5))
    assert special.vmf_density(3, 2.0, 1.0) == pytest.approx(2 * math.exp(2) / (4 * math.pi * math.sinh(2)))
    assert special.hypergeometric_tail(10, 4, 5, 0) == pytest.approx(1) and special.hypergeometric_tail(10, 4, 5, 4) == pytest.approx(6 / 252)
    assert special.interpolate([(0, 0), (2, 4)], 1) == 2 and special.interpolate2([0, 1], [0, 1], [[0, 1], [2, 3]], 0.5, 0.5) == 1.5
    with pytest.raises(ValueError):
        special.interpolate([(0, 0), (1, 1)], 2)
    assert special.fit_vmf_kappa(3, 0.0) == 0 and special.fit_vmf_kappa(3, 0.9) > 5


def test_phi_against_erf(spark):
    from cairn.operators.aggregates import phi

    z = [-3.0, -0.5, 0.0, 1.0, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(phi(F.col("z"))).collect()]
    assert np.allclose(got, [special.normal_cdf(x) for x in z], atol=2e-7)


def test_delimited_rejects(spark, tmp_path):
    (tmp_path / "e.csv").write_text('name,"A:long a",B\n"r1",1,2\nr2\t3\t\t4\nr3,1\nr4,x,2\n')
    rows, rejects, long = delimited.read_events(spark, str(tmp_path / "e.csv"))
    assert {(r["name"], r["A"], r["B"]) for r in rows.collect()} == {("r1", 1.0, 2.0), ("r2", 3.0, 4.0)} and long == ["long a", "B"]
    assert {r.reason for r in rejects.collect()} == {"wrong number of columns", "not a number"}
    (tmp_path / "h.csv").write_text("1,2\n3,4\n")
    got = {r["name"]: r["x"] for r in delimited.read_headerless(spark, str(tmp_path / "h.csv"), ["x", "y"], "ds").collect()}
    assert got == {"ds.fcs Event 0000001": 1.0, "ds.fcs Event 0000002": 3.0}
    assert delimited.column_roles("# c\n0, 0, a\n1, 5, b\n") == {"a": 0, "b": 2}
    assert delimited.batch_config("k=auto\nfeatures=1,3\n") == {"k": "auto", "features": [1, 3]}
    both = delimited.merge_files([spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, Time double, b double"), spark.createDataFrame([(1.0, 2.0)], "b double, a double")], ["x", "y"])
    assert both.columns == ["file", "a", "b"] and both.count() == 2


def test_annotations(spark, tmp_path):
    pts = spark.createDataFrame([(1, "n1"), (2, "n2")], "id long, name string")
    (tmp_path / "a.txt").write_text("1,x,y\n2\tz\n3,q\nfoo,q\n4\n")
    known, rejects = delimited.read_annotations(spark, str(tmp_path / "a.txt"), pts)
    assert {(r.id, r.term) for r in known.collect()} == {(1, "x"), (1, "y"), (2, "z")}
    assert sorted(r.reason for r in rejects.collect()) == ["id is not a number", "too few fields", "unknown id"]
    named = spark.createDataFrame([("n1", "a;b"), ("n9", "c")], "name string, terms string")
    assert {(r.id, r.term) for r in delimited.annotations_by_name(named, pts).collect()} == {(1, "a"), (1, "b")}


def test_fcs_round_trip(spark, tmp_path):
    values = np.arange(12, dtype=float).reshape(4, 3) / 4
    assert np.array_equal(fcs.decode(fcs.encode(["A", "B/x", "C"], ["la", "lb", "lc"], values))[2], values)
    assert fcs.decode(fcs.encode(["A", "B/x", "C"], ["la", "lb", "lc"], values))[:2] == (["A", "B/x", "C"], ["la", "lb", "lc"])
    df = spark.createDataFrame([("p", 1.0, 2.0), ("p", 3.0, 4.0), ("q", 5.0, 6.0)], "part string, A double, B double")
    written = fcs.write_fcs(df, f"file://{tmp_path}/out", ["A", "B"], "part").collect()
    assert sorted(r.events for r in written) == [1, 2]
    back = fcs.read_fcs(spark, f"{tmp_path}/out/*.fcs")
    assert sorted((r.A, r.B) for r in back.collect()) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_catalog(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    pts = spark.createDataFrame([(1, "a", [1.0, float("nan")], None, "f1", 0), (0, "b", [2.0, 3.0], None, "f2", 0)], "id long, name string, vec array<double>, side array<double>, file string, idx long")
    one = store.save_dataset("one", pts, ["x", "y"])
    assert [tuple(r.vec) for r in store.points(one).collect()] == [(2.0, 3.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        store.save_dataset("one", pts, ["x", "y"])
    store.save_annotation(one, "ann", spark.createDataFrame([(1, "t")], "id long, term string"))
    assert {(r.annotation, r.term) for r in store.annotations(one).collect()} == {("ann", "t"), ("By file: one", "f1"), ("By file: one", "f2")}
    members = spark.createDataFrame([(1, 0), (1, 1)], "cluster long, id long")
    clusters = spark.createDataFrame([(1, 2, [1.5, 1.5])], "cluster long, size long, profile array<double>")
    made = store.save_clusters(one, members, clusters, "density", "angular", 20)
    assert store.members(made).count() == 2 and store.cluster_sets(one).first()["n_clusters"] == 1
    store.cache(one, "density", spark.createDataFrame([(1, [0.5])], "id long, payload array<double>"))
    store.cache(one, "density", spark.createDataFrame([(1, [0.7])], "id long, payload array<double>"))
    assert [r.payload for r in store.cached(one, "density").collect()] == [[0.7]]
    store.compact("points", one)
    store.delete_annotation(one, "ann")
    assert store.annotations(one).where("annotation = 'ann'").count() == 0
    store.delete_dataset(one)
    assert store.dataset_names().count() == 0 and store.members(made).count() == 0


def test_synthetic_groups_and_classifier(spark):
    pts = synthetic.two_normals(spark, 40, 6, 12.0).withColumn("component", F.col("side")[1].cast("long"))
    assert pts.count() == 80 and synthetic.trajectory(spark, 5, 3, 4).count() == 15 and synthetic.mixture(spark, 20, 4, 3).count() == 20
    assert synthetic.one_normal(spark, 10).count() == 10 and synthetic.one_marker(spark, 5).count() == 10
    models = joins.models(pts, "component", 6)
    found = joins.nearest_mahalanobis(pts.select("id", "vec"), models)
    assert found.join(pts, "id").where("centre = component").count() == 80
    assert joins.nearest_mahalanobis(pts.select("id", "vec"), models, most=0.0).where("centre IS NULL").count() == 80


def test_streamed_classification(spark, tmp_path):
    rows = synthetic.two_normals(spark, 10, 3, 12.0).select("id", "vec")
    rows.write.parquet(str(tmp_path / "in"))
    models = [(0, [12.0, 0.0, 0.0], [1.0] * 3), (1, [0.0, 12.0, 0.0], [1.0] * 3)]
    stream = classified(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), models)
    run = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    assert {(r.id, r.centre) for r in spark.table("seen").collect()} == {(r.id, r.id % 2) for r in rows.collect()}


def test_marker_tree_separates_marked_groups():
    profiles = np.array([[0.0, 1.0], [0.1, 1.0], [5.0, 1.0], [5.1, 1.0]])
    tree = hierarchy.marker_tree(profiles, ["m", "n"], np.ones(2), depth=1)
    assert sorted(hierarchy.leaves(tree)) == [("m+", [2, 3]), ("m-", [0, 1])]


def test_samples_and_terms(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    assert {r["n"] for r in T.stratified(df, "g", "id", 5).groupBy("g").agg(F.count("*").alias("n")).collect()} == {5}
    chosen, rest = T.subset_and_rest(df, "id", 30)
    assert chosen.count() == 30 and rest.count() == 70 and chosen.intersect(rest).count() == 0
    assert T.rescale(df.select(F.lit(1.0).alias("x")), ["x"]).first()["x"] == 1.0
    with pytest.raises(ValueError):
        T.transform(df, ["id"], "log")


def test_automatic_k_depends_on_the_cluster_counts(spark, tmp_path):
    from cairn.plans.neighbours import auto_clusters

    chosen = set()
    for groups, size in ((12, 10), (30, 8)):
        rng = np.random.default_rng(1)
        rows = np.concatenate([rng.normal(rng.normal(size=64) * 3, 0.3, (size, 64)) for _ in range(groups)])
        embeddings = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
        embeddings.write.parquet(f"{tmp_path}/{groups}/embeddings.parquet")
        chosen.add(auto_clusters(spark, f"{tmp_path}/{groups}").first()["k"])
    assert len(chosen) == 2  # both have the same range of K


def test_permutation_null_of_many_points(spark, tmp_path):
    from cairn.plans.groups import permutation_null

    embeddings = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    embeddings.write.parquet(f"{tmp_path}/embeddings.parquet")
    covered = [r.covered for r in permutation_null(spark, str(tmp_path)).collect()]
    assert len(covered) == 200 and len(set(covered)) > 10
    assert np.mean(covered) == pytest.approx(137_072 * (1 - (1 - 10_000 / 137_072) ** 2), rel=0.0005)


def test_shuffles_are_permutations_and_correlations_exact(spark):
    rng = np.random.default_rng(2)
    vectors = {i: np.where(rng.random(23) < 0.4, rng.normal(size=23).round(2), 0.0) for i in (-3, 4, 9)} | {11: np.full(23, 2.0)}
    entries = spark.createDataFrame([(i, p, float(x)) for i, v in vectors.items() for p, x in enumerate(v) if x], "id long, pos long, value double")
    moved, rounds = {}, 12
    for r in statistics.permuted(entries, 23, rounds).collect():
        moved.setdefault((r["round"], r["id"]), {})[r["pos"]] = r["value"]
    for n in range(rounds):
        for i, v in vectors.items():
            assert sorted(moved[n, i].values()) == sorted(x for x in v if x) and set(moved[n, i]) <= set(range(23))
    assert len({tuple(sorted(moved[n, 11])) for n in range(rounds)}) == 1 and len({tuple(sorted(moved[n, 4].items())) for n in range(rounds)}) > rounds // 2
    dense = {k: np.array([v.get(p, 0.0) for p in range(23)]) for k, v in moved.items()}
    got = {(r["round"], r["a"], r["b"]): r["correlation"] for r in statistics.permutation_correlations(entries, 23, rounds).collect()}
    assert len(got) == rounds * 6
    for (n, a, b), c in got.items():
        assert c is None if 11 in (a, b) else c == pytest.approx(np.corrcoef(dense[n, a], dense[n, b])[0, 1])
    covered = {r["round"]: r["covered"] for r in statistics.permutation_null(entries, 23, rounds).collect()}
    assert covered == {n: int((sum(dense[n, i] for i in vectors) > 0).sum()) for n in range(rounds)}
    with pytest.raises(Exception, match="outside"):
        statistics.permuted(entries, 22, 1).collect()


def test_concentration_fits(spark):
    rng = np.random.default_rng(4)
    dim, data = 5, []
    for g, kappa in ((0, 3.0), (1, 40.0)):
        while len([1 for x in data if x[2] == g]) < 800:  # by rejection from the cosine's density
            t = rng.uniform(-1, 1)
            if rng.random() < math.exp(kappa * (t - 1)) * (1 - t * t) / (1 if kappa < 5 else 0.1):
                rest = rng.normal(size=dim - 1)
                v = np.concatenate([[t], rest / np.linalg.norm(rest) * math.sqrt(1 - t * t)])
                data.append((len(data), [float(x) for x in v * rng.uniform(0.9, 1.1)], g))
    data += [(len(data) + i, [1.0, 0.0, 0.0, 0.0, 0.0], 2) for i in range(50)]
    data += [(len(data) + i, [1.0, 1.2 * (-1) ** i, 0.0, 0.0, 0.0], 3) for i in range(400)]  # all at one angle: no such distribution
    got = {r["label"]: r for r in statistics.concentrations(spark.createDataFrame(data, "id long, vec array<double>, label long"), "label", dim).collect()}
    assert abs(got[0]["kappa"] - 3) <= 1 and abs(got[1]["kappa"] - 40) <= 5 and got[2]["kappa"] == 499
    assert got[0]["p_value"] > 0.001 and got[1]["p_value"] > 0.001
    assert got[3]["p_value"] < 1e-6
    assert all(r["kappa"] == max(range(500), key=lambda k: special.log_vmf_constant(dim, k) + k * r["mean_cosine"]) for r in got.values())


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_hypergeometric_tails(monkeypatch, most):
    monkeypatch.setattr(statistics, "TERMS", most)
    rng = np.random.default_rng(5)
    n = rng.integers(1, 400, 60)
    m, d = rng.integers(0, n + 1), rng.integers(0, n + 1)
    h = rng.integers(0, np.minimum(m, d) + 2)
    got = statistics.tails(n, m, d, h)
    assert got == pytest.approx([special.hypergeometric_tail(*map(int, v)) for v in zip(n, m, d, h, strict=True)], abs=1e-9)
    assert len(statistics.tails(*(np.array([], dtype=np.int64) for _ in range(4)))) == 0


def test_scalar_functions_on_columns(spark):
    from cairn.functions.scalars import on_columns

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, None), (0.5, 4.0)], "a double, b double").repartition(1)
    assert sorted(map(str, (r[0] for r in df.select(on_columns(lambda a, b: a * 10 + b, "a", "b")).collect()))) == ["12.0", "12.0", "9.0", "None"]


def test_chi_square_tail():
    for df, x, p in ((1, 3.841458820694124, 0.05), (10, 18.307038053275146, 0.05), (19, 10.117013063859044, 0.95), (2, 2 * math.log(4), 0.25), (19, 43.820195964517531, 0.001)):
        assert special.chi_square_tail(df, x) == pytest.approx(p, rel=1e-9)
    assert special.chi_square_tail(5, 0) == 1 and special.chi_square_tail(3, 1e6) == 0


def test_angular_roots_count_by_direction(spark):
    """Vectors of unequal length at 0, 90, 45 and about 84 degrees: neighbours by angle are 0-2, 2-3 and 3-1."""
    pts = points_of(spark, [(1, 0), (0, 10), (5, 5), (0.3, 3)])
    assert {(r.a, r.b) for r in density.gabriel_edges(pts, "angular").collect()} == {(0, 2), (2, 3), (1, 3)}
    assert {(r.a, r.b) for r in density.gabriel_edges(pts, "euclidean").collect()} == {(0, 3), (1, 2), (1, 3), (2, 3)}
    links = spark.createDataFrame([(i, d, None) for i, d in enumerate((-4.0, -1.0, -3.0, -2.0))], "id long, density double, parent long")
    scaled = points_of(spark, [(7, 0), (0, 1), (0.2, 0.2), (0.1, 1)])
    same = [{r.id: r.parent for r in density.merged_roots(p, links, 1).collect()} for p in (pts, scaled)]
    assert same[0] == same[1] and same[0][1] is None


def test_nearest_centres_clean_vectors_alike(spark, monkeypatch):
    pts = points_of(spark, [(1, 0), (float("nan"), 2), (3, 3)])
    centres = spark.createDataFrame([(7, [1.0, float("nan")]), (8, [0.0, 1.0])], "centre long, profile array<double>")
    few = {(r.id, r.centre, round(r.dist, 9)) for r in joins.nearest_centre(pts, centres).collect()}
    monkeypatch.setattr(joins, "MOST_SENT_CENTRES", 1)
    assert {(r.id, r.centre, round(r.dist, 9)) for r in joins.nearest_centre(pts, centres).collect()} == few == {(0, 7, 0.0), (1, 8, 0.0), (2, 7, round(math.pi / 4, 9))}
    # centres of any type, also numbers that points have as ids, and ties to the least
    for kind, names in (("long", [1, 0, 2]), ("string", ["b", "a", "c"])):
        many = spark.createDataFrame(list(zip(names, [[0.0, 1.0], [1.0, 0.0], [0.0, 2.0]], strict=True)), f"centre {kind}, profile array<double>")
        assert {r.id: r.centre for r in joins.nearest_centre(pts, many).collect()} == {0: names[1], 1: names[0], 2: names[1]}


def test_registered_distances_reach_neighbours(spark):
    knn.register_metric("largest", lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).max(2))
    rows = np.random.default_rng(2).normal(size=(40, 3))
    got = {(r.i, r.rank): r.j for r in knn.knn(points_of(spark, rows), 4, "largest", block_rows=9).collect()}
    d = np.abs(rows[:, None, :] - rows[None, :, :]).max(2)
    assert got == {(i, r + 1): j for i in range(40) for r, j in enumerate(np.argsort(d[i])[:4].tolist())}


def test_start_layout_and_mean_shift(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(50, 4)) * [5, 2, 1, 1]
    got = np.array([(r.x, r.y) for r in sorted(graphs.start_layout(points_of(spark, rows), 4).collect(), key=lambda r: r.id)])
    centred = rows - rows.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    want = centred @ (axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]).T
    assert np.allclose(got, want * 5000 / np.abs(want).max())
    centre = np.full(4, 0.5)
    for _ in range(50):
        w = np.exp(-((rows - centre) ** 2).sum(1) / (2 * 9))
        moved = (rows * w[:, None]).sum(0) / w.sum()
        if np.linalg.norm(moved - centre) < 3e-3:
            break
        centre = moved
    assert np.allclose(density.mean_shift(points_of(spark, rows), [0.5] * 4, 3.0), moved)
    with pytest.raises(RuntimeError):
        density.mean_shift(points_of(spark, rows), [9.0] * 4, 3.0, rounds=1)


def test_batch(spark, tmp_path):
    from cairn.batch import run_batch
    from cairn.sources.delimited import batch_config

    rng = np.random.default_rng(7)
    for name in ("a", "b"):
        rows = np.concatenate([rng.normal([200, 5, 5], 4, (40, 3)), rng.normal([5, 5, 200], 4, (40, 3))])
        (tmp_path / f"{name}.fcs").write_bytes(fcs.encode(["A", "B", "C"], ["A", "B", "C"], rows))
    for extra in ("", "limit=60\n"):
        settings = batch_config(f"features=1,3\nk=10\n{extra}fcs=file://{tmp_path}/fcs{len(extra)}")
        done = run_batch(spark, settings, f"{tmp_path}/*.fcs", f"{tmp_path}/out{len(extra)}").collect()
        channel = {(name, i): c for name in "ab" for i, c in enumerate(fcs.decode((tmp_path / f"fcs{len(extra)}" / f"{name}.fcs").read_bytes())[2][:, 3])}
        ordinal = {c: n for n, (_, c) in enumerate(sorted((-k, c) for c, k in Counter(r.cluster for r in done).items()), start=1)}
        assert channel == {(r.file[-5], r.idx): ordinal[r.cluster] for r in done}
        sides = [{r.cluster for r in done if (r.idx < 40) == low} for low in (True, False)]
        assert len({(r.file, r.idx) for r in done}) == len(done) == 160 and sides[0] and sides[1] and not sides[0] & sides[1]
