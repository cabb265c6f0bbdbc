"""Neighbours and kernel sums in blocks of a metric space against brute force."""

import numpy as np
import pytest

from cairn.operators import knn, metric


def frame(spark, rows, params):
    data = [(i, [float(x) for x in row], *map(float, p)) for i, (row, p) in enumerate(zip(rows, params, strict=True))]
    return spark.createDataFrame(data, "id long, vec array<double>, " + ", ".join(f"p{c} double" for c in range(len(params[0])))).repartition(3)


def brute(rows, params, k, name, limits):
    d = np.round(knn.distances(rows, rows, knn.resolved(name)), 12)
    np.fill_diagonal(d, 0)
    found = set()
    for i in range(len(rows)):
        near = [j for j in range(len(rows)) if all(abs(params[i][c] - params[j][c]) <= x for c, x in enumerate(limits))]
        found |= {(i, j, r) for r, j in enumerate(sorted(near, key=lambda j: (i != j, d[i, j], j))[:k], start=1)}
    return found


@pytest.mark.parametrize("name", ["angular", "euclidean", "manhattan"])
@pytest.mark.parametrize("limits", [(), (0.4,), (0.0,), (2.0, 0.3), (1e9,)])
def test_limits_are_tested_before_the_nearest_are_taken(spark, name, limits):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 6)) * 4
    rows = np.concatenate([centres[rng.integers(0, 4, 150)] + rng.normal(size=(150, 6)) * 0.3, np.zeros((2, 6)), np.ones((25, 6))])
    params = np.stack([np.round(rng.normal(size=len(rows)), 1), rng.random(len(rows))], axis=1)
    got = metric.nearest_in_metric(frame(spark, rows, params), 5, name, {f"p{c}": x for c, x in enumerate(limits)}, block_rows=16, pivots=5)
    assert {(r.i, r.j, r.rank) for r in got.collect()} == brute(rows, params, 5, name, limits)


def test_points_without_a_parameter_have_no_neighbours(spark):
    rows = [(1, [0.0, 1.0], 1.0), (2, [0.0, 2.0], None), (3, [0.0, 3.0], float("nan")), (4, [1.0, 1.0], 1.5), (5, [float("nan"), 1.0], 9.0)]
    got = metric.nearest_in_metric(spark.createDataFrame(rows, "id long, vec array<double>, p double"), 3, "euclidean", {"p": 1})
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 1), (1, 4), (4, 1), (4, 4), (5, 5)]
    none = spark.createDataFrame([], "id long, vec array<double>, p double")
    assert metric.nearest_in_metric(none, 3).count() == 0 and metric.kernel_sums_in_metric(none, "vmf", 1.0).count() == 0


def test_far_blocks_are_not_met(spark):
    """Two far groups: no block of one asks for one of the other."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) + 1000])
    held = metric._at_home(metric.blocks(frame(spark, rows, [(0.0,)] * 400).select("id", "vec"), "euclidean", rows=20), 3, "euclidean", [])
    b = held.collect()
    far, reach = (np.concatenate([np.frombuffer(r[c]) for r in b]) for c in ("far", "reach"))
    lower = metric._lower(far.reshape(400, -1), np.array([r.low for r in b]), np.array([r.high for r in b]))
    assert len(b) >= 20 and (lower <= reach[:, None]).mean() < 0.55  # half the blocks, and those that hold points of both groups
    got = {(r.i, r.j) for r in metric.nearest_in_metric(frame(spark, rows, [(0.0,)] * 400), 3, "euclidean", block_rows=20).collect()}
    assert all((i < 200) == (j < 200) for i, j in got)


@pytest.mark.parametrize("kernel,param", [("gaussian", 0.7), ("vmf", 4.0)])
def test_kernel_sums_stay_within_their_tolerance(spark, kernel, param):
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(3, 4))[rng.integers(0, 3, 120)] * 6 + rng.normal(size=(120, 4)) * 0.4, rng.normal(size=(80, 4))])
    pts = frame(spark, rows, [(0.0,)] * 200).select("id", "vec")
    d = knn.distances(rows, rows, "euclidean" if kernel == "gaussian" else "angular")
    want = np.exp(-d * d / (2 * param * param)).sum(1) if kernel == "gaussian" else np.exp(param * np.cos(d)).sum(1)
    for tolerance in (0.0, 1e-6, 1e-2):
        got = {r.id: r.density for r in metric.kernel_sums_in_metric(pts, kernel, param, tolerance, block_rows=15, pivots=6).collect()}
        assert len(got) == 200 and max(abs(got[i] - want[i]) for i in range(200)) <= 200 * tolerance + 1e-6


@pytest.mark.parametrize("merge", [False, True])
def test_all_k_at_once_equal_each_k_alone(spark, merge):
    from cairn.operators import density

    rng = np.random.default_rng(11)
    rows = np.concatenate([rng.normal(size=(3, 4))[rng.integers(0, 3, 90)] * 5 + rng.normal(size=(90, 4)), np.ones((4, 4))])
    pts, ks = frame(spark, rows, [(0.0,)] * 94).select("id", "vec"), [2, 5, 9, 20]
    every = {}
    for r in density.clusters_of_all(pts, ks, 8, "euclidean", merge).collect():
        every.setdefault(r.k, {})[r.id] = r.cluster
    for k in ks:
        assert every[k] == {r.id: r.cluster for r in density.clusters(pts, k, 8, "euclidean", merge).collect()}
    assert {r.k: r.n_clusters for r in density.k_sweep(pts, ks, 8, "euclidean", merge).collect()} == {k: len(set(c.values())) for k, c in every.items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vectors_are_shuffled_for_neighbours_and_kernels(spark):
    """Where every block meets every block, a shuffle of pairs of blocks was the square of the points on disk."""
    rows = np.random.default_rng(3).normal(size=(90, 8))
    pts = frame(spark, rows, [(0.0,)] * 90).select("id", "vec")
    for df in (metric.nearest_in_metric(pts, 4, block_rows=10), metric.kernel_sums_in_metric(pts, "gaussian", 1.0, block_rows=10), knn.nearest(pts, pts, 4, block_rows=10)):
        plan = plan_of(df)
        assert "CartesianProduct" in plan and "SortMergeJoin [a#" not in plan and "BroadcastHashJoin [a#" not in plan
    got = {(r.i, r.j, r.rank) for r in knn.nearest(pts, pts, 4, block_rows=10).collect()}
    assert got == brute(rows, [()] * 90, 4, "angular", ())


def test_components_read_their_edges_once(spark):
    from cairn.operators import graphs

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b").mapInArrow(run, "a long, b long")
    assert graphs.subgraph(chain, 3).count() == 61 and made.value == 60


def test_thin_paths_are_probed_once(spark, monkeypatch):
    from cairn.operators import density

    asked, plain = [], density.nearest
    monkeypatch.setattr(density, "nearest", lambda queries, *more: asked.append(queries.count()) or plain(queries, *more))
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(20, 3)) * 0.1 + at for at in (0, 50, 100)])
    pts = frame(spark, rows, [(0.0,)] * 60).select("id", "vec")
    links = spark.createDataFrame([(0, -1.0, None), (20, -0.9, None), (40, -0.8, None)], "id long, density double, parent long")
    assert {r.id: r.parent for r in density.merged_roots(pts, links, 5, "euclidean").collect()} == {0: None, 20: None, 40: None}
    assert asked == [2, 0]
