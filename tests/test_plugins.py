"""Kernels, filters and scorers that users register."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import plugins, registry


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(9)
    rows = {g: rng.normal(size=(30, 3)) + 5 * g for g in range(3)}
    data = [(100 * g + i, g, [float(x) for x in v]) for g, own in rows.items() for i, v in enumerate(own)]
    members = spark.createDataFrame(data, "id long, g int, vec array<double>")
    centres = spark.createDataFrame([(g, own.mean(0).tolist()) for g, own in rows.items()], "g int, centre array<double>")
    return rows, members, centres


CONE = plugins.Kernel("cone", "manhattan", lambda d, p: np.maximum(0, 1 - d / p), lambda d, p: F.greatest(F.lit(0.0), 1 - d / p), F.avg, lambda m, dim: m * dim, lambda dim, p: -dim * np.log(p))


def test_a_registered_kernel_runs_everywhere(groups):
    rows, members, centres = groups
    plugins.register_kernel(CONE)
    every = np.concatenate(list(rows.values()))
    between = np.abs(every[:, None] - every[None]).sum(2)
    got = {(r.width, r.id): r.density for r in registry.kernel_grid("cone", members.select("id", "vec"), [2.0, 6.0]).collect()}
    for w in (2.0, 6.0):
        want = np.maximum(0, 1 - between / w).sum(1)
        assert [got[w, 100 * g + i] for g in range(3) for i in range(30)] == pytest.approx(want.tolist())
    for g, own in rows.items():
        d = np.abs(own - own.mean(0)).sum(1)
        assert registry.fit_bandwidth("cone", members.where(F.col("g") == g), own.mean(0).tolist()) == pytest.approx(d.mean() * 3)
    fits = {r.g: r.parameter for r in plugins.fitted(members, centres, "g", "cone", 3).collect()}
    means = {r.g: r["mean"] for r in plugins.weighted_means(members, centres, "g", "cone", 4.0, 3).collect()}
    density = {r.g: r.density for r in plugins.densities_at(members, centres, "g", "cone", 4.0, 3).collect()}
    for g, own in rows.items():
        d = np.abs(own - own.mean(0)).sum(1)
        w = np.maximum(0, 1 - d / 4)
        assert fits[g] == pytest.approx(d.mean() * 3) and means[g] == pytest.approx(((w[:, None] * own).sum(0) / w.sum()).tolist())
        assert density[g] == pytest.approx(w.sum() / 64)


def test_built_in_kernels_and_fits(groups):
    rows, members, centres = groups
    for g, own in rows.items():
        far = np.linalg.norm(own - own.mean(0), axis=1)
        assert registry.fit_bandwidth("gaussian", members.where(F.col("g") == g), own.mean(0).tolist()) == pytest.approx(far.max() / 1.96)
        assert registry.fit_bandwidth("nearest", members.where(F.col("g") == g), own.mean(0).tolist()) == 30
    density = {r.g: r.density for r in plugins.densities_at(members, centres, "g", "gaussian", 0.7, 3).collect()}
    for g, own in rows.items():
        square = ((own - own.mean(0)) ** 2).sum(1)
        assert density[g] == pytest.approx((np.exp(-square / 0.98) / (2 * np.pi * 0.49) ** 1.5).sum())
    assert plugins.kernel("vmf").ascending and not plugins.kernel("gaussian").ascending
    with pytest.raises(ValueError, match="known: .*gaussian"):
        plugins.kernel("none")


def test_filters_and_scorers(groups):
    rows, members, _ = groups
    plugins.register_filter("even", lambda points, by=2: points.where(F.col("id") % by == 0))
    plugins.register_scorer("first", lambda points, at=0: points.select("id", F.col("vec")[at].alias("score")))
    kept = plugins.filtered(members, [("even", {}), ("within", {"dim": 1, "low": 4, "high": 7})])
    want = {100 * g + i: own[i] for g, own in rows.items() for i in range(0, 30, 2) if 4 <= own[i][1] <= 7}
    assert {r.id: r.score for r in plugins.scored(kept, "first", at=2).collect()} == {k: v[2] for k, v in want.items()}
    noise = np.cov(np.random.default_rng(1).normal(size=(3, 50)))
    got = {r.id: r.score for r in plugins.scored(kept, "mahalanobis", noise=noise.tolist()).collect()}
    assert got == pytest.approx({k: float(np.sqrt(v @ np.linalg.inv(noise) @ v)) for k, v in want.items()})
    assert 5 < plugins.filtered(members, [("share", {"share": 0.3})]).count() < 50
    for run in (lambda: plugins.filtered(members, [("no", {})]), lambda: plugins.scored(members, "no")):
        with pytest.raises(ValueError, match="unknown"):
            run()
