"""Seeded synthetic points: normals, separated pairs, trajectories and mixtures, made in tasks from per-row seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

POINT = "id long, name string, vec array<double>, side array<double>"


def _made(spark: SparkSession, n: int, draw, seed: int) -> DataFrame:
    """n points; draw(rng, i) gives (component, vector, log density)."""

    def run(frames):
        for frame in frames:
            rows = []
            for i in frame["id"]:
                c, x, density = draw(np.random.default_rng([seed, int(i)]), int(i))
                rows.append((int(i), f"c_{c}_{i}", x.tolist(), [float(density), float(c)]))
            yield pd.DataFrame(rows, columns=["id", "name", "vec", "side"])

    return spark.range(n).mapInPandas(run, POINT)


def _log_normal(x, mean, sd):
    z = (x - mean) / sd
    return float(-(z @ z) / 2 - np.log(np.broadcast_to(sd, x.shape)).sum() - len(x) / 2 * np.log(2 * np.pi))


def one_normal(spark, n: int = 10_000, dim: int = 3, mean: float = 5.0, sd: float = 1.0, seed: int = 1) -> DataFrame:
    def draw(rng, i):
        x = rng.normal(mean, sd, dim)
        return 0, x, _log_normal(x, mean, sd)

    return _made(spark, n, draw, seed)


def two_normals(spark, each: int = 2000, dim: int = 40, separation: float = 2.3, effective: int | None = None, seed: int = 1) -> DataFrame:
    """Two normals `separation` apart on axes 0 and 1; dimensions beyond `effective` have almost no spread."""
    sd = np.where(np.arange(dim) < (effective or dim), 1.0, 1e-6)

    def draw(rng, i):
        c = i % 2
        mean = np.zeros(dim)
        mean[c] = separation
        x = rng.normal(mean, sd)
        return c, x, _log_normal(x, mean, sd)

    return _made(spark, 2 * each, draw, seed)


def one_marker(spark, each: int = 1000, dim: int = 38, effective: int = 11, separation: float = 2.57, seed: int = 1) -> DataFrame:
    """Two normals that differ in one marker."""
    sd = np.where(np.arange(dim) < effective, 1.0, 1e-6)

    def draw(rng, i):
        c = i % 2
        mean = np.full(dim, 5.0)
        mean[0] += c * separation
        x = rng.normal(mean, sd)
        return c, x, _log_normal(x, mean, sd)

    return _made(spark, 2 * each, draw, seed)


def trajectory(spark, components: int = 1000, each: int = 50, dim: int = 50, step: float = 0.5, branch: float = 0.02, seed: int = 1) -> DataFrame:
    """Normals along a random walk that branches now and then; the walk is made once, on the driver."""
    rng = np.random.default_rng(seed)
    means = [np.zeros(dim)]
    for _ in range(1, components):
        origin = means[rng.integers(len(means))] if rng.random() < branch else means[-1]
        means.append(origin + rng.normal(0, step, dim))
    path = np.array(means)

    def draw(rng, i):
        c = i % components
        x = rng.normal(path[c], 1.0)
        return c, x, _log_normal(x, path[c], 1.0)

    return _made(spark, components * each, draw, seed)


def mixture(spark, n: int = 5000, components: int = 10, dim: int = 50, spread: float = 4.0, df: int = 5, seed: int = 1) -> DataFrame:
    """Half the components normal, half Student-t (a normal over the root of a chi-square share)."""
    centres = np.random.default_rng(seed).normal(0, spread, (components, dim))

    def draw(rng, i):
        c = i % components
        x = rng.normal(0, 1, dim)
        if c % 2:
            x = x / np.sqrt(rng.chisquare(df) / df)
        return c, centres[c] + x, _log_normal(x, 0.0, 1.0)

    return _made(spark, n, draw, seed)
