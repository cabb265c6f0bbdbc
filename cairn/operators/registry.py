"""Clustering algorithms and densities by name, batches over datasets and parameters, and bandwidth fits."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import density, hierarchy, joins, knn, plugins

#: name -> f(points, **parameters) -> (id, cluster); more can be registered.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "density": density.clusters,
    "hierarchical": hierarchy.cut_clusters,
}

#: Densities that are no sums over all points: name -> f(points, parameter) -> (id, density).
DENSITIES: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    "nearest": lambda points, n: density.nearest_mean_kernel(knn.knn(points, int(n)), int(n)),
}


def register_algorithm(name: str, run: Callable[..., DataFrame]) -> None:
    ALGORITHMS[name] = run


def register_density(name: str, run: Callable[[DataFrame, float], DataFrame]) -> None:
    DENSITIES[name] = run


def run(name: str, points: DataFrame, **parameters) -> DataFrame:
    try:
        return ALGORITHMS[name](points, **parameters)
    except KeyError:
        raise ValueError(f"unknown algorithm: {name}; known: {', '.join(sorted(ALGORITHMS))}") from None


def batch(name: str, datasets: dict[str, DataFrame], grid: Iterable[dict]) -> DataFrame:
    """(dataset, parameters, id, cluster) for every dataset and every set of parameters."""
    out = None
    grid = list(grid)
    for dataset, points in datasets.items():
        for parameters in grid:
            text = ", ".join(f"{k}={v}" for k, v in sorted(parameters.items()))
            one = run(name, points, **parameters).select(F.lit(dataset).alias("dataset"), F.lit(text).alias("parameters"), "id", "cluster")
            out = one if out is None else out.unionByName(one)
    return out


def kernel_grid(name: str, points: DataFrame, widths: Iterable[float]) -> DataFrame:
    """(width, id, density) over a grid of bandwidths, by a registered kernel or density."""
    out = None
    for w in widths:
        found = DENSITIES[name](points, w) if name in DENSITIES else knn.kernel_sums(points, plugins.kernel(name), w)
        one = found.select(F.lit(float(w)).alias("width"), "id", "density")
        out = one if out is None else out.unionByName(one)
    return out


def fit_bandwidth(name: str, members: DataFrame, centre: list[float]) -> float:
    """A kernel's parameter from members (id, vec) around a centre, by the kernel's own fit; for "nearest" their number."""
    if name in DENSITIES:
        return float(members.count())
    group = F.lit(0).alias("group")
    centres = members.sparkSession.createDataFrame([(0, [float(x) for x in centre])], "group int, centre array<double>")
    return plugins.fitted(members.select(group, "id", "vec"), centres, "group", name, len(centre)).first()["parameter"]


def nearest_root(points: DataFrame, links: DataFrame, metric: str = "angular") -> DataFrame:
    """(id, cluster): the nearest root instead of the root that links lead to."""
    roots = links.where("parent IS NULL").select("id").join(points, "id").select(F.col("id").alias("centre"), F.col("vec").alias("profile"))
    return joins.nearest_centre(points, roots, metric).select("id", F.col("centre").alias("cluster"))


def node_attributes(nodes: DataFrame, annotations: DataFrame, chosen: str) -> DataFrame:
    """`nodes` (id) with group (a number for each first term), selected (has the chosen term) and n_terms."""
    from pyspark.sql import Window

    terms = annotations.groupBy("id").agg(F.min("term").alias("term"), F.max((F.col("term") == chosen).cast("int")).alias("hit"), F.count("*").alias("n_terms"))
    numbers = annotations.select("term").distinct().withColumn("group", F.row_number().over(Window.orderBy("term")))  # a row for each term
    out = nodes.join(terms, "id", "left").join(numbers, "term", "left")
    return out.select("id", F.coalesce("group", F.lit(0)).alias("group"), (F.coalesce("hit", F.lit(0)) == 1).alias("selected"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
