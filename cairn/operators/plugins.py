"""Kernels, point filters and point scorers by name; users register their own beside the built-in ones.

A kernel is a falling function of a distance with one parameter. It is given twice: over arrays, for sums over all
points in blocks of the metric space, and as a column, for aggregates about the centres of groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import special
from cairn.functions import vectors as V


@dataclass(frozen=True)
class Kernel:
    """`value` and `weight` of (distance, parameter); `measure` is an aggregate of a group's distances to its centre, of which `finish` (with the dimension) makes the parameter.

    `log_constant` of (dimension, parameter) is the logarithm of the normaliser; `ascending` says whether a greater
    parameter shows more detail.
    """

    name: str
    metric: str
    value: Callable[[np.ndarray, float], np.ndarray]
    weight: Callable[[Column, float], Column]
    measure: Callable[[Column], Column]
    finish: Callable[[float, int], float]
    log_constant: Callable[[int, float], float] = lambda dim, parameter: 0.0
    ascending: bool = False


GAUSSIAN = Kernel(
    "gaussian", "euclidean",
    lambda d, p: np.exp(-(d * d) / (2 * p * p)), lambda d, p: F.exp(-(d * d) / (2 * p * p)),
    F.max, lambda m, dim: m / 1.96,
    lambda dim, p: -dim * (np.log(p) + 0.5 * np.log(2 * np.pi)),
)
VMF = Kernel(
    "vmf", "angular",
    lambda d, p: np.exp(p * np.cos(np.minimum(d, np.pi))), lambda d, p: F.exp(p * F.cos(d)),
    lambda d: F.avg(F.cos(d)), lambda m, dim: float(special.fit_vmf_kappa(dim, m)),
    special.log_vmf_constant, True,
)
KERNELS: dict[str, Kernel] = {k.name: k for k in (GAUSSIAN, VMF)}

#: name -> f(points, **parameters) -> the rows of points that stay.
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "min_length": lambda points, least: points.where(V.length(F.col("vec")) >= least),
    "within": lambda points, dim, low, high: points.where(F.col("vec")[dim].between(low, high)),
    "share": lambda points, share, seed=1: points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)),
}


def mahalanobis_length(points: DataFrame, noise: list[list[float]]) -> DataFrame:
    """(id, score): the length of each vector in units of a noise covariance."""
    inverse = np.linalg.inv(np.asarray(noise, dtype=float))
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in inverse]
    product = F.array(*[V.dot(F.col("vec"), row) for row in rows])
    return points.select("id", F.sqrt(F.greatest(F.lit(0.0), V.dot(F.col("vec"), product))).alias("score"))


#: name -> f(points, **parameters) -> (id, score).
SCORERS: dict[str, Callable[..., DataFrame]] = {
    "mahalanobis": mahalanobis_length,
    "length": lambda points: points.select("id", V.length(F.col("vec")).alias("score")),
}


def _known(table: dict, name: str, what: str):
    if name not in table:
        raise ValueError(f"unknown {what}: {name}; known: {', '.join(sorted(table))}")
    return table[name]


def register_kernel(kernel: Kernel) -> None:
    KERNELS[kernel.name] = kernel


def register_filter(name: str, stays: Callable[..., DataFrame]) -> None:
    FILTERS[name] = stays


def register_scorer(name: str, score: Callable[..., DataFrame]) -> None:
    SCORERS[name] = score


def kernel(name: str) -> Kernel:
    return _known(KERNELS, name, "kernel")


def filtered(points: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """`points` after each named filter with its parameters."""
    for name, parameters in steps:
        points = _known(FILTERS, name, "filter")(points, **parameters)
    return points


def scored(points: DataFrame, name: str, **parameters) -> DataFrame:
    return _known(SCORERS, name, "scorer")(points, **parameters)


def _about(members: DataFrame, centres: DataFrame, key: str, own: Kernel) -> DataFrame:
    """`members` (key, id, vec) with `__d`, their distance to the centre (key, centre) of their group."""
    return members.join(centres.select(key, "centre"), key).withColumn("__d", V.metric(own.metric)(F.col("vec"), F.col("centre")))


def fitted(members: DataFrame, centres: DataFrame, key: str, name: str, dim: int) -> DataFrame:
    """(key, parameter): the kernel's parameter of every group at once."""
    own = kernel(name)
    measured = _about(members, centres, key, own).groupBy(key).agg(own.measure(F.col("__d")).cast("double").alias("measure"))
    finish = own.finish

    @F.pandas_udf("double")
    def parameter(measures: pd.Series) -> pd.Series:  # a row for each group
        return measures.map(lambda m: float(finish(m, dim)))

    return measured.select(key, parameter("measure").alias("parameter"))


def weighted_means(members: DataFrame, centres: DataFrame, key: str, name: str, parameter: float, dim: int) -> DataFrame:
    """(key, mean): each group's mean with the kernel's weights about its centre."""
    own = kernel(name)
    rows = _about(members, centres, key, own).withColumn("__w", own.weight(F.col("__d"), parameter))
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("__w") * F.col("vec")[i]) / F.sum("__w") for i in range(dim)]).alias("mean"))


def densities_at(members: DataFrame, centres: DataFrame, key: str, name: str, parameter: float, dim: int) -> DataFrame:
    """(key, density): the normalised kernel density of each group's members at its centre, summed."""
    own = kernel(name)
    rows = _about(members, centres, key, own)
    return rows.groupBy(key).agg((F.sum(own.weight(F.col("__d"), parameter)) * float(np.exp(own.log_constant(dim, parameter)))).alias("density"))
