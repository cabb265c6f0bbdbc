"""Column expressions over vectors held as array<double>. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def cleaned(v: Column) -> Column:
    """NaN and null components as 0."""
    return F.transform(v, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def length(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """`v` at length 1; a zero vector stays zero."""
    return F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where a vector is zero."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), length(a) * length(b)), F.lit(0.0))))


def angular(a: Column, b: Column) -> Column:
    return F.acos(cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def blend(a: Column, b: Column, k: Column | float) -> Column:
    """k * a + (1 - k) * b."""
    k = F.lit(k) if isinstance(k, (int, float)) else k
    return F.zip_with(a, b, lambda x, y: k * x + (1 - k) * y)


def subset(v: Column, places: list[int]) -> Column:
    return F.array(*[v[i] for i in places])


def asinh_scaled(v: Column, factor: float = 5.0) -> Column:
    return F.transform(v, lambda x: F.asinh(x / factor))


def double_asinh(v: Column, factor: float = 5.0) -> Column:
    return F.transform(v, lambda x: F.asinh(F.asinh(x / factor)))


def sinh_scaled(v: Column, factor: float = 5.0) -> Column:
    """Back from asinh_scaled."""
    return F.transform(v, lambda x: F.sinh(x) * factor)


def thresholded(v: Column, least: float = 1.0) -> Column:
    """Components of less than `least` in size as 0."""
    return F.transform(v, lambda x: F.when(F.abs(x) < least, 0.0).otherwise(x))


def to_sign_beyond_one(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.abs(x) > 1, F.signum(x)).otherwise(x))


def noise_suppressed(build: Callable[[Column, Column], Column], least: float = 1.0) -> Callable[[Column, Column], Column]:
    """A distance after components of less than `least` are set to 0. The definition is ours."""
    return lambda a, b: build(thresholded(a, least), thresholded(b, least))


#: Distances by name; more can be registered as functions of two vector columns.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"angular": angular, "euclidean": euclidean, "manhattan": manhattan, "noise_suppressing_angular": noise_suppressed(angular), "noise_suppressing_euclidean": noise_suppressed(euclidean)}


def register_metric(name: str, build: Callable[[Column, Column], Column]) -> None:
    METRICS[name] = build


def metric(name: str) -> Callable[[Column, Column], Column]:
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown distance: {name}; known: {', '.join(sorted(METRICS))}") from None
