"""Profiles, group statistics, matrices and contingency tables over points (vec array<double>) and measurements (columns).

Profiles aggregate each dimension as its own column, so one partial aggregation before one shuffle does the work and no
row is exploded. `by_place` turns array results into long rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.order import quantiles


def by_place(df: DataFrame, vec: str, keys: list[str], value: str = "value") -> DataFrame:
    """Long form: keys, dim (from 0) and value."""
    return df.select(*keys, F.posexplode(vec).alias("dim", value))


def mean_profile(points: DataFrame, keys: list[str], dim: int, vec: str = "vec") -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("size"), F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)]).alias("profile"))


def weighted_profile(points: DataFrame, keys: list[str], dim: int, weight: str, vec: str = "vec") -> DataFrame:
    w = F.col(weight)
    return points.groupBy(*keys).agg(F.array(*[F.try_divide(F.sum(F.col(vec)[i] * w), F.sum(w)) for i in range(dim)]).alias("profile"))


def median_profile(points: DataFrame, keys: list[str], dim: int, vec: str = "vec") -> DataFrame:
    found = quantiles(points, {f"__m{i}": F.col(vec)[i] for i in range(dim)}, 0.5, keys, [F.count("*").alias("size")])
    return found.select(*keys, "size", F.array(*[f"__m{i}" for i in range(dim)]).alias("profile"))


def group_statistics(points: DataFrame, members: DataFrame, annotations: DataFrame, dim: int) -> DataFrame:
    """Count and median profile for each (cluster, term); members (id, cluster), annotations (id, term)."""
    return median_profile(points.join(members, "id").join(annotations, "id"), ["cluster", "term"], dim)


def bounds(points: DataFrame, dim: int, keys: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """Arrays `low` and `high` of each dimension's least and greatest value."""
    low = F.array(*[F.min(F.col(vec)[i]) for i in range(dim)]).alias("low")
    high = F.array(*[F.max(F.col(vec)[i]) for i in range(dim)]).alias("high")
    return points.groupBy(*(keys or [])).agg(low, high)


def sufficient_statistics(points: DataFrame, key: str, dim: int, vec: str = "vec") -> DataFrame:
    """(key, n, sums, squares): what means, spreads and Mahalanobis distances of merged groups need."""
    sums = F.array(*[F.sum(F.col(vec)[i]) for i in range(dim)]).alias("sums")
    squares = F.array(*[F.sum(F.col(vec)[i] * F.col(vec)[i]) for i in range(dim)]).alias("squares")
    return points.groupBy(key).agg(F.count("*").alias("n"), sums, squares)


def pooled_spread(points: DataFrame, key: str, dim: int, least: float = 0.25, vec: str = "vec") -> DataFrame:
    """One row: `spread`, each dimension's within-group standard deviation (over n), at least `least`."""
    stats = sufficient_statistics(points, key, dim, vec)
    within = [F.sum(F.col("squares")[i] - F.col("sums")[i] * F.col("sums")[i] / F.col("n")) / F.sum("n") for i in range(dim)]
    return stats.agg(F.array(*[F.greatest(F.lit(least), F.sqrt(F.greatest(w, F.lit(0.0)))) for w in within]).alias("spread"))


def covariances(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, cov) with n - 1 for all pairs of columns, in one pass."""
    return _pairs(df, cols, "cov", lambda a, b: F.covar_samp(a, b))


def correlations(df: DataFrame, cols: list[str], centred: bool = True) -> DataFrame:
    """(a, b, corr): Pearson, or the cosine of the two columns."""
    if centred:
        return _pairs(df, cols, "corr", lambda a, b: F.corr(a, b))
    return _pairs(df, cols, "corr", lambda a, b: F.try_divide(F.sum(F.col(a) * F.col(b)), F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))))


def _pairs(df: DataFrame, cols: list[str], name: str, build) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[build(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias(name)) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def contingency(left: DataFrame, right: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """(a, b, n): members that two labelings share."""
    return left.join(right, key).groupBy(a, b).agg(F.count("*").alias("n"))


def precision_recall(table: DataFrame, truth: str, found: str) -> DataFrame:
    """`table` (truth, found, n) with precision (of the found group), recall (of the true group) and F; 0 where undefined."""
    precision = F.col("n") / F.sum("n").over(Window.partitionBy(found))
    recall = F.col("n") / F.sum("n").over(Window.partitionBy(truth))
    out = table.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def normalised_contingency(table: DataFrame, by: str) -> DataFrame:
    """`share`: n over the size of its `by` class."""
    return table.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def best_parent(table: DataFrame, child: str, parent: str) -> DataFrame:
    """For each child the parent of greatest overlap n, the least parent on ties."""
    return table.groupBy(child).agg(F.max_by(parent, F.struct("n", -F.col(parent))).alias("parent"), F.max("n").alias("overlap"))


def majority_vote(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """The most frequent vote of each key, the least on ties; keys whose winner is empty are left out."""
    counted = votes.groupBy(key, vote).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), vote)))
    return ranked.where(f"r = 1 AND {vote} <> ''").select(key, vote, "n")


def shares(df: DataFrame, cls: str) -> DataFrame:
    """(cls, n, share of all rows)."""
    counted = df.groupBy(cls).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def group_confidence(df: DataFrame, cluster: str, value: str, assay: Column, control: Column) -> DataFrame:
    """For each cluster the means under two conditions, z by pooled deviation, and confidence |2 Phi(z) - 1|.

    Confidence is one minus a two-sided p with the spread of single values, not of means; `p` is the two-sided p of z
    for the means. Spark has no error function: Phi is by its fixed five-term polynomial (error under 1e-7).
    """
    a, c = F.when(assay, F.col(value)), F.when(control, F.col(value))
    out = df.groupBy(cluster).agg(
        F.avg(a).alias("mean_assay"), F.avg(c).alias("mean_control"), F.count(a).alias("n_assay"), F.count(c).alias("n_control"), F.var_samp(a).alias("va"), F.var_samp(c).alias("vc")
    )
    pooled = F.sqrt(F.try_divide((F.col("n_assay") - 1) * F.col("va") + (F.col("n_control") - 1) * F.col("vc"), F.col("n_assay") + F.col("n_control") - 2))
    out = out.withColumn("z", F.try_divide(F.col("mean_assay") - F.col("mean_control"), pooled))
    means = F.col("z") / F.sqrt(F.try_divide(F.lit(1.0), F.col("n_assay")) + F.try_divide(F.lit(1.0), F.col("n_control")))
    out = out.withColumns({"confidence": F.abs(2 * phi(F.col("z")) - 1), "p": 2 * (1 - phi(F.abs(means)))})
    return out.drop("va", "vc")


def phi(z: Column) -> Column:
    """Standard normal distribution function. The polynomial's coefficients (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def histogram2d(df: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float], bins: int) -> DataFrame:
    """(bx, by, n): counts in a bins x bins grid over [low, high], the top edges included."""

    def cell(c, a, b):
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - a) * bins / (b - a))).cast("int")

    inside = F.col(x).between(low[0], high[0]) & F.col(y).between(low[1], high[1])
    return df.where(inside).groupBy(cell(x, low[0], high[0]).alias("bx"), cell(y, low[1], high[1]).alias("by")).agg(F.count("*").alias("n"))


def smoothed(grid: DataFrame, bins: int, radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """The grid's counts spread by a Gaussian kernel of the given radius in cells."""
    offsets = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    import math

    kernel = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)).alias("w")) for dx, dy in offsets])
    spread = grid.select("bx", "by", "n", F.inline(kernel)).select((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), (F.col("n") * F.col("w")).alias("v"))
    return spread.where(f"bx BETWEEN 0 AND {bins - 1} AND by BETWEEN 0 AND {bins - 1}").groupBy("bx", "by").agg(F.sum("v").alias("density"))


def levels(grid: DataFrame, count: int = 15, value: str = "density") -> DataFrame:
    """Each cell's contour level: 1 to `count` by its share of the greatest value."""
    top = grid.agg(F.max(value).alias("top"))
    return grid.join(F.broadcast(top)).withColumn("level", F.least(F.lit(count), F.floor(F.col(value) / F.col("top") * count).cast("int") + 1)).drop("top")


def volume(points: DataFrame, dim: int, spread: list[float], keys: list[str], vec: str = "vec") -> DataFrame:
    """Product over the dimensions of range over spread."""
    ranges = [(F.max(F.col(vec)[i]) - F.min(F.col(vec)[i])) / F.lit(float(spread[i])) for i in range(dim)]
    return points.groupBy(*keys).agg(F.aggregate(F.array(*ranges), F.lit(1.0), lambda p, x: p * x).alias("volume"))


def group_deviation(points: DataFrame, key: str, dim: int, vec: str = "vec") -> DataFrame:
    """(key, sum_asinh, median_dist): asinh of squared distances to the group's mean, summed, and the median distance."""
    from cairn.functions import vectors as V

    means = mean_profile(points, [key], dim, vec).select(key, "profile")
    far = points.join(means, key).withColumn("d", V.euclidean(F.col(vec), F.col("profile")))
    return quantiles(far, {"median_dist": F.col("d")}, 0.5, [key], [F.sum(F.asinh(F.col("d") * F.col("d"))).alias("sum_asinh")])
