"""Import transforms, filters, samples and row order over measurement columns or vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import order as O


def transform(df: DataFrame, cols: list[str], kind: str = "asinh", factor: float = 5.0) -> DataFrame:
    """Columns by "none", "asinh" (x / factor) or "double_asinh"."""
    build = {"none": lambda c: c, "asinh": lambda c: F.asinh(c / factor), "double_asinh": lambda c: F.asinh(F.asinh(c / factor))}
    if kind not in build:
        raise ValueError(f"unknown transform: {kind}")
    return df.withColumns({c: build[kind](F.col(c)) for c in cols})


def noise_threshold(df: DataFrame, cols: list[str], least: float = 1.0) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(F.col(c)) < least, 0.0).otherwise(F.col(c)) for c in cols})


def background(df: DataFrame, cols: list[str], subtract: float = 1.0, jitter: float = 0.01, seed: int = 1) -> DataFrame:
    """max(0, x - subtract), zeros jittered within (0, jitter)."""
    out = df.withColumns({c: F.greatest(F.lit(0.0), F.col(c) - subtract) for c in cols})
    return out.withColumns({c: F.when(F.col(c) == 0, F.rand(seed + i) * jitter).otherwise(F.col(c)) for i, c in enumerate(cols)}) if jitter else out


def rescale(df: DataFrame, cols: list[str], kind: str = "sd", quantile: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Columns over their standard deviation or a quantile, over all rows or for each group; a zero scale leaves them."""
    if kind == "none":
        return df
    if kind == "sd":
        scales = df.groupBy(*(by or [])).agg(*[F.stddev_samp(c).alias(f"__scale_{c}") for c in cols])
    elif kind == "quantile":
        scales = O.quantiles(df, {f"__scale_{c}": F.col(c) for c in cols}, quantile, by or [])
    else:
        raise ValueError(f"unknown scale: {kind}")
    joined = df.join(scales, by) if by else df.join(F.broadcast(scales))  # without groups it is one row
    return joined.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col(f"__scale_{c}")), F.col(c)) for c in cols}).drop(*[f"__scale_{c}" for c in cols])


def at_least_length(df: DataFrame, cols: list[str], least: float) -> DataFrame:
    return df.where(F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))) >= least)


def first_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group. Spark cuts each task's groups to n before the shuffle where n is small (spark.sql.optimizer.windowGroupLimitThreshold)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def prepared(df: DataFrame, cols: list[str], threshold: float = 1.0, kind: str = "asinh", factor: float = 5.0, scale: str = "none", quantile: float = 0.99, by: list[str] | None = None, least_length: float = 0.0) -> DataFrame:
    """An import in its documented order: noise threshold, transform, rescale, length filter."""
    out = rescale(transform(noise_threshold(df, cols, threshold), cols, kind, factor), cols, scale, quantile, by)
    return at_least_length(out, cols, least_length) if least_length else out


def as_points(df: DataFrame, id_col: str, features: list[str], side: list[str] | None = None, name: str | None = None, file: str | None = None) -> DataFrame:
    """(id, name, vec, side, file) from measurement columns."""
    none = F.lit(None).cast("string")
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(name) if name else none).alias("name"),
        V.cleaned(F.array(*[F.col(c).cast("double") for c in features])).alias("vec"),
        (F.array(*[F.col(c).cast("double") for c in side]) if side else F.lit(None).cast("array<double>")).alias("side"),
        (F.col(file) if file else none).alias("file"),
    )


def flat(points: DataFrame, features: list[str]) -> DataFrame:
    """One column for each feature."""
    return points.select("id", "name", "file", *[F.col("vec")[i].alias(c) for i, c in enumerate(features)])


def gate(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Conjunction of channel limits (least, most); None is open."""
    out = F.lit(True)
    for c, (low, high) in limits.items():
        if low is not None:
            out = out & (F.col(c) >= low)
        if high is not None:
            out = out & (F.col(c) <= high)
    return out


def gate_counts(df: DataFrame, limits: dict[str, tuple[float | None, float | None]], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(gate(limits)).alias("in_gate"), F.count("*").alias("total"))


def row_hash(cols: list[str], scale: float = 1000.0) -> Column:
    """Three or more channels, scaled and cut to whole numbers, as one key."""
    return F.concat_ws("|", *[F.floor(F.col(c) * scale).cast("long").cast("string") for c in cols])


def clean_name(c: Column) -> Column:
    """A channel name without a bracketed part and what follows a colon."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\(.+\)", ""), ":.*", ""))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def label(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def remapped(df: DataFrame, term: str, mapping: DataFrame) -> DataFrame:
    """`term` by a table (old, new) of bounded size; blank or missing new terms leave it. The join is Spark's to plan."""
    m = mapping.select(F.col("old").alias("__old"), F.nullif(F.trim("new"), F.lit("")).alias("__new"))
    return df.join(m, F.col(term) == F.col("__old"), "left").withColumn(term, F.coalesce("__new", term)).drop("__old", "__new")


def clamp_bins(c: Column, bins: int = 7) -> Column:
    """floor(v / 2) held to -3 .. 3, plus 3, at most bins - 1."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(-3), F.least(F.lit(3), F.floor(c / 2))) + 3).cast("int")


def equal_frequency_bins(df: DataFrame, value: str, bins: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """`df` with `bin` (from 0): runs of rows by (value, order) within each group, whose sizes differ by one at most."""
    placed = O.places(df, by or [], [value, *order])
    return placed.withColumn("bin", O.bins_of(F.col("place"), F.col("group_rows"), bins)).drop("place", "group_rows")


def rotated(x: Column, y: Column, angle: float, scale: float = 1.0) -> tuple[Column, Column]:
    import math

    c, s = math.cos(angle) * scale, math.sin(angle) * scale
    return x * c - y * s, x * s + y * c


def hash_order(id_col: str, seed: int = 0) -> Column:
    """A repeatable random-looking order, the same in any engine: a multiplicative hash of the id."""
    return F.pmod((F.col(id_col) + seed) * F.lit(2654435761), F.lit(4294967296))


def stratified(df: DataFrame, by: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, in hash order."""
    return first_rows(df.withColumn("__h", hash_order(id_col, seed)), by, ["__h", id_col], n).drop("__h")


def subset_and_rest(df: DataFrame, id_col: str, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n rows in hash order and all others. The limit is the feature; the rest is an anti join."""
    chosen = df.orderBy(hash_order(id_col, seed), id_col).limit(n)
    return chosen, df.join(chosen.select(id_col), id_col, "left_anti")


def renumbered(df: DataFrame, id_col: str, first: int = 0) -> DataFrame:
    """`df` with ids from `first` on in the order of the old ones, which `old_id` keeps; equal ids get different new ones."""
    placed = O.places(df.withColumnRenamed(id_col, "old_id"), [], ["old_id"])
    return placed.withColumn(id_col, F.col("place") + first).drop("place", "group_rows")


def numeric_then_text(c: Column) -> list[Column]:
    """Sort keys: numbers by value before other texts."""
    return [F.expr(f"try_cast({c} AS double)").asc_nulls_last() if isinstance(c, str) else c.try_cast("double").asc_nulls_last(), F.col(c).asc() if isinstance(c, str) else c.asc()]


def merged_by_comment(clusters: DataFrame) -> DataFrame:
    """`clusters` (cluster, comment) with group: the comment, or the cluster's own number where it is empty."""
    return clusters.withColumn("group", F.coalesce(F.nullif(F.trim("comment"), F.lit("")), F.col("cluster").cast("string")))


def large_enough(sizes: DataFrame, n: int, size: str = "size") -> DataFrame:
    """Clusters of at least min(50, n / 300) members."""
    return sizes.where(F.col(size) >= min(50, n // 300))
