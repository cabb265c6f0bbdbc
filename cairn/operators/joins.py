"""Joins between points, centres, clusters and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres are cluster-level; beyond this count they are searched in blocks instead of being sent to every task.
MOST_SENT_CENTRES = 20_000
SLICE_ROWS = 1024


def _least(points: DataFrame, centres: list, kind: str, distance) -> DataFrame:
    """(id, centre, dist): for each point the centre of least distance(vectors), ties to the least centre; no shuffle, one row for each point."""
    import numpy as np
    import pandas as pd

    names = [r["centre"] for r in centres]
    key = points.schema["id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for low in range(0, len(frame), SLICE_ROWS):
                part = frame.iloc[low : low + SLICE_ROWS]
                d = np.round(distance(np.nan_to_num(np.stack(part["vec"].to_numpy()).astype(float), nan=0.0)), 12)
                best = d.argmin(1)
                yield pd.DataFrame({"id": part["id"], "centre": [names[i] for i in best], "dist": d[np.arange(len(d)), best]})

    return points.select("id", "vec").mapInPandas(run, f"id {key}, centre {kind}, dist double")


def nearest_centre(points: DataFrame, centres: DataFrame, metric: str = "angular", most: float | None = None) -> DataFrame:
    """(id, centre, dist) for points (id, vec) and centres (centre, profile); farther than `most` gives a null centre.

    Ties go to the least centre, and NaN counts as 0. The centres' number is checked before they are sent to every task;
    a larger set is searched in blocks with an equi-join.
    """
    import numpy as np

    from cairn.operators.knn import distances, nearest, resolved
    from cairn.operators.order import places
    from cairn.session import cut_lineage

    rows = centres.select("centre", "profile").orderBy("centre").limit(MOST_SENT_CENTRES + 1).collect()
    if len(rows) <= MOST_SENT_CENTRES:
        profiles = np.nan_to_num(np.array([r["profile"] for r in rows], dtype=float), nan=0.0)
        found = _least(points, rows, centres.schema["centre"].dataType.simpleString(), lambda x, between=resolved(metric): distances(x, profiles, between)) if rows else points.select("id", F.lit(None).cast(centres.schema["centre"].dataType).alias("centre"), F.lit(None).cast("double").alias("dist"))
    else:
        # numbers in the order of the centres, of any type, that no point has as its id
        numbered = cut_lineage(places(centres.select("centre", "profile"), [], ["centre"]).select((F.col("place") - 2**62).alias("j"), "centre", "profile"))
        found = nearest(points, numbered.select(F.col("j").alias("id"), F.col("profile").alias("vec")), 1, metric).join(numbered.select("j", "centre"), "j").select(F.col("i").alias("id"), "centre", "dist")
    return found if most is None else found.withColumn("centre", F.when(F.col("dist") <= most, F.col("centre")))


def nearest_mahalanobis(points: DataFrame, models: DataFrame, most: float | None = None) -> DataFrame:
    """(id, centre, dist) by diagonal Mahalanobis distance to models (centre, mean, spread); farther than `most` is unclassified (null)."""
    import numpy as np

    rows = models.select("centre", "mean", "spread").orderBy("centre").limit(MOST_SENT_CENTRES + 1).collect()
    if len(rows) > MOST_SENT_CENTRES:
        raise ValueError("too many models to send to every task")
    scaled = [(np.array(r["mean"], float), np.array(r["spread"], float)) for r in rows]
    found = _least(points, rows, models.schema["centre"].dataType.simpleString(), lambda x: np.stack([np.sqrt((((x - m) / s) ** 2).sum(1)) for m, s in scaled], axis=1))
    return found if most is None else found.withColumn("centre", F.when(F.col("dist") <= most, F.col("centre")))


def models(points: DataFrame, key: str, dim: int, least_variance: float = 0.19) -> DataFrame:
    """(centre, mean, spread) of each group: diagonal covariance with variances of at least `least_variance`."""
    mean = F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("mean")
    spread = F.array(*[F.sqrt(F.greatest(F.coalesce(F.var_samp(F.col("vec")[i]), F.lit(0.0)), F.lit(least_variance))) for i in range(dim)]).alias("spread")
    return points.groupBy(F.col(key).alias("centre")).agg(mean, spread)


def first_match(gated: DataFrame, rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """For each key of `gated` the least id of `rows` with that key."""
    return gated.select(key).distinct().join(rows.groupBy(key).agg(F.min(id_col).alias(id_col)), key)


def match_fraction(pairs: DataFrame, lookup: DataFrame, left: str, right: str, key: str, value: str) -> DataFrame:
    """Share of pairs whose two looked-up values are equal; a missing value matches nothing."""
    a = lookup.select(F.col(key).alias(left), F.col(value).alias("__va"))
    b = lookup.select(F.col(key).alias(right), F.col(value).alias("__vb"))
    return pairs.join(a, left, "left").join(b, right, "left").agg(F.count("*").alias("pairs"), F.avg(F.coalesce(F.col("__va") == F.col("__vb"), F.lit(False)).cast("double")).alias("share"))


def combined_annotators(tables: list[DataFrame], key: str, term: str) -> DataFrame:
    """One column t0, t1, ... for each annotator, "" where it has no term for a key."""
    out = None
    for i, t in enumerate(tables):
        t = t.select(key, F.col(term).alias(f"t{i}"))
        out = t if out is None else out.join(t, key, "full_outer")
    return out.select(key, *[F.coalesce(f"t{i}", F.lit("")).alias(f"t{i}") for i in range(len(tables))])


def composition(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """(cluster, term, n, term_size, place): a cluster's terms by members in it, and how many members the term has."""
    from pyspark.sql import Window

    sizes = annotations.groupBy("term").agg(F.count("*").alias("term_size"))
    found = members.join(annotations, "id").groupBy("cluster", "term").agg(F.count("*").alias("n")).join(sizes, "term")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "term")))
