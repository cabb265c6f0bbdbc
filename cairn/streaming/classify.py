"""Classification of arriving points against stored cluster models: a stateless stream joined to a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import vectors as V


def classified(stream: DataFrame, models: list[tuple[int, list[float], list[float]]], most: float | None = None) -> DataFrame:
    """`stream` (id, vec, ...) with centre and dist, the nearest of few models (centre, mean, spread); farther than `most` is null.

    The models are literals in the plan, so the query needs no state and no join, and runs alike on streams and tables.
    """
    if len(models) > 2_000:
        raise ValueError("too many models for literals")
    options = []
    for centre, mean, spread in models:
        d = F.sqrt(V.total(F.zip_with(F.zip_with("vec", F.array(*map(F.lit, map(float, mean))), lambda x, m: x - m), F.array(*map(F.lit, map(float, spread))), lambda x, s: x * x / (s * s))))
        options.append(F.struct(F.round(d, 12).alias("dist"), F.lit(centre).alias("centre")))
    out = stream.withColumn("__best", F.array_min(F.array(*options)))
    centre = F.col("__best.centre") if most is None else F.when(F.col("__best.dist") <= most, F.col("__best.centre"))
    return out.withColumns({"centre": centre, "dist": F.col("__best.dist")}).drop("__best")
