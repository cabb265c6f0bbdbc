"""What the query modules share: tables in the engine's shapes, and a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.session import table

DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The points in SQL, and their label centroids.
P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
C = P + ", long AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM p), " + (
    "c AS (SELECT label::BIGINT AS id, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM long GROUP BY label, d) GROUP BY label)"
)
ACOS = "acos(greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))))"


def angle(a: str, b: str) -> str:
    return ACOS.format(a=a, b=b)


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its DuckDB text."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (id, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("vec"), "label")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): mean vector of each label."""
    from cairn.operators.aggregates import mean_profile

    return mean_profile(points(spark, sf_dir), ["label"], DIM).select(F.col("label").cast("long").alias("id"), F.col("profile").alias("vec"))


def r6(c, digits: int = 6):
    return F.round(c, digits)
