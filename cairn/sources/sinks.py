"""Exports: cluster members, datasets, distance matrices, layouts, cluster numbers by term, profiles as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clusters_to_csv(members: DataFrame, points: DataFrame, features: list[str], path: str) -> None:
    """ClusterID, name and features of every member."""
    member_rows(members, points, features).write.csv(path, header=True)


def member_rows(members: DataFrame, points: DataFrame, features: list[str]) -> DataFrame:
    return members.join(points, "id").select(F.col("cluster").alias("ClusterID"), "name", *[F.col("vec")[i].alias(c) for i, c in enumerate(features)])


def dataset_to_csv(points: DataFrame, features: list[str], path: str) -> None:
    points.select("id", "name", "file", *[F.col("vec")[i].alias(c) for i, c in enumerate(features)]).write.csv(path, header=True)


def distance_rows(pairs: DataFrame) -> DataFrame:
    """(id, distances): a line of the matrix for each id, from pairs (a, b, dist) with a < b."""
    zero = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    full = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "dist").union(pairs.select("b", "a", "dist")).union(zero.select("id", F.col("id").alias("other"), F.lit(0.0)))
    return full.groupBy("id").agg(F.expr("transform(sort_array(collect_list(struct(other, dist))), x -> x.dist)").alias("distances"))


def distances_to_text(pairs: DataFrame, path: str) -> None:
    distance_rows(pairs).orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), F.expr("transform(distances, x -> cast(x AS string))"))).write.text(path)


def layout_to_csv(layout: DataFrame, path: str) -> None:
    """EventID, Filename, Index_In_File, X, Y from (id, file, idx, x, y)."""
    layout.select(F.col("id").alias("EventID"), F.col("file").alias("Filename"), F.col("idx").alias("Index_In_File"), F.col("x").alias("X"), F.col("y").alias("Y")).write.csv(path, header=True)


def cluster_ordinals(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, ordinal): the cluster's place by falling size, from 1; 0 without a cluster is the reader's default."""
    from pyspark.sql import Window

    order = clusters.select("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")).alias("ordinal"))  # cluster-level
    return members.join(order, "cluster").select("id", "ordinal")


def ordinals_by_term(members: DataFrame, clusters: DataFrame, annotations: DataFrame, path: str) -> None:
    """A text folder for each term: its members' cluster ordinals in order of id."""
    rows = annotations.join(cluster_ordinals(members, clusters), "id", "left").select("term", "id", F.coalesce("ordinal", F.lit(0)).cast("string").alias("value"))
    rows.repartition("term").sortWithinPartitions("term", "id").select("term", "value").write.partitionBy("term").text(path)


def profile_text(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster", F.concat_ws("\t", F.expr("transform(profile, x -> cast(round(x, 6) AS string))")).alias("text"))


def reassigned(all_rows: DataFrame, clusters: DataFrame, metric: str = "angular") -> DataFrame:
    """(id, centre, dist) for rows that were not clustered: the cluster with the nearest profile."""
    from cairn.operators.joins import nearest_centre

    return nearest_centre(all_rows, clusters.select(F.col("cluster").alias("centre"), "profile"), metric)
