"""A headless run: FCS files in, features transformed, clusters by density gradients, every event's cluster out."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import density
from cairn.operators import transforms as T
from cairn.operators.aggregates import mean_profile
from cairn.session import cut_lineage
from cairn.sources.delimited import batch_config
from cairn.sources.fcs import read_fcs, write_with_clusters
from cairn.sources.sinks import reassigned

FILE_BITS = 33


def run_batch(spark: SparkSession, settings: dict, files: str, out: str) -> DataFrame:
    """Clusters the events of `files` and writes (file, idx, cluster) as Parquet to `out`; gives the table written.

    Settings: features (1-based channel numbers), k (a number, or "auto" for the elbow of a sweep), and as options
    limit (events of each file that are clustered; the others go to the nearest cluster profile), threshold (1.0),
    factor (5.0), metric (angular) and fcs (a folder for FCS files that have the clusters, numbered from 1 by falling size,
    as a channel). An event's id is its file's number in order of name, and its place in the file.
    """
    events = read_fcs(spark, files)
    channels = [c for c in events.columns if c not in ("file", "idx")]
    features = [channels[i - 1] for i in settings["features"]]
    names = sorted(r["file"] for r in events.select("file").distinct().collect())  # a row for each file
    numbers = spark.createDataFrame(list(enumerate(names)), "number long, file string")
    metric = settings.get("metric", "angular")
    ready = T.prepared(events, features, float(settings.get("threshold", 1.0)), factor=float(settings.get("factor", 5.0)))
    ready = ready.join(numbers, "file").withColumn("id", F.shiftleft("number", FILE_BITS) + F.col("idx"))
    ready = cut_lineage(ready.select("id", "file", "idx", *features))
    limit = settings.get("limit")
    chosen = T.first_rows(ready, "file", ["idx"], int(limit)) if limit else ready
    points = cut_lineage(T.as_points(chosen, "id", features).select("id", "vec"))
    if settings.get("k", "auto") == "auto":
        _, members = density.auto_clusters(points, len(features), metric)
    else:
        reach = density.default_range(len(features), points.count())["reach"]
        members = density.clusters(points, int(settings["k"]), reach, metric)
    if limit:
        profiles = mean_profile(points.join(members, "id"), ["cluster"], len(features))
        members = reassigned(T.as_points(ready, "id", features).select("id", "vec"), profiles, metric).select("id", F.col("centre").alias("cluster"))
    ready.select("id", "file", "idx").join(members, "id").select("file", "idx", "cluster").write.mode("overwrite").parquet(out)
    found = spark.read.parquet(out)
    if settings.get("fcs"):
        order = Window.orderBy(F.desc("size"), "cluster")  # a row for each cluster
        ordinals = found.groupBy("cluster").agg(F.count("*").alias("size")).select("cluster", F.row_number().over(order).alias("ordinal"))
        numbered = found.join(ordinals, "cluster").select("file", "idx", F.col("ordinal").alias("cluster"))
        write_with_clusters(numbered, settings["fcs"]).collect()  # a row for each file
    return found


def main(arguments: list[str]) -> None:
    """python -m cairn.batch CONFIG FILES OUT"""
    config, files, out = arguments
    spark = SparkSession.builder.appName("cairn-batch").getOrCreate()
    with open(config, encoding="utf-8") as f:
        run_batch(spark, batch_config(f.read()), files, out)


if __name__ == "__main__":
    main(sys.argv[1:])
