"""Exports are read back."""

from pyspark.sql import functions as F

from cairn.operators import graphs, registry
from cairn.sources import sinks


def test_exports(spark, tmp_path):
    points = spark.createDataFrame([(0, "a", "f", [1.0, 2.0]), (1, "b", "f", [2.0, 1.0]), (2, "c", "g", [5.0, 5.0])], "id long, name string, file string, vec array<double>")
    members = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "id long, cluster long")
    clusters = members.groupBy("cluster").agg(F.count("*").alias("size"))
    sinks.clusters_to_csv(members, points, ["x", "y"], str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True).collect()} == {(7, "a", 1.0, 2.0), (7, "b", 2.0, 1.0), (8, "c", 5.0, 5.0)}
    sinks.dataset_to_csv(points, ["x", "y"], str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).columns == ["id", "name", "file", "x", "y"]
    sinks.distances_to_text(graphs.pairwise(points.select("id", "vec"), "euclidean"), str(tmp_path / "m"))
    assert sorted(len(r.value.split("\t")) for r in spark.read.text(str(tmp_path / "m")).collect()) == [4, 4, 4]
    sinks.ordinals_by_term(members, clusters, spark.createDataFrame([(0, "t"), (2, "t"), (1, "u"), (9, "u")], "id long, term string"), str(tmp_path / "o"))
    assert sorted((r.term, r.value) for r in spark.read.text(str(tmp_path / "o")).collect()) == [("t", "1"), ("t", "2"), ("u", "0"), ("u", "1")]
    layout = points.select("id", "file", F.lit(0).alias("idx"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    sinks.layout_to_csv(layout, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).columns == ["EventID", "Filename", "Index_In_File", "X", "Y"]


def test_algorithms_by_name(spark):
    import pytest

    points = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "id long, vec array<double>")
    assert {r.id: r.cluster for r in registry.run("hierarchical", points, threshold=0.5).collect()} == {0: 0, 1: 0, 2: 2}
    with pytest.raises(ValueError):
        registry.run("none", points)
