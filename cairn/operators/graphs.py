"""Graphs over clusters and points: spanning trees, neighbour graphs, module maps, components, layouts, paths.

What runs on the driver (Kruskal, the layout) takes cluster-level tables and checks their size first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators.order import percent_places
from cairn.session import cut_lineage

MOST_DRIVER_ROWS = 2_000_000


def _on_driver(df: DataFrame, limit: int = MOST_DRIVER_ROWS) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for the driver")
    return rows


def pairwise(points: DataFrame, metric: str = "angular") -> DataFrame:
    """(a, b, dist) for a < b of a cluster-level set (id, vec), whose size is checked: every pair is the result."""
    n = points.count()
    if n > 5_000:
        raise ValueError("pairwise distances are for cluster-level sets; use nearest neighbours for points")
    left, right = points.select(F.col("id").alias("a"), F.col("vec").alias("va")), points.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", V.metric(metric)(F.col("va"), F.col("vb")).alias("dist"))


def spanning_tree(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(a, b, weight): the spanning tree (or forest) of greatest total weight of edges (a, b, weight), ties by a, b; by Boruvka's rounds.

    In a round every component takes its best edge to another one, then components that an edge joins become one, so
    there are at least half as few each round. Edges inside a component are dropped before the next.
    """
    left = cut_lineage(edges.select("a", "b", F.col(weight).alias("weight"), F.col("a").alias("ca"), F.col("b").alias("cb")).where("a <> b"))
    tree = left.select("a", "b", "weight").limit(0)
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct((-F.col("weight")).alias("less"), "a", "b", "ca", "cb").alias("edge"))
        best = cut_lineage(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        tree = cut_lineage(tree.unionByName(best.select("a", "b", (-F.col("less")).alias("weight"))))
        joined = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        for side in ("ca", "cb"):
            left = left.join(joined.select(F.col("id").alias(side), F.col("component").alias(f"{side}_now")), side)
        left = cut_lineage(left.where("ca_now <> cb_now").select("a", "b", "weight", F.col("ca_now").alias("ca"), F.col("cb_now").alias("cb")))
    return tree


def similarity_tree(profiles: DataFrame) -> DataFrame:
    """Spanning tree of greatest cosine similarity between cluster profiles (id, vec); weights are 5 * similarity / the greatest."""
    edges = pairwise(profiles, "angular").select("a", "b", F.cos("dist").alias("weight"))
    tree = spanning_tree(edges)
    return tree.crossJoin(F.broadcast(tree.agg(F.max("weight").alias("top")))).select("a", "b", (5 * F.col("weight") / F.col("top")).alias("weight"))  # one row


def node_sizes(sizes: DataFrame) -> DataFrame:
    """`sizes` (cluster, size) with node_size max(1, size ^ 0.33)."""
    return sizes.withColumn("node_size", F.greatest(F.lit(1.0), F.pow("size", F.lit(0.33))))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id that edges (a, b) connect to each node; rounds grow with the logarithm of the diameter."""
    edges = cut_lineage(edges.select("a", "b"))  # every round reads them
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = now.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = now.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        step = cut_lineage(lower.join(jump, "component", "left").select("id", "was", F.coalesce(F.least("component", "beyond"), "component").alias("component")))
        now = step.select("id", "component")
        if step.where("was <> component").isEmpty():
            break
    return now if nodes is None else nodes.select("id").join(now, "id", "left").withColumn("component", F.coalesce("component", "id"))


def knn_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """Undirected edges (a, b, dist) from each node to its k - 1 nearest others."""
    near = neighbours.where((F.col("rank") <= k) & (F.col("i") != F.col("j")))
    return near.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("dist").alias("dist"))


def knn_graph_by_density(neighbours: DataFrame, density: DataFrame, least: int, most: int) -> DataFrame:
    """As knn_graph, with a degree from `least` for the thinnest node to `most` for the densest, by rank of density."""
    ranked = percent_places(density, "density")
    degree = ranked.select(F.col("id").alias("i"), F.round(least + F.col("share") * (most - least)).cast("int").alias("degree"))
    near = neighbours.join(degree, "i").where((F.col("rank") <= F.col("degree") + 1) & (F.col("i") != F.col("j")))
    return near.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("dist").alias("dist"))


def module_map(profiles: DataFrame, sharpness: float = 10.0, least: float = 0.01) -> DataFrame:
    """(a, b, weight): exp(k |cos|) / exp(k) with the cosine's sign, where it is above `least`."""
    cos = pairwise(profiles, "angular").withColumn("cos", F.cos("dist"))
    strength = F.exp(sharpness * F.abs("cos") - sharpness)
    return cos.withColumn("weight", strength * F.signum("cos")).where(F.abs("weight") > least).select("a", "b", "weight")


def shortest_paths(edges: DataFrame, root: int) -> DataFrame:
    """(id, dist): least path length from `root` over directed edges (a, b, weight), by relaxation until nothing improves."""
    spark = edges.sparkSession
    now = spark.createDataFrame([(root, 0.0)], "id long, dist double")
    while True:
        reached = now.select(F.col("id").alias("a"), "dist").join(edges, "a").select(F.col("b").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"))
        better = cut_lineage(now.unionByName(reached).groupBy("id").agg(F.min("dist").alias("dist")))
        changed = better.join(now.withColumnRenamed("dist", "was"), "id", "left").where("was IS NULL OR dist < was")
        now, done = better, changed.isEmpty()
        if done:
            return now


def force_layout(nodes: list[int], edges: list[tuple[int, int, float]], rounds: int = 200, seed: int = 1, start: dict | None = None) -> dict[int, tuple[float, float]]:
    """Positions by attraction along edges, degree-weighted repulsion and gravity, with a cooling step; repeatable."""
    if len(nodes) > 20_000:
        raise ValueError("too many nodes for a layout on the driver")
    at = {n: k for k, n in enumerate(nodes)}
    rng = np.random.default_rng(seed)
    pos = np.array([start[n] for n in nodes], float) if start else rng.normal(size=(len(nodes), 2)) * 10
    mass = np.ones(len(nodes))
    ends = np.array([(at[a], at[b]) for a, b, _ in edges], dtype=int).reshape(-1, 2)
    weight = np.array([w for *_, w in edges], float)
    np.add.at(mass, ends.ravel(), 1)
    for r in range(rounds):
        force = -pos * (mass / (np.linalg.norm(pos, axis=1) + 1e-9))[:, None]
        for low in range(0, len(nodes), 512):
            away = pos[low : low + 512, None, :] - pos[None, :, :]
            square = (away**2).sum(2) + 1e-6
            force[low : low + 512] += (away * (10 * mass[low : low + 512, None] * mass[None, :] / square)[:, :, None]).sum(1)
        pull = (pos[ends[:, 1]] - pos[ends[:, 0]]) * weight[:, None]
        np.add.at(force, ends[:, 0], pull)
        np.add.at(force, ends[:, 1], -pull)
        size = np.linalg.norm(force, axis=1, keepdims=True) + 1e-9
        pos = pos + force / size * np.minimum(size / mass[:, None], 5.0 * (1 - r / rounds))
    return {n: (float(pos[k, 0]), float(pos[k, 1])) for n, k in at.items()}


def start_layout(points: DataFrame, dim: int, extent: float = 5000.0) -> DataFrame:
    """(id, x, y): start positions from the two first principal components of (id, vec), scaled so that the farthest coordinate is `extent`."""
    from cairn.operators.statistics import principal_components, projected

    mean, axes, _ = principal_components(points, dim, 2)
    flat = projected(points, mean, axes)
    top = flat.agg(F.greatest(F.max(F.abs("pc1")), F.max(F.abs("pc2"))).alias("top")).first()["top"] or 1.0
    return flat.select("id", (F.col("pc1") * (extent / top)).alias("x"), (F.col("pc2") * (extent / top)).alias("y"))


def distance_preservation(high: DataFrame, low: DataFrame, anchors: int = 100) -> DataFrame:
    """(anchor, id, high, low): distances from the first `anchors` points by id in both spaces; (id, vec) each."""
    chosen = high.join(low.select("id", F.col("vec").alias("vl")), "id").orderBy("id").limit(anchors).select(F.col("id").alias("anchor"), F.col("vec").alias("ah"), F.col("vl").alias("al"))
    both = high.select("id", F.col("vec").alias("vh")).join(low.select("id", F.col("vec").alias("vl")), "id")
    pairs = both.join(F.broadcast(chosen))  # `anchors` rows
    return pairs.select("anchor", "id", V.euclidean(F.col("ah"), F.col("vh")).alias("high"), V.euclidean(F.col("al"), F.col("vl")).alias("low"))


def subgraph(edges: DataFrame, node: int) -> DataFrame:
    """Nodes that are connected to `node`."""
    found = components(edges)
    return found.join(found.where(F.col("id") == node).select("component"), "component").select("id")


def write_gml(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """An undirected graph as GML with weight 1.0 for every edge; cluster-level, written by the driver."""
    lines = ["graph [", "  directed 0"]
    lines += [f'  node [ id {r["id"]} label "{r["label"]}" ]' for r in sorted(_on_driver(nodes.select("id", "label")), key=lambda r: r["id"])]
    lines += [f"  edge [ source {r['a']} target {r['b']} weight 1.0 ]" for r in sorted(_on_driver(edges.select("a", "b")))]
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join([*lines, "]", ""]))
