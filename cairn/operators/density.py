"""Clustering by density gradients: densities from neighbour tables, links uphill, roots, merging of roots, assignment.

Points are (id, vec). A point's density is minus the sum of its K nearest distances (itself first, at 0). Its parent is
the nearest of its first `reach` neighbours that is denser; equal densities count as denser for the smaller id, so
links never form a cycle. Points without a parent are roots.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators.knn import distances, knn, nearest, resolved
from cairn.session import cut_lineage

#: Shares of the first root at which the path between two roots is probed.
PROBES = tuple(round(0.05 * i, 2) for i in range(1, 19))
DIGITS = 9
MOST_ROOTS, MOST_SETS = 5_000, 100


def default_range(dim: int, n: int) -> dict[str, int]:
    """Default K range and link reach for data of this dimension and size. The curves' coefficients and limits."""
    high = int(min(1000, max(3, 2890 * dim**-0.8)))
    low = int(min(1000, max(3, 1942 * dim**-1.61)))
    return {"k_max": high, "k_min": low, "reach": max((dim + 1) // 2, -math.ceil(math.log2(0.01 / n)))}


def older_default_range(dim: int) -> tuple[int, int]:
    """An older default K range. Coefficients and limits."""
    return max(-12 * dim * dim + 1050, 150), max(5, int(-0.38 * dim**1.5 + 11))


def sweep(k_max: int, k_min: int, steps: int = 30, quadratic: bool = False) -> list[int]:
    """Different K from k_max down to k_min, evenly or evenly in their square roots."""
    if quadratic:
        values = np.linspace(math.sqrt(k_max), math.sqrt(k_min), steps) ** 2
    else:
        values = np.linspace(k_max, k_min, steps)
    return sorted({int(round(v)) for v in values}, reverse=True)


def densities(neighbours: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(id, density) from a neighbour table (i, j, rank, dist) of at least k ranks; rounded, so that order of summation does not show."""
    return neighbours.where(F.col("rank") <= k).groupBy(F.col("i").alias("id")).agg(F.round(-F.sum("dist"), digits).alias("density"))


def mean_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, mean_dist) over ranks 2 to k."""
    return neighbours.where(F.col("rank").between(2, k)).groupBy(F.col("i").alias("id")).agg(F.avg("dist").alias("mean_dist"))


def nearest_mean_kernel(neighbours: DataFrame, n: int) -> DataFrame:
    """(id, density): exp(-10 * mean distance of the n nearest)."""
    return neighbours.where(F.col("rank") <= n).groupBy(F.col("i").alias("id")).agg(F.exp(-10 * F.avg("dist")).alias("density"))


def parents(neighbours: DataFrame, density: DataFrame, reach: int) -> DataFrame:
    """(id, density, parent): the nearest denser neighbour of ranks 2 to reach; null for roots."""
    near = neighbours.where(F.col("rank").between(2, reach))
    other = density.select(F.col("id").alias("j"), F.col("density").alias("dj"))
    linked = near.join(density.select(F.col("id").alias("i"), F.col("density").alias("di")), "i").join(other, "j")
    linked = linked.where("dj > di OR (dj = di AND j < i)").groupBy(F.col("i").alias("id")).agg(F.min_by("j", F.struct("dist", "j")).alias("parent"))
    return density.join(linked, "id", "left")


def sweep_links(neighbours: DataFrame, ks: list[int], reach: int, digits: int = DIGITS) -> DataFrame:
    """(k, id, density, parent) for every K at once, from one neighbour table.

    One aggregate over the ranked distances gives a point's densities at all K as an array; neighbours are joined to
    the arrays once, and only the parents are kept by K.
    """
    sums = [F.round(-F.sum(F.when(F.col("rank") <= k, F.col("dist"))), digits) for k in ks]
    dens = cut_lineage(neighbours.where(F.col("rank") <= max(ks)).groupBy(F.col("i").alias("id")).agg(F.array(*sums).alias("dens")))
    near = neighbours.where(F.col("rank").between(2, reach))
    both = near.join(dens.select(F.col("id").alias("i"), F.col("dens").alias("di")), "i").join(dens.select(F.col("id").alias("j"), F.col("dens").alias("dj")), "j")
    denser = F.expr(f"filter(sequence(0, {len(ks) - 1}), n -> dj[n] > di[n] OR (dj[n] = di[n] AND j < i))")
    linked = both.select(F.col("i").alias("id"), "j", "dist", F.explode(denser).alias("n")).groupBy("id", "n").agg(F.min_by("j", F.struct("dist", "j")).alias("parent"))
    every = dens.select("id", F.posexplode("dens").alias("n", "density")).join(linked, ["id", "n"], "left")
    return every.select(F.array(*map(F.lit, ks))[F.col("n")].alias("k"), "id", "density", "parent")


def roots_of(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, root) by pointer doubling over (keys, id, parent): each round halves every path, so rounds grow with the logarithm of the depth."""
    now = cut_lineage(links.select(*keys, "id", F.coalesce("parent", "id").alias("root")))
    while True:
        beyond = now.select(*keys, F.col("id").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(beyond, [*keys, "root"]).select(*keys, "id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = step.select(*keys, "id", "root")
        if step.where("moved").isEmpty():
            return now


def gabriel_edges(points: DataFrame, metric: str = "angular") -> DataFrame:
    """(a, b): pairs of a cluster-level set (id, vec) to whose midpoint no third point is nearer than the two ends.

    Under the angular metric vectors count by direction alone: the midpoint is that of the unit vectors. Points on the
    border (within 1e-9) do not part a pair. The set's size is checked before it is sent to the tasks, each of which
    takes some of the first ends.
    """
    return gabriel_edges_by(points.select(F.lit(0).alias("k"), "id", "vec"), metric).select("a", "b")


def gabriel_edges_by(points: DataFrame, metric: str = "angular") -> DataFrame:
    """(k, a, b): gabriel_edges of each of several cluster-level sets (k, id, vec), which may share points."""
    sizes = points.groupBy("k").count().agg(F.max("count"), F.count("*")).first()
    if (sizes[0] or 0) > MOST_ROOTS or (sizes[1] or 0) > MOST_SETS:
        raise ValueError(f"more than {MOST_ROOTS} points to test for adjacency, or more than {MOST_SETS} sets of them")
    rows = points.select("id", "vec").dropDuplicates(["id"]).limit(MOST_ROOTS * 4 + 1).collect()
    if len(rows) > MOST_ROOTS * 4:
        raise ValueError(f"more than {MOST_ROOTS * 4} points in all sets to test for adjacency")
    rows.sort(key=lambda r: r["id"])
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    vectors = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    if metric == "angular":
        vectors = unit_rows(vectors)
    between, sets = resolved(metric), {}
    for r in points.select("k", "id").collect():  # MOST_ROOTS in each of MOST_SETS
        sets.setdefault(r["k"], []).append(r["id"])
    sets = {k: np.searchsorted(ids, np.unique(own)) for k, own in sets.items()}

    def run(frames):
        for frame in frames:
            for k, n in zip(frame["k"], frame["n"], strict=True):
                own = sets[k]
                i, ends, found = own[n], own[n + 1 :], []
                for low in range(0, len(ends), 256):
                    j = ends[low : low + 256]
                    middle = (vectors[i] + vectors[j]) / 2
                    far = distances(middle, vectors[own], between)
                    half = far[:, n].copy()
                    far[:, n] = far[np.arange(len(j)), np.searchsorted(own, j)] = np.inf
                    found.append(j[far.min(1) >= half - 1e-9])
                right = np.concatenate(found) if found else ends
                yield pd.DataFrame({"k": np.full(len(right), k, dtype=np.int32), "a": np.full(len(right), ids[i]), "b": ids[right]})

    spark = points.sparkSession
    work = spark.createDataFrame([(int(k), len(own)) for k, own in sorted(sets.items())], "k int, size int").where("size > 0")
    work = work.select("k", F.explode(F.expr("sequence(0, size - 1)")).alias("n")).repartition(spark.sparkContext.defaultParallelism)
    return work.mapInPandas(run, "k int, a long, b long")


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def merged_roots(points: DataFrame, links: DataFrame, k: int, metric: str = "angular", digits: int = DIGITS) -> DataFrame:
    """`links` with each root tied to the most similar Gabriel neighbour among the roots that is denser and to which no probe of the path is thinner than the root itself.

    Under the angular metric adjacency, path and probes are those of the unit vectors.
    """
    return merged_sweep(points, links.withColumn("k", F.lit(k)), k, metric, digits).select("id", "density", "parent")


def merged_sweep(points: DataFrame, links: DataFrame, most: int, metric: str = "angular", digits: int = DIGITS) -> DataFrame:
    """merged_roots() of the links (k, id, density, parent) of every K, the greatest of which is `most`, at once."""
    end = V.unit(F.col("vec")) if metric == "angular" else F.col("vec")
    roots = cut_lineage(links.where("parent IS NULL").select("k", "id", "density").join(points.select("id", end.alias("vec")), "id"))
    edges = gabriel_edges_by(roots.select("k", "id", "vec"), metric)
    both = edges.unionByName(edges.select("k", F.col("b").alias("a"), F.col("a").alias("b")))
    low = roots.select("k", F.col("id").alias("a"), F.col("density").alias("da"), F.col("vec").alias("va"))
    high = roots.select("k", F.col("id").alias("b"), F.col("density").alias("db"), F.col("vec").alias("vb"))
    pairs = both.join(low, ["k", "a"]).join(high, ["k", "b"]).where("db > da OR (db = da AND b < a)")
    pairs = cut_lineage(pairs.withColumn("pair", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers

    def open_at(some: DataFrame, shares) -> DataFrame:
        probes = some.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
        share = F.array(*map(F.lit, shares))[F.col("n")]
        ids = -(10**12) - (F.col("pair") * len(shares) + F.col("n"))
        near = nearest(probes.select(ids.alias("id"), V.blend(F.col("va"), F.col("vb"), share).alias("vec")), points.select("id", "vec"), most, metric)
        near = near.join(probes.select(ids.alias("i"), "k", "pair", "da"), "i").where(F.col("rank") <= F.col("k"))
        thickness = near.groupBy("i", "pair", "da").agg(F.round(-F.sum("dist"), digits).alias("thickness"))
        opened = thickness.groupBy("pair").agg(F.bool_and(F.col("thickness") >= F.col("da")).alias("open")).where("open")
        return cut_lineage(some.join(opened.select("pair"), "pair", "left_semi"))

    # Most paths are thin at their middle, so the other probes are for the few that are not.
    left = open_at(open_at(pairs, PROBES[9:10]), PROBES[:9] + PROBES[10:])
    ways = left.select("k", F.col("a").alias("id"), "b", V.metric(metric)(F.col("va"), F.col("vb")).alias("dist"))
    tied = ways.groupBy("k", "id").agg(F.min_by("b", F.struct("dist", "b")).alias("tied"))
    return links.join(tied, ["k", "id"], "left").select("k", "id", "density", F.coalesce("parent", "tied").alias("parent"))


def clusters(points: DataFrame, k: int, reach: int, metric: str = "angular", merge: bool = True, neighbours: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """(id, cluster): the id of the root that each point's links lead to. The neighbour table is made once."""
    table = cut_lineage(knn(points, max(k, reach), metric)) if neighbours is None else neighbours
    links = cut_lineage(parents(table, densities(table, k, digits), reach))
    return roots_of(merged_roots(points, links, k, metric, digits) if merge else links).withColumnRenamed("root", "cluster")


def clusters_of_all(points: DataFrame, ks: list[int], reach: int, metric: str = "angular", merge: bool = False, digits: int = DIGITS, neighbours: DataFrame | None = None) -> DataFrame:
    """(k, id, cluster) of every K by one chain of jobs: links, merging and pointer doubling go by (K, id)."""
    table = cut_lineage(knn(points, max([*ks, reach]), metric)) if neighbours is None else neighbours
    links = cut_lineage(sweep_links(table, ks, reach, digits))
    if merge:
        links = cut_lineage(merged_sweep(points, links, max(ks), metric, digits))
    return roots_of(links, ("k",)).withColumnRenamed("root", "cluster")


def k_sweep(points: DataFrame, ks: list[int], reach: int, metric: str = "angular", merge: bool = False, digits: int = DIGITS) -> DataFrame:
    """(k, n_clusters) of every K: the roots are the links' ends, so without assignment of the points."""
    table = cut_lineage(knn(points, max([*ks, reach]), metric))
    links = sweep_links(table, ks, reach, digits)
    if merge:
        links = merged_sweep(points, cut_lineage(links), max(ks), metric, digits)
    return links.where("parent IS NULL").groupBy("k").agg(F.count("*").alias("n_clusters"))


def elbow(counts: dict[int, int]) -> int:
    """The K at the elbow of (K, clusters): an exponential fit below and a line above a break, of least squared error together."""
    ks = sorted(counts)
    if len(ks) < 5:
        return ks[-1]
    x, y = np.array(ks, float), np.array([counts[k] for k in ks], float)

    def error(part, values):
        fit = np.polyval(np.polyfit(part, values, 1), part)
        return fit

    best = None
    for cut in range(2, len(ks) - 2):
        low = np.exp(error(x[:cut], np.log(np.maximum(y[:cut], 1e-9))))
        high = error(x[cut:], y[cut:])
        total = float(((low - y[:cut]) ** 2).sum() + ((high - y[cut:]) ** 2).sum())
        if best is None or total < best[0]:
            best = (total, ks[cut])
    return best[1]


def auto_clusters(points: DataFrame, dim: int, metric: str = "angular", steps: int = 12, merge: bool = False) -> tuple[int, DataFrame]:
    """The K at the elbow of a sweep over the default range, and its clusters (id, cluster), all from one neighbour table."""
    n = points.count()
    given = default_range(dim, n)
    ks = sweep(min(given["k_max"], n - 1), max(2, given["k_min"]), steps, quadratic=True)
    every = cut_lineage(clusters_of_all(points, ks, given["reach"], metric, merge))
    counts = {r["k"]: r["n"] for r in every.groupBy("k").agg(F.countDistinct("cluster").alias("n")).collect()}  # a row for each K
    k = elbow(counts)
    return k, every.where(F.col("k") == k).select("id", "cluster")


def merge_by_mahalanobis(stats: list[dict], threshold: float = 2.0, shrink: float = 1.03) -> dict[int, int]:
    """cluster -> merged cluster: the closest pair merges while nearer than `threshold`.

    `stats` has for each cluster: cluster, n, sums and squares (arrays); it is cluster-level and must fit the driver.
    Distance is the length of the mean difference over the mean of the two spreads (n - 1, divided by `shrink`); a
    single member or a dimension without spread blocks a merge.
    """
    if len(stats) > 2_000:
        raise ValueError("too many clusters to merge on the driver")
    have = {s["cluster"]: (s["n"], np.array(s["sums"], float), np.array(s["squares"], float), [s["cluster"]]) for s in stats}

    def far(a, b):
        (na, sa, qa, _), (nb, sb, qb, _) = have[a], have[b]
        if na < 2 or nb < 2:
            return math.inf
        spread = [np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)) / shrink for n, s, q in ((na, sa, qa), (nb, sb, qb))]
        mean = (spread[0] + spread[1]) / 2
        return math.inf if (mean <= 0).any() else float(np.sqrt((((sa / na - sb / nb) / mean) ** 2).sum()))

    known = {}
    while len(have) > 1:
        ids = list(have)
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if (b, a) not in known:
                    known[b, a] = far(a, b)
        (a, b), least = min(((p, d) for p, d in known.items() if p[0] in have and p[1] in have), key=lambda x: (x[1], x[0]))
        if least >= threshold:
            break
        (na, sa, qa, ma), (nb, sb, qb, mb) = have.pop(a), have.pop(b)
        have[min(ma + mb)] = (na + nb, sa + sb, qa + qb, ma + mb)
        known = {p: d for p, d in known.items() if a not in p and b not in p}
    return {m: c for c, (_, _, _, members) in have.items() for m in members}


def mean_shift(points: DataFrame, start: list[float], bandwidth: float, ratio: float = 1e-3, rounds: int = 50) -> list[float]:
    """One centre moved to the Gaussian-weighted mean of all points until it moves by less than `ratio` of the bandwidth.

    A centre that still moves after `rounds` is an error.
    """
    centre, dim = list(start), len(start)
    for _ in range(rounds):
        at = F.array(*[F.lit(float(c)) for c in centre])
        weighted = points.withColumn("w", F.exp(-F.pow(V.euclidean(F.col("vec"), at) / bandwidth, 2) / 2))
        row = weighted.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("vec")[i]).alias(f"s{i}") for i in range(dim)]).first()
        moved = [row[f"s{i}"] / row["w"] for i in range(dim)]
        if math.dist(moved, centre) < ratio * bandwidth:
            return moved
        centre = moved
    raise RuntimeError(f"the centre still moves after {rounds} rounds")
