"""Queries on nearest neighbours, densities, links, clusters, trees and graphs over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import aggregates, density, graphs, hierarchy, joins, knn, metric, statistics
from cairn.plans.base import DIM, C, P, angle, centroids, points, query, r6
from cairn.session import cut_lineage

K, REACH = 10, 16

KNN = P + f""", d AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0.0 ELSE {angle('a.v', 'b.v')} END AS dist FROM p a, p b),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, dist FROM d)"""
EUCLID = P + """, d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM p a, p b),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, dist FROM d)"""
DENS = KNN + f", dens AS (SELECT i AS id, round(-sum(dist), 6) AS density FROM k WHERE rank <= {K} GROUP BY i)"
LINKS = DENS + f""", near AS (SELECT k.i, k.j, k.dist FROM k JOIN dens a ON a.id = k.i JOIN dens b ON b.id = k.j
  WHERE rank BETWEEN 2 AND {REACH} AND (b.density > a.density OR (b.density = a.density AND k.j < k.i))),
links AS (SELECT dens.id, dens.density, (SELECT arg_min(near.j, near.dist) FROM near WHERE near.i = dens.id) AS parent FROM dens)"""
WALK = LINKS.replace("WITH ", "", 1) + """, walk AS (SELECT id, coalesce(parent, id) AS cur FROM links
  UNION SELECT walk.id, coalesce(links.parent, walk.cur) FROM walk JOIN links ON links.id = walk.cur),
roots AS (SELECT walk.id, walk.cur AS cluster FROM walk JOIN links ON links.id = walk.cur WHERE links.parent IS NULL)"""


def table_of(spark, d, k=max(K, REACH), metric="angular"):
    return knn.knn(points(spark, d), k, metric)


def densities(spark, d, neighbours=None):
    return density.densities(table_of(spark, d) if neighbours is None else neighbours, K, 6)


def links(spark, d):
    near = cut_lineage(table_of(spark, d))
    return cut_lineage(density.parents(near, densities(spark, d, near), REACH))


def assignment(spark, d):
    return density.roots_of(links(spark, d)).withColumnRenamed("root", "cluster")


@query("knn_angular", f"WITH {KNN} SELECT i, j, rank, round(dist, 6) AS dist FROM k WHERE rank <= 11")
def knn_angular(spark, d):
    return table_of(spark, d, 11).select("i", "j", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("knn_euclidean", f"WITH {EUCLID} SELECT i, j, rank, round(dist, 6) AS dist FROM k WHERE rank <= 11")
def knn_euclidean(spark, d):
    return table_of(spark, d, 11, "euclidean").select("i", "j", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("knn_pruned", f"WITH {EUCLID} SELECT i, j, rank, round(dist, 6) AS dist FROM k WHERE rank <= 6")
def knn_pruned(spark, d):
    return metric.nearest_in_metric(points(spark, d), 6, "euclidean").select("i", "j", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query(
    "knn_range_limited",
    f"""WITH {P}, d AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0.0 ELSE {angle('a.v', 'b.v')} END AS dist FROM p a JOIN p b ON abs(a.label - b.label) <= 1)
SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, round(dist, 6) AS dist FROM d QUALIFY rank <= 11""",
)
def knn_range_limited(spark, d):
    return metric.nearest_in_metric(points(spark, d), 11, limits={"label": 1}).select("i", "j", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("knn_density", f"WITH {DENS} SELECT id, density FROM dens")
def knn_density(spark, d):
    return densities(spark, d)


@query("knn_mean_distance", f"WITH {KNN} SELECT i AS id, round(avg(dist), 6) AS mean_dist FROM k WHERE rank BETWEEN 2 AND {K} GROUP BY i")
def knn_mean_distance(spark, d):
    return density.mean_distances(table_of(spark, d), K).select("id", r6("mean_dist").alias("mean_dist"))


@query("nnn_kernel_density", f"WITH {KNN} SELECT i AS id, round(exp(-10 * avg(dist)), 6) AS density FROM k WHERE rank <= {K} GROUP BY i")
def nnn_kernel_density(spark, d):
    return density.nearest_mean_kernel(table_of(spark, d), K).select("id", r6("density").alias("density"))


@query("gaussian_density", f"WITH {P} SELECT a.id, round(sum(exp(-power(list_distance(a.v, b.v), 2) / 0.5)), 5) AS density FROM p a, p b GROUP BY a.id")
def gaussian_density(spark, d):
    return knn.kernel_sums(points(spark, d), "gaussian", 0.5).select("id", r6("density", 5).alias("density"))


@query("vmf_density_unnormalised", f"WITH {P} SELECT a.id, round(sum(exp(5 * cos({angle('a.v', 'b.v')}))), 4) AS density FROM p a, p b GROUP BY a.id")
def vmf_density(spark, d):
    return knn.kernel_sums(points(spark, d), "vmf", 5.0).select("id", r6("density", 4).alias("density"))


@query("parent_links", f"WITH {LINKS} SELECT id, density, parent FROM links")
def parent_links(spark, d):
    return links(spark, d)


@query("density_roots", f"WITH {LINKS} SELECT id, density FROM links WHERE parent IS NULL")
def density_roots(spark, d):
    return links(spark, d).where("parent IS NULL").select("id", "density")


@query("gradient_assignment", f"WITH RECURSIVE {WALK} SELECT id, cluster FROM roots")
def gradient_assignment(spark, d):
    return assignment(spark, d)


@query(
    "gradient_cluster_profiles",
    f"""WITH RECURSIVE {WALK}, x AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM roots JOIN p USING (id))
SELECT cluster, dim::INT AS dim, count(*) AS size, round(avg(x), 6) AS value FROM x GROUP BY cluster, dim""",
)
def gradient_cluster_profiles(spark, d):
    profiles = aggregates.mean_profile(points(spark, d).join(assignment(spark, d), "id"), ["cluster"], DIM)
    return aggregates.by_place(profiles, "profile", ["cluster", "size"]).withColumn("value", r6("value"))


MIDDLE = "list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) / 2)"
MERGED = LINKS + f""", r AS (SELECT links.id, links.density, list_transform(p.v, lambda x: x / sqrt(list_dot_product(p.v, p.v))) AS u FROM links JOIN p USING (id) WHERE parent IS NULL),
g AS (SELECT x.id AS a, y.id AS b, x.density AS da, x.u AS va, y.u AS vb, {MIDDLE.format(a='x.u', b='y.u')} AS mid FROM r x JOIN r y ON y.density > x.density OR (y.density = x.density AND y.id < x.id)),
parted AS (SELECT DISTINCT g.a, g.b FROM g JOIN r t ON t.id <> g.a AND t.id <> g.b AND {angle('g.mid', 't.u')} < {angle('g.mid', 'g.va')} - 1e-9),
probe AS (SELECT a, b, da, share, list_transform(list_zip(va, vb), lambda z: share * z[1] + (1 - share) * z[2]) AS v
  FROM g ANTI JOIN parted USING (a, b), (SELECT round(0.05 * i, 2) AS share FROM range(1, 19) s(i))),
far AS (SELECT a, b, da, share, {angle('probe.v', 'p.v')} AS dist FROM probe, p),
thick AS (SELECT a, b, da, share, round(-sum(dist), 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY a, b, share ORDER BY dist) AS n FROM far) WHERE n <= {K} GROUP BY a, b, da, share),
opened AS (SELECT a, b FROM thick GROUP BY a, b HAVING bool_and(density >= da)),
tied AS (SELECT a AS id, arg_min(b, (dist, b)) AS tied FROM (SELECT g.a, g.b, {angle('g.va', 'g.vb')} AS dist FROM g SEMI JOIN opened USING (a, b)) GROUP BY a),
merged AS (SELECT links.id, links.density, coalesce(parent, tied) AS parent FROM links LEFT JOIN tied USING (id))"""


@query("root_merge", f"WITH {MERGED} SELECT id, density, parent FROM merged")
def root_merge(spark, d):
    """Links of all points after roots are tied along open paths."""
    return density.merged_roots(points(spark, d), links(spark, d), K, digits=6)


@query(
    "density_clusters",
    f"""WITH RECURSIVE {MERGED}, walk AS (SELECT id, coalesce(parent, id) AS cur FROM merged UNION SELECT walk.id, coalesce(merged.parent, walk.cur) FROM walk JOIN merged ON merged.id = walk.cur)
SELECT walk.id, walk.cur AS cluster FROM walk JOIN merged ON merged.id = walk.cur WHERE merged.parent IS NULL""",
)
def density_clusters(spark, d):
    return density.clusters(points(spark, d), K, REACH, digits=6)


#: Every K of a sweep at once: densities, links and the numbers of roots. SWEPT takes the values of K, and the reach.
SWEPT = KNN + """, ks AS (SELECT unnest([{ks}]) AS kk),
dens AS (SELECT kk, i AS id, round(-sum(dist), 9) AS density FROM k JOIN ks ON rank <= kk GROUP BY kk, i),
ups AS (SELECT a.kk, a.id, arg_min(k.j, (k.dist, k.j)) AS parent FROM dens a JOIN k ON k.i = a.id AND k.rank BETWEEN 2 AND {reach} JOIN dens b ON b.id = k.j AND b.kk = a.kk
  WHERE b.density > a.density OR (b.density = a.density AND b.id < a.id) GROUP BY a.kk, a.id),
links AS (SELECT dens.kk, dens.id, parent FROM dens LEFT JOIN ups USING (kk, id)),
counts AS (SELECT kk, count(*) AS n FROM links WHERE parent IS NULL GROUP BY kk)"""
SWEEP = density.sweep(60, 3, 30)
AUTO = density.sweep(103, 3, 12, quadratic=True)  # the default range of 64 dimensions
AUTO_REACH = 32


@query("k_sweep", f"WITH {SWEPT.format(ks=', '.join(map(str, SWEEP)), reach=REACH)} SELECT kk::INTEGER AS k, n AS n_clusters FROM counts")
def k_sweep(spark, d):
    """Numbers of clusters for 30 values of K, from one neighbour table by one chain of jobs."""
    return density.k_sweep(points(spark, d), SWEEP, REACH)


@query(
    "auto_clusters",
    f"""WITH RECURSIVE {SWEPT.format(ks=', '.join(map(str, AUTO)), reach=AUTO_REACH)},
y AS (SELECT kk, n, row_number() OVER (ORDER BY kk) - 1 AS n_th FROM counts),
fits AS (SELECT cut, regr_slope(ln(n), kk) FILTER (WHERE n_th < cut) AS a, regr_intercept(ln(n), kk) FILTER (WHERE n_th < cut) AS b, regr_slope(n, kk) FILTER (WHERE n_th >= cut) AS c, regr_intercept(n, kk) FILTER (WHERE n_th >= cut) AS e
  FROM y, (SELECT unnest(range(2, {len(AUTO) - 2})) AS cut) GROUP BY cut),
breaks AS (SELECT cut, sum(CASE WHEN n_th < cut THEN (exp(a * kk + b) - n) ** 2 ELSE (c * kk + e - n) ** 2 END) AS error FROM fits, y GROUP BY cut),
chosen AS (SELECT kk FROM y WHERE n_th = (SELECT arg_min(cut, (error, cut)) FROM breaks)),
own AS (SELECT id, parent FROM links WHERE kk = (SELECT kk FROM chosen)),
walk AS (SELECT id, id AS cur FROM own UNION SELECT walk.id, own.parent FROM walk JOIN own ON own.id = walk.cur WHERE own.parent IS NOT NULL)
SELECT walk.id, walk.cur AS cluster, (SELECT kk FROM chosen)::INTEGER AS k FROM walk JOIN own ON own.id = walk.cur WHERE own.parent IS NULL""",
)
def auto_clusters(spark, d):
    """The elbow of the sweep over the default range, and the clusters at it."""
    k, found = density.auto_clusters(points(spark, d), DIM)
    return found.withColumn("k", F.lit(k))


@query(
    "density_batch",
    f"""WITH RECURSIVE {SWEPT.format(ks='5, 10', reach=REACH)},
walk AS (SELECT kk, id, id AS cur FROM links UNION SELECT walk.kk, walk.id, links.parent FROM walk JOIN links ON links.kk = walk.kk AND links.id = walk.cur WHERE links.parent IS NOT NULL)
SELECT 'embeddings' AS dataset, 'k=' || walk.kk || ', merge=False, reach={REACH}' AS parameters, walk.id, walk.cur AS cluster FROM walk JOIN links ON links.kk = walk.kk AND links.id = walk.cur WHERE links.parent IS NULL""",
)
def density_batch(spark, d):
    """An algorithm by name, over a grid of parameters."""
    from cairn.operators.registry import batch

    return batch("density", {"embeddings": points(spark, d)}, [{"k": k, "reach": REACH, "merge": False} for k in (5, 10)])


MODELS = C + """, mv AS (SELECT label, d, avg(x) AS m, sqrt(greatest(coalesce(var_samp(x), 0), 0.19)) AS s FROM long GROUP BY label, d)"""


@query(
    "nearest_centroid",
    f"WITH {C}, q AS (SELECT p.id, c.id AS centre, round({angle('p.v', 'c.v')}, 12) AS dist FROM p, c) SELECT id, arg_min(centre, (dist, centre)) AS centre, round(min(dist), 6) AS dist FROM q GROUP BY id",
)
def nearest_centroid(spark, d):
    found = joins.nearest_centre(points(spark, d), centroids(spark, d).select(F.col("id").alias("centre"), F.col("vec").alias("profile")))
    return found.select("id", "centre", r6("dist").alias("dist"))


def reject_sql(most: float) -> str:
    return f"""WITH {C}, q AS (SELECT p.id, c.id AS centre, round({angle('p.v', 'c.v')}, 12) AS dist FROM p, c),
b AS (SELECT id, arg_min(centre, (dist, centre)) AS centre, min(dist) AS dist FROM q GROUP BY id)
SELECT CASE WHEN dist <= {most} THEN centre END AS centre, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY 1"""


def rejecting(spark, d, most):
    found = joins.nearest_centre(points(spark, d), centroids(spark, d).select(F.col("id").alias("centre"), F.col("vec").alias("profile")), most=most)
    return aggregates.shares(found, "centre").withColumn("share", r6("share"))


@query("nearest_with_reject", reject_sql(1.0))
def nearest_with_reject(spark, d):
    return rejecting(spark, d, 1.0)


@query("nearest_with_wide_reject", reject_sql(1.35))
def nearest_with_wide_reject(spark, d):
    """A limit that keeps about half of the given vectors, which are nearly at right angles to their centroids."""
    return rejecting(spark, d, 1.35)


MAHA = f"""WITH {MODELS}, q AS (SELECT l.id, mv.label AS centre, round(sqrt(sum(((l.x - mv.m) / mv.s) ** 2)), 12) AS dist FROM long l JOIN mv ON mv.d = l.d GROUP BY l.id, mv.label),
b AS (SELECT id, arg_min(centre, (dist, centre)) AS centre, min(dist) AS dist FROM q GROUP BY id)"""


@query("nearest_mahalanobis", MAHA + " SELECT id, centre, round(dist, 6) AS dist FROM b")
def nearest_mahalanobis(spark, d):
    found = joins.nearest_mahalanobis(points(spark, d), joins.models(points(spark, d), "label", DIM))
    return found.select("id", "centre", r6("dist").alias("dist"))


@query("classify_stream_static", MAHA + " SELECT id, CASE WHEN dist <= 2.2 THEN centre END AS centre, round(dist, 6) AS dist FROM b")
def classify_stream_static(spark, d):
    from cairn.streaming.classify import classified

    known = [(r["centre"], list(r["mean"]), list(r["spread"])) for r in joins.models(points(spark, d), "label", DIM).collect()]
    return classified(points(spark, d), known, 2.2).select("id", "centre", r6("dist").alias("dist"))


PAIRS = f"WITH {C}, q AS (SELECT a.id AS a, b.id AS b, {angle('a.v', 'b.v')} AS ang, list_distance(a.v, b.v) AS euc FROM c a JOIN c b ON a.id < b.id)"


@query("pairwise_distance", PAIRS + " SELECT a, b, round(ang, 6) AS dist FROM q")
def pairwise_distance(spark, d):
    return graphs.pairwise(centroids(spark, d)).withColumn("dist", r6("dist"))


@query("distance_correlation", PAIRS + " SELECT round(corr(ang, euc), 6) AS centred, round(sum(ang * euc) / sqrt(sum(ang * ang) * sum(euc * euc)), 6) AS uncentred FROM q")
def distance_correlation(spark, d):
    both = graphs.pairwise(centroids(spark, d)).join(graphs.pairwise(centroids(spark, d), "euclidean").withColumnRenamed("dist", "euc"), ["a", "b"])
    return both.agg(r6(F.corr("dist", "euc")).alias("centred"), r6(F.sum(F.col("dist") * F.col("euc")) / F.sqrt(F.sum(F.col("dist") * F.col("dist")) * F.sum(F.col("euc") * F.col("euc")))).alias("uncentred"))


@query("distance_matrix_rows", PAIRS + ", f AS (SELECT a AS id, b AS o, ang FROM q UNION ALL SELECT b, a, ang FROM q UNION ALL SELECT id, id, 0.0 FROM c) SELECT id, array_to_string(list(printf('%.5f', ang) ORDER BY o), ' ') AS line FROM f GROUP BY id")
def distance_matrix_rows(spark, d):
    from cairn.sources.sinks import distance_rows

    rows = distance_rows(graphs.pairwise(centroids(spark, d)))
    return rows.select("id", F.expr("array_join(transform(distances, x -> format_string('%.5f', x)), ' ')").alias("line"))


@query(
    "gabriel_edges",
    f"""WITH {C}, f AS (SELECT id, v[1:3] AS v FROM c), r AS (SELECT id, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM f),
g AS (SELECT x.id AS a, y.id AS b, x.v AS va, {MIDDLE.format(a='x.v', b='y.v')} AS mid, x.u AS ua, {MIDDLE.format(a='x.u', b='y.u')} AS turn FROM r x JOIN r y ON x.id < y.id)
SELECT 'euclidean' AS metric, a, b FROM g WHERE NOT EXISTS (SELECT 1 FROM r t WHERE t.id <> g.a AND t.id <> g.b AND list_distance(g.mid, t.v) < list_distance(g.mid, g.va) - 1e-9)
UNION ALL SELECT 'angular', a, b FROM g WHERE NOT EXISTS (SELECT 1 FROM r t WHERE t.id <> g.a AND t.id <> g.b AND {angle('g.turn', 't.u')} < {angle('g.turn', 'g.ua')} - 1e-9)""",
)
def gabriel_edges(spark, d):
    """Adjacency of the centroids' first three dimensions under both metrics: in 64 dimensions no point parts a pair."""
    flat = cut_lineage(centroids(spark, d).select("id", F.slice("vec", 1, 3).alias("vec")))
    euclid, turned = (density.gabriel_edges(flat, m).select(F.lit(m).alias("metric"), "a", "b") for m in ("euclidean", "angular"))
    return euclid.unionByName(turned)


@query(
    "vmf_density",
    f"""WITH {P}, constant AS (SELECT 31 * ln(5.0) - 32 * ln(2 * pi()) - ln(sum(exp((2 * i + 31) * ln(2.5) - lgamma(i + 1) - lgamma(i + 32)))) AS c FROM range(0, 60) s(i))
SELECT x.id, round(sum(exp(c + 5 * cos({angle('x.v', 'y.v')}))) / 1e20, 4) AS density FROM p x, p y, constant GROUP BY x.id""",
)
def vmf_density_normalised(spark, d):
    """Densities with their constant, in units of 1e20."""
    return knn.vmf_densities(points(spark, d), DIM, 5.0).select("id", r6(F.col("density") / 1e20, 4).alias("density"))


@query(
    "diagonal_gaussian_density",
    f"""WITH {P} SELECT x.id, round(ln(sum(exp(-0.5 * list_sum(list_transform(list_zip(x.v, y.v, range(1, 65)), lambda z: power((z[1] - z[2]) / (0.2 + 0.005 * z[3]), 2))))))
- 32 * ln(2 * pi()) - (SELECT sum(ln(0.2 + 0.005 * i)) FROM range(1, 65) s(i)), 6) AS log_density FROM p x, p y GROUP BY x.id""",
)
def diagonal_gaussian_density(spark, d):
    found = knn.diagonal_gaussian_densities(points(spark, d), [0.2 + 0.005 * i for i in range(1, DIM + 1)])
    return found.select("id", r6(F.ln("density")).alias("log_density"))


@query("knn_manhattan", "WITH " + P + """, d AS (SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 9) AS dist FROM p a, p b),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY (i <> j), dist, j) AS rank, dist FROM d) SELECT i, j, rank, round(dist, 6) AS dist FROM k WHERE rank <= 6""")
def knn_manhattan(spark, d):
    return table_of(spark, d, 6, "manhattan").select("i", "j", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query("module_map_edges", PAIRS + " SELECT a, b, round(exp(10 * abs(cos(ang)) - 10) * sign(cos(ang)), 6) AS weight FROM q WHERE exp(10 * abs(cos(ang)) - 10) > 0.01")
def module_map_edges(spark, d):
    return graphs.module_map(centroids(spark, d)).withColumn("weight", r6("weight"))


@query("module_map_soft_edges", PAIRS + " SELECT a, b, round(exp(4 * abs(cos(ang)) - 4) * sign(cos(ang)), 6) AS weight FROM q WHERE exp(4 * abs(cos(ang)) - 4) > 0.03")
def module_map_soft_edges(spark, d):
    """A flatter curve than module_map_edges, by which some of the given centroids are tied."""
    return graphs.module_map(centroids(spark, d), 4.0, 0.03).withColumn("weight", r6("weight"))


@query("knn_graph_edges", f"WITH {KNN} SELECT least(i, j) AS a, greatest(i, j) AS b, round(min(dist), 6) AS dist FROM k WHERE rank <= 5 AND i <> j GROUP BY 1, 2")
def knn_graph_edges(spark, d):
    return graphs.knn_graph(table_of(spark, d, 5), 5).withColumn("dist", r6("dist"))


@query(
    "knn_graph_in_range",
    f"""WITH {P}, d AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0.0 ELSE {angle('a.v', 'b.v')} END AS dist FROM p a JOIN p b ON abs(a.v[1] - b.v[1]) <= 0.1),
k AS (SELECT i, j, dist FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) <= 5)
SELECT least(i, j) AS a, greatest(i, j) AS b, round(min(dist), 6) AS dist FROM k WHERE i <> j GROUP BY 1, 2""",
)
def knn_graph_in_range(spark, d):
    """A graph of the nearest points among those whose first component differs by 0.1 at most."""
    rows = points(spark, d).withColumn("first", F.col("vec")[0])
    return graphs.knn_graph(metric.nearest_in_metric(rows, 5, limits={"first": 0.1}), 5).withColumn("dist", r6("dist"))


@query(
    "knn_graph_by_density",
    f"""WITH {DENS}, degree AS (SELECT id, round(2 + percent_rank() OVER (ORDER BY density) * 6)::INT AS degree FROM dens)
SELECT least(i, j) AS a, greatest(i, j) AS b, round(min(dist), 6) AS dist FROM k JOIN degree ON degree.id = k.i WHERE rank <= degree + 1 AND i <> j GROUP BY 1, 2""",
)
def knn_graph_by_density(spark, d):
    near = cut_lineage(table_of(spark, d))
    return graphs.knn_graph_by_density(near, densities(spark, d, near), 2, 8).withColumn("dist", r6("dist"))


JOINED = f"""WITH RECURSIVE {KNN}, e AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM k WHERE rank <= 2 AND i <> j),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT id, id AS r FROM p UNION SELECT w.id, s.b FROM w JOIN s ON s.a = w.r)"""


@query("connected_components", JOINED + " SELECT id, min(r) AS component FROM w GROUP BY id")
def connected_components(spark, d):
    return graphs.components(graphs.knn_graph(table_of(spark, d, 2), 2), points(spark, d))


@query("connected_subgraph", JOINED + " SELECT r AS id FROM w WHERE id = 0")
def connected_subgraph(spark, d):
    return graphs.subgraph(graphs.knn_graph(table_of(spark, d, 2), 2), 0)


@query(
    "shortest_paths",
    PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, s AS (SELECT a, b, power(ang, 3) AS w FROM q UNION ALL SELECT b, a, power(ang, 3) FROM q),
t AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS dist, 0 AS hops UNION ALL SELECT s.b, t.dist + s.w, hops + 1 FROM t JOIN s ON s.a = t.id WHERE hops < 5)
SELECT id, round(min(dist), 6) AS dist FROM t GROUP BY id""",
)
def shortest_paths(spark, d):
    """Paths between centroids over cubed angles, so that detours may be shorter."""
    edges = graphs.pairwise(centroids(spark, d)).select("a", "b", F.pow("dist", F.lit(3)).alias("weight"))
    found = graphs.shortest_paths(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), 0)
    return found.select("id", r6("dist").alias("dist"))


@query(
    "spanning_tree",
    PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT a, b, cos(ang) AS w FROM q), s AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
t AS (SELECT a, b, w, a AS node FROM e UNION SELECT t.a, t.b, t.w, s.b FROM t JOIN s ON s.a = t.node AND s.w > t.w),
kept AS (SELECT a, b, w FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = e.a AND t.b = e.b AND t.node = e.b))
SELECT a, b, round(5 * w / max(w) OVER (), 6) AS weight FROM kept""",
)
def spanning_tree(spark, d):
    return graphs.similarity_tree(centroids(spark, d)).withColumn("weight", r6("weight"))


@query("start_layout")
def start_layout(spark, d):
    return graphs.start_layout(centroids(spark, d), DIM)


@query("force_layout")
def force_layout(spark, d):
    tree = [(r["a"], r["b"], r["weight"]) for r in graphs.similarity_tree(centroids(spark, d)).collect()]
    nodes = sorted({x for a, b, _ in tree for x in (a, b)})
    return spark.createDataFrame([(n, x, y) for n, (x, y) in graphs.force_layout(nodes, tree).items()], "id long, x double, y double")


@query("linkage_average")
def linkage_average(spark, d):
    return hierarchy.linkage_table(points(spark, d), "average")


@query("linkage_regroup")
def linkage_regroup(spark, d):
    """Clusters of cluster profiles."""
    return hierarchy.linkage_table(centroids(spark, d), "complete")


CUT = f"""WITH RECURSIVE {P}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id WHERE {angle('a.v', 'b.v')} < 0.5),
w AS (SELECT id, id AS r FROM p UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r)
SELECT id, min(r) AS cluster FROM w GROUP BY id"""


@query("cut_tree", CUT)
def cut_tree(spark, d):
    return hierarchy.cut_clusters(points(spark, d), 0.5, "minimal")


@query("cut_unit_means")
def cut_unit_means(spark, d):
    return hierarchy.unit_means(hierarchy.cut_clusters(points(spark, d), 1.0, "average"), points(spark, d), DIM)


@query("thresholds_desc")
def thresholds_desc(spark, d):
    return hierarchy.thresholds(hierarchy.linkage_table(points(spark, d), "average"))


@query("marker_tree")
def marker_tree(spark, d):
    import numpy as np

    rows = centroids(spark, d).orderBy("id").collect()
    spread = np.array(aggregates.pooled_spread(points(spark, d), "label", DIM, 0.05).first()["spread"])
    tree = hierarchy.marker_tree(np.array([r["vec"] for r in rows]), [f"m{i}" for i in range(DIM)], spread)
    return spark.createDataFrame([(label, [rows[m]["id"] for m in members]) for label, members in hierarchy.leaves(tree)], "label string, members array<long>")


@query("pca_projection")
def pca_projection(spark, d):
    mean, axes, _ = statistics.principal_components(points(spark, d), DIM, 3)
    return statistics.projected(points(spark, d), mean, axes)


@query(
    "pca_total_variance",
    f"WITH {C} SELECT round(sum(v), 6) AS variance FROM (SELECT d, var_samp(x) AS v FROM long GROUP BY d)",
)
def pca_total_variance(spark, d):
    """The sum of all components' variances, which must be that of the dimensions."""
    _, _, values = statistics.principal_components(points(spark, d), DIM, DIM)
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "variance double")


@query("mahalanobis_merge")
def mahalanobis_merge(spark, d):
    stats = [r.asDict() for r in aggregates.sufficient_statistics(points(spark, d), "label", DIM).withColumnRenamed("label", "cluster").collect()]
    return spark.createDataFrame(sorted(density.merge_by_mahalanobis(stats, 8.0).items()), "cluster long, merged long")


@query(
    "mean_shift_centre",
    f"""WITH RECURSIVE {P}, long AS (SELECT id, v, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM p), step(k, c, moved) AS (
SELECT 0, list_transform(range(0, {DIM}), lambda i: 0.1::DOUBLE), 1e9::DOUBLE UNION ALL
SELECT k + 1, list(m ORDER BY d), list_distance(list(m ORDER BY d), any_value(c)) FROM (
  SELECT k, d, any_value(c) AS c, sum(x * exp(-pow(list_distance(v, c) / 0.6, 2) / 2)) / sum(exp(-pow(list_distance(v, c) / 0.6, 2) / 2)) AS m FROM step, long WHERE moved >= 0.0006 GROUP BY k, d) GROUP BY k)
SELECT (generate_subscripts(c, 1) - 1)::INT AS dim, round(unnest(c), 6) + 0.0 AS value FROM (SELECT c FROM step ORDER BY k DESC LIMIT 1)""",
)
def mean_shift_centre(spark, d):
    centre = density.mean_shift(points(spark, d), [0.1] * DIM, 0.6)
    return spark.createDataFrame(list(enumerate(centre)), "dim int, value double").withColumn("value", r6("value") + 0.0)


@query(
    "distance_preservation",
    f"""WITH {P}, a AS (SELECT id, v FROM p ORDER BY id LIMIT 100)
SELECT a.id AS anchor, round(corr(list_distance(a.v, p.v), list_distance(a.v[1:2], p.v[1:2])), 6) AS r FROM a, p GROUP BY a.id""",
)
def distance_preservation(spark, d):
    low = points(spark, d).select("id", F.slice("vec", 1, 2).alias("vec"))
    return graphs.distance_preservation(points(spark, d), low).groupBy("anchor").agg(r6(F.corr("high", "low")).alias("r"))


@query("unit_vectors", f"WITH {P} SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total FROM p")
def unit_vectors(spark, d):
    return points(spark, d).select("id", r6(V.total(V.unit(F.col("vec")))).alias("total"))


@query(
    "blended_neighbours",
    f"WITH {KNN} SELECT k.i, k.j, round(list_distance(list_transform(list_zip(a.v, b.v), lambda z: 0.25 * z[1] + 0.75 * z[2]), b.v), 6) AS to_j, round(1 / (1 + list_distance(a.v, b.v)), 6) AS similarity FROM k JOIN p a ON a.id = k.i JOIN p b ON b.id = k.j WHERE rank = 2",
)
def blended_neighbours(spark, d):
    """Weighted means of each point and its nearest other, and their similarity."""
    pts = points(spark, d)
    near = table_of(spark, d, 2).where("rank = 2").join(pts.select(F.col("id").alias("i"), F.col("vec").alias("va")), "i").join(pts.select(F.col("id").alias("j"), F.col("vec").alias("vb")), "j")
    return near.select("i", "j", r6(V.euclidean(V.blend(F.col("va"), F.col("vb"), 0.25), F.col("vb"))).alias("to_j"), r6(V.similarity(V.euclidean(F.col("va"), F.col("vb")))).alias("similarity"))
