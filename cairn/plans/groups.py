"""Queries on clusters, labelings and annotations of the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import aggregates, joins, plugins, statistics
from cairn.operators import transforms as T
from cairn.plans.base import DIM, C, P, angle, centroids, points, query, r6
from cairn.plans.neighbours import LINKS
from cairn.session import table

#: A second labeling to compare with: the id modulo 7.
OTHER = "id % 7"

#: The least length to which vectors are padded for permutations. Fixed value.
PADDING = 137_072


def labels(spark, d):
    return points(spark, d).select("id", F.col("label").alias("truth"))


def others(spark, d):
    return points(spark, d).select("id", (F.col("id") % 7).alias("found"))


def members(spark, d):
    return points(spark, d).select("id", F.col("label").alias("cluster"))


def annotations(spark, d):
    return points(spark, d).select("id", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("term"))


def long_profile(df, keys):
    return aggregates.by_place(df, "profile", keys).withColumn("value", r6("value"))


X = C.replace("generate_subscripts(v, 1) AS d", "generate_subscripts(v, 1) - 1 AS d")


@query("cluster_mean_profile", f"WITH {X} SELECT label, d::INT AS dim, count(*) AS size, round(avg(x), 6) AS value FROM long GROUP BY label, d")
def cluster_mean_profile(spark, d):
    return long_profile(aggregates.mean_profile(points(spark, d), ["label"], DIM), ["label", "size"])


@query("cluster_median_profile", f"WITH {X} SELECT label, d::INT AS dim, count(*) AS size, round(quantile_cont(x, 0.5), 6) AS value FROM long GROUP BY label, d")
def cluster_median_profile(spark, d):
    return long_profile(aggregates.median_profile(points(spark, d), ["label"], DIM), ["label", "size"])


@query("weighted_profile", f"WITH {X} SELECT label, d::INT AS dim, round(sum(x * (id % 5 + 1)) / sum(id % 5 + 1), 6) AS value FROM long GROUP BY label, d")
def weighted_profile(spark, d):
    return long_profile(aggregates.weighted_profile(points(spark, d).withColumn("w", F.col("id") % 5 + 1), ["label"], DIM, "w"), ["label"])


@query("group_statistics", f"WITH {X} SELECT label AS cluster, 't' || (id % 7) AS term, d::INT AS dim, count(*) AS size, round(quantile_cont(x, 0.5), 6) AS value FROM long GROUP BY 1, 2, 3")
def group_statistics(spark, d):
    return long_profile(aggregates.group_statistics(points(spark, d).select("id", "vec"), members(spark, d), annotations(spark, d), DIM), ["cluster", "term", "size"])


@query("pooled_sd", f"WITH {X}, m AS (SELECT label, d, avg(x) AS m FROM long GROUP BY 1, 2) SELECT long.d::INT AS dim, round(greatest(0.1, sqrt(sum((x - m) ** 2) / count(*))), 6) AS value FROM long JOIN m ON m.label = long.label AND m.d = long.d GROUP BY long.d")
def pooled_sd(spark, d):
    return aggregates.by_place(aggregates.pooled_spread(points(spark, d), "label", DIM, 0.1), "spread", []).withColumn("value", r6("value"))


@query(
    "mahalanobis_pairs",
    f"""WITH {X}, s AS (SELECT label, d, avg(x) AS m, stddev_samp(x) / 1.03 AS s FROM long GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum(((a.m - b.m) / ((a.s + b.s) / 2)) ** 2)), 6) AS dist FROM s a JOIN s b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2""",
)
def mahalanobis_pairs(spark, d):
    stats = aggregates.sufficient_statistics(points(spark, d), "label", DIM)
    mean = F.zip_with("sums", F.array_repeat("n", DIM), lambda s, n: s / n)
    spread = F.expr("transform(sums, (s, i) -> sqrt(greatest((squares[i] - s * s / n) / (n - 1), 0D)) / 1.03D)")
    each = stats.select("label", mean.alias("m"), spread.alias("s"))
    a, b = (each.select(F.col("label").alias(x), F.col("m").alias(f"m{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))  # cluster-level
    return pairs.select("a", "b", r6(F.expr("sqrt(aggregate(transform(ma, (m, i) -> pow((m - mb[i]) / ((sa[i] + sb[i]) / 2), 2)), 0D, (t, x) -> t + x))")).alias("dist"))


@query("contingency", f"WITH {P} SELECT label AS truth, {OTHER} AS found, count(*) AS n FROM p GROUP BY 1, 2")
def contingency(spark, d):
    return aggregates.contingency(labels(spark, d), others(spark, d), "truth", "found")


PRF = f"""WITH {P}, t AS (SELECT label AS truth, {OTHER} AS found, count(*) AS n FROM p GROUP BY 1, 2),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY found) AS pr, n / sum(n) OVER (PARTITION BY truth) AS rc FROM t)"""


@query("precision_recall_f", PRF + " SELECT truth, found, n, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f FROM q")
def precision_recall_f(spark, d):
    out = aggregates.precision_recall(contingency(spark, d), "truth", "found")
    return out.select("truth", "found", "n", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f").alias("f"))


@query("normalised_contingency", PRF + " SELECT truth, found, n, round(rc, 6) AS share FROM q")
def normalised_contingency(spark, d):
    return aggregates.normalised_contingency(contingency(spark, d), "truth").withColumn("share", r6("share"))


@query("best_match_recall", PRF + " SELECT truth, arg_max(found, (rc, -found)) AS found, round(max(rc), 6) AS recall FROM q GROUP BY truth")
def best_match_recall(spark, d):
    out = aggregates.precision_recall(contingency(spark, d), "truth", "found")
    return out.groupBy("truth").agg(F.max_by("found", F.struct("recall", -F.col("found"))).alias("found"), r6(F.max("recall")).alias("recall"))


@query("matched_f")
def matched_f(spark, d):
    """One-to-one matching of greatest total F."""
    return statistics.matched_f(aggregates.precision_recall(contingency(spark, d), "truth", "found"), "truth", "found")


@query(
    "matched_f_total",
    PRF.replace("WITH", "WITH RECURSIVE", 1)
    + """, f AS (SELECT l.truth, o.found, coalesce(2 * pr * rc / (pr + rc), 0) AS f FROM (SELECT DISTINCT truth FROM t) l CROSS JOIN (SELECT DISTINCT found FROM t) o LEFT JOIN q USING (truth, found)),
m(k, used, total) AS (SELECT 0, []::INT[], 0.0::DOUBLE UNION ALL SELECT k + 1, list_append(used, truth), total + f FROM m JOIN f ON found = k AND NOT list_contains(used, truth))
SELECT k::BIGINT AS pairs, round(max(total), 6) AS total FROM m GROUP BY k ORDER BY k DESC LIMIT 1""",
)
def matched_f_total(spark, d):
    """How many classes are matched one to one, and the greatest total F; against every way to match in SQL."""
    return matched_f(spark, d).agg(F.count("*").alias("pairs"), r6(F.sum("f")).alias("total"))


@query("max_overlap_parent", PRF + " SELECT found, arg_max(truth, (n, -truth)) AS parent, max(n) AS overlap FROM t GROUP BY found")
def max_overlap_parent(spark, d):
    return aggregates.best_parent(contingency(spark, d), "found", "truth")


ENRICH = f"""WITH {P}, a AS (SELECT id, label AS cluster, 't' || (id % 7) AS term FROM p), n AS (SELECT count(*) AS population FROM p),
h AS (SELECT cluster, term, count(*) AS hits FROM a GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT term, count(*) AS marked FROM a GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT cluster, count(*) AS drawn FROM a GROUP BY 1),
e AS (SELECT cluster, term, hits, drawn, marked, population FROM h JOIN m USING (term) JOIN s USING (cluster), n)"""


@query("enrichment_counts", ENRICH + " SELECT * FROM e")
def enrichment_counts(spark, d):
    return statistics.enrichment_counts(members(spark, d), annotations(spark, d))


LOGC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query(
    "enrichment_pvalues",
    ENRICH
    + f""", k AS (SELECT *, unnest(range(greatest(hits, drawn + marked - population, 0), least(drawn, marked) + 1)) AS k FROM e)
SELECT cluster, term, hits, round(least(1.0, sum(exp({LOGC.format(n="marked", k="k")} + {LOGC.format(n="(population - marked)", k="(drawn - k)")} - {LOGC.format(n="population", k="drawn")}))), 6) AS p FROM k GROUP BY cluster, term, hits""",
)
def enrichment_pvalues(spark, d):
    return statistics.enrichment(members(spark, d), annotations(spark, d)).select("cluster", "term", "hits", r6("p").alias("p"))


@query("cluster_composition", ENRICH + ", c AS (SELECT cluster, term, count(*) AS n FROM a GROUP BY 1, 2), z AS (SELECT term, count(*) AS term_size FROM a GROUP BY 1) SELECT cluster, c.term, n, term_size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c.term) AS place FROM c JOIN z ON z.term = c.term")
def cluster_composition(spark, d):
    return joins.composition(members(spark, d), annotations(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(
    "merge_by_comment",
    f"WITH {X}, g AS (SELECT *, CASE WHEN label < 4 THEN 'same' ELSE label::VARCHAR END AS \"group\" FROM long) SELECT \"group\", d::INT AS dim, count(*) AS size, round(quantile_cont(x, 0.5), 6) AS value FROM g GROUP BY 1, 2",
)
def merge_by_comment(spark, d):
    """Clusters with one non-empty comment become one, with the median as profile."""
    sets = T.merged_by_comment(members(spark, d).select("cluster").distinct().withColumn("comment", F.when(F.col("cluster") < 4, "same").otherwise("")))
    joined = points(spark, d).join(members(spark, d), "id").join(sets, "cluster")
    return long_profile(aggregates.median_profile(joined, ["group"], DIM), ["group", "size"])


@query("cluster_size_filter", f"WITH {P}, s AS (SELECT {OTHER} * 3 + label % 2 AS cluster, count(*) AS size FROM p GROUP BY 1) SELECT cluster, size FROM s WHERE size >= least(50, (SELECT count(*) FROM p) // 300)")
def cluster_size_filter(spark, d):
    pts = points(spark, d)
    sizes = pts.groupBy(((F.col("id") % 7) * 3 + F.col("label") % 2).alias("cluster")).agg(F.count("*").alias("size"))
    return T.large_enough(sizes, pts.count())


@query("cluster_volume", f"WITH {X}, r AS (SELECT label, d, max(x) - min(x) AS r FROM long GROUP BY 1, 2) SELECT label, round(sum(ln(r / 0.25)), 6) AS log_volume FROM r GROUP BY label")
def cluster_volume(spark, d):
    """The logarithm of the volume over all dimensions."""
    return aggregates.volume(points(spark, d), DIM, [0.25] * DIM, ["label"]).select("label", r6(F.ln("volume")).alias("log_volume"))


@query(
    "group_deviation",
    f"WITH {C}, f AS (SELECT p.label, list_distance(p.v, c.v) AS dist FROM p JOIN c ON c.id = p.label) SELECT label, round(sum(asinh(dist * dist)), 6) AS sum_asinh, round(quantile_cont(dist, 0.5), 6) AS median_dist FROM f GROUP BY label",
)
def group_deviation(spark, d):
    out = aggregates.group_deviation(points(spark, d), "label", DIM)
    return out.select("label", r6("sum_asinh").alias("sum_asinh"), r6("median_dist").alias("median_dist"))


@query("node_sizes", f"WITH {P}, s AS (SELECT label AS cluster, count(*) AS size FROM p GROUP BY 1) SELECT cluster, size, round(greatest(1.0, power(size, 0.33)), 6) AS node_size FROM s")
def node_sizes(spark, d):
    from cairn.operators.graphs import node_sizes as sized

    return sized(members(spark, d).groupBy("cluster").agg(F.count("*").alias("size"))).withColumn("node_size", r6("node_size"))


@query("cluster_ordinals", f"WITH {P}, s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS ordinal FROM p GROUP BY label) SELECT id, ordinal FROM p JOIN s USING (label)")
def cluster_ordinals(spark, d):
    from cairn.sources.sinks import cluster_ordinals as numbered

    sizes = members(spark, d).groupBy("cluster").agg(F.count("*").alias("size"))
    return numbered(members(spark, d), sizes).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("export_member_rows", f"WITH {P} SELECT label AS ClusterID, 'e' || id AS name, {', '.join(f'v[{i + 1}] AS f{i}' for i in range(DIM))} FROM p")
def export_member_rows(spark, d):
    from cairn.sources.sinks import member_rows

    named = points(spark, d).select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("name"), "vec")
    return member_rows(members(spark, d), named, [f"f{i}" for i in range(DIM)])


@query("profile_text", f"WITH {X} SELECT label AS cluster, d::INTEGER AS dim, round(avg(x), 6) AS value FROM long GROUP BY label, d")
def profile_text(spark, d):
    """Profiles as tab-separated text; all cells read back."""
    from cairn.sources.sinks import profile_text as as_text

    text = as_text(aggregates.mean_profile(points(spark, d), ["label"], DIM).withColumnRenamed("label", "cluster"))
    return text.select("cluster", F.posexplode(F.split("text", "\t")).alias("dim", "value")).withColumn("value", r6(F.col("value").cast("double")))


@query(
    "reassigned_rows",
    f"WITH {C}, q AS (SELECT p.id, c.id AS centre, round({angle('p.v', 'c.v')}, 12) AS dist FROM p, c) SELECT id, arg_min(centre, (dist, centre)) AS centre, round(min(dist), 6) AS dist FROM q GROUP BY id",
)
def reassigned_rows(spark, d):
    from cairn.sources.sinks import reassigned

    found = reassigned(points(spark, d), centroids(spark, d).select(F.col("id").alias("cluster"), F.col("vec").alias("profile")))
    return found.select("id", "centre", r6("dist").alias("dist"))


@query(
    "first_component_spread",
    f"""WITH RECURSIVE {C}, x AS (SELECT id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM long), n AS (SELECT count(*) - 1 AS n FROM p),
cov AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / any_value(n) AS c FROM x a JOIN x b USING (id) CROSS JOIN n GROUP BY ALL),
m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
power AS (SELECT 0 AS step, list_transform(range(1, {DIM + 1}), lambda k: 1.0 / k) AS v
  UNION ALL SELECT step + 1, list_transform(w, lambda y: y / sqrt(list_dot_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM power, m WHERE step < 600))
SELECT round(sqrt(list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v)))), 6) AS sd FROM power, m WHERE step = 600""",
)
def first_component_spread(spark, d):
    mean, axes, _ = statistics.principal_components(points(spark, d), DIM, 1)
    return statistics.projected(points(spark, d), mean, axes).agg(r6(F.stddev_samp("pc1")).alias("sd"))


#: Logarithms of the von Mises-Fisher normaliser of 64 dimensions for whole kappas, in SQL.
NORM = """ks AS (SELECT unnest(range(0, 500)) AS k),
series AS (SELECT k, i, (2 * i + 31) * ln(k / 2) - lgamma(i + 1) - lgamma(i + 32) AS t FROM ks, (SELECT unnest(range(0, 800)) AS i) WHERE k > 0),
bessel AS (SELECT series.k, any_value(m) + ln(sum(exp(t - m))) AS log_i FROM series JOIN (SELECT k, max(t) AS m FROM series GROUP BY k) USING (k) GROUP BY series.k),
norm AS (SELECT k, 31 * ln(k) - 32 * ln(2 * pi()) - log_i AS c FROM bessel UNION ALL SELECT 0, lgamma(32) - ln(2) - 32 * ln(pi()))"""


#: A one in the vector of each label at the place of each of its points, shuffled as `permuted` does it: four steps of a
#: network on 18 bits, again until the place is one of LENGTH.
SHUFFLED = f"""{P}, size AS (SELECT greatest({PADDING}, max(id) + 1) AS length FROM p), half AS (SELECT length, greatest(1, ((length(bin(greatest(2, length - 1))) + 1) // 2))::INTEGER AS h FROM size),
e AS (SELECT label::BIGINT AS id, p.id AS pos, length, h, ((1::BIGINT << h) - 1) AS low FROM p, half),
moved AS (SELECT round, id, length, list_reduce(list_prepend(pos, range(0, 257)), lambda x, i: CASE WHEN x >= 1099511627776 THEN x WHEN i % 4 = 0 AND i > 0 AND x < length THEN x + 1099511627776
  ELSE ((x & low) << h) | xor(x >> h, ((((x & low) * 40503 + (round * 1000003 + id % 1048576 * 7919 + i % 4 * 104729 + 15485863) % 1048576) * 2654435761) >> 16) & low) END) - 1099511627776 AS pos FROM e, (SELECT unnest(range(0, {{rounds}})) AS round))"""


def label_entries(spark, d):
    """A vector for each label with a one at the place of each of its points, and the vectors' length: PADDING, or more where ids are greater."""
    pts = points(spark, d)
    length = max(PADDING, (pts.agg(F.max("id")).first()[0] or 0) + 1)
    return pts.select(F.col("label").cast("long").alias("id"), F.col("id").alias("pos"), F.lit(1.0).alias("value")), length


@query("permutation_null", f"WITH {SHUFFLED.format(rounds=200)} SELECT round, count(DISTINCT pos) AS covered FROM moved GROUP BY round")
def permutation_null(spark, d):
    """Columns that the shuffled vectors of all labels cover together, 200 rounds."""
    entries, length = label_entries(spark, d)
    return statistics.permutation_null(entries, length, 200)


@query(
    "permutation_correlations",
    f"""WITH {SHUFFLED.format(rounds=20)}, s AS (SELECT id, count(*)::DOUBLE AS s, max(length)::DOUBLE AS n FROM e GROUP BY id),
xy AS (SELECT round, x.id AS a, y.id AS b, count(*)::DOUBLE AS xy FROM moved x JOIN moved y USING (round, pos) WHERE x.id < y.id GROUP BY ALL)
SELECT r.round, x.id AS a, y.id AS b, round((coalesce(xy, 0) - x.s * y.s / x.n) / sqrt((x.s - x.s * x.s / x.n) * (y.s - y.s * y.s / x.n)), 9) AS correlation
FROM s x JOIN s y ON x.id < y.id CROSS JOIN (SELECT unnest(range(0, 20)) AS round) r LEFT JOIN xy ON xy.round = r.round AND xy.a = x.id AND xy.b = y.id""",
)
def permutation_correlations(spark, d):
    """Correlations of every two labels' shuffled vectors, 20 rounds."""
    entries, length = label_entries(spark, d)
    return statistics.permutation_correlations(entries, length, 20).withColumn("correlation", r6("correlation", 9))


@query(
    "concentration_fits",
    f"""WITH {C}, cosines AS (SELECT p.label, greatest(-1.0, least(1.0, list_dot_product(p.v, c.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(c.v, c.v)))) AS cosine FROM p JOIN c ON c.id = p.label),
g AS (SELECT label, count(*) AS n, avg(cosine) AS mean_cosine FROM cosines GROUP BY label),
seen AS (SELECT label, least(20, floor((cosine + 1) * 21 / 2))::INTEGER AS bin, count(*) AS n FROM cosines GROUP BY ALL),
{NORM},
fit AS (SELECT label, arg_max(k, c + k * mean_cosine) AS kappa FROM g, norm GROUP BY label),
places AS (SELECT j // 64 AS bin, -1 + (j + 0.5) * 2 / 1344 AS t FROM (SELECT unnest(range(0, 1344)) AS j)),
logs AS (SELECT k, bin, k * t + 30.5 * ln(1 - t * t) AS w FROM ks, places),
tops AS (SELECT k, max(w) AS m FROM logs GROUP BY k),
mass AS (SELECT k, bin, sum(exp(w - m)) AS w FROM logs JOIN tops USING (k) GROUP BY k, bin),
share AS (SELECT k, bin, w / sum(w) OVER (PARTITION BY k) AS share FROM mass),
chi AS (SELECT g.label, k, sum(power(coalesce(seen.n, 0) - greatest(g.n * share, 0.001), 2) / greatest(g.n * share, 0.001)) AS chi FROM g CROSS JOIN share LEFT JOIN seen ON seen.label = g.label AND seen.bin = share.bin GROUP BY g.label, k),
lowest AS (SELECT label, arg_min(k, (chi, k)) AS k FROM chi GROUP BY label),
own AS (SELECT fit.label, kappa, chi FROM fit JOIN chi ON chi.label = fit.label AND chi.k = kappa),
tail AS (SELECT label, any_value(chi) AS chi, CASE WHEN any_value(chi) > 600 THEN 0 ELSE 1 - sum(exp((9.5 + i) * ln(chi / 2) - chi / 2 - lgamma(10.5 + i))) END AS p FROM own, (SELECT unnest(range(0, 2000)) AS i) GROUP BY label)
SELECT g.label, g.n, round(mean_cosine, 6) AS mean_cosine, kappa, lowest.k AS kappa_by_chi_square, round(tail.chi, 3) AS chi_square, round(p, 6) AS p_value
FROM g JOIN fit USING (label) JOIN lowest USING (label) JOIN tail USING (label)""",
)
def concentration_fits(spark, d):
    """For the points of every label the fitted concentration about their mean direction, with a chi-square test."""
    found = statistics.concentrations(points(spark, d), "label", DIM)
    return found.withColumns({"mean_cosine": r6("mean_cosine"), "chi_square": r6("chi_square", 3), "p_value": r6("p_value")})


@query("random_discriminant")
def random_discriminant(spark, d):
    import numpy as np

    rows = centroids(spark, d).orderBy("id").collect()  # label-level
    a, b, score = statistics.random_discriminant(np.array([r["vec"] for r in rows]), np.array([r["id"] % 2 for r in rows]), spark, 200, 8)
    return spark.createDataFrame([(a.tolist(), b.tolist(), float(score))], "a array<double>, b array<double>, score double")


@query("random_discriminant_distances")
def random_discriminant_distances(spark, d):
    import numpy as np

    rows = centroids(spark, d).orderBy("id").collect()  # label-level
    a, b, score = statistics.random_discriminant(np.array([r["vec"] for r in rows]), np.array([r["id"] % 2 for r in rows]), spark, 200, 8, objective="distances")
    return spark.createDataFrame([(a.tolist(), b.tolist(), float(score))], "a array<double>, b array<double>, score double")


@query(
    "node_attributes",
    f"WITH {P} SELECT id, id % 7 + 1 AS \"group\", id % 7 = 3 AS selected, 1::BIGINT AS n_terms FROM p",
)
def node_attributes(spark, d):
    from cairn.operators.registry import node_attributes as attributes

    return attributes(points(spark, d), annotations(spark, d), "t3").withColumn("group", F.col("group").cast("long"))


@query(
    "kernel_grid",
    f"WITH {P} SELECT w::DOUBLE AS width, x.id, round(sum(exp(-power(list_distance(x.v, y.v), 2) / (2 * w * w))), 5) AS density FROM p x, p y, (VALUES (0.3), (0.6)) s(w) GROUP BY w, x.id",
)
def kernel_grid(spark, d):
    """Densities of all points over a grid of bandwidths."""
    from cairn.operators.registry import kernel_grid as over

    return over("gaussian", points(spark, d), [0.3, 0.6]).withColumn("density", r6("density", 5))


TRIWEIGHT = plugins.Kernel(
    "triweight", "euclidean", lambda d, p: np.maximum(0.0, 1 - (d / p) ** 2) ** 3, lambda d, p: F.pow(F.greatest(F.lit(0.0), 1 - F.pow(d / p, F.lit(2))), F.lit(3)), F.max, lambda m, dim: m
)
ABOUT = "m AS (SELECT p.label, p.id, p.v, c.v AS centre, list_distance(p.v, c.v) AS d FROM p JOIN c ON c.id = p.label)"


def groups_and_centres(spark, d):
    centres = centroids(spark, d).select(F.col("id").cast("int").alias("label"), F.col("vec").alias("centre"))
    return points(spark, d), centres


@query(
    "fitted_bandwidths",
    f"""WITH {C}, {ABOUT}, {NORM}, cos AS (SELECT label, avg(greatest(-1.0, least(1.0, list_dot_product(v, centre) / sqrt(list_dot_product(v, v) * list_dot_product(centre, centre))))) AS mean FROM m GROUP BY label)
SELECT label, 'gaussian' AS kernel, round(max(d) / 1.96, 6) AS parameter FROM m GROUP BY label UNION ALL SELECT label, 'triweight', round(max(d), 6) FROM m GROUP BY label
UNION ALL SELECT label, 'vmf', arg_max(k, c + k * mean)::DOUBLE FROM cos, norm GROUP BY label""",
)
def fitted_bandwidths(spark, d):
    """The parameters of two built-in kernels and a registered one for the points of every label."""
    plugins.register_kernel(TRIWEIGHT)
    members, centres = groups_and_centres(spark, d)
    out = None
    for name in ("gaussian", "triweight", "vmf"):
        one = plugins.fitted(members, centres, "label", name, DIM).select("label", F.lit(name).alias("kernel"), r6("parameter").alias("parameter"))
        out = one if out is None else out.unionByName(one)
    return out


@query("registered_kernel", f"WITH {P} SELECT w::DOUBLE AS width, a.id, round(sum(power(greatest(0, 1 - power(list_distance(a.v, b.v) / w, 2)), 3)), 6) AS density FROM p a, p b, (VALUES (0.8), (1.2)) t(w) GROUP BY ALL")
def registered_kernel(spark, d):
    """Densities of all points by a kernel that a user registered, over a grid of widths."""
    from cairn.operators.registry import kernel_grid as over

    plugins.register_kernel(TRIWEIGHT)
    return over("triweight", points(spark, d), [0.8, 1.2]).withColumn("density", r6("density"))


@query(
    "kernel_weighted_means",
    f"""WITH {C}, {ABOUT}, x AS (SELECT label, exp(-d * d / (2 * 0.5 * 0.5)) AS w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM m)
SELECT label, dim::INTEGER AS dim, round(sum(w * x) / sum(w), 6) AS value FROM x GROUP BY label, dim""",
)
def kernel_weighted_means(spark, d):
    members, centres = groups_and_centres(spark, d)
    means = plugins.weighted_means(members, centres, "label", "gaussian", 0.5, DIM)
    return means.select("label", F.posexplode("mean").alias("dim", "value")).withColumn("value", r6("value"))


@query(
    "filtered_scores",
    f"WITH {P} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x / 0.04)) + list_sum(list_transform(v[1:1], lambda x: x * x * (1 / 0.01 - 1 / 0.04)))), 6) AS score FROM p WHERE v[1] BETWEEN -0.2 AND 0.3 AND sqrt(list_dot_product(v, v)) >= 0.9",
)
def filtered_scores(spark, d):
    """Points that two filters leave, with their lengths in units of a noise covariance."""
    kept = plugins.filtered(points(spark, d), [("within", {"dim": 0, "low": -0.2, "high": 0.3}), ("min_length", {"least": 0.9})])
    noise = np.diag([0.01] + [0.04] * (DIM - 1))
    return plugins.scored(kept, "mahalanobis", noise=noise.tolist()).withColumn("score", r6("score"))


@query(
    "nearest_root_assignment",
    f"""WITH {LINKS}, q AS (SELECT p.id, links.id AS root, round({angle('p.v', 'o.v')}, 12) AS dist FROM p, links JOIN p o ON o.id = links.id WHERE parent IS NULL)
SELECT id, arg_min(root, (dist, root)) AS cluster FROM q GROUP BY id""",
)
def nearest_root_assignment(spark, d):
    from cairn.operators.registry import nearest_root
    from cairn.plans.neighbours import links

    return nearest_root(points(spark, d), links(spark, d))


@query("algorithm_batch")
def algorithm_batch(spark, d):
    from cairn.operators.registry import batch

    return batch("hierarchical", {"embeddings": points(spark, d)}, [{"threshold": 0.5}, {"threshold": 1.0, "method": "complete"}])


@query("label_quality", "SELECT quality, toxic, count(*) AS n FROM labels SEMI JOIN documents USING (doc_id) GROUP BY 1, 2")
def label_quality(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_semi").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
