"""Queries on sources, sinks and the store: rows are written by one, read back by another, and compared with the tables.

Files go to a new folder beside the session's checkpoints, which driver and executors share.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cairn.functions import special
from cairn.functions import vectors as V
from cairn.functions.scalars import on_columns
from cairn.operators import density, graphs, synthetic
from cairn.operators import transforms as T
from cairn.plans.base import ACOS, DIM, C, P, centroids, points, query, r6
from cairn.session import shared_folder, table
from cairn.sources import delimited, fcs, sinks
from cairn.sources.catalog import Catalog

FEATURES = [f"f{i}" for i in range(DIM)]
VALUES = ", ".join(f"v[{i + 1}] AS f{i}" for i in range(DIM))


@query("delimited_events", "SELECT 'L' || l_orderkey || '_' || l_linenumber AS name, l_quantity AS quantity, l_extendedprice AS price, 'Price of all, Quantity' AS long FROM lineitem")
def delimited_events(spark, d):
    """Text with "short:long" headers and row names, read back."""
    path = shared_folder(spark, "events")
    name = F.concat(F.lit("L"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name")
    table(spark, d, "lineitem").select(name, F.col("l_quantity").alias("quantity:Quantity"), F.col("l_extendedprice").alias("price:Price of all")).write.csv(path, header=True)
    rows, _, long = delimited.read_events(spark, path)
    return rows.select("name", "quantity", "price", F.lit(", ".join(sorted(long))).alias("long"))


@query("delimited_rejects", "SELECT event_id, CASE event_type WHEN 'click' THEN 'wrong number of columns' WHEN 'view' THEN 'not a number' ELSE 'read' END AS outcome FROM events")
def delimited_rejects(spark, d):
    """Rows with a cell too many, or with a word in place of a number, are told apart from those that are read."""
    path = shared_folder(spark, "events")
    cell = F.when(F.col("event_type") == "click", "1,2").when(F.col("event_type") == "view", "word").otherwise(F.col("user_id").cast("string"))
    table(spark, d, "events").select(F.col("event_id").alias("name"), "value", cell.alias("user")).write.csv(path, header=True)
    rows, rejects, _ = delimited.read_events(spark, path)
    refused = rejects.select(F.regexp_extract("line", "^([0-9]+)", 1).cast("long").alias("event_id"), F.col("reason").alias("outcome"))
    return rows.select(F.col("name").cast("long").alias("event_id"), F.lit("read").alias("outcome")).unionByName(refused)


@query("headerless_events", "SELECT printf('n.fcs Event %07d', n_nationkey::INT + 1) AS name, n_nationkey::DOUBLE AS nation, n_regionkey::DOUBLE AS region FROM nation")
def headerless_events(spark, d):
    """One file of numbers, in order; names count its rows."""
    path = shared_folder(spark, "numbers")
    table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").coalesce(1).write.csv(path)
    return delimited.read_headerless(spark, path, ["nation", "region"], "n")


@query("csv_by_name", "SELECT c_custkey, c_acctbal, try_cast(c_mktsegment AS BIGINT) AS c_mktsegment FROM customer")
def csv_by_name(spark, d):
    path = shared_folder(spark, "csv")
    table(spark, d, "customer").write.csv(path, header=True)
    return delimited.read_named(spark, path, {"c_custkey": "long", "c_acctbal": "double", "c_mktsegment": "long"})


@query("fcs_events", f"WITH {P} SELECT label::VARCHAR AS part, id::DOUBLE AS id, {VALUES} FROM p")
def fcs_events(spark, d):
    """FCS files for each label, written and read back; vectors are of 32-bit floats, as the files are."""
    folder = shared_folder(spark, "fcs")
    rows = points(spark, d).select("label", "id", *[F.col("vec")[i].alias(f) for i, f in enumerate(FEATURES)])
    fcs.write_fcs(rows, folder, ["id", *FEATURES], "label", rows_per_file=1000).collect()  # a row for each file
    part = F.regexp_extract("file", "([0-9]+)(_[0-9]+)?[.]fcs$", 1).alias("part")
    fcs.register(spark)
    return spark.read.format("fcs").option("bytesPerPartition", 4096).load(f"{folder}/*.fcs").select(part, "id", *FEATURES)


@query("fcs_with_clusters", f"WITH {P} SELECT label::VARCHAR AS part, id::DOUBLE AS id, (id % 7)::DOUBLE AS cluster, {VALUES} FROM p")
def fcs_with_clusters(spark, d):
    """Files of each label, with a cluster of every event as a further channel, in parts of 40 events."""
    folder, out = shared_folder(spark, "fcs"), shared_folder(spark, "fcs")
    rows = points(spark, d).select("label", "id", *[F.col("vec")[i].alias(c) for i, c in enumerate(FEATURES)])
    fcs.write_fcs(rows, folder, ["id", *FEATURES], "label").collect()  # a row for each file
    fcs.register(spark)
    events = spark.read.format("fcs").schema("file string, idx long, id double").load(f"{folder}/*.fcs")
    fcs.write_with_clusters(events.select("file", "idx", (F.col("id") % 7).alias("cluster")), out, rows_per_file=40).collect()  # a row for each file
    part = F.regexp_extract("file", "([0-9]+)(_[0-9]+)?[.]fcs$", 1).alias("part")
    return spark.read.format("fcs").load(out).select(part, "id", "cluster", *FEATURES)


@query("fcs_back_transforms", "SELECT p_size::VARCHAR AS part, count(*) AS n, round(sum(round(p_retailprice, 2)), 2) AS price, round(sum(p_partkey), 0) AS key FROM part GROUP BY 1")
def fcs_back_transforms(spark, d):
    """Files for each term, of columns that are asinh or logarithm in the table and measured values in the files."""
    part = table(spark, d, "part").select("p_size", F.asinh(F.col("p_retailprice") / 5).alias("price"), F.asinh(F.col("p_partkey") / 5).alias("id"), F.log("p_retailprice").alias("log_price"))
    read = None
    for kind, col in (("asinh", "price"), ("log", "log_price")):
        folder = shared_folder(spark, "fcs")
        fcs.write_fcs(part, folder, [col, "id"] if kind == "asinh" else [col], "p_size", 5.0, kind).collect()  # a row for each file
        rows = fcs.read_fcs(spark, f"{folder}/*.fcs").withColumn("part", F.regexp_extract("file", "([0-9]+)[.]fcs$", 1))
        sums = rows.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum(F.round(col, 2)), 2).alias(kind), *([F.sum("id").alias("key")] if kind == "asinh" else []))
        read = sums if read is None else read.join(sums.drop("n"), "part")
    return read.select("part", "n", F.when(F.col("asinh") == F.col("log"), F.col("asinh")).alias("price"), F.round("key", 0).alias("key"))


@query(
    "merged_files",
    "SELECT 'orders' AS file, o_custkey AS custkey, o_totalprice AS amount FROM orders UNION ALL SELECT 'customers', c_custkey, c_acctbal FROM customer",
)
def merged_files(spark, d):
    """Columns that both files have, in the first one's order; a channel that is skipped by default is left out."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.lit(1.0).alias("Time"), F.col("o_totalprice").alias("amount"), "o_orderkey")
    customers = table(spark, d, "customer").select(F.col("c_acctbal").alias("amount"), F.lit(2.0).alias("Time"), F.col("c_custkey").alias("custkey"), "c_name")
    return delimited.merge_files([orders, customers], ["orders", "customers"])


@query("column_roles", "SELECT l_orderkey AS id, l_quantity AS a, l_tax AS b, l_discount AS side FROM lineitem")
def column_roles(spark, d):
    """Feature and side vectors by a file of roles."""
    roles = delimited.column_roles("# index, role, name\n0, 0, l_quantity\n1, 1, l_discount\n2, 0, l_tax\n3, 5, l_extendedprice\n")
    features, side = ([c for c, r in roles.items() if r == k] for k in (0, 1))
    return T.as_points(table(spark, d, "lineitem"), "l_orderkey", features, side).select("id", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"), F.col("side")[0].alias("side"))


@query("flat_points", f"WITH {P} SELECT id, 'e' || id AS name, {VALUES} FROM p")
def flat_points(spark, d):
    named = points(spark, d).select("id", F.concat(F.lit("e"), "id").alias("name"), F.lit(None).cast("string").alias("file"), "vec")
    return T.flat(named, FEATURES).drop("file")


@query(
    "annotation_file",
    """WITH k AS (SELECT event_id AS id, event_type FROM events WHERE event_id % 3 = 0)
    SELECT id, event_type AS term FROM k UNION ALL SELECT id, 'third' FROM k UNION ALL
    SELECT NULL, CASE WHEN event_type = 'click' THEN 'too few fields' WHEN event_type = 'view' THEN 'id is not a number' ELSE 'unknown id' END FROM events WHERE event_id % 3 <> 0""",
)
def annotation_file(spark, d):
    """Lines of ids and terms: two terms for each known id, and the reasons of the others."""
    path = shared_folder(spark, "annotations")
    events, known = table(spark, d, "events"), F.col("event_id") % 3 == 0
    good = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", F.lit("third"))
    bad = F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).when(F.col("event_type") == "view", F.concat(F.lit("x"), "event_id", F.lit(",a"))).otherwise(F.concat("event_id", F.lit(",a")))
    events.select(F.when(known, good).otherwise(bad).alias("value")).write.text(path)
    rows, rejects = delimited.read_annotations(spark, path, events.where(known).select(F.col("event_id").alias("id")))
    return rows.select("id", "term").unionByName(rejects.select(F.lit(None).cast("long").alias("id"), F.col("reason").alias("term")))


@query("annotations_by_name", "SELECT c_custkey AS id, unnest([c_mktsegment, 'n' || c_nationkey]) AS term FROM customer")
def annotations_by_name(spark, d):
    customers = table(spark, d, "customer")
    named = customers.select(F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("; n"), "c_nationkey", F.lit("; ")).alias("terms"))
    return delimited.annotations_by_name(named, customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query(
    "external_clusters",
    f"WITH {P}, long AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM p WHERE id % 5 <> 0) SELECT label AS cluster, d::INT AS dim, count(*) AS size, round(avg(x), 6) AS value FROM long GROUP BY 1, 2",
)
def external_clusters(spark, d):
    """Clusters of another program: -1 is no cluster; sizes and mean profiles of the rest."""
    pts = points(spark, d)
    rows = pts.select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("label")).alias("cluster"))
    _, clusters = delimited.external_assignment(rows, pts, DIM)
    return clusters.select("cluster", "size", F.posexplode("profile").alias("dim", "value")).withColumn("value", r6("value"))


def store(spark, d):
    """A store with the points as one dataset, whose first component is NaN in every tenth."""
    made = Catalog(spark, shared_folder(spark, "store"))
    vec = F.when(F.col("id") % 10 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice("vec", 2, DIM - 1))).otherwise(F.col("vec"))
    rows = points(spark, d).select("id", F.concat(F.lit("e"), "id").alias("name"), vec.alias("vec"), F.concat(F.lit("file"), F.col("label") % 2).alias("file"))
    return made, made.save_dataset("first", rows, FEATURES)


@query("stored_points", f"WITH {P} SELECT 'first' AS dataset, id, 'e' || id AS name, 'file' || label % 2 AS file, CASE WHEN id % 10 = 0 THEN 0 ELSE v[1] END AS f0, round(list_sum(v[2:]), 6) AS rest FROM p")
def stored_points(spark, d):
    """Saved under a name, found by it, read back with NaN as 0."""
    made, _ = store(spark, d)
    found = made.dataset_names().where("name = 'first'").first()["dataset_id"]
    return made.points(found).select(F.lit("first").alias("dataset"), "id", "name", "file", F.col("vec")[0].alias("f0"), r6(V.total(F.slice("vec", 2, DIM - 1))).alias("rest"))


@query("stored_annotations", f"WITH {P} SELECT 'seven' AS annotation, id, 't' || id % 7 AS term FROM p UNION ALL SELECT 'By file: first', id, 'file' || label % 2 FROM p")
def stored_annotations(spark, d):
    """Of three annotations one is deleted; that by file is always there."""
    made, found = store(spark, d)
    for name, by in (("seven", 7), ("gone", 3)):
        made.save_annotation(found, name, points(spark, d).select("id", F.concat(F.lit("t"), F.col("id") % by).alias("term")))
    made.delete_annotation(found, "gone")
    return made.annotations(found)


@query(
    "stored_clusters",
    f"WITH {P}, s AS (SELECT label AS cluster, count(*) AS size FROM p GROUP BY 1) SELECT 'labels' AS method, (SELECT count(*) FROM s) AS n_clusters, row_number() OVER (ORDER BY size DESC, cluster) AS place, cluster::BIGINT AS cluster, size, size AS members FROM s",
)
def stored_clusters(spark, d):
    """Two cluster sets, one deleted; the other's clusters by falling size with the counts of their members."""
    made, found = store(spark, d)
    members = points(spark, d).select("id", F.col("label").cast("long").alias("cluster"))
    clusters = points(spark, d).groupBy(F.col("label").cast("long").alias("cluster")).agg(F.count("*").alias("size"), F.array(F.avg(F.col("vec")[0])).alias("profile"))
    kept = made.save_clusters(found, members, clusters, "labels", "angular", 1.0)
    made.delete_cluster_set(made.save_clusters(found, members.where("cluster = 0"), clusters.where("cluster = 0"), "gone", "angular", 2.0))
    made.compact("members", kept)
    sets = made.cluster_sets(found).collect()  # a row for each cluster set
    counted = made.members(kept).groupBy("cluster").agg(F.count("*").alias("members"))
    places = [(r["cluster"], i) for i, r in enumerate(made.clusters(kept).select("cluster").collect(), 1)]  # cluster-level
    rows = made.clusters(kept).join(spark.createDataFrame(places, "cluster long, place long"), "cluster").join(counted, "cluster")
    return rows.select(F.lit(", ".join(r["method"] for r in sets)).alias("method"), F.lit(sum(r["n_clusters"] for r in sets)).cast("long").alias("n_clusters"), "place", "cluster", "size", "members")


def times(factor):
    return lambda x: x * factor


@query("stored_cache", f"WITH {P} SELECT id, round(list_sum(v) * 2, 6) AS density, NULL::BIGINT AS after_delete FROM p UNION ALL SELECT NULL, NULL, 0")
def stored_cache(spark, d):
    """A cached table that is written twice holds the second; without its dataset nothing is left."""
    made, found = store(spark, d)
    for factor in (1, 2):
        made.cache(found, "densities", points(spark, d).select("id", F.transform("vec", times(factor)).alias("payload")))
    path = shared_folder(spark, "kept")
    made.cached(found, "densities").select("id", r6(V.total(F.col("payload"))).alias("density")).write.parquet(path)
    made.delete_dataset(found)
    left = sum(made.table(t).count() for t in ("datasets", "points", "cached"))
    kept = spark.read.parquet(path).withColumn("after_delete", F.lit(None).cast("long"))
    return kept.unionByName(spark.createDataFrame([(None, None, left)], "id long, density double, after_delete long"))


@query("dataset_export", f"WITH {P} SELECT id, 'e' || id AS name, {VALUES} FROM p")
def dataset_export(spark, d):
    path = shared_folder(spark, "dataset")
    named = points(spark, d).select("id", F.concat(F.lit("e"), "id").alias("name"), F.lit("x").alias("file"), "vec")
    sinks.dataset_to_csv(named, FEATURES, path)
    return delimited.read_named(spark, path, {"id": "long", "name": "string"} | dict.fromkeys(FEATURES, "double"))


@query("layout_export", 'SELECT event_id AS "EventID", event_type AS "Filename", user_id AS "Index_In_File", value AS "X", -value AS "Y" FROM events')
def layout_export(spark, d):
    path = shared_folder(spark, "layout")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("file"), F.col("user_id").alias("idx"), F.col("value").alias("x"), (-F.col("value")).alias("y"))
    sinks.layout_to_csv(rows, path)
    return delimited.read_named(spark, path, {"EventID": "long", "Filename": "string", "Index_In_File": "long", "X": "double", "Y": "double"})


@query("ordinals_export", f"WITH {P}, s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS ordinal FROM p GROUP BY 1) SELECT 't' || id % 7 AS term, ordinal::VARCHAR AS value, count(*) AS n FROM p JOIN s USING (label) GROUP BY 1, 2")
def ordinals_export(spark, d):
    """Cluster ordinals as text for each term, read back and counted."""
    path, pts = shared_folder(spark, "ordinals"), points(spark, d)
    members = pts.select("id", F.col("label").alias("cluster"))
    sinks.ordinals_by_term(members, members.groupBy("cluster").agg(F.count("*").alias("size")), pts.select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("term")), path)
    return spark.read.text(path).groupBy(F.col("term").cast("string").alias("term"), "value").agg(F.count("*").alias("n"))


@query("distances_export", f"WITH {C}, m AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 0 ELSE {ACOS.format(a='a.v', b='b.v')} END AS dist FROM c a, c b) SELECT a AS id, row_number() OVER (PARTITION BY a ORDER BY b) AS place, round(dist, 6) AS dist FROM m")
def distances_export(spark, d):
    """The matrix of distances between label centroids as text, read back cell by cell."""
    path = shared_folder(spark, "distances")
    sinks.distances_to_text(graphs.pairwise(centroids(spark, d)), path)
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    rows = cells.select(F.col("c")[0].cast("long").alias("id"), F.posexplode(F.expr("slice(c, 2, size(c) - 1)")).alias("place", "dist"))
    return rows.select("id", (F.col("place") + 1).cast("long").alias("place"), r6(F.col("dist").cast("double")).alias("dist"))


@query("vector_parts", f"WITH {P} SELECT id, v[3] AS third, v[1] AS first, CASE WHEN abs(v[1] * 8) > 1 THEN sign(v[1])::DOUBLE ELSE v[1] * 8 END AS clamped, len(v) + 1 AS longer, CASE WHEN id % 2 = 0 THEN 0 ELSE v[1] END AS cleaned FROM p")
def vector_parts(spark, d):
    """Some components by place, values beyond one as their sign, a vector with a further component, NaN as 0."""
    vec, nan = F.col("vec"), F.array(F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("vec")[0]))
    part = V.subset(vec, [2, 0])
    clamped = V.to_sign_beyond_one(F.array(vec[0] * 8))[0]
    return points(spark, d).select("id", part[0].alias("third"), part[1].alias("first"), clamped.alias("clamped"), F.size(F.concat(vec, F.array(F.lit(1.0)))).cast("long").alias("longer"), V.cleaned(nan)[0].alias("cleaned"))


@query(
    "default_ranges",
    """WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), d AS (SELECT unnest(range(1, 101)) AS dim) SELECT event_type, dim::BIGINT AS dim, trunc(least(1000, greatest(3, 2890 * pow(dim, -0.8))))::BIGINT AS k_max,
    trunc(least(1000, greatest(3, 1942 * pow(dim, -1.61))))::BIGINT AS k_min, greatest((dim + 1) // 2, -ceil(log2(0.01 / n)))::BIGINT AS reach,
    greatest(-12 * dim * dim + 1050, 150)::BIGINT AS older_max, greatest(5, trunc(-0.38 * pow(dim, 1.5) + 11))::BIGINT AS older_min FROM d, n""",
)
def default_ranges(spark, d):
    """Search ranges of 1 to 100 dimensions for as many rows as each type of event has."""

    def run(frames):
        for frame in frames:
            for kind, n in zip(frame["event_type"], frame["n"], strict=True):
                rows = [(kind, dim, *density.default_range(dim, n).values(), *density.older_default_range(dim)) for dim in range(1, 101)]
                yield pd.DataFrame(rows, columns=["event_type", "dim", "k_max", "k_min", "reach", "older_max", "older_min"])

    groups = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return groups.mapInPandas(run, "event_type string, dim long, k_max long, k_min long, reach long, older_max long, older_min long")


@query(
    "chi_densities",
    """WITH g AS (SELECT l_linenumber::DOUBLE AS df, l_quantity / 8 AS x, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT df, x, n, round(exp((1 - df / 2) * ln(2) + (df - 1) * ln(x) - x * x / 2 - lgamma(df / 2)), 9) + 0.0 AS chi, round(exp((df / 2 - 1) * ln(x) - x / 2 - (df / 2) * ln(2) - lgamma(df / 2)), 9) + 0.0 AS chi_square FROM g""",
)
def chi_densities(spark, d):
    """Chi and chi-square densities at the quantities of all lines, with as many degrees as the line's number."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("df"), (F.col("l_quantity") / 8).alias("x")).agg(F.count("*").alias("n"))
    return g.withColumns({c: F.round(on_columns(f, "df", "x"), 9) + 0.0 for c, f in (("chi", special.chi_density), ("chi_square", special.chi_square_density))})


@query(
    "bessel_logs",
    """WITH g AS (SELECT l_linenumber / 2.0 AS ord, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT ord, x, n, (2 * k + ord) * ln(x / 2) - lgamma(k + 1) - lgamma(k + ord + 1) AS t FROM g, (SELECT unnest(range(0, 140)) AS k)),
    m AS (SELECT *, max(t) OVER (PARTITION BY ord, x) AS m FROM t)
    SELECT ord::DOUBLE AS ord, x, n, round(max(m) + ln(sum(exp(t - m))), 8) + 0.0 AS log_bessel FROM m GROUP BY ord, x, n""",
)
def bessel_logs(spark, d):
    """ln I of whole and half orders at the quantities of all lines."""
    g = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") / 2).alias("ord"), F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    return g.withColumn("log_bessel", F.round(on_columns(special.log_bessel_i, "ord", "x"), 8) + 0.0)


@query(
    "vmf_densities",
    f"""WITH {C}, ks AS (SELECT unnest(range(1, 92, 10)) AS k),
    series AS (SELECT k, i, (2 * i + 31) * ln(k / 2) - lgamma(i + 1) - lgamma(i + 32) AS t FROM ks, (SELECT unnest(range(0, 300)) AS i)),
    bessel AS (SELECT series.k, any_value(m) + ln(sum(exp(t - m))) AS log_i FROM series JOIN (SELECT k, max(t) AS m FROM series GROUP BY k) USING (k) GROUP BY series.k)
    SELECT p.id, round(31 * ln(k) - 32 * ln(2 * pi()) - log_i + k * greatest(-1.0, least(1.0, list_dot_product(p.v, c.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(c.v, c.v)))), 6) + 0.0 AS log_density
    FROM p JOIN c ON c.id = p.label JOIN bessel ON k = 10 * p.label + 1""",
)
def vmf_densities(spark, d):
    """Logarithms of the von Mises-Fisher densities of all points about their label's mean, with a concentration for each label."""
    centres = centroids(spark, d).select(F.col("id").alias("label"), F.col("vec").alias("centre"))
    constant = on_columns(lambda kappa: special.log_vmf_constant(DIM, kappa), F.col("kappa").cast("double"))
    rows = points(spark, d).join(centres, "label").withColumn("kappa", 10 * F.col("label") + 1)
    return rows.select("id", (F.round(constant + F.col("kappa") * V.cosine(F.col("vec"), F.col("centre")), 6) + 0.0).alias("log_density"))


@query(
    "tabled_functions",
    """WITH g AS (SELECT l_quantity / 5 AS x, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT x, n, round(floor(x) * floor(x) + (x - floor(x)) * (2 * floor(x) + 1), 9) + 0.0 AS squares, round(x * 3 + (10 - x) * 2, 9) + 0.0 AS plane FROM g""",
)
def tabled_functions(spark, d):
    """Squares between whole numbers by a table, and a plane by a grid, at the quantities of all lines."""
    squares, at = [(float(i), float(i * i)) for i in range(12)], [float(i) for i in range(0, 11, 2)]
    values = [[3 * x + 2 * y for y in at] for x in at]
    g = table(spark, d, "lineitem").groupBy((F.col("l_quantity") / 5).alias("x")).agg(F.count("*").alias("n"))
    by_table, by_grid = on_columns(lambda x: special.interpolate(squares, x), "x"), on_columns(lambda x: special.interpolate2(at, at, values, x, 10 - x), "x")
    return g.withColumns({"squares": F.round(by_table, 9) + 0.0, "plane": F.round(by_grid, 9) + 0.0})


@query(
    "generated_points",
    """WITH n AS (SELECT count(*) AS n FROM events) SELECT generator, n // parts * parts AS n, dim, least(components, n // parts * parts) AS components, true AS finite_density
    FROM n, (VALUES ('one_normal', 1, 3::BIGINT, 1::BIGINT), ('two_normals', 2, 40, 2), ('one_marker', 2, 38, 2), ('trajectory', 50, 50, 50), ('mixture', 10, 50, 10)) v(generator, parts, dim, components)""",
)
def generated_points(spark, d):
    """As many points of each generator as there are events: rows, dimensions, components, and whether every stated log density is a number."""
    n = table(spark, d, "events").count()
    made = {
        "one_normal": synthetic.one_normal(spark, n), "two_normals": synthetic.two_normals(spark, n // 2), "one_marker": synthetic.one_marker(spark, n // 2),
        "trajectory": synthetic.trajectory(spark, 50, n // 50), "mixture": synthetic.mixture(spark, n // 10 * 10),
    }
    out = None
    for name, df in made.items():
        rows = df.select(F.size("vec").alias("dim"), F.col("side")[1].alias("component"), F.col("side")[0].alias("density"))
        one = rows.agg(F.count("*").alias("n"), F.max("dim").cast("long").alias("dim"), F.countDistinct("component").alias("components"), F.bool_and(F.col("density").isNotNull() & ~F.isnan("density")).alias("finite_density"))
        one = one.select(F.lit(name).alias("generator"), "n", "dim", "components", "finite_density")
        out = one if out is None else out.unionByName(one)
    return out
