"""Queries on measurement tables: transforms, filters, samples, gates, matrices, histograms, lookups and sets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cairn.operators import aggregates, contours, joins, postings
from cairn.operators import order as O
from cairn.operators import transforms as T
from cairn.plans.base import query, r6
from cairn.session import cut_lineage, table

CH = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ID = ["l_orderkey", "l_linenumber"]
IDS = "l_orderkey, l_linenumber"


def items(spark, d, *extra):
    return table(spark, d, "lineitem").select(*ID, *CH, *extra)


def rounded(df, cols, digits=6):
    return df.withColumns({c: r6(c, digits) + 0.0 for c in cols})


def sql_cols(build, digits=6):
    return ", ".join(f"round({build(c)}, {digits}) + 0.0 AS {c}" for c in CH)


@query("asinh_transform", f"SELECT {IDS}, {sql_cols(lambda c: f'asinh({c} / 5)')} FROM lineitem")
def asinh_transform(spark, d):
    return rounded(T.transform(items(spark, d), CH), CH)


@query("double_asinh_transform", f"SELECT {IDS}, {sql_cols(lambda c: f'asinh(asinh({c} / 5))')} FROM lineitem")
def double_asinh_transform(spark, d):
    return rounded(T.transform(items(spark, d), CH, "double_asinh"), CH)


@query("noise_threshold", f"SELECT {IDS}, {', '.join(f'CASE WHEN abs({c}) < 1 THEN 0.0 ELSE {c} END AS {c}' for c in CH)} FROM lineitem")
def noise_threshold(spark, d):
    return T.noise_threshold(items(spark, d), CH)


@query("background_subtract", f"SELECT {IDS}, {', '.join(f'round(greatest(0.0, {c} - 1), 6) AS {c}' for c in CH)} FROM lineitem")
def background_subtract(spark, d):
    return T.background(items(spark, d), CH, jitter=0.0).withColumns({c: r6(c) for c in CH})


@query(
    "rescale_sd",
    f"WITH s AS (SELECT l_returnflag, {', '.join(f'stddev_samp({c}) AS s_{c}' for c in CH)} FROM lineitem GROUP BY 1) SELECT {IDS}, {', '.join(f'round({c} / s_{c}, 6) + 0.0 AS {c}' for c in CH)} FROM lineitem JOIN s USING (l_returnflag)",
)
def rescale_sd(spark, d):
    return rounded(T.rescale(items(spark, d, "l_returnflag"), CH, "sd", by=["l_returnflag"]), CH).drop("l_returnflag")


@query(
    "rescale_quantile",
    f"WITH s AS (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS s_{c}' for c in CH)} FROM lineitem) SELECT {IDS}, {', '.join(f'round({c} / s_{c}, 6) + 0.0 AS {c}' for c in CH)} FROM lineitem, s",
)
def rescale_quantile(spark, d):
    return rounded(T.rescale(items(spark, d), CH, "quantile"), CH)


LENGTH = "sqrt(" + " + ".join(f"{c} * {c}" for c in CH) + ")"


@query("min_length_filter", f"SELECT {IDS} FROM lineitem WHERE {LENGTH} >= 50000")
def min_length_filter(spark, d):
    return T.at_least_length(items(spark, d), CH, 50000).select(*ID)


@query("row_limit_per_file", f"SELECT {IDS}, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {IDS}) <= 1000")
def row_limit_per_file(spark, d):
    """The first rows of each file: the limit is the operator."""
    return T.first_rows(items(spark, d, "l_returnflag"), "l_returnflag", ID, 1000).select(*ID, "l_returnflag")


@query(
    "import_prepared",
    f"WITH t AS (SELECT {IDS}, {', '.join(f'asinh(CASE WHEN abs({c}) < 1 THEN 0 ELSE {c} END / 5) AS {c}' for c in CH)} FROM lineitem) SELECT {IDS}, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in CH)} FROM t WHERE {LENGTH} >= 10",
)
def import_prepared(spark, d):
    """Threshold, transform and length filter in the documented order."""
    return rounded(T.prepared(items(spark, d), CH, least_length=10.0), CH)


@query("clamp_bins", f"SELECT {IDS}, CAST(least(6, greatest(-3, least(3, floor((l_quantity - 25) / 2))) + 3) AS INT) AS bin FROM lineitem")
def clamp_bins(spark, d):
    return items(spark, d).select(*ID, T.clamp_bins(F.col("l_quantity") - 25).alias("bin"))


@query("equal_frequency_bins", f"SELECT {IDS}, ntile(10) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, {IDS}) - 1 AS bin FROM lineitem")
def equal_frequency_bins(spark, d):
    return T.equal_frequency_bins(items(spark, d, "l_returnflag"), "l_quantity", 10, ID, ["l_returnflag"]).select(*ID, F.col("bin").cast("long").alias("bin"))


COS, SIN = math.cos(0.5) * 2, math.sin(0.5) * 2


@query("rotate_xy", f"SELECT {IDS}, round(l_quantity * {COS} - l_tax * {SIN}, 6) AS x, round(l_quantity * {SIN} + l_tax * {COS}, 6) AS y FROM lineitem")
def rotate_xy(spark, d):
    x, y = T.rotated(F.col("l_quantity"), F.col("l_tax"), 0.5, 2.0)
    return items(spark, d).select(*ID, r6(x).alias("x"), r6(y).alias("y"))


HASH = "floor(l_quantity * 1000)::BIGINT || '|' || floor(l_discount * 1000)::BIGINT || '|' || floor(l_tax * 1000)::BIGINT"


@query("row_hash_match", f"WITH h AS (SELECT l_orderkey AS id, l_returnflag, {HASH} AS h FROM lineitem), g AS (SELECT DISTINCT h FROM h WHERE l_returnflag = 'R') SELECT h.h, min(id) AS id FROM h JOIN g ON g.h = h.h WHERE l_returnflag = 'N' GROUP BY h.h")
def row_hash_match(spark, d):
    rows = items(spark, d, "l_returnflag").select(F.col("l_orderkey").alias("id"), "l_returnflag", T.row_hash(["l_quantity", "l_discount", "l_tax"]).alias("h"))
    return joins.first_match(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'"), "h", "id")


@query("gate_count", "SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity >= 10 AND l_quantity <= 30 AND l_discount <= 0.05) AS in_gate, count(*) AS total FROM lineitem GROUP BY ALL")
def gate_count(spark, d):
    return T.gate_counts(items(spark, d, "l_returnflag", "l_linestatus"), {"l_quantity": (10, 30), "l_discount": (None, 0.05)}, ["l_returnflag", "l_linestatus"])


@query("term_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def term_filter(spark, d):
    return table(spark, d, "events").where(F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))).select("event_id")


@query("term_any_of", "SELECT event_id FROM events SEMI JOIN (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 2) USING (event_type)")
def term_any_of(spark, d):
    events = table(spark, d, "events")
    top = events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(2)
    return events.join(top, "event_type", "left_semi").select("event_id")


@query("term_remap", "SELECT event_id, CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS term FROM events")
def term_remap(spark, d):
    mapping = spark.createDataFrame([("click", "press"), ("view", " ")], "old string, new string")
    return T.remapped(table(spark, d, "events").select("event_id", F.col("event_type").alias("term")), "term", mapping)


@query("term_normalise", "SELECT event_id, regexp_replace(lower(event_type), 's$', '') || 's' AS term FROM events")
def term_normalise(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.regexp_replace(F.lower("event_type"), "s$", ""), F.lit("s")).alias("term"))


@query("split_terms", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS term FROM part")
def split_terms(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("term"))


@query("reject_rows", "SELECT c_custkey, CASE WHEN try_cast(string_split(c_name, '#')[2] AS BIGINT) IS NULL THEN 'not a number' ELSE 'ok' END AS reason FROM customer")
def reject_rows(spark, d):
    number = F.expr("try_cast(get(split(c_name, '#'), 1) AS bigint)")
    return table(spark, d, "customer").select("c_custkey", F.when(number.isNull(), "not a number").otherwise("ok").alias("reason"))


@query("unknown_ids", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def unknown_ids(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("stratified_sample_hash", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761) % 4294967296, event_id) <= 100")
def stratified_sample_hash(spark, d):
    """At most 100 of each type: sampling is the operator."""
    return T.stratified(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100)


@query(
    "subset_and_rest",
    "WITH s AS (SELECT event_id FROM events ORDER BY (event_id * 2654435761) % 4294967296, event_id LIMIT 1000) SELECT 'subset' AS part, event_id FROM s UNION ALL SELECT 'rest', event_id FROM events ANTI JOIN s USING (event_id)",
)
def subset_and_rest(spark, d):
    """A subset of 1000 rows and its complement: the limit is the operator."""
    chosen, rest = T.subset_and_rest(table(spark, d, "events").select("event_id"), "event_id", 1000)
    return chosen.select(F.lit("subset").alias("part"), "event_id").unionByName(rest.select(F.lit("rest").alias("part"), "event_id"))


@query(
    "subset_renumbered",
    """WITH s AS (SELECT event_id FROM events ORDER BY (event_id * 2654435761) % 4294967296, event_id LIMIT 1000), b AS (SELECT 'subset' AS part, event_id FROM s UNION ALL SELECT 'rest', event_id FROM events ANTI JOIN s USING (event_id))
SELECT part, event_id AS old_id, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS event_id FROM b""",
)
def subset_renumbered(spark, d):
    """Both parts of subset_and_rest with ids from 0 on."""
    chosen, rest = T.subset_and_rest(table(spark, d, "events").select("event_id"), "event_id", 1000)
    both = [T.renumbered(part, "event_id").withColumn("part", F.lit(name)) for name, part in (("subset", chosen), ("rest", rest))]
    return both[0].unionByName(both[1])


PAIR = [(a, b) for i, a in enumerate(CH) for b in CH[i:]]


def pair_sql(build):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {build(a, b)} FROM lineitem" for a, b in PAIR)


@query("covariance_matrix", pair_sql(lambda a, b: f"round(covar_samp({a}, {b}), 3) + 0.0 AS cov"))
def covariance_matrix(spark, d):
    return aggregates.covariances(items(spark, d), CH).withColumn("cov", F.round("cov", 3) + 0.0)


@query("correlation_matrix", pair_sql(lambda a, b: f"round(corr({a}, {b}), 6) AS corr"))
def correlation_matrix(spark, d):
    return aggregates.correlations(items(spark, d), CH).withColumn("corr", r6("corr"))


@query("uncentered_correlation", pair_sql(lambda a, b: f"round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) AS corr"))
def uncentered_correlation(spark, d):
    return aggregates.correlations(items(spark, d), CH, centred=False).withColumn("corr", r6("corr"))


@query("data_bounds", "SELECT l_returnflag, " + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in CH) + " FROM lineitem GROUP BY 1")
def data_bounds(spark, d):
    vec = items(spark, d, "l_returnflag").withColumn("vec", F.array(*CH))
    out = aggregates.bounds(vec, 4, ["l_returnflag"])
    return out.select("l_returnflag", *[x for i, c in enumerate(CH) for x in (F.col("low")[i].alias(f"low_{c}"), F.col("high")[i].alias(f"high_{c}"))])


GRID = "least(19, floor((l_quantity - 0) * 20 / 50))::INT AS bx, least(19, floor((l_discount - 0) * 20 / 0.1))::INT AS \"by\""
GRIDDED = f"SELECT {GRID}, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2"


def grid(spark, d):
    return aggregates.histogram2d(items(spark, d), "l_quantity", "l_discount", (0, 0), (50, 0.1), 20)


@query("hist2d", GRIDDED)
def hist2d(spark, d):
    return grid(spark, d)


SMOOTH = f"""WITH g AS ({GRIDDED}), o AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 2.0) / (2 * pi()) AS w FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
s AS (SELECT (bx + dx)::INT AS bx, ("by" + dy)::INT AS "by", sum(n * w) AS density FROM g, o WHERE bx + dx BETWEEN 0 AND 19 AND "by" + dy BETWEEN 0 AND 19 GROUP BY 1, 2)"""


@query("hist2d_smooth", SMOOTH + " SELECT bx, \"by\", round(density, 6) AS density FROM s")
def hist2d_smooth(spark, d):
    return aggregates.smoothed(grid(spark, d), 20).withColumn("density", r6("density"))


@query("contour_levels", SMOOTH + ", r AS (SELECT bx, \"by\", round(density, 6) AS density FROM s) SELECT bx, \"by\", least(15, floor(density / (SELECT max(density) FROM r) * 15)::INT + 1) AS level FROM r")
def contour_levels(spark, d):
    return aggregates.levels(aggregates.smoothed(grid(spark, d), 20).withColumn("density", r6("density"))).select("bx", "by", "level")


@query(
    "contour_rings",
    SMOOTH + """, r AS (SELECT bx, "by", round(density, 6) AS density FROM s)
SELECT i::INTEGER AS level, bx, "by" FROM r, (SELECT unnest(range(1, 15)) AS i), (SELECT max(density) AS top FROM r) WHERE density > top * i / 15""",
)
def contour_rings(spark, d):
    """The grid points that the closed contour lines of each level enclose, by crossings of the lines with the points' rows."""
    density = cut_lineage(aggregates.smoothed(grid(spark, d), 20).withColumn("density", r6("density")))
    return contours.enclosed(contours.contours(density), density)


@query(
    "term_intersections",
    """WITH t AS (SELECT DISTINCT user_id AS id, event_type AS term FROM events) SELECT x.term AS a, y.term AS b, count(*) AS n FROM t x JOIN t y ON x.id = y.id AND x.term < y.term GROUP BY ALL""",
)
def term_intersections(spark, d):
    """Users with two types of events, from posting lists."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("term"))
    return postings.shared(cut_lineage(postings.index(rows, 64)))


@query(
    "term_searches",
    """WITH t AS (SELECT DISTINCT l_orderkey AS id, l_returnflag || l_linestatus AS term FROM lineitem), w AS (SELECT * FROM (VALUES ('AF+NO', ['AF', 'NO']), ('RF+NO', ['RF', 'NO']), ('AF+NF+RF', ['AF', 'NF', 'RF']), ('AO+XX', ['AO', 'XX'])) v(query, terms))
SELECT query, count(found.id) AS n FROM w LEFT JOIN (SELECT query AS q, id FROM t, w WHERE list_contains(terms, term) GROUP BY query, id, terms HAVING count(*) = len(terms)) found ON q = query GROUP BY query""",
)
def term_searches(spark, d):
    """Orders whose lines have all the states asked for."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("term"))
    return postings.matching(cut_lineage(postings.index(rows)), [["AF", "NO"], ["RF", "NO"], ["AF", "NF", "RF"], ["AO", "XX"]])


T_ = "(1 / (1 + 0.2316419 * abs(z)))"
UP = f"({T_} * (0.319381530 + {T_} * (-0.356563782 + {T_} * (1.781477937 + {T_} * (-1.821255978 + {T_} * 1.330274429)))) * exp(-z * z / 2) / sqrt(2 * 3.141592653589793))"


@query(
    "group_confidence",
    f"""WITH a AS (SELECT l_linestatus, avg(l_quantity) FILTER (l_returnflag = 'R') AS ma, avg(l_quantity) FILTER (l_returnflag = 'A') AS mc, count(*) FILTER (l_returnflag = 'R') AS na,
count(*) FILTER (l_returnflag = 'A') AS nc, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS vc FROM lineitem GROUP BY 1),
z AS (SELECT *, CASE WHEN na + nc > 2 THEN (ma - mc) / sqrt(((na - 1) * va + (nc - 1) * vc) / (na + nc - 2)) END AS z FROM a)
SELECT l_linestatus, na AS n_assay, nc AS n_control, round(z, 6) AS z, round(abs(2 * CASE WHEN z >= 0 THEN 1 - {UP} ELSE {UP} END - 1), 6) AS confidence FROM z""",
)
def group_confidence(spark, d):
    out = aggregates.group_confidence(items(spark, d, "l_linestatus", "l_returnflag"), "l_linestatus", "l_quantity", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    return out.select("l_linestatus", "n_assay", "n_control", r6("z").alias("z"), r6("confidence").alias("confidence"))


@query(
    "abundance_log_ratio",
    "WITH a AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'N') AS assay, count(*) FILTER (l_returnflag = 'A') AS control FROM lineitem GROUP BY 1) SELECT l_linestatus, assay, control, CASE WHEN assay > 0 AND control > 0 THEN round(ln(assay / control / (sum(assay) OVER () / sum(control) OVER ())), 6) END AS log_ratio FROM a",
)
def abundance_log_ratio(spark, d):
    from cairn.operators.statistics import abundance

    return abundance(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "N", "A").withColumn("log_ratio", r6("log_ratio"))


@query(
    "dimension_match_rate",
    "WITH p AS (SELECT o_orderkey, o_custkey AS a, o_custkey + 1 AS b FROM orders) SELECT count(*) AS pairs, round(avg(coalesce(x.c_nationkey = y.c_nationkey, false)::INT), 6) AS share FROM p LEFT JOIN customer x ON x.c_custkey = a LEFT JOIN customer y ON y.c_custkey = b",
)
def dimension_match_rate(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"))
    return joins.match_fraction(pairs, table(spark, d, "customer"), "a", "b", "c_custkey", "c_nationkey").withColumn("share", r6("share"))


@query("dimension_lookup", "SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(spark, d):
    out = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("o_orderkey", "n_name", "r_name")


@query("majority_vote", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1 AND event_type <> ''")
def majority_vote(spark, d):
    return aggregates.majority_vote(table(spark, d, "events"), "user_id", "event_type")


@query(
    "combined_annotators",
    "WITH a AS (SELECT o_custkey AS k, min(o_orderpriority) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_orderpriority) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.t, '') AS t0, coalesce(b.t, '') AS t1 FROM a FULL JOIN b ON a.k = b.k",
)
def combined_annotators(spark, d):
    one = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("t"))
    return joins.combined_annotators([one("O"), one("F")], "k", "t")


@query("class_fraction", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def class_fraction(spark, d):
    return aggregates.shares(table(spark, d, "events"), "event_type").withColumn("share", r6("share"))


@query("name_clean", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_type || ' (x):' || p_brand, '\\(.+\\)', ''), ':.*', '')) AS name FROM part")
def name_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", T.clean_name(F.concat("p_type", F.lit(" (x):"), "p_brand")).alias("name"))


@query("safe_file_names", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM customer")
def safe_file_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.safe_file_name(F.col("c_name")).alias("name"))


@query("label_compose", "SELECT p_partkey, p_partkey::VARCHAR || ' ' || p_brand AS label, printf('%.2f', p_retailprice) AS price FROM part")
def label_compose(spark, d):
    return table(spark, d, "part").select("p_partkey", T.label(F.col("p_partkey").cast("string"), F.col("p_brand")).alias("label"), F.format_string("%.2f", "p_retailprice").alias("price"))


@query("numeric_sort_rank", "SELECT p_partkey, row_number() OVER (ORDER BY try_cast(string_split(p_brand, '#')[2] AS DOUBLE) NULLS LAST, p_brand, p_partkey) AS r FROM part")
def numeric_sort_rank(spark, d):
    keyed = table(spark, d, "part").withColumn("k", F.expr("get(split(p_brand, '#'), 1)"))
    placed = O.places(keyed.select("p_partkey", "p_brand", "k"), [], [T.numeric_then_text("k")[0], "p_brand", "p_partkey"])
    return placed.select("p_partkey", (F.col("place") + 1).alias("r"))


@query("distinct_terms", "SELECT count(DISTINCT event_type) AS terms, count(DISTINCT user_id) AS users, max(event_id) + 1 AS next_id, min(event_id) AS first_id FROM events")
def distinct_terms(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("event_type").alias("terms"), F.countDistinct("user_id").alias("users"), (F.max("event_id") + 1).alias("next_id"), F.min("event_id").alias("first_id"))


@query("inverted_index", "SELECT event_type AS term, count(*) AS n, sum(user_id) AS checksum, len(list(event_id)) AS ids FROM events GROUP BY 1")
def inverted_index(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"), F.sum("user_id").alias("checksum"), F.size(F.collect_list("event_id")).cast("long").alias("ids"))


@query(
    "set_operations",
    "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)",
)
def set_operations(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("op"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@query("group_by_prefix", "SELECT string_split(c_name, '#')[1] AS prefix, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1, 2")
def group_by_prefix(spark, d):
    return table(spark, d, "customer").groupBy(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"), "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("row_order_in_file", f"SELECT {IDS}, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {IDS}) - 1 AS idx FROM lineitem")
def row_order_in_file(spark, d):
    return O.places(table(spark, d, "lineitem").select(*ID, "l_returnflag"), ["l_returnflag"], ID).select(*ID, "l_returnflag", F.col("place").alias("idx"))


@query("percentile_by_place", "SELECT l_returnflag, list_sort(list(l_extendedprice))[(count(*) * 0.05)::INT + 1] AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM (SELECT * FROM lineitem) GROUP BY 1")
def percentile_by_place(spark, d):
    """The value at place n / 20 of the sorted values (from 0), and the median."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", *ID)
    fifth = O.places(rows, ["l_returnflag"], ["l_extendedprice", *ID]).where("place = cast(round(group_rows * 0.05) AS bigint)").select("l_returnflag", F.col("l_extendedprice").alias("p5"))
    return fifth.join(O.quantiles(rows, {"median": F.col("l_extendedprice")}, 0.5, ["l_returnflag"]).withColumn("median", r6("median")), "l_returnflag")


@query("expression_colours", "SELECT event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 6) AS quantile, round((value - min(value) OVER (PARTITION BY event_type)) / nullif(max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type), 0), 6) AS linear FROM events")
def expression_colours(spark, d):
    """Node colour values on a quantile and on a linear scale."""
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    ends = events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = O.percent_places(events, "value", ["event_type"]).join(ends, "event_type")
    return placed.select("event_id", r6("share").alias("quantile"), r6(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))).alias("linear"))


@query("flat_view", "SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, coalesce(t.terms, '') AS terms FROM orders o LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS terms FROM lineitem GROUP BY 1) t ON t.l_orderkey = o.o_orderkey")
def flat_view(spark, d):
    terms = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("terms"))
    return table(spark, d, "orders").join(terms, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_totalprice", F.coalesce("terms", F.lit("")).alias("terms"))


@query("json_properties", "SELECT event_id, len(json_keys(props)) AS n FROM events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("back_transform", f"SELECT {IDS}, round(l_quantity, 6) AS l_quantity FROM lineitem")
def back_transform(spark, d):
    """asinh and back gives what went in."""
    there = T.transform(items(spark, d), ["l_quantity"])
    return there.select(*ID, r6(F.sinh("l_quantity") * 5.0).alias("l_quantity"))


@query(
    "scalar_functions",
    r"""SELECT p_partkey AS id, contains(p_name, 'widget') AS has, instr(p_name, 'o')::INT AS place, substring(p_name, 2, 3) AS part, regexp_matches(p_brand, '#1[0-9]') AS alike,
replace(p_name, ' ', '_') AS joined, rint AS rounded, p_retailprice = 'Infinity'::DOUBLE AS endless, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted,
list_position(string_split(p_name, ' '), 'widget')::BIGINT AS word, array_to_string(list_sort(string_split(p_type, '')), '') AS letters, true AS later
FROM (SELECT *, round_even(p_retailprice, 0) AS rint FROM part)""",
)
def scalar_functions(spark, d):
    """Functions of text, numbers and arrays that no other query uses; a shuffle is sorted again, and the clock only compared."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.contains("p_name", F.lit("widget")).alias("has"),
        F.instr("p_name", "o").alias("place"),
        F.substring("p_name", 2, 3).alias("part"),
        F.col("p_brand").rlike("#1[0-9]").alias("alike"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"),
        F.rint("p_retailprice").alias("rounded"),
        (F.col("p_retailprice") == float("inf")).alias("endless"),
        F.array_join(F.array_sort(F.split("p_name", " ")), " ").alias("sorted"),
        F.coalesce(F.expr("nullif(array_position(split(p_name, ' '), 'widget'), 0)"), F.lit(None).cast("long")).alias("word"),
        F.array_join(F.array_sort(F.shuffle(F.split("p_type", ""))), "").alias("letters"),
        (F.current_timestamp() > F.lit("2000-01-01").cast("timestamp")).alias("later"),
    )
