"""Places, bins and exact quantiles of whole tables whose groups may each be larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut_lineage

#: monotonically_increasing_id() holds the place within a partition in its low bits.
PLACE_BITS = 33
#: Ranges of at most this many rows (one for each pair of partition and group) are sent to the tasks, more are joined.
MOST_SENT_RANGES = 100_000
#: Groups whose brackets are sent to the tasks (some kilobytes each), more are joined.
MOST_SENT_GROUPS = 5_000
#: percentile_approx misses a rank by at most one in this many rows; a bracket of four such steps holds what is sought.
ACCURACY = 20_000
#: Values of a group that one task may hold to give exact quantiles at once.
MOST_HELD = 400_000


def places(df: DataFrame, by: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """`df` with `place` (from 0, by `order` within its `by` group) and `group_rows`, both long.

    Rows are dealt by ranges of (by, order) and sorted; a row's place is its place in its partition and the rows of its
    group in earlier partitions. So a group is spread over as many tasks as its size asks, and no window holds it. Rows
    that are equal in `order` have places in any order, and stay in one task: end `order` with a key. A null in `by` is
    a group of its own.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", PLACE_BITS)
    ranges = dealt.groupBy(part.alias("__part"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    group = Window.partitionBy(*[f"__by{i}" for i in range(len(by))])  # a row for each partition that the group reaches
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut_lineage(ranges.withColumns({"__before": before, "group_rows": F.sum("__rows").over(group)}))
    if ranges.count() <= MOST_SENT_RANGES:
        ranges = F.broadcast(ranges)
    same = part == F.col("__part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    found = dealt.join(ranges, same).withColumn("place", F.col("__before") + F.col("__at") - F.col("__first"))
    return found.select(*df.columns, "place", "group_rows")


def bins_of(place: Column, rows: Column, bins: int) -> Column:
    """The bin (from 0) of each place when `rows` rows go into `bins` runs whose sizes differ by one at most, larger ones first."""
    size, larger = F.floor(rows / bins), rows % bins
    ahead = larger * (size + 1)
    return F.when(place < ahead, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - ahead) / F.greatest(size, F.lit(1))))


def quantiles(df: DataFrame, values: dict[str, Column], share: float, by: list[str], also: list[Column] | None = None) -> DataFrame:
    """For each `by` group the exact quantile of each value by linear interpolation, under its name; nulls are left out.

    Groups are counted first. Those that hold MOST_HELD values at most go by Spark's own exact percentile, which holds a
    group's different values in one task; larger ones go by brackets (`_by_brackets`), which no size can fill. `also`
    are further aggregates.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share between 0 and 1")
    keys, also = [f"__by{i}" for i in range(len(by))], also or []
    valued = df.select("*", *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[v.cast("double").alias(f"__v{k}") for k, v in enumerate(values.values())])
    sizes = cut_lineage(valued.groupBy(*keys).agg(F.count("*").alias("__rows")))
    most = MOST_HELD // max(1, len(values))
    groups = sizes.agg(F.count("*").alias("n"), F.max("__rows").alias("most")).first()
    exact = [F.expr(f"percentile(__v{k}, {share!r}D) AS __q{k}") for k in range(len(values))]

    def held(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(*exact, *also)
        others = [c for c in found.columns if c not in keys and not c.startswith("__q")]
        return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *others, *[F.col(f"__q{k}").alias(name) for k, name in enumerate(values)])

    if (groups["most"] or 0) <= most:
        return held(valued)
    if not by:
        return _by_brackets(valued, values, share, by, also)
    sizes = sizes.withColumnsRenamed({k: f"{k}_" for k in keys})
    if groups["n"] <= MOST_SENT_GROUPS:
        sizes = F.broadcast(sizes)
    sized = valued.join(sizes, F.expr(" AND ".join(f"{k} <=> {k}_" for k in keys) or "true")).drop(*(f"{k}_" for k in keys))
    small, large = (sized.where(F.col("__rows") <= most).drop("__rows"), sized.where(F.col("__rows") > most).drop("__rows"))
    return _by_brackets(large, values, share, by, also).unionByName(held(small))


def _by_brackets(valued: DataFrame, values: dict[str, Column], share: float, by: list[str], also: list[Column]) -> DataFrame:
    """quantiles() of rows with their keys (__by0, ...) and values (__v0, ...) by two passes of bounded memory.

    The first brackets the quantile by approximate percentiles. The second counts the values below the bracket and at
    its ends, and gathers those strictly inside: at most about 10 in ACCURACY of a group, since a more frequent value
    would itself be an end.
    """
    step = 4.0 / ACCURACY
    ends = f"array({max(0.0, share - step)!r}D, {min(1.0, share + step)!r}D)"
    keys, many = [f"__by{i}" for i in range(len(by))], range(len(values))
    # one text for each aggregate, since a profile has many
    texts = [t for k in many for t in (f"percentile_approx(__v{k}, {ends}, {ACCURACY}) AS __e{k}", f"count(__v{k}) AS __n{k}")]
    brackets = cut_lineage(valued.groupBy(*keys).agg(*map(F.expr, texts), *also))
    kept = [c for c in brackets.columns if c not in keys]
    brackets = brackets.withColumnsRenamed({k: f"{k}_" for k in keys})
    if brackets.count() <= MOST_SENT_GROUPS:
        brackets = F.broadcast(brackets)
    rows = valued.select(*keys, *[f"__v{k}" for k in many])
    same = F.expr(" AND ".join(f"{k} <=> {k}_" for k in keys) or "true")
    second = []
    for k in many:
        v, low, high = f"__v{k}", f"__e{k}[0]", f"__e{k}[1]"
        parts = {
            "below": f"count_if({v} < {low})",
            "at_low": f"count_if({v} = {low})",
            "inside": f"collect_list(CASE WHEN {v} > {low} AND {v} < {high} THEN {v} END)",
            "before": f"max(CASE WHEN {v} < {low} THEN {v} END)",
            "at_high": f"count_if({v} = {high} AND {high} > {low})",
            "after": f"min(CASE WHEN {v} > {high} THEN {v} END)",
        }
        named = ", ".join(f"'{name}', {text}" for name, text in parts.items())
        second.append(F.expr(f"named_struct('ends', first(__e{k}), 'n', first(__n{k}), {named}) AS __s{k}"))
    extra = [c for c in kept if not c.startswith("__")]
    counted = rows.join(brackets, same).groupBy(*keys).agg(*second, *[F.first(c).alias(c) for c in extra])
    every = F.array(*[f"__s{k}" for k in many])

    def at(s: Column, place: Column) -> Column:
        """The value at a place (from 0) of the sorted values."""
        beyond = place - s["below"]
        inner = beyond - s["at_low"]
        past = inner - F.size(s["inside"])
        found = F.when(beyond == -1, s["before"]).when((beyond >= 0) & (inner < 0), s["ends"][0])
        found = found.when((inner >= 0) & (past < 0), F.get(F.array_sort(s["inside"]), inner.cast("int")))
        found = found.when((past >= 0) & (past < s["at_high"]), s["ends"][1]).when(past == s["at_high"], s["after"])
        return found.otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    def one(s: Column) -> Column:
        exact = (s["n"] - 1) * F.lit(float(share))
        down = F.floor(exact)
        beyond = F.when(exact > down, (exact - down) * (at(s, down + 1) - at(s, down))).otherwise(0.0)
        return F.when(s["n"] > 0, at(s, down) + beyond)

    found = counted.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *extra, F.transform(every, one).alias("__found"))
    return found.select(*by, *extra, *[F.col("__found")[k].alias(name) for k, name in enumerate(values)])


def percent_places(df: DataFrame, value: str, by: list[str] | None = None, share: str = "share") -> DataFrame:
    """`df` with the share of its group's other rows that lie below each value (0 for a single row); equal values are alike.

    Rows are counted by value first; the places of the counts follow as in places().
    """
    by = by or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__by{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("__value")).agg(F.count("*").alias("__rows"))
    dealt = cut_lineage(counts.repartitionByRange(n, *keys, "__value").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)  # a row for each partition that the group reaches
    earlier = Window.unboundedPreceding, -1
    totals = dealt.groupBy("__part", *keys).agg(F.sum("__rows").alias("__sum"))
    totals = totals.select("__part", *keys, F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(*earlier)), F.lit(0)).alias("__ahead"), F.sum("__sum").over(group).alias("__all"))
    totals = cut_lineage(totals.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"{k}_") for k in keys], "__ahead", "__all"))
    if totals.count() <= MOST_SENT_RANGES:
        totals = F.broadcast(totals)
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inside = F.coalesce(F.sum("__rows").over(Window.partitionBy("__part", *keys).orderBy("__value").rowsBetween(*earlier)), F.lit(0))
    placed = dealt.withColumn("__inside", inside).join(totals, same)
    shares = placed.select(*keys, "__value", F.coalesce(F.try_divide(F.col("__ahead") + F.col("__inside"), F.col("__all") - 1), F.lit(0.0)).alias(share))
    alike = F.col(value).eqNullSafe(F.col("__value"))
    for c, k in zip(by, keys, strict=True):
        alike = alike & F.col(c).eqNullSafe(F.col(k))
    return df.join(shares, alike).drop("__value", *keys)
