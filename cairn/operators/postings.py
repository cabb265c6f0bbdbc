"""An inverted index: for each term, ascending ids in blocks of a fixed span of ids.

A term in very many rows has many blocks, none larger than the span, and blocks of different terms over the same span
line up: terms are intersected, united and subtracted block by block, by an equi-join on the block's number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 4096


def index(terms: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, block, ids): from (id, term); null terms and ids and repeated rows do not count."""
    rows = terms.where("id IS NOT NULL AND term IS NOT NULL").select("term", F.floor(F.col("id") / span).cast("long").alias("block"), "id")
    return rows.groupBy("term", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One index of two."""
    return old.unionByName(new).groupBy("term", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def with_all(postings: DataFrame, terms: list[str], without: list[str] = ()) -> DataFrame:
    """(block, ids): ids that have every one of `terms` and none of `without`; only the blocks of those terms are read."""
    if not terms:
        raise ValueError("at least one term is needed")
    of = lambda t, i: postings.where(F.col("term") == t).select("block", F.col("ids").alias(f"ids{i}"))
    found = of(terms[0], 0)
    for i, t in enumerate(terms[1:], start=1):
        found = found.join(of(t, i), "block").select("block", F.array_intersect("ids0", f"ids{i}").alias("ids0"))
    for i, t in enumerate(without, start=1):
        found = found.join(of(t, i), "block", "left").select("block", F.when(F.col(f"ids{i}").isNull(), F.col("ids0")).otherwise(F.array_except("ids0", f"ids{i}")).alias("ids0"))
    return found.select("block", F.array_sort("ids0").alias("ids")).where(F.size("ids") > 0)


def with_any(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(block, ids): ids that have at least one of `terms`."""
    own = postings.where(F.col("term").isin(list(terms))) if terms else postings.limit(0)
    return own.groupBy("block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def shared(postings: DataFrame) -> DataFrame:
    """(a, b, n): for each two different terms with ids in common, how many; blocks meet by number."""
    left, right = (postings.select(F.col("term").alias(t), "block", F.col("ids").alias(f"ids_{t}")) for t in ("a", "b"))
    met = left.join(right, "block").where("a < b").select("a", "b", F.size(F.array_intersect("ids_a", "ids_b")).alias("n"))
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def matching(postings: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """(query, n): for each list of terms how many ids have them all."""
    return reduce(DataFrame.unionByName, [with_all(postings, terms).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n")).select(F.lit("+".join(terms)).alias("query"), "n") for terms in wanted])
