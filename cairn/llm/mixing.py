"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of `block_rows` documents. With target weight w (a whole number) of W in all, a
source's i-th block is released at slot floor((i - 1) W / w) and due by slot ceil(i W / w); earliest deadline first among
the released blocks fills every slot, and at any slot each source is less than one block from its exact share. When a
source has no blocks left, the weights of the others are scaled up and a new phase begins, so every document is placed
once and none is repeated.

After W slots every source has had exactly w blocks, so the schedule repeats: the driver makes one period for each
phase, never the whole schedule, and its work does not grow with the documents. A document's slot follows from its
block's number: the phase, the period in the phase, and the place in the period. The period is joined to the documents,
and blocks have one length at every size of the corpus.

Documents find their block by an exact rank within their source, from counts of hash buckets (few for a small source,
many for a large one) and a rank inside each bucket; no source meets in one task.

Limits, checked before the work: MOST_SOURCES sources (merge small ones before mixing) and given weights that sum to at
most MOST_PERIOD when divided by their common divisor.

Defined cases: a null source is a source of its own; sources without a given weight have weight 1 where weights are
given; weights must be positive; inside a source the order is by a hash of id and text, then id; repeated rows are
each placed (they share a hash bucket, while copies under other ids do not); an empty table gives an empty result;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import gcd, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import narrow, numbered, read_table

BLOCK_ROWS = 16
DEFAULT_PERIOD = 2_048
MOST_PERIOD = 65_536
MOST_SOURCES = 1_024
BUCKET_ROWS = 256
MOST_BUCKETS = 65_536


def period(weights: dict[str, int]) -> list[str]:
    """The source of each of the sum(weights) slots of one period: earliest deadline first among released blocks.

    Ties of deadlines go to the source whose next block is due first, then by name.
    """
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 1) for s, w in weights.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    order: list[str] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, -(-(i + 1) * total // weights[s]), s, i))
        _, next_due, s, i = heapq.heappop(ready)
        order.append(s)
        if i < weights[s]:
            heapq.heappush(waiting, (i * total // weights[s], next_due, s, i + 1))
    return order


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """The phases of the schedule: each with its first slot, length, order (one period) and the blocks `done` before it."""
    done = dict.fromkeys(blocks, 0)
    active = sorted(s for s in blocks if blocks[s] > 0)
    slot, found = 0, []
    while active:
        common = gcd(*(weights[s] for s in active))
        share = {s: weights[s] // common for s in active}
        order = period(share)
        places: dict[str, list[int]] = {s: [] for s in active}
        for t, s in enumerate(order):
            places[s].append(t)

        def last_slot(s):  # of this source's last block, from the start of the phase
            left = blocks[s] - done[s] - 1
            return left // share[s] * len(order) + places[s][left % share[s]]  # noqa: B023

        length = min(map(last_slot, active)) + 1
        found.append({"slot": slot, "length": length, "order": order, "done": {s: done[s] for s in active}})
        for s in active:
            done[s] += length // len(order) * share[s] + bisect_left(places[s], length % len(order))
        slot += length
        active = [s for s in active if done[s] < blocks[s]]
    return found


def default_weights(counts: dict[str, int]) -> dict[str, int]:
    """In proportion to the square roots of the counts, DEFAULT_PERIOD in all or so: large sources are damped, small ones raised."""
    roots = {s: isqrt(n * 1_000_000) for s, n in counts.items()}
    total = max(1, sum(roots.values()))
    return {s: max(1, round(r * DEFAULT_PERIOD / total)) for s, r in roots.items()}


def _placed(docs: DataFrame, weights: dict[str, int] | None, source: str, block_rows: int) -> DataFrame:
    """`docs` with columns named c0, c1, ..., and __block, __slot and __position."""
    spark = docs.sparkSession
    plain, places, at = numbered(docs)
    keyed = plain.withColumns(
        {
            "__key": F.when(F.col(at[source]).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s:"), F.col(at[source]).cast("string"))),
            "__hash": F.xxhash64(at["doc_id"], *([at["text"]] if "text" in at else [])),
        }
    )
    counts = {r["__key"]: r["n"] for r in keyed.groupBy("__key").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: merge small ones before mixing")
    given = default_weights(counts) if weights is None else {k: weights.get(k[2:] if k != "n" else None, 1) for k in counts}
    if any(w <= 0 or w != int(w) for w in given.values()):
        raise ValueError("weights must be positive whole numbers")
    given = {k: int(w) for k, w in given.items()}
    if given and sum(given.values()) // gcd(*given.values()) > MOST_PERIOD:
        raise ValueError(f"weights sum to more than {MOST_PERIOD}")
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    steps, slots, missing = [], [], 0  # missing: rows by which full blocks before a phase would be too many
    plan = phases(blocks, given)
    for number, phase in enumerate(plan):
        of = dict.fromkeys(phase["done"], 0)
        for t, k in enumerate(phase["order"]):
            if t < phase["length"]:
                slots.append((number, k, of[k], t))
            of[k] += 1
        steps += [(k, number, phase["done"][k], of[k], len(phase["order"]), phase["slot"], missing) for k in of]
        ends = [k for k in of if number + 1 == len(plan) or k not in plan[number + 1]["done"]]
        missing += sum(blocks[k] * block_rows - counts[k] for k in ends)
    starts: dict[str, list] = {k: [] for k in counts}
    for k, *step in steps:
        starts[k].append(step)
    fields = "phase: int, first: long, share: long, period: long, slot: long, missing: long"
    known = spark.createDataFrame(
        [(k, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)), starts[k]) for k, n in counts.items()], f"__key string, __buckets long, __phases array<struct<{fields}>>"
    )  # a row for each source
    order = spark.createDataFrame(slots, "__phase int, __key string, __place long, __t long")
    dealt = keyed.join(F.broadcast(known.select("__key", "__buckets")), "__key").withColumn("__bucket", F.pmod("__hash", "__buckets"))
    sizes = dealt.groupBy("__key", "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__key", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__key", "__bucket").orderBy("__hash", at["doc_id"])
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(before, ["__key", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__start"))
    ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / block_rows).cast("long")).join(F.broadcast(known.select("__key", "__phases")), "__key")
    ranked = ranked.withColumn("__p", F.expr("element_at(filter(__phases, p -> p.first <= __block), -1)")).drop("__phases")
    ranked = ranked.withColumns({"__phase": F.col("__p.phase"), "__place": F.expr("pmod(__block - __p.first, __p.share)")})
    placed = ranked.join(F.broadcast(order) if len(slots) <= MOST_PERIOD else order, ["__phase", "__key", "__place"])
    placed = placed.withColumn("__slot", F.expr("__p.slot + cast(floor((__block - __p.first) / __p.share) AS bigint) * __p.period + __t"))
    placed = placed.withColumn("__position", F.expr(f"__slot * {block_rows} - __p.missing + __rank - __block * {block_rows}"))
    return placed.select(*places, "__block", "__slot", "__position")


def place(docs: DataFrame, weights: dict[str, int] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`docs` with __block (in its source), __slot and __position (0, 1, ... over all rows) as its last columns."""
    return _placed(docs, weights, source, block_rows).toDF(*docs.columns, "__block", "__slot", "__position")


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of `docs`, their columns unchanged, in the order of the mix."""
    return _placed(docs, weights, source, block_rows).orderBy("__position").drop("__block", "__slot", "__position").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = narrow(read_table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return place(docs).select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))
