"""Contour lines of a grid by marching squares, joined into closed rings by list ranking.

A grid is (bx, by, value) with whole coordinates; cells without a row are 0, and so is everything outside, so every
line closes. Each square of four grid points gives up to two segments for a level, from one of its edges to another,
with the greater values on the left. On each level an edge is the end of one segment and the start of another, so
segments are a successor list, and its rings and the places in them come from pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import cut_lineage

BOTTOM, RIGHT, TOP, LEFT = range(4)
#: Segments by the corners that lie above the level (1: lower left, 2: lower right, 4: upper right, 8: upper left), and
#: whether the middle does, which decides where two opposite corners do.
SEGMENTS = {
    1: [(BOTTOM, LEFT)], 2: [(RIGHT, BOTTOM)], 4: [(TOP, RIGHT)], 8: [(LEFT, TOP)], 3: [(RIGHT, LEFT)], 6: [(TOP, BOTTOM)], 12: [(LEFT, RIGHT)], 9: [(BOTTOM, TOP)],
    14: [(LEFT, BOTTOM)], 13: [(BOTTOM, RIGHT)], 11: [(RIGHT, TOP)], 7: [(TOP, LEFT)],
    5: [(BOTTOM, LEFT), (TOP, RIGHT)], 10: [(RIGHT, BOTTOM), (LEFT, TOP)], 5 + 16: [(BOTTOM, RIGHT), (TOP, LEFT)], 10 + 16: [(LEFT, BOTTOM), (RIGHT, TOP)],
}


def _corners(grid: DataFrame, value: str) -> DataFrame:
    """(x, y, c0..c3): the values at the corners of each square that touches a grid point, counter-clockwise from the lower left."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(c).alias("c")) for c, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])])
    rows = grid.select("bx", "by", F.col(value).alias("v"), F.inline(shifts))
    squares = rows.groupBy((F.col("bx") - F.col("dx")).alias("x"), (F.col("by") - F.col("dy")).alias("y"))
    return squares.agg(*[F.coalesce(F.max(F.when(F.col("c") == c, F.col("v"))), F.lit(0.0)).alias(f"c{c}") for c in range(4)])


def segments(grid: DataFrame, thresholds: list[float], value: str = "density") -> DataFrame:
    """(level, node, next, x, y): the segments of each threshold (levels from 1), as numbered edges of the grid, and where the first edge is crossed."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds, start=1)])
    squares = _corners(grid, value).select("*", F.inline(levels))
    above = sum(((F.when(F.col(f"c{c}") > F.col("t"), 1 << c).otherwise(0)) for c in range(1, 4)), F.when(F.col("c0") > F.col("t"), 1).otherwise(0))
    middle = (F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")) / 4 > F.col("t")
    squares = squares.withColumn("above", above).withColumn("case", F.when(F.col("above").isin(5, 10) & middle, F.col("above") + 16).otherwise(F.col("above")))
    known = F.create_map(*[x for case, own in SEGMENTS.items() for x in (F.lit(case), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in own]))])
    found = squares.where(~F.col("above").isin(0, 15)).select("*", F.explode(known[F.col("case")]).alias("s"))

    def at(side: Column, of: dict[int, Column]) -> Column:
        return F.when(side == BOTTOM, of[BOTTOM]).when(side == RIGHT, of[RIGHT]).when(side == TOP, of[TOP]).otherwise(of[LEFT])

    def edge(x: Column, y: Column, upright: int) -> Column:
        return F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), F.lit(upright).alias("upright"))

    x, y = F.col("x"), F.col("y")
    share = lambda a, b: (F.col("t") - F.col(a)) / (F.col(b) - F.col(a))
    edges = {BOTTOM: edge(x, y, 0), TOP: edge(x, y + 1, 0), LEFT: edge(x, y, 1), RIGHT: edge(x + 1, y, 1)}
    xs = {BOTTOM: x + share("c0", "c1"), TOP: x + share("c3", "c2"), LEFT: x.cast("double"), RIGHT: (x + 1).cast("double")}
    ys = {BOTTOM: y.cast("double"), TOP: (y + 1).cast("double"), LEFT: y + share("c0", "c3"), RIGHT: y + share("c1", "c2")}
    side = F.col("s.a")
    return found.select("level", at(side, edges).alias("node"), at(F.col("s.b"), edges).alias("next"), at(side, xs).alias("x"), at(side, ys).alias("y"))


def rings(found: DataFrame) -> DataFrame:
    """(level, ring, place, x, y): `segments` as closed rings, each named by its least edge, with places from 0 at that edge."""
    found = cut_lineage(found)
    now = found.select("level", "node", F.col("next").alias("ahead"), F.least("node", "next").alias("ring"))
    while True:  # the least edge among the next 1, 2, 4, ... of each
        there = now.select("level", F.col("node").alias("ahead"), F.col("ahead").alias("beyond"), F.col("ring").alias("other"))
        step = cut_lineage(now.join(there, ["level", "ahead"]).select("level", "node", F.col("beyond").alias("ahead"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("lower")))
        now = step.drop("lower")
        if step.where("lower").isEmpty():
            break
    now = found.join(now.select("level", "node", "ring"), ["level", "node"]).select("level", "node", "ring", F.col("next").alias("ahead"), F.lit(1).alias("steps"))
    while True:  # steps until the ring's name comes
        there = now.select("level", F.col("node").alias("ahead"), F.col("ahead").alias("beyond"), F.col("steps").alias("more"))
        open_ = F.col("ahead") != F.col("ring")
        step = now.join(there, ["level", "ahead"]).select("level", "node", "ring", F.when(open_, F.col("beyond")).otherwise(F.col("ahead")).alias("ahead"), (F.col("steps") + F.when(open_, F.col("more")).otherwise(0)).alias("steps"))
        now = cut_lineage(step)
        if now.where("ahead <> ring").isEmpty():
            break
    sizes = now.groupBy("level", "ring").agg(F.count("*").alias("size"))
    placed = now.join(sizes, ["level", "ring"]).select("level", "node", "ring", (F.col("size") - F.col("steps")).alias("place"))
    return placed.join(found.drop("next"), ["level", "node"]).select("level", "ring", "place", "x", "y")


def contours(grid: DataFrame, count: int = 15, value: str = "density") -> DataFrame:
    """rings() at the thresholds 1 / count, 2 / count, ... of the greatest value, below that value."""
    top = grid.agg(F.max(value)).first()[0]
    return rings(segments(grid, [top * i / count for i in range(1, count)] if top else [], value)) if top else rings(segments(grid, [1.0], value))


def enclosed(lines: DataFrame, grid: DataFrame) -> DataFrame:
    """(level, bx, by): the grid points inside an odd number of rings of a level, by the crossings to their left on their own row."""
    on_row = lines.where(F.col("ring").isNotNull() & (F.col("y") == F.floor("y")) & (F.col("x") != F.floor("x"))).select("level", F.col("y").cast("int").alias("by"), "x")
    return on_row.join(grid.select("bx", "by"), "by").where("x < bx").groupBy("level", "bx", "by").agg(F.count("*").alias("n")).where("n % 2 = 1").select("level", "bx", "by")
