"""Contour rings and posting lists against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import contours, postings


def grid_of(spark, values):
    return spark.createDataFrame([(int(x), int(y), float(v)) for (x, y), v in np.ndenumerate(values) if v], "bx int, by int, density double")


def rings_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.level, tuple(r.ring)), {})[r.place] = (r.x, r.y)
    assert all(sorted(points) == list(range(len(points))) for points in out.values())
    return {k: [points[i] for i in range(len(points))] for k, points in out.items()}


def inside(ring, x, y):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(4))
def test_rings_close_and_hold_what_lies_above(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.where(rng.random((9, 7)) < 0.7, rng.random((9, 7)), 0) if seed else np.zeros((9, 7))
    if not seed:
        values[2:7, 1:6] = 1.0
        values[4, 3] = 0.0  # a ring in a ring
    grid = grid_of(spark, values)
    lines = contours.contours(grid, 6)
    found, top = rings_of(lines), values.max()
    for level in range(1, 6):
        own = [ring for (n, _), ring in found.items() if n == level]
        for ring in own:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
                assert math.dist((x0, y0), (x1, y1)) <= math.sqrt(2) + 1e-9  # no jumps: each step stays in one square
        for (x, y), v in np.ndenumerate(values):
            assert (sum(inside(ring, x, y + 1e-7) for ring in own) % 2 == 1) == (v > top * level / 6)
        assert sum(len(ring) for ring in own) == len({p for ring in own for p in ring}) or seed == 0
    assert {(r.level, r.bx, r.by) for r in contours.enclosed(lines, grid).collect()} == {(n, x, y) for n in range(1, 6) for (x, y), v in np.ndenumerate(values) if v > top * n / 6}
    if not seed:
        assert len(found) == 10 and {sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True)) > 0 for r in found.values()} == {True, False}


def test_an_empty_grid_has_no_rings(spark):
    assert contours.contours(grid_of(spark, np.zeros((2, 2)))).count() == 0


def test_postings(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), t) for t, share in (("a", 0.9), ("b", 0.3), ("c", 0.05), ("d", 0.0)) for i in np.flatnonzero(rng.random(500) < share) - 100]
    rows += rows[:50] + [(None, "a"), (7, None), (10**15, "a"), (10**15, "c")]
    df = spark.createDataFrame(rows, "id long, term string")
    of = {t: {i for i, x in rows if x == t and i is not None} for t in "abcd"}
    index = postings.index(df, 16).cache()
    assert index.agg(F.max(F.size("ids"))).first()[0] <= 16
    for r in index.collect():
        assert r.ids == sorted({i for i in of[r.term] if i // 16 == r.block})
    ids = lambda found: sorted(i for r in found.collect() for i in r.ids)
    assert ids(postings.with_all(index, ["a", "b", "c"])) == sorted(of["a"] & of["b"] & of["c"])
    assert ids(postings.with_all(index, ["a"], ["b", "c", "x"])) == sorted(of["a"] - of["b"] - of["c"])
    assert ids(postings.with_any(index, ["b", "c", "x"])) == sorted(of["b"] | of["c"]) and ids(postings.with_any(index, [])) == []
    assert ids(postings.with_all(index, ["a", "d"])) == []
    assert {(r.a, r.b): r.n for r in postings.shared(index).collect()} == {(x, y): len(of[x] & of[y]) for x in "abc" for y in "abc" if x < y}
    halves = [postings.index(df.where(F.pmod("id", F.lit(2)) == k), 16) for k in (0, 1)]
    assert sorted(map(str, postings.merged(*halves).collect())) == sorted(map(str, index.collect()))
    with pytest.raises(ValueError):
        postings.with_all(index, [])
