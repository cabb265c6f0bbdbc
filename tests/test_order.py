"""Places, bins, shares and quantiles against numpy, with small brackets, ties, nulls and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import order
from cairn.operators import transforms as T


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(5)
    values = [0.0] * 700 + [float(v) for v in rng.normal(size=500)] + [None] * 9
    groups = [None if i % 31 == 0 else "hot" if i % 3 else "g" + str(i % 5) for i in range(len(values))]
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(zip(groups, values, strict=True))], "id long, g string, v double").repartition(5)


def grouped(rows):
    found = {}
    for r in rows.collect():
        found.setdefault(r.g, []).append(r)
    return found


@pytest.mark.parametrize("sent", [0, 1000])
def test_places_and_bins(rows, monkeypatch, sent):
    monkeypatch.setattr(order, "MOST_SENT_RANGES", sent)
    placed = order.places(rows, ["g"], ["v", "id"], 7)
    for members in grouped(placed).values():
        wanted = sorted(members, key=lambda r: (r.v is not None, r.v or 0.0, r.id))
        assert [r.place for r in wanted] == list(range(len(members))) and {r.group_rows for r in members} == {len(members)}
    whole = T.equal_frequency_bins(rows, "v", 7, ["id"]).groupBy("bin").count().collect()
    assert sorted(r["bin"] for r in whole) == list(range(7)) and {r["count"] for r in whole} <= {172, 173}
    few = sorted(r["bin"] for r in T.equal_frequency_bins(rows.where("id < 3"), "v", 7, ["id"]).collect())
    assert few == [0, 1, 2]
    assert order.places(rows.where("false"), ["g"], ["id"]).count() == 0


@pytest.mark.parametrize("accuracy,held", [(20_000, 0), (40, 0), (40, "middle"), (40, 10**6)])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.77, 0.99, 1.0])
def test_quantiles(rows, monkeypatch, accuracy, held, share):
    """By brackets, by Spark's percentile, and with some groups each way."""
    sizes = sorted(len(m) for m in grouped(rows).values())
    assert sizes[0] < sizes[-1]
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    monkeypatch.setattr(order, "MOST_HELD", 2 * sizes[-1] - 1 if held == "middle" else held)
    found = {r.g: r for r in order.quantiles(rows, {"q": F.col("v"), "minus": -F.col("v")}, share, ["g"], [F.count("*").alias("n")]).collect()}
    for g, members in grouped(rows).items():
        known = [r.v for r in members if r.v is not None]
        assert found[g].n == len(members)
        assert found[g].q == pytest.approx(np.quantile(known, share)) and found[g].minus == pytest.approx(np.quantile([-v for v in known], share))
    whole = [r.v for r in rows.collect() if r.v is not None]
    assert order.quantiles(rows, {"q": F.col("v")}, share, []).first().q == pytest.approx(np.quantile(whole, share))


@pytest.mark.parametrize("held", [0, 10**6])
def test_quantiles_of_little(spark, rows, monkeypatch, held):
    monkeypatch.setattr(order, "MOST_HELD", held)
    assert order.quantiles(rows.where("v IS NULL"), {"q": F.col("v")}, 0.5, []).first().q is None
    assert order.quantiles(rows.where("false"), {"q": F.col("v")}, 0.5, ["g"]).count() == 0
    with pytest.raises(ValueError):
        order.quantiles(rows, {"q": F.col("v")}, 1.5, [])
    for n in range(1, 9):
        numbers = spark.range(n).select(F.col("id").cast("double").alias("v"))
        for share in (0.1, 0.5, 0.99):
            assert order.quantiles(numbers, {"q": F.col("v")}, share, []).first().q == pytest.approx(np.quantile(range(n), share))


def test_percent_places(rows):
    known = rows.where("v IS NOT NULL")
    for members in grouped(order.percent_places(known, "v", ["g"])).values():
        for r in members:
            assert r.share == pytest.approx(sum(o.v < r.v for o in members) / max(1, len(members) - 1))
    whole = order.percent_places(known, "v").collect()
    assert len(whole) == 1200 and min(r.share for r in whole) == 0
