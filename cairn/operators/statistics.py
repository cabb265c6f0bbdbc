"""Enrichment, abundance, principal components, matching and discriminants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of tails that are summed at once.
TERMS = 1_000_000


def log_factorials(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers: sums up to 32, Stirling's series beyond."""
    n = np.asarray(n, dtype=float)
    few = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 33)))])[np.minimum(n, 32).astype(int)]
    x = np.maximum(n, 1)
    return np.where(n <= 32, few, x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5))


def tails(n: np.ndarray, m: np.ndarray, d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each row the hypergeometric chance of h or more of m marked among d drawn of n: about TERMS terms at once."""
    low, high = np.maximum(np.maximum(h, d + m - n), 0), np.minimum(m, d)
    out, left = np.zeros(len(n)), np.flatnonzero(high >= low)
    choose = lambda a, b: log_factorials(a) - log_factorials(b) - log_factorials(a - b)
    begin = low.copy()
    while len(left):
        sizes = np.minimum(high[left] - begin[left] + 1, TERMS)
        own = left[: max(1, int(np.searchsorted(np.cumsum(sizes), TERMS, side="right")))]
        sizes = sizes[: len(own)]
        row = np.repeat(own, sizes)
        k = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        terms = np.exp(choose(m[row], k) + choose(n[row] - m[row], d[row] - k) - choose(n[row], d[row]))
        out[own] += np.bincount(np.repeat(np.arange(len(own)), sizes), terms, minlength=len(own))
        begin[own] += sizes
        left = np.concatenate([own[begin[own] <= high[own]], left[len(own) :]])
    return np.minimum(out, 1.0)


@F.pandas_udf(DoubleType())
def _tail(population: pd.Series, marked: pd.Series, drawn: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series(tails(*(x.to_numpy(dtype=np.int64) for x in (population, marked, drawn, hits))))


def enrichment_counts(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """(cluster, term, hits, drawn, marked, population) for terms of at least 2 members, at least 2 of them in the cluster."""
    terms = annotations.where("trim(term) <> ''").select("id", "term").distinct()
    marked = terms.groupBy("term").agg(F.count("*").alias("marked")).where("marked >= 2")
    drawn = members.groupBy("cluster").agg(F.count("*").alias("drawn"))
    population = members.agg(F.count("*").alias("population"))
    hits = members.join(terms, "id").groupBy("cluster", "term").agg(F.count("*").alias("hits")).where("hits >= 2")
    return hits.join(marked, "term").join(drawn, "cluster").join(F.broadcast(population)).select("cluster", "term", "hits", "drawn", "marked", "population")


def enrichment(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """enrichment_counts with p, the hypergeometric chance of as many hits or more; on cluster x term rows."""
    return enrichment_counts(members, annotations).withColumn("p", _tail("population", "marked", "drawn", "hits"))


def abundance(counts: DataFrame, cluster: str, condition: str, assay: str, control: str) -> DataFrame:
    """(cluster, assay, control, log_ratio): ln of the cluster's assay to control ratio over the overall ratio; null where either is 0."""
    n = counts.groupBy(cluster).agg(F.count_if(F.col(condition) == assay).alias("assay"), F.count_if(F.col(condition) == control).alias("control"))
    everywhere = Window.partitionBy()
    whole = F.try_divide(F.sum("assay").over(everywhere), F.sum("control").over(everywhere))
    ratio = F.try_divide(F.try_divide(F.col("assay"), F.col("control")), whole)
    return n.withColumn("log_ratio", F.when(ratio > 0, F.ln(ratio)))


def principal_components(points: DataFrame, dim: int, count: int = 3, to_unit: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as rows, variances), largest first: one pass for the moments, then a dim x dim problem on the driver."""
    from cairn.functions import vectors as V

    v = V.unit(F.col("vec")) if to_unit else F.col("vec")
    schema = "place int, x double"

    def run(frames):
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()).astype(float)
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        flat = np.concatenate([[n], s, m.ravel()])
        yield pd.DataFrame({"place": np.arange(len(flat), dtype="int32"), "x": flat})

    part = points.select(v.alias("v")).mapInPandas(run, schema).groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()  # 1 + dim + dim^2 rows
    flat = np.array([r["x"] for r in part])
    n, s, m = flat[0], flat[1 : 1 + dim], flat[1 + dim :].reshape(dim, dim)
    mean = s / n
    cov = (m - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:count]
    axes = vectors[:, order].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]  # the largest part is positive
    return mean, axes, values[order]


def projected(points: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, pc1, pc2, ...): coordinates along the axes, in the JVM."""
    from cairn.functions import vectors as V

    centre = F.array(*[F.lit(float(x)) for x in mean])
    moved = points.withColumn("c", F.zip_with("vec", centre, lambda x, m: x - m))
    return moved.select("id", *[V.dot(F.col("c"), F.array(*[F.lit(float(x)) for x in axis])).alias(f"pc{k + 1}") for k, axis in enumerate(axes)])


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least total cost of rows to columns, by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        return sorted((b, a) for a, b in hungarian(cost.T))
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], column = i, 0
        least, used = np.full(m + 1, math.inf), np.zeros(m + 1, bool)
        while True:
            used[column] = True
            row = match[column]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[row - 1, free - 1] - u[row] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], column
            nxt = free[least[free].argmin()]
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            column = nxt
            if match[column] == 0:
                break
        while column:
            match[column], column = match[way[column]], way[column]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def matched_f(table: DataFrame, truth: str, found: str) -> DataFrame:
    """(truth, found, f): the one-to-one matching of greatest total F from precision_recall's table (class-level)."""
    sizes = table.agg(F.countDistinct(truth), F.countDistinct(found)).first()
    if sizes[0] * sizes[1] > 25_000_000:
        raise ValueError("too many classes to match on the driver")
    rows = table.select(truth, found, "f").collect()
    a, b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    f = np.zeros((len(a), len(b)))
    at, bt = ({x: i for i, x in enumerate(names)} for names in (a, b))
    for r in rows:
        f[at[r[0]], bt[r[1]]] = r[2]
    pairs = [(a[i], b[j], float(f[i, j])) for i, j in hungarian(-f)]
    kind = {x.name: x.dataType.simpleString() for x in table.schema}
    return table.sparkSession.createDataFrame(pairs, f"{truth} {kind[truth]}, {found} {kind[found]}, f double")


ROUND_KEYS = (1_000_003, 7_919, 104_729, 15_485_863, 1 << 20)
FEISTEL_ROUNDS = 4


def permuted(entries: DataFrame, length: int, rounds: int, seed: int = 1) -> DataFrame:
    """(round, id, pos, value): the entries (id, pos, value) of sparse vectors, each vector shuffled anew in every round.

    A round of a vector has a key, and a Feistel network under it is a permutation of a power of four; applying it again
    until the place is below `length` makes it one of all places. So each entry moves alone, zeros are never made, and a
    lost task gives the same places again. An entry at a place outside 0 to length - 1 is an error.
    """
    half = max(1, (max(2, length - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    by_round, by_id, by_step, by_seed, most = ROUND_KEYS

    def run(frames):
        for frame in frames:
            pos, vector = frame["pos"].to_numpy().astype(np.int64), frame["id"].to_numpy().astype(np.int64)
            if len(pos) and (pos.min() < 0 or pos.max() >= length):
                raise ValueError(f"an entry lies outside the {length} places of its vector")
            for r in range(rounds):
                now, open_ = pos.copy(), np.arange(len(pos))
                while len(open_):
                    left, right = now[open_] >> half, now[open_] & low
                    for step in range(FEISTEL_ROUNDS):
                        key = (r * by_round + vector[open_] % most * by_id + step * by_step + seed * by_seed) % most
                        left, right = right, left ^ ((((right * 40_503 + key) * 2_654_435_761) >> 16) & low)
                    now[open_] = (left << half) | right
                    open_ = open_[now[open_] >= length]
                yield pd.DataFrame({"round": np.int64(r), "id": vector, "pos": now, "value": frame["value"]})

    return entries.select(F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")).mapInPandas(run, "round long, id long, pos long, value double")


def permutation_null(entries: DataFrame, length: int, rounds: int, seed: int = 1) -> DataFrame:
    """(round, covered): how many of the `length` columns have a sum above 0 when each vector of (id, pos, value) is shuffled."""
    sums = permuted(entries, length, rounds, seed).groupBy("round", "pos").agg(F.sum("value").alias("total"))
    return sums.groupBy("round").agg(F.sum((F.col("total") > 0).cast("long")).alias("covered"))


def permutation_correlations(entries: DataFrame, length: int, rounds: int, seed: int = 1) -> DataFrame:
    """(round, a, b, correlation): the correlations of every two shuffled vectors, zeros included; null where a vector is constant.

    Means and deviations do not change by shuffling; products are made only where two vectors have an entry at one place.
    """
    moved = permuted(entries, length, rounds, seed)
    left, right = (moved.select("round", "pos", F.col("id").alias(side), F.col("value").alias(f"v{side}")) for side in "ab")
    products = left.join(right, ["round", "pos"]).where("a < b").groupBy("round", "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("xy"))
    stats = entries.groupBy(F.col("id").cast("long").alias("id")).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    one, other = (stats.select(F.col("id").alias(side), F.col("s").alias(f"s{side}"), F.col("q").alias(f"q{side}")) for side in "ab")
    pairs = one.join(other, F.col("a") < F.col("b"))  # vectors, not entries
    every = pairs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<bigint>"))).join(products, ["round", "a", "b"], "left")
    n = F.lit(float(length))
    spread = lambda side: F.col(f"q{side}") - F.col(f"s{side}") * F.col(f"s{side}") / n
    product = F.sqrt(spread("a") * spread("b"))
    return every.select("round", "a", "b", F.when(product > 0, (F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb") / n) / product).alias("correlation"))


def concentrations(points: DataFrame, key: str, dim: int, bins: int = 21, highest: int = 500) -> DataFrame:
    """key, n, mean_cosine, kappa, kappa_by_chi_square, chi_square, p_value: von Mises-Fisher fits of the groups of (id, vec, key).

    Directions are taken about the group's mean direction. kappa is the whole number of greatest likelihood below
    `highest`; kappa_by_chi_square that of least chi-square of the cosines in `bins` bins; chi_square and p_value test
    kappa's fit by those bins, one parameter being fitted. Only counts of bins, a row for each group, reach the last step.
    """
    from cairn.functions import special
    from cairn.functions import vectors as V

    means = points.groupBy(key).agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("mean"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("vec"), F.col("mean")) / F.sqrt(V.dot(F.col("vec"), F.col("vec")) * V.dot(F.col("mean"), F.col("mean")))))
    seen = points.join(means, key).select(key, cosine.alias("cosine")).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("cosine") + 1) * bins / 2)).cast("int"))
    groups = seen.groupBy(key).agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"), *[F.sum((F.col("bin") == i).cast("long")).alias(f"n{i}") for i in range(bins)])
    table = special.cosine_bins(dim, bins, highest)

    def run(frames):
        for frame in frames:
            seen = frame[[f"n{i}" for i in range(bins)]].to_numpy(dtype=float)
            n = frame["n"].to_numpy(dtype=float)
            kappa = np.array([special.fit_vmf_kappa(dim, c, highest) for c in frame["mean_cosine"]], dtype=np.int64)
            chi = np.stack([special.chi_square(row, table * total) for row, total in zip(seen, n, strict=True)]) if len(n) else np.zeros((0, highest))
            own = chi[np.arange(len(n)), kappa]
            out = frame[[key, "n", "mean_cosine"]].assign(kappa=kappa, kappa_by_chi_square=chi.argmin(1), chi_square=own)
            yield out.assign(p_value=[special.chi_square_tail(bins - 2, x) for x in own])

    kind = points.schema[key].dataType.simpleString()
    return groups.mapInPandas(run, f"`{key}` {kind}, n long, mean_cosine double, kappa long, kappa_by_chi_square long, chi_square double, p_value double")


def random_discriminant(groups: np.ndarray, labels: np.ndarray, spark, tries: int, restarts: int, seed: int = 1, most_cosine: float = 0.2, objective: str = "within") -> tuple[np.ndarray, np.ndarray, float]:
    """Two nearly uncorrelated axes by random search; restarts are dealt to tasks.

    The objective, to be least, is "within" (within-group over total deviation) or "distances" (minus the correlation of
    all pairwise distances before and after).

    `groups` are bounded data (rows by dimensions) that go to every task.
    """
    if groups.size > 5_000_000:
        raise ValueError("the data of a random search go to every task; sample them first")
    dim = groups.shape[1]

    if objective not in ("within", "distances"):
        raise ValueError(f"unknown objective: {objective}")
    upper = np.triu_indices(len(groups), 1)

    def gaps(x):
        return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))[upper]

    full = gaps(groups) if objective == "distances" else None

    def score(axes):
        p = groups @ axes.T
        if full is not None:
            return -float(np.corrcoef(full, gaps(p))[0, 1])
        within = sum(((p[labels == g] - p[labels == g].mean(0)) ** 2).sum() for g in np.unique(labels))
        return within / max(1e-12, ((p - p.mean(0)) ** 2).sum())

    def run(frames):
        for frame in frames:
            for r in frame["id"]:
                rng = np.random.default_rng([seed, int(r)])
                best, axes = math.inf, None
                for _ in range(tries):
                    a = rng.normal(size=(2, dim)) if axes is None or rng.random() < 0.5 else axes + rng.normal(size=(2, dim)) * 0.2
                    a /= np.linalg.norm(a, axis=1, keepdims=True)
                    if abs(a[0] @ a[1]) <= most_cosine and (s := score(a)) < best:
                        best, axes = s, a
                yield pd.DataFrame({"score": [best], "axes": [axes.ravel() if axes is not None else []]})

    row = spark.range(restarts).mapInPandas(run, "score double, axes array<double>").orderBy("score").first()
    axes = np.array(row["axes"]).reshape(2, dim)
    return axes[0], axes[1], row["score"]
