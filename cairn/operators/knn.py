"""Exact nearest neighbours of any distance by blocks.

Points (id, vec) are packed into blocks, one row each. Every query block meets every base block, partition by partition and
without a shuffle of vectors; a task keeps k candidates for each query over all blocks of its base partition, and a second
step keeps the k best of them. So nothing is broadcast or collected, and a task holds one base partition at a time.

`metric.py` gives the same result with fewer meetings where a distance keeps the triangle inequality.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut_lineage

BLOCK_ROWS = 4096
#: Blocks of the base that a task of `nearest` holds.
BASE_BLOCKS = 128
#: Distances that keep the triangle inequality.
TRIANGLE = {"angular", "euclidean", "manhattan"}
NEIGHBOUR = "i long, j long, dist double"


def distances(a: np.ndarray, b: np.ndarray, metric) -> np.ndarray:
    """Pairwise distances of the rows of two matrices by a distance's name or function; NaN counts as 0."""
    if callable(metric):
        return np.asarray(metric(a, b), dtype=float)
    if metric == "angular":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        cos = (a @ b.T) / np.where(na > 0, na, 1)[:, None] / np.where(nb > 0, nb, 1)[None, :]
        return np.arccos(np.clip(cos, -1, 1))
    if metric == "euclidean":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))
    raise ValueError(f"no matrix form of distance {metric}; known: angular, euclidean, {', '.join(sorted(MATRIX_METRICS))}")


def resolved(metric: str):
    """The function of a registered distance, which goes to the tasks with their code; or the name of a built-in one."""
    return MATRIX_METRICS.get(metric, metric)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(a - row).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


#: Further distances as functions of two matrices that give all distances of their rows; more can be registered.
MATRIX_METRICS = {"manhattan": manhattan}


def register_metric(name: str, between, triangle: bool = False) -> None:
    """Makes `between(a, b)` a distance of knn, nearest and nearest_centre; `triangle` says that it keeps the triangle inequality."""
    MATRIX_METRICS[name] = between
    (TRIANGLE.add if triangle else TRIANGLE.discard)(name)


def crossed(left: DataFrame, right: DataFrame, where) -> DataFrame:
    """Rows of both sides for which `where` holds, each partition with each: nothing is shuffled, and a task holds one of `right`."""
    return left.join(right.hint("shuffle_replicate_nl"), where)


def _blocks(points: DataFrame, label: str, rows: int) -> DataFrame:
    """One row for each block: its number, ids, and the vectors one after another."""
    n = points.count()
    count = max(1, -(-n // rows))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    grouped = dealt.groupBy("block").agg(F.collect_list(F.struct("id", "vec")).alias(label))
    return grouped.select(F.col("block").alias(f"{label}_block"), label), count


def _packed(blocks: DataFrame, count: int, label: str) -> tuple[DataFrame, int]:
    """Blocks as (block, ids, vecs) in bytes, and their number."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                rows = batch.column(1)[n].values
                vecs = rows.field("vec")
                flat = np.nan_to_num(vecs.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([rows.field("id").to_numpy().astype("<i8").tobytes()]), pa.array([flat.tobytes()])], names=[f"{label}_block", f"{label}_ids", f"{label}_vecs"])

    return blocks.mapInArrow(run, f"{label}_block int, {label}_ids binary, {label}_vecs binary"), count


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], dtype=np.int64), np.nan_to_num(np.array([r["vec"] for r in rows], dtype=np.float64), nan=0.0)


class Nearest:
    """The k nearest to each of some queries (ids i, rows a) of all base rows added so far; ties by j, a point itself first."""

    def __init__(self, i: np.ndarray, a: np.ndarray, k: int, metric, reach: np.ndarray | None = None):
        self.i, self.a, self.k, self.metric = i, a, k, metric
        self.reach = np.full(len(i), np.inf) if reach is None else reach.copy()
        self.norm = np.where((n := np.linalg.norm(a, axis=1)) > 0, n, 1)
        self.kept, self.waiting, self.count = [], [], 0

    def add(self, j: np.ndarray, m: np.ndarray, rows: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        """Base rows m with ids j; of the queries only those at `rows`, and with each only what is `allowed`."""
        rows = np.arange(len(self.i)) if rows is None else rows
        if not len(rows) or not len(j):
            return
        a, i, reach = self.a[rows], self.i[rows], self.reach[rows]
        if self.metric == "angular" and not np.isin(i, j).any():  # angles only of what may count
            dot, norm = a @ m.T, np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)
            share = dot / norm[None, :]
            least = np.cos(np.minimum(reach, np.pi)) * self.norm[rows]
            if allowed is None and len(j) > 4 * self.k and np.isinf(reach).any():
                least = np.maximum(least, np.partition(share, len(j) - self.k, axis=1)[:, len(j) - self.k])
            ok = share >= (least - 1e-9 * self.norm[rows])[:, None]
            at, column = np.nonzero(ok if allowed is None else ok & allowed)
            value = np.round(np.arccos(np.clip(dot[at, column] / self.norm[rows][at] / norm[column], -1, 1)), 12)
            close = value <= reach[at]
            at, column, value = at[close], column[close], value[close]
        else:
            d = np.round(distances(a, m, self.metric), 12)
            d[i[:, None] == j[None, :]] = -1.0  # first, also among equal points
            ok = d <= reach[:, None]
            if allowed is not None:
                ok &= allowed
            if d.shape[1] > 4 * self.k:
                kth = np.partition(np.where(ok, d, np.inf), self.k - 1, axis=1)[:, self.k - 1]
                ok &= d <= kth[:, None]
            at, column = np.nonzero(ok)
            value = d[at, column]
        self.waiting.append((rows[at], j[column], value))
        self.count += len(at)
        if self.count > len(self.i) * self.k:
            self._settle()

    def _settle(self) -> None:
        row, j, value = (np.concatenate(x) for x in zip(*self.kept, *self.waiting, strict=True))
        order = np.lexsort((j, value, row))
        row, j, value = row[order], j[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.reach[row[last]] = np.minimum(self.reach[row[last]], value[last])
        keep = place < self.k
        self.kept, self.waiting, self.count = [(row[keep], j[keep], value[keep])], [], 0

    def batch(self):
        """(i, j, dist) as an Arrow batch, or nothing."""
        import pyarrow as pa

        if self.waiting:
            self._settle()
        for row, j, value in self.kept:
            yield pa.RecordBatch.from_arrays([pa.array(self.i[row]), pa.array(j), pa.array(np.maximum(value, 0.0))], names=["i", "j", "dist"])


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "angular", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, rank, dist): the k nearest of `base` to each of `queries`, both (id, vec); rank from 1, ties by j, a point itself first.

    A point of both sides with one id is its own neighbour at distance 0. With fewer than k base points all are given.
    """
    metric, cores = resolved(metric), queries.sparkSession.sparkContext.defaultParallelism
    (q, asking), (b, count) = (_packed(*_blocks(df, label, min(block_rows, 1024)), label) for df, label in ((queries, "q"), (base, "b")))
    if asking * count > 1:
        q, b = cut_lineage(q.repartition(min(asking, 2 * cores), "q_block")), cut_lineage(b.coalesce(max(-(-count // BASE_BLOCKS), 1 if asking >= 2 * cores else 4)))

    def run(batches):
        now, held = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                block, q_ids, q_vecs, b_ids, b_vecs = (x[0].as_py() for x in batch.slice(n, 1).columns)
                if block != now:
                    if held is not None:
                        yield from held.batch()
                    now, i = block, np.frombuffer(q_ids, dtype="<i8")
                    held = Nearest(i, np.frombuffer(q_vecs, dtype=float).reshape(len(i), -1), k, metric)
                j = np.frombuffer(b_ids, dtype="<i8")
                held.add(j, np.frombuffer(b_vecs, dtype=float).reshape(len(j), -1))
        if held is not None:
            yield from held.batch()

    return k_best(crossed(q, b, F.lit(True)).select("q_block", "q_ids", "q_vecs", "b_ids", "b_vecs").mapInArrow(run, NEIGHBOUR), k)


def knn(points: DataFrame, k: int, metric: str = "angular", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """nearest() of a set to itself; every point is its own first neighbour.

    More points than one block holds are searched in blocks of a metric space, if the distance is known to keep the
    triangle inequality; the result is the same.
    """
    if metric in TRIANGLE and points.limit(block_rows + 1).count() > block_rows:
        from cairn.operators.metric import nearest_in_metric

        return nearest_in_metric(points, k, metric, block_rows=min(block_rows, 1024))
    return nearest(points, points, k, metric, block_rows)


def k_best(found: DataFrame, k: int) -> DataFrame:
    """(i, j, rank, dist): the k first candidates of each query."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.col("i") != F.col("j"), "dist", "j")))
    return ranked.where(F.col("rank") <= k).select("i", "j", "rank", "dist")


def vmf_densities(points: DataFrame, dim: int, kappa: float) -> DataFrame:
    """(id, density): over all points the sum of von Mises-Fisher densities of concentration `kappa`, with their constant."""
    from cairn.functions.special import log_vmf_constant

    constant = float(np.exp(log_vmf_constant(dim, kappa)))
    return kernel_sums(points, "vmf", kappa).select("id", (F.col("density") * constant).alias("density"))


def diagonal_gaussian_densities(points: DataFrame, spread: list[float]) -> DataFrame:
    """(id, density): over all points the sum of Gaussian densities with a diagonal covariance (`spread`: standard deviations)."""
    by = F.array(*[F.lit(float(s)) for s in spread])
    constant = float(np.exp(-0.5 * len(spread) * np.log(2 * np.pi) - np.log(spread).sum()))
    scaled = points.select("id", F.zip_with("vec", by, lambda x, s: x / s).alias("vec"))
    return kernel_sums(scaled, "gaussian", 1.0).select("id", (F.col("density") * constant).alias("density"))


def kernel_sums(points: DataFrame, kernel, param: float, block_rows: int = BLOCK_ROWS, tolerance: float = 1e-12) -> DataFrame:
    """(id, density): over all points the sum of a kernel's values, by blocks; a Kernel, or the name of one.

    "gaussian" is exp(-d^2 / (2 param^2)) and "vmf" exp(param * cosine). More points than one block holds are summed in
    blocks of a metric space; for n points such a sum is n * tolerance off at most.
    """
    from cairn.operators import plugins

    own = plugins.kernel(kernel) if isinstance(kernel, str) else kernel
    if points.limit(block_rows + 1).count() > block_rows:
        from cairn.operators.metric import kernel_sums_in_metric

        return kernel_sums_in_metric(points, own, param, tolerance, min(block_rows, 1024))
    q, _ = _blocks(points, "q", block_rows)
    b, count = _blocks(points, "b", block_rows)
    pairs = q.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(b, "b_block").select("q", "b")
    metric, value = resolved(own.metric), own.value

    def run(frames):
        for frame in frames:
            for left, right in zip(frame["q"], frame["b"], strict=True):
                i, a = _matrix(left)
                _, m = _matrix(right)
                yield pd.DataFrame({"id": i, "part": np.minimum(value(distances(a, m, metric), param).sum(1), np.finfo(float).max)})

    return pairs.mapInPandas(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("density"))
