"""Exact neighbours and kernel sums over blocks of a metric space, alone or inside a window of further parameters.

Points (id, vec) lie in blocks of like place: first by the window of a parameter, if there is a limit on one, then by the
nearest of a few pivots and the distance to it. A block keeps the least and greatest distance to every pivot, and of
every parameter. By the triangle inequality these bound all distances from a query to the block's points, so a query
sees its own block first, which gives a distance that its k-th neighbour does not exceed, and after that only blocks
whose bounds can undercut it and whose parameters come near enough. Limits are tested before the k best are taken.

Blocks meet partition by partition where they are stored, so no vector is shuffled; bounds drop pairs of blocks before their
vectors reach Python, so no block meets every block unless the data are so spread that bounds say nothing. A task keeps the
best of each query over all blocks of its partition, and only those are shuffled. Pivots come from a bounded sample and change speed
only. Any distance that satisfies the triangle inequality will do. NaN components count as 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import plugins
from cairn.operators.knn import NEIGHBOUR, Nearest, crossed, distances, k_best, resolved
from cairn.session import cut_lineage

BLOCK_ROWS, SUPER_ROWS = 1024, 1024
PIVOTS, SAMPLE = 16, 256
BLOCK = "block long, ids binary, vecs binary, params binary, far binary, low array<double>, high array<double>, least array<double>, most array<double>, norm double"
HOME = BLOCK + ", reach binary, widest double"
#: Bytes of blocks that a task holds while others meet them.
PART_BYTES = 1 << 27


def _pivots(points: DataFrame, metric, count: int) -> np.ndarray:
    """Up to `count` points of a bounded sample, each the farthest from those before."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()  # SAMPLE rows
    sample = np.nan_to_num(np.array([r["vec"] for r in rows], dtype=float), nan=0.0)
    if not len(sample):
        return sample
    chosen = [int(distances(sample[:1], sample, metric).argmax())]
    near = distances(sample, sample[chosen], metric).ravel()
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]], metric).ravel())
    return sample[chosen]


def _vectors(column) -> np.ndarray:
    return np.nan_to_num(np.array(column.to_pylist(), dtype=float), nan=0.0)


def blocks(points: DataFrame, metric, params: list[str] = (), limits: list[float] = (), rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """BLOCK, checkpointed: the points (id, vec, params...) in blocks of at most `rows`."""
    import pyarrow as pa

    named = points.select("id", "vec", F.array(*[F.col(c).cast("double") for c in params]).cast("array<double>").alias("params"))
    seeds, names = _pivots(named, metric, pivots), [c.split()[0] for c in BLOCK.split(", ")]

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                far = distances(_vectors(batch.column("vec")), seeds, metric)
                cell = far.argmin(1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("near", pa.array(far[np.arange(len(far)), cell]))

    def pack(batches):
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 32, None
        for batch in (*batches, None):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            while rest is not None and rest.num_rows and (rest.num_rows >= rows or batch is None):
                cells = rest["cell"].slice(0, rows).to_numpy()
                turns = np.flatnonzero(cells[1:] != cells[:-1]) + 1
                size = int(turns[-1]) if len(turns) and turns[-1] * 2 >= rows else rows  # rather not a block of two cells
                part, rest = rest.slice(0, size), rest.slice(size).combine_chunks()
                m, p = _vectors(part["vec"]), np.array(part["params"].to_pylist(), dtype=float).reshape(part.num_rows, -1)
                far = distances(m, seeds, metric)
                spans = {"low": far.min(0), "high": far.max(0), "least": p.min(0), "most": p.max(0)}
                row = {"block": [number], "ids": [part["id"].to_numpy().astype("<i8").tobytes()], "vecs": [m.tobytes()], "params": [p.tobytes()], "far": [far.tobytes()]}
                row["norm"] = [float(np.linalg.norm(m, axis=1).max())]
                made = row | {c: pa.array([x.tolist()], pa.list_(pa.float64())) for c, x in spans.items()}
                yield pa.RecordBatch.from_pydict({c: made[c] for c in names})
                number += 1

    dealt = named.mapInArrow(deal, "id long, vec array<double>, params array<double>, cell int, near double")
    order = ["cell", "near", "id"]
    if params:
        window = F.when(F.lit(limits[0]) > 0, F.floor(F.col("params")[0] / F.lit(limits[0] or 1))).otherwise(F.col("params")[0])
        dealt, order = dealt.withColumn("window", window.cast("double")), ["window", *order]
    return cut_lineage(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("window").mapInArrow(pack, BLOCK))


def _array(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=float).reshape(rows, -1)


def _allowed(a: np.ndarray, b: np.ndarray, limits) -> np.ndarray:
    """Which pairs of rows of two parameter matrices differ by at most the limits."""
    ok = np.ones((len(a), len(b)), dtype=bool)
    for c, limit in enumerate(limits):
        ok &= np.abs(a[:, c, None] - b[None, :, c]) <= limit
    return ok


def _lower(far: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances from queries to blocks."""
    out = np.zeros((len(far), len(low)))
    for p in range(far.shape[1]):
        own = far[:, p, None]
        np.maximum(out, np.maximum(low[None, :, p] - own, own - high[None, :, p]), out=out)
    return out


def _measured(a: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, metric) -> np.ndarray:
    d = np.round(distances(a, m, metric), 12)
    d[i[:, None] == j[None, :]] = -1.0  # a point itself is first, also among equal points
    return d


def _at_home(held: DataFrame, k: int, metric, limits) -> DataFrame:
    """HOME, checkpointed: what the distance of each point's k-th neighbour can't exceed, which its own block tells."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                row = {c: one.column(c)[0].as_py() for c in ("ids", "vecs", "params")}
                ids = np.frombuffer(row["ids"], dtype="<i8")
                m, p = _array(row["vecs"], len(ids)), _array(row["params"], len(ids))
                d = _measured(m, m, ids, ids, metric)
                d[~_allowed(p, p, limits)] = np.inf
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= len(ids) else np.full(len(ids), np.inf)
                one = one.append_column("reach", pa.array([np.ascontiguousarray(reach).tobytes()], pa.binary()))
                yield one.append_column("widest", pa.array([float(reach.max())]))

    return cut_lineage(held.mapInArrow(run, HOME))


def _supers(held: DataFrame) -> tuple[DataFrame, int]:
    """Summaries of blocks, SUPER_ROWS or so in a row."""
    count = max(1, -(-held.count() // SUPER_ROWS))
    number = F.pmod(F.xxhash64("block"), F.lit(count)).cast("int").alias("number")
    return held.groupBy(number).agg(F.collect_list(F.struct("block", "low", "high", "least", "most", "norm", (F.length("ids") / 8).cast("long").alias("n"))).alias("supers")), count


def _meetings(queries: DataFrame, supers: DataFrame, count: int) -> DataFrame:
    """Each query block with each row of summaries."""
    return queries.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(supers, "number").drop("number")


def _summary(rows) -> tuple[np.ndarray, ...]:
    columns = [np.array([r[c] for r in rows], dtype=float).reshape(len(rows), -1) for c in ("low", "high", "least", "most")]
    return np.array([r["block"] for r in rows], dtype=np.int64), *columns, np.array([r["norm"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.int64)


def _error(norm: float, norms: np.ndarray) -> np.ndarray:
    """More than rounding can add to a difference of distances between vectors of such lengths."""
    return 1e-7 + 2e-7 * (norm + norms)[None, :]


def _meet(left: DataFrame, right: DataFrame, where) -> DataFrame:
    """(a_..., b_...): blocks of `left` with those of `right`. Vectors are read again from where they are and never shuffled; blocks of the right side come one after another for each of the left."""
    size = right.agg(F.sum(F.length("ids") + F.length("vecs") + F.length("params"))).first()[0] or 0
    parts = right.coalesce(max(1, -(-size // PART_BYTES)))
    sides = [df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for s, df in (("a", left), ("b", parts))]
    return crossed(*sides, where)


def nearest_in_metric(points: DataFrame, k: int, metric: str = "angular", limits: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(i, j, rank, dist): the k nearest points to each point (id, vec, and the columns of `limits`), itself first, ties by j.

    With `limits` only points whose parameters differ from the query's by at most that much count, and the k nearest of
    those are given, all of them if fewer. Points with a null or NaN parameter have no neighbours and are none.
    """
    import pyarrow as pa

    metric, limits = resolved(metric), limits or {}
    for c in limits:
        points = points.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    spans = [float(x) for x in limits.values()]
    homes = _at_home(blocks(points, metric, list(limits), spans, block_rows, pivots), k, metric, spans)

    def meet(batches):
        now, held, far, params, norm = None, None, None, None, 0.0
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: x[0] for c, x in zip(batch.schema.names, batch.slice(n, 1).columns, strict=True)}
                if row["a_block"].as_py() != now:
                    if held is not None:
                        yield from held.batch()
                    now, norm = row["a_block"].as_py(), row["a_norm"].as_py()
                    i = np.frombuffer(row["a_ids"].as_py(), dtype="<i8")
                    far, params = _array(row["a_far"].as_py(), len(i)), _array(row["a_params"].as_py(), len(i))
                    held = Nearest(i, _array(row["a_vecs"].as_py(), len(i)), k, metric, np.frombuffer(row["a_reach"].as_py(), dtype=float))
                j = np.frombuffer(row["b_ids"].as_py(), dtype="<i8")
                low, high = (np.array(row[c].as_py(), dtype=float)[None, :] for c in ("b_low", "b_high"))
                own = _array(row["b_params"].as_py(), len(j))
                see = _lower(far, low, high)[:, 0] <= held.reach + _error(norm, np.array([row["b_norm"].as_py()]))[0, 0]
                see |= row["b_block"].as_py() == now
                for c, limit in enumerate(spans):
                    see &= (own[:, c].min() - limit <= params[:, c]) & (params[:, c] <= own[:, c].max() + limit)
                rows = np.flatnonzero(see)
                held.add(j, _array(row["b_vecs"].as_py(), len(j)), rows, _allowed(params[rows], own, spans) if spans else None)
        if held is not None:
            yield from held.batch()

    bound = F.col("a_widest") + 1e-7 + 2e-7 * (F.col("a_norm") + F.col("b_norm"))
    above, below = (F.array_max(F.zip_with(x, y, lambda a, b: a - b)) for x, y in (("b_low", "a_high"), ("a_low", "b_high")))
    where = (F.col("a_block") == F.col("b_block")) | ((above <= bound) & (below <= bound))
    for c, limit in enumerate(spans):
        where &= (F.col("a_least")[c] - limit <= F.col("b_most")[c]) & (F.col("b_least")[c] <= F.col("a_most")[c] + limit)
    both = _meet(homes, homes.drop("far", "reach", "widest"), where)
    both = both.select("a_block", "a_ids", "a_vecs", "a_params", "a_far", "a_reach", "a_norm", "b_block", "b_ids", "b_vecs", "b_params", "b_low", "b_high", "b_norm")
    return k_best(both.mapInArrow(meet, NEIGHBOUR), k)


def kernel_sums_in_metric(points: DataFrame, kernel, param: float, tolerance: float = 0.0, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(id, density) as kernel_sums gives it, each within `tolerance` of a kernel value for every point.

    Where the bounds of a query's distances to a block let the kernel vary by no more than twice the tolerance, the
    block counts with the middle value and is not read. So the error of a sum over n points is at most n * tolerance,
    and with tolerance 0 blocks whose kernel is beyond the range of numbers are left out at most.
    """
    import pyarrow as pa

    own = plugins.kernel(kernel) if isinstance(kernel, str) else kernel
    metric, value = resolved(own.metric), lambda d, f=own.value: f(d, param)
    held = blocks(points, metric, rows=block_rows, pivots=pivots)
    supers, count = _supers(held)

    def see(far, row):
        number, low, high, _, _, norms, n = _summary(row["supers"])
        error = _error(row["norm"], norms)
        nearest, farthest = _lower(far, low, high), np.full((len(far), len(number)), np.inf)
        for p in range(far.shape[1]):
            np.minimum(farthest, far[:, p, None] + high[None, :, p], out=farthest)
        most, least = value(np.maximum(nearest - error, 0)), value(farthest + error)
        return number, most - least > 2 * tolerance, (most + least) / 2 * n[None, :]

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, open_, _ = see(_array(row["far"], len(row["ids"]) // 8), row)
                wanted = number[open_.any(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), row["block"], dtype=np.int64)), pa.array(wanted)], names=["block", "other"])

    def beyond(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype="<i8")
                _, open_, middle = see(_array(row["far"], len(ids)), row)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(open_, 0.0, middle).sum(1))], names=["id", "part"])

    def meet(batches):
        now, ids, total, m, far = None, None, None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: x[0].as_py() for c, x in zip(batch.schema.names, batch.slice(n, 1).columns, strict=True)}
                if row["a_block"] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "part"])
                    now, ids = row["a_block"], np.frombuffer(row["a_ids"], dtype="<i8")
                    m, far, total = _array(row["a_vecs"], len(ids)), _array(row["a_far"], len(ids)), np.zeros(len(ids))
                b_rows = len(row["b_ids"]) // 8
                one = {"block": row["b_block"], "low": row["b_low"], "high": row["b_high"], "least": [], "most": [], "norm": row["b_norm"], "n": b_rows}
                who = np.flatnonzero(see(far, {"supers": [one], "norm": row["a_norm"]})[1][:, 0])
                part = value(distances(m[who], _array(row["b_vecs"], b_rows), metric)).sum(1)
                total[who] = np.minimum(total[who] + np.minimum(part, np.finfo(float).max), np.finfo(float).max)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "part"])

    meetings = _meetings(held.select("block", "ids", "far", "norm"), supers, count)
    asked = meetings.mapInArrow(ask, "block long, other long").groupBy("block").agg(F.collect_list("other").alias("others"))
    left = held.select("block", "ids", "vecs", "far", "norm").join(asked, "block")
    both = _meet(left, held.select("block", "ids", "vecs", "params", "low", "high", "norm"), F.array_contains("a_others", F.col("b_block")))
    near = both.drop("a_others", "b_params").mapInArrow(meet, "id long, part double")
    return near.unionByName(meetings.mapInArrow(beyond, "id long, part double")).groupBy("id").agg(F.sum("part").alias("density"))
