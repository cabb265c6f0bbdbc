"""Exact top-k search by inner product with a pivot table.

Equal vectors are one vector with their least k + 1 ids, so copies are searched once. A few pivots are picked far apart
from a bounded sample; every vector gets its distances to all of them. Vectors lie in blocks of like pivot and distance,
and a block keeps the least and greatest distance to each pivot. By the triangle inequality |d(q, p) - d(c, p)| bounds
d(q, c) from below, the greatest over the pivots bounds it best, and (|q|^2 + |c|^2 - d^2) / 2 is the inner product.

A query is first searched in its own block, which gives a score that its k-th result reaches; then blocks that can't
reach it by their bounds are left out, and in each block that is left candidates are evaluated in the order of their
bounds until none can reach the k-th score so far. Queries meet blocks' summaries first, a thousand in a row, and
vectors travel only to blocks they ask for. The pivots, picked from at most SAMPLE vectors, change speed, never results.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without vec_id;
rows equal in both count once; a row of the same vec_id with another vector is a row of its own; a shorter vector counts
as padded with zeros; ties go to the smaller vec_id; fewer than k candidates give all. Scores must fit 64 bits. Memory
of a task: a block and a pack of queries, of at most CELLS components each (or a single longer vector).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import narrow, read_table, stored

K, EVERY, SCALE = 20, 20, 64
PIVOTS, SAMPLE = 16, 256
BLOCK_ROWS, PACK_ROWS, SUPER_ROWS, CELLS = 2048, 1024, 1024, 1 << 19
PAIRS = 1 << 21
BLOCK = "block long, dim int, kind string, vecs binary, ids binary, sizes binary, far binary, asks binary, lengths binary, low array<float>, high array<float>, norm double"
HOME = "key long, vec array<long>, far binary, score long, id long, top array<struct<score: long, id: long, own: boolean>>"
PACK = "pack long, dim int, kind string, vecs binary, keys binary, far binary, reach binary"


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, vec): floor(scale * x) of every component of every vector that takes part; rows equal in both once."""
    rows = narrow(embeddings, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = rows.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))))
    return finite.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec")).distinct()


def different(rows: DataFrame, k: int, every: int) -> DataFrame:
    """(vec, ids, asks), stored: each different vector, its k + 1 least ids, and whether one of its ids is a query."""
    dealt = rows.withColumn("asks", F.pmod("id", F.lit(every)) == 0)
    least = dealt.withColumn("place", F.row_number().over(Window.partitionBy("vec", "asks").orderBy("id"))).where(F.col("place") <= k + 1)
    return stored(least.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks")), "vectors")


def matrix(lists, dim: int | None = None) -> np.ndarray:
    """Lists of whole numbers as the rows of one matrix, padded with zeros."""
    dim = max([dim or 0, *map(len, lists)])
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def packed(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the least width that holds it."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, m.astype(kind).tobytes()


def unpacked(kind: str, vecs: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(vecs, dtype=kind).reshape(rows, dim).astype(np.int64)


def squares(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return np.einsum("ij,ij->i", m, m)


def to_pivots(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    dim = max(m.shape[1], pivots.shape[1])
    m, p = widened(m, dim).astype(np.float64), widened(pivots, dim).astype(np.float64)
    return np.sqrt(np.maximum(squares(m)[:, None] + squares(p)[None, :] - 2 * (m @ p.T), 0))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of `sample` far apart: the one farthest from the mean, then each the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    nearest = to_pivots(sample, sample[chosen]).ravel()
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, to_pivots(sample, sample[chosen[-1:]]).ravel())
    return sample[chosen]


def error_of(far_q, far_c, square_q, square_c) -> float:
    """More than rounding can add to a difference of two distances."""
    return 3e-7 * (float(far_q.max(initial=0)) + float(far_c.max(initial=0))) + 1e-7 * (float(square_q.max(initial=0)) ** 0.5 + float(square_c.max(initial=0)) ** 0.5)


def upper(lower: np.ndarray, square_q: np.ndarray, square_c: np.ndarray, error: float) -> np.ndarray:
    """Greatest inner products that lower bounds of distances allow."""
    total = square_q[:, None] + square_c[None, :]
    return (total * (1 + 1e-9) - np.maximum(lower - error, 0) ** 2) / 2 + 1e-6


def best_in_bound_order(q: np.ndarray, far_q: np.ndarray, reach: np.ndarray, c: np.ndarray, far_c: np.ndarray, first: np.ndarray, k: int):
    """For each query the places and scores of its k best of the rows `c` among those that can reach `reach`; ties by `first`.

    Candidates are evaluated in the order of their bounds, so the search ends at the first that can't reach the k-th.
    """
    dim = max(q.shape[1], c.shape[1])
    q, c = widened(q, dim), widened(c, dim)
    square_q, square_c = squares(q), squares(c)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim < 2**52:
        q, c = q.astype(np.float64), c.astype(np.float64)  # sums stay exact
    error, step = error_of(far_q, far_c, square_q, square_c), max(1, PAIRS // max(1, len(c)))
    for at in range(0, len(q), step):
        own = slice(at, at + step)
        lower = np.zeros((len(q[own]), len(c)), dtype=np.float32)
        for p in range(far_q.shape[1]):
            np.maximum(lower, np.abs(far_q[own, p, None] - far_c[None, :, p]), out=lower)
        bounds = upper(lower, square_q[own], square_c, error)
        for i, (bound, needed) in enumerate(zip(bounds, reach[own], strict=True), start=at):
            places = np.flatnonzero(bound >= needed)
            places = places[np.argsort(-bound[places], kind="stable")]
            bound = bound[places]
            scores, done, take = np.empty(0, dtype=q.dtype), 0, 4 * k
            while done < len(places) and bound[done] >= needed:
                scores = np.concatenate([scores, c[places[done : done + take]] @ q[i]])
                done += take
                take *= 2
                if len(scores) >= k:
                    needed = max(needed, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
            places = places[: len(scores)]
            if len(scores) > k:
                kept = np.flatnonzero(scores >= needed)
                places, scores = places[kept], scores[kept]
            order = np.lexsort((first[places], -scores))[:k]
            yield i, places[order], scores[order].astype(np.int64)


def _cut(rows: int, dims, most: int):
    """Spans of consecutive vectors: at most `most` of them, and CELLS components once padded."""
    begin, widest = 0, 0
    for i in range(rows):
        dim = max(widest, int(dims[i]), 1)
        if i > begin and (i - begin >= most or (i - begin + 1) * dim > CELLS):
            yield begin, i
            begin, dim = i, max(int(dims[i]), 1)
        widest = dim
    if rows > begin:
        yield begin, rows


def _gathered(batches, dims_of, most: int):
    """Tables of consecutive rows of Arrow batches, cut as _cut says; what a batch leaves over goes with the next."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        spans = list(_cut(rest.num_rows, dims_of(rest), most))
        for begin, end in spans[:-1]:
            yield rest.slice(begin, end - begin)
        rest = rest.slice(spans[-1][0]).combine_chunks() if spans else rest
    if rest is not None and rest.num_rows:
        yield rest


def _sizes(column: str):
    import pyarrow.compute as pc

    return lambda rows: pc.list_value_length(rows[column]).to_numpy()


def _entries(places, scores, ids, bounds, k: int, own: int = -1):
    """The first k + 1 (score, id, own) of the ids that vectors at `places` stand for."""
    found = [(-int(s), int(i), p == own) for p, s in zip(places.tolist(), scores.tolist(), strict=True) for i in ids[bounds[p] : bounds[p + 1]]]
    return [(-s, i, o) for s, i, o in sorted(found)[: k + 1]]


class Block:
    """A row of BLOCK as arrays."""

    def __init__(self, dim, kind, vecs, ids, sizes, far):
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype="<i4"))])
        self.ids = np.frombuffer(ids, dtype="<i8")
        rows = len(self.bounds) - 1
        self.vecs, self.far, self.first = unpacked(kind, vecs, dim, rows), np.frombuffer(far, dtype="<f4").reshape(rows, -1), self.ids[self.bounds[:-1]]


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`rows` with the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            for begin, end in _cut(batch.num_rows, _sizes("vec")(batch), BLOCK_ROWS):
                part = batch.slice(begin, end - begin)
                far = to_pivots(matrix(part.column("vec").to_pylist()), pivots)
                cell = far.argmin(1)
                yield part.append_column("cell", _array(cell.astype(np.int32))).append_column("near", _array(far[np.arange(len(far)), cell]))

    return rows.mapInArrow(run, "vec array<long>, ids array<long>, asks boolean, cell int, near double")


def _array(values):
    import pyarrow as pa

    return pa.array(values)


def blocks(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """BLOCK, stored: the vectors by nearest pivot and the distance to it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in _gathered(batches, _sizes("vec"), BLOCK_ROWS):
            m, ids = matrix(part["vec"].to_pylist()), part["ids"].to_pylist()
            far, (kind, vecs) = to_pivots(m, pivots).astype("<f4"), packed(m)
            flat = np.array([i for own in ids for i in own], dtype="<i8").tobytes()
            sizes, asks = np.array([len(own) for own in ids], dtype="<i4").tobytes(), np.array(part["asks"].to_pylist(), dtype=np.uint8).tobytes()
            row = {"block": [number], "dim": pa.array([m.shape[1]], pa.int32()), "kind": [kind], "vecs": [vecs], "ids": [flat], "sizes": [sizes], "far": [far.tobytes()], "asks": [asks], "lengths": [np.array(_sizes("vec")(part), dtype="<i4").tobytes()]}
            yield pa.RecordBatch.from_pydict(row | {"low": pa.array([far.min(0)], pa.list_(pa.float32())), "high": pa.array([far.max(0)], pa.list_(pa.float32())), "norm": [float(squares(m).max())]})
            number += 1

    ordered = _dealt(rows, pivots).repartitionByRange("cell", "near").sortWithinPartitions("cell", "near")
    return stored(ordered.mapInArrow(run, BLOCK), "blocks")


def at_home(held: DataFrame, k: int) -> DataFrame:
    """HOME, stored: each query's best in its own block; score and id are of the last of its k + 1, null if there are fewer."""
    schema = _schema(HOME)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                b, who = Block(*(row[c] for c in ("dim", "kind", "vecs", "ids", "sizes", "far"))), np.flatnonzero(np.frombuffer(row["asks"], dtype=np.uint8))
                lengths = np.frombuffer(row["lengths"], dtype="<i4")
                out = {c: [] for c in ("key", "vec", "far", "score", "id", "top")}
                for i, places, scores in best_in_bound_order(b.vecs[who], b.far[who], np.full(len(who), -np.inf), b.vecs, b.far, b.first, k + 1):
                    top = _entries(places, scores, b.ids, b.bounds, k, who[i])
                    last = top[k] if len(top) > k else (None, None)
                    for c, v in zip(out, ((row["block"] << 12) + int(who[i]), b.vecs[who[i], : lengths[who[i]]], b.far[who[i]].tobytes(), last[0], last[1], [dict(zip(("score", "id", "own"), e, strict=True)) for e in top]), strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return stored(held.mapInArrow(run, HOME), "homes")


def _schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def packs(homes: DataFrame) -> DataFrame:
    """PACK, stored: queries together in rows; `reach` is the score that a result must have at least."""
    schema = _schema(PACK)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in _gathered(batches, _sizes("vec"), PACK_ROWS):
            m = matrix(part["vec"].to_pylist())
            kind, vecs = packed(m)
            reach = np.array([-np.inf if s is None else s for s in part["score"].to_pylist()], dtype="<f8")
            row = {"pack": [number], "dim": [m.shape[1]], "kind": [kind], "vecs": [vecs], "keys": [part["key"].to_numpy().astype("<i8").tobytes()], "far": [b"".join(part["far"].to_pylist())], "reach": [reach.tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)
            number += 1

    return stored(homes.select("key", "vec", "far", "score").mapInArrow(run, PACK), "packs")


def asked(held: DataFrame, queries: DataFrame) -> DataFrame:
    """(pack, block, who): which queries of a pack have to see a block other than their own."""
    count = max(1, -(-held.count() // SUPER_ROWS))
    number = F.pmod(F.xxhash64("block"), F.lit(count)).cast("int")
    summaries = held.groupBy(number.alias("number")).agg(F.collect_list(F.struct("block", "low", "high", "norm")).alias("summaries"))
    pairs = queries.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(summaries, "number")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                keys, reach = np.frombuffer(row["keys"], dtype="<i8"), np.frombuffer(row["reach"], dtype="<f8")
                far, square = np.frombuffer(row["far"], dtype="<f4").reshape(len(keys), -1), squares(unpacked(row["kind"], row["vecs"], row["dim"], len(keys)))
                low, high, norm = (np.array([s[c] for s in row["summaries"]], dtype=np.float64) for c in ("low", "high", "norm"))
                number = np.array([s["block"] for s in row["summaries"]], dtype=np.int64)
                lower = np.zeros((len(keys), len(number)))
                for p in range(far.shape[1]):
                    own = far[:, p, None].astype(np.float64)
                    np.maximum(lower, np.maximum(low[None, :, p] - own, own - high[None, :, p]), out=lower)
                see = (upper(lower, square, norm, error_of(far, high, square, norm)) >= reach[:, None]) & (keys[:, None] >> 12 != number[None, :])
                who = [(int(n), np.flatnonzero(column).astype("<i4").tobytes()) for n, column in zip(number, see.T, strict=True) if column.any()]
                yield pa.RecordBatch.from_arrays([pa.array([row["pack"]] * len(who), pa.int64()), pa.array([n for n, _ in who], pa.int64()), pa.array([w for _, w in who], pa.binary())], names=["pack", "block", "who"])

    return pairs.select("pack", "dim", "kind", "vecs", "keys", "far", "reach", "summaries").mapInArrow(run, "pack long, block long, who binary")


def met(pairs: DataFrame, k: int) -> DataFrame:
    """(key, score, id): results of the queries of a pack in a block."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, who = np.frombuffer(row["keys"], dtype="<i8"), np.frombuffer(row["who"], dtype="<i4")
                b = Block(*(row[c] for c in ("dim", "kind", "vecs", "ids", "sizes", "far")))
                q, far = unpacked(row["q_kind"], row["q_vecs"], row["q_dim"], len(keys))[who], np.frombuffer(row["q_far"], dtype="<f4").reshape(len(keys), -1)[who]
                found = [(int(keys[who[n]]), s, j) for n, places, scores in best_in_bound_order(q, far, np.frombuffer(row["reach"], dtype="<f8")[who], b.vecs, b.far, b.first, k + 1) for s, j, _ in _entries(places, scores, b.ids, b.bounds, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["key", "score", "id"])

    return pairs.mapInArrow(run, "key long, score long, id long")


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, the k rows of highest inner product."""
    rows = vectors(embeddings, scale)
    known = different(rows, k, every)
    sample = [r.vec for r in known.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").collect()]  # SAMPLE vectors
    held = blocks(known, pick_pivots(matrix(sample), pivots))
    homes = at_home(held, k)
    asking = packs(homes)
    renamed = asking.select("pack", "keys", "reach", *(F.col(c).alias(f"q_{c}") for c in ("dim", "kind", "vecs", "far")))
    pairs = asked(held, asking).join(renamed, "pack").join(held.select("block", "dim", "kind", "vecs", "ids", "sizes", "far"), "block")
    beyond = met(pairs, k).select("key", "score", "id", F.lit(False).alias("own"))
    found = homes.select("key", F.explode("top").alias("e")).select("key", "e.*").unionByName(beyond)
    first = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id", "own"))).alias("top"))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).withColumnRenamed("id", "query_id")
    results = queries.join(homes.select("key", "vec").join(top, "key"), "vec")
    others = F.slice(F.filter("top", lambda e: ~(e.own & (e.id == F.col("query_id")))), 1, k)
    return results.select("query_id", F.posexplode(others).alias("place", "e")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), "e.score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id)::INTEGER AS rank, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20
"""
