"""What the training-data operators share: table access, shared storage, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 8_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """The columns `names` by exact name, even where other columns differ from them in case only."""
    seen: set[str] = set()
    kept = []
    for i, c in enumerate(df.columns):
        if c in names and c not in seen:
            seen.add(c)
            kept.append(c)
        else:
            kept.append(f"__other_{i}")
    return df.toDF(*kept).select(*names)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """`df` with its columns renamed c0, c1, ...; those names; and the new name of each old one (the first of equal ones).

    A stage that works on such names can't meet a clash; `select(*places).toDF(*df.columns)` gives the old names back.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*places), places, {c: p for c, p in reversed(list(zip(df.columns, places, strict=True)))}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_written_order(df: DataFrame, name: str) -> DataFrame:
    """`df`, read from Parquet files that Spark wrote, with `name`: each row's place (0, 1, ...) in the order of writing.

    Reading keeps no order (files are packed by size), so places are counted from the numbers in the files' names and
    the rows' places in their files. Only counts, a row for each file, meet in one task. The new column comes first, so
    it is the one that `narrow` finds where `df` has such a column already. Files that are not named as Spark's own
    writer names them are an error, for their order is unknown.
    """
    hidden = "_metadata"
    while hidden in {c.lower() for c in df.columns}:  # Spark, too, makes way for a column of that name
        hidden = f"_{hidden}"
    places = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select("*", F.col(f"{hidden}.file_path"), F.col(f"{hidden}.row_index")).toDF(*places, "file", "row")
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    part, piece = (F.regexp_extract("file", rf"{before}(\d+)[^/]*$", 1).try_cast("long") for before in ("/part-", r"/part-[^/]*-c"))
    known = F.when(part.isNotNull() & piece.isNotNull(), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no place in the order of writing: "), "file")))
    earlier = Window.orderBy(part, piece, "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = counts.withColumn("n", known).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "file").select(F.col("start") + F.col("row"), *places).toDF(name, *df.columns)


def joined_spread(rows: DataFrame, side: DataFrame, key: str, size: str, over: int = 1000, salts: int = 32) -> DataFrame:
    """`rows` joined to `side`, which has one row for each `key` and in `size` about how many of `rows` it meets.

    A side row that meets more than `over` rows is sent once for each salt, so no key's rows meet in one task; there are
    at most salts / over as many such copies as rows. The other keys are joined plainly.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    large = side.where(F.col(size) > over)
    copies = large.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", salt)
    spread = dealt.join(copies, [key, "__salt"]).drop("__salt")
    flags = copies.select(key, "__salt")
    rest = dealt.join(flags, [key, "__salt"], "left_anti").drop("__salt")
    return spread.unionByName(rest.join(side.where(F.col(size) <= over), key))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))



def slices(batch, rows: int = 512, most: int = SLICE_BYTES):
    """Slices of an Arrow batch of at most `rows` rows and, but for a single longer row, about `most` bytes of text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    long = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in long:
        sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    until, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(until, most + (until[at - 1] if at else 0), side="right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_documents(df: DataFrame, fn, schema: str, rows: int = 512) -> DataFrame:
    """`fn(columns)` over slices of at most `rows` rows: a dict of lists in, a dict of lists out, as Arrow batches.

    A slice at a time is turned into Python objects, so memory follows the slice and not the batch.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, rows):
                yield pa.RecordBatch.from_pydict(fn(piece.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def discard(df: DataFrame) -> None:
    """Deletes the files of a `stored` table whose rows are no longer needed."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
