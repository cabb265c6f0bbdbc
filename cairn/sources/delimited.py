"""Delimited event tables, column roles, annotations and external assignments, as typed DataFrames with rejects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels that are skipped unless asked for. Fixed values.
SKIPPED_BY_DEFAULT = ("Time", "beadDist", "Cell_length", "Pt1", "Pd1", "Ir19")


@dataclass
class ImportConfig:
    """What an import does; thresholds first, then transform, rescale, length filter and row limit."""

    name: str
    features: list[str]
    side: list[str] = field(default_factory=list)
    rescale: str = "none"
    transform: str = "asinh"
    factor: float = 5.0
    quantile: float = 0.99
    rescale_per_file: bool = False
    row_limit: int = -1
    least_length: float = 0.0
    noise_threshold: float = 1.0


def header_names(header: str) -> tuple[list[str], list[str]]:
    """Short and long names from "name, short:long, ..."; without a colon both are the same."""
    import re

    cells = [c.strip().strip('"') for c in re.split(r"[\t,]+", header.strip())][1:]
    return [c.split(":", 1)[0] for c in cells], [c.split(":", 1)[-1] for c in cells]


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, rejects, long names) of delimited text with a header line and the row name in the first column.

    rows: name, file, and a double column for each short name. A line with another number of cells or a cell that is
    not a number goes to rejects (file, line, reason). Runs of tabs and commas separate once; quotes are dropped.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    header = lines.first()["line"]  # one line
    short, long = header_names(header)
    cells = lines.where(F.col("line") != header).withColumn("cells", F.split(F.regexp_replace("line", '"', ""), "[\t,]+"))
    numbers = cells.withColumn("values", F.expr("transform(slice(cells, 2, greatest(size(cells) - 1, 0)), x -> try_cast(trim(x) AS double))"))
    reason = F.when(F.size("cells") != len(short) + 1, F.lit("wrong number of columns")).when(F.exists("values", lambda x: x.isNull()), F.lit("not a number"))
    judged = numbers.withColumn("reason", reason)
    rows = judged.where("reason IS NULL").select(F.col("cells")[0].alias("name"), "file", *[F.col("values")[i].alias(c) for i, c in enumerate(short)])
    return rows, judged.where("reason IS NOT NULL").select("file", "line", "reason"), long


def read_headerless(spark: SparkSession, path: str, names: list[str], dataset: str) -> DataFrame:
    """Rows of numbers; the row's name is "<dataset>.fcs Event %07d" by its place in the file order."""
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` double" for n in names)).withColumn("__at", F.monotonically_increasing_id())
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(starts, "__p long, __before long") if starts else spark.createDataFrame([], "__p long, __before long")
    placed = rows.withColumn("__p", F.shiftright("__at", 33)).join(offsets, "__p")
    event = F.col("__before") + F.col("__at") - F.shiftleft("__p", 33) + 1
    return placed.select(F.format_string(f"{dataset}.fcs Event %07d", event).alias("name"), *names)


def read_named(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by name of CSV files with a header, as the given types; a value that is not of its type is null."""
    cells = spark.read.csv(path, header=True, inferSchema=False)
    return cells.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])


def common_columns(frames: list[DataFrame], drop_default: bool = True) -> list[str]:
    """Columns of all frames, in the first one's order."""
    shared = set.intersection(*(set(f.columns) for f in frames)) if frames else set()
    skipped = {s.lower() for s in SKIPPED_BY_DEFAULT} if drop_default else set()
    return [c for c in frames[0].columns if c in shared and c.lower() not in skipped] if frames else []


def merge_files(frames: list[DataFrame], names: list[str], drop_default: bool = True) -> DataFrame:
    """One dataset of several files: their common columns and `file`."""
    cols = [c for c in common_columns(frames, drop_default) if c != "file"]
    out = None
    for f, n in zip(frames, names, strict=True):
        one = f.select(F.lit(n).alias("file"), *cols)
        out = one if out is None else out.unionByName(one)
    return out


def column_roles(text: str) -> dict[str, int]:
    """name -> 0 (feature), 1 (side) or 2 (skipped) from lines "idx, role, names..."; # starts a comment, larger roles are 2."""
    roles = {}
    for line in text.splitlines():
        cells = [c.strip() for c in line.split("#")[0].replace("\t", ",").split(",")]
        if len(cells) >= 3 and cells[1].lstrip("-").isdigit():
            roles[cells[2]] = min(2, max(0, int(cells[1])))
    return roles


def batch_config(text: str) -> dict:
    """Keys and values of a batch file, "key=value" a line; feature columns as 1-based numbers, K a number or "auto"."""
    out: dict = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if sep:
            key, value = key.strip(), value.strip()
            out[key] = [int(v) for v in value.split(",")] if key == "features" else (value if key != "k" or value == "auto" else int(value))
    return out


def read_annotations(spark: SparkSession, path: str, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations (id, term), rejects (line, reason)) of lines "event_id, term, term ..." for the ids of `points`."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).withColumn("cells", F.split("line", "[\t,]+"))
    judged = lines.withColumn("id", F.expr("try_cast(trim(cells[0]) AS bigint)"))
    judged = judged.withColumn("reason", F.when(F.size("cells") < 2, "too few fields").when(F.col("id").isNull(), "id is not a number"))
    good = judged.where("reason IS NULL")
    known = good.join(points.select("id"), "id", "left_semi").select("id", F.explode(F.expr("slice(cells, 2, size(cells) - 1)")).alias("term"))
    unknown = good.join(points.select("id"), "id", "left_anti").select("line", F.lit("unknown id").alias("reason"))
    return known.withColumn("term", F.trim("term")).where("term <> ''"), judged.where("reason IS NOT NULL").select("line", "reason").unionByName(unknown)


def annotations_by_name(named: DataFrame, points: DataFrame, terms: str = "terms", name: str = "name") -> DataFrame:
    """(id, term) from ;-separated terms of rows that match a point's name."""
    return points.select("id", "name").join(named.select(F.col(name).alias("name"), F.explode(F.split(terms, ";")).alias("term")), "name").select("id", F.trim("term").alias("term")).where("term <> ''")


def external_assignment(rows: DataFrame, points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members (id, cluster), clusters with size and mean profile) from (id, cluster); -1 is unassigned."""
    from cairn.operators.aggregates import mean_profile

    members = rows.where("cluster <> -1").select("id", "cluster")
    return members, mean_profile(points.join(members, "id"), ["cluster"], dim)
