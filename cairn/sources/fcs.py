"""FCS 3.x files (the public flow cytometry standard): list-mode float and integer data, read and written."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEADER = 58
PART_BYTES = 64_000_000
BATCH_EVENTS = 65_536


def _keywords(segment: bytes) -> dict[str, str]:
    text = segment.decode("utf-8", "replace")
    mark, body = text[0], text[1:]
    parts = [p.replace("\0", mark) for p in body.replace(mark * 2, "\0").split(mark)]
    return {k.upper(): v for k, v in zip(parts[::2], parts[1::2], strict=False)}


class Layout(NamedTuple):
    """What the header and the text of a file say: its keywords, names of channels, type of an event, first byte and number of events."""

    words: dict[str, str]
    short: list[str]
    long: list[str]
    event: np.dtype
    start: int
    events: int


def layout(read: Callable[[int, int], bytes]) -> Layout:
    """The layout of a file whose `read(at, size)` gives bytes; no event is read."""
    head = read(0, HEADER)
    if head[:3] != b"FCS":
        raise ValueError("not an FCS file")
    places = [int(head[10 + 8 * i : 18 + 8 * i].strip() or 0) for i in range(4)]
    words = _keywords(read(places[0], places[1] + 1 - places[0]))
    channels, order = int(words["$PAR"]), "<" if words.get("$BYTEORD", "1,2,3,4").startswith("1") else ">"
    code = {"F": "f4", "D": "f8"}.get(words.get("$DATATYPE", "F"))
    event = np.dtype([(f"c{i}", order + (code or f"u{int(words[f'$P{i + 1}B']) // 8}")) for i in range(channels)])
    short = [words.get(f"$P{i}N", f"P{i}") for i in range(1, channels + 1)]
    long = [words.get(f"$P{i}S", s) for i, s in zip(range(1, channels + 1), short, strict=True)]
    return Layout(words, short, long, event, places[2] or int(words["$BEGINDATA"]), int(words["$TOT"]))


def _columns(raw: bytes, event: np.dtype) -> list[np.ndarray]:
    rows = np.frombuffer(raw, dtype=event)
    return [rows[c].astype(np.float64) for c in event.names or ()]


def decode(data: bytes) -> tuple[list[str], list[str], np.ndarray]:
    """Short names, long names and the events (rows by channels) of a file."""
    found = layout(lambda at, size: data[at : at + size])
    values = _columns(data[found.start : found.start + found.events * found.event.itemsize], found.event)
    return found.short, found.long, np.column_stack(values) if values else np.zeros((found.events, 0))


def _laid_out(words: dict[str, str], data: bytes, version: bytes = b"FCS3.1") -> bytes:
    """A file of these keywords and data; the keywords that say where the data are get their values here."""
    begin = 0
    for _ in range(3):  # the places of the data depend on the length of the text that states them
        shown = words | {"$BEGINDATA": str(begin), "$ENDDATA": str(begin + max(0, len(data) - 1))}
        text = "/" + "".join(f"{k}/{str(v).replace('/', '//') or ' '}/" for k, v in shown.items())
        begin = HEADER + len(text.encode())
    places = [HEADER, begin - 1, begin, begin + max(0, len(data) - 1)]
    fit = [p if p < 10**8 else 0 for p in places]
    return version.ljust(10) + "".join(f"{p:>8}" for p in [*fit, 0, 0]).encode() + text.encode() + data


def encode(short: list[str], long: list[str], values: np.ndarray) -> bytes:
    """A little-endian FCS 3.1 file of 32-bit floats."""
    words = {"$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(len(short)), "$TOT": str(len(values))}
    for i, (s, w) in enumerate(zip(short, long, strict=True), 1):
        top = int(np.ceil(values[:, i - 1].max())) + 1 if len(values) else 1
        words |= {f"$P{i}N": s, f"$P{i}S": w, f"$P{i}B": "32", f"$P{i}E": "0,0", f"$P{i}R": str(max(1, top))}
    return _laid_out(words, np.ascontiguousarray(values, dtype="<f4").tobytes())


def with_channel(found: Layout, raw: bytes, name: str, values: np.ndarray) -> bytes:
    """A file of the events `raw` with one channel more, of the file's own type; its other keywords stay as they are."""
    rows = np.frombuffer(raw, dtype=found.event)
    kind = found.event[0].newbyteorder("=").kind if len(found.event) else "f"
    added = np.dtype(found.event[0].byteorder.replace("=", "<") + ("u4" if kind == "u" else f"f{found.event[0].itemsize}")) if len(found.event) else np.dtype("<f4")
    out = np.empty(len(rows), dtype=np.dtype([*((c, found.event[c]) for c in found.event.names), ("added", added)]))
    for c in found.event.names:
        out[c] = rows[c]
    out["added"] = np.where(values < 0, 2**32 - 1, values) if kind == "u" else values
    n, moved = len(found.short) + 1, ("$BEGINDATA", "$ENDDATA", "$BEGINANALYSIS", "$ENDANALYSIS", "$BEGINSTEXT", "$ENDSTEXT", "$NEXTDATA")
    words = {k: v for k, v in found.words.items() if k not in moved} | {"$NEXTDATA": "0", "$PAR": str(n), "$TOT": str(len(rows))}
    words |= {f"$P{n}N": name, f"$P{n}S": name, f"$P{n}B": str(added.itemsize * 8), f"$P{n}E": "0,0", f"$P{n}R": str(int(values.max(initial=0)) + 1)}
    return _laid_out(words, out.tobytes())


def _system(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


def _files(path: str) -> list[str]:
    """The files under a path: a file, a folder's .fcs files, or a pattern in the last part."""
    from pyarrow import fs

    system, root = _system(path)
    folder, _, last = root.rpartition("/")
    if not any(c in last for c in "*?["):
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [path]
        folder, last = root, "*.fcs"
    prefix = path[: len(path) - len(root)]
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, last))


def _layout_of(uri: str) -> Layout:
    system, root = _system(uri)
    with system.open_input_file(root) as f:
        return layout(lambda at, size: f.read_at(size, at))


class FcsPart(InputPartition):
    """Events begin to end of a file."""

    def __init__(self, uri: str, begin: int, end: int):
        super().__init__((uri, begin, end))
        self.uri, self.begin, self.end = uri, begin, end


class FcsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.files = schema, _files(options["path"])
        self.part_bytes = int(options.get("bytesperpartition", PART_BYTES))

    def partitions(self) -> list[FcsPart]:
        out = []
        for uri in self.files:
            found = _layout_of(uri)
            step = max(1, self.part_bytes // max(1, found.event.itemsize))
            out += [FcsPart(uri, at, min(at + step, found.events)) for at in range(0, found.events, step)]
        return out or [FcsPart("", 0, 0)]

    def read(self, partition: FcsPart) -> Iterator:
        import pyarrow as pa

        if partition.begin == partition.end:
            return
        found, (system, root) = _layout_of(partition.uri), _system(partition.uri)
        size, places = found.event.itemsize, {c: i for i, c in reversed(list(enumerate(found.short)))}
        missing = [c for c in self.schema.names if c not in places and c not in ("file", "idx")]
        if missing:
            raise ValueError(f"{partition.uri} has no channel {', '.join(missing)}")
        with system.open_input_file(root) as f:
            for at in range(partition.begin, partition.end, BATCH_EVENTS):
                until = min(at + BATCH_EVENTS, partition.end)
                rows = np.frombuffer(f.read_at((until - at) * size, found.start + at * size), dtype=found.event)
                columns = {"file": lambda n=len(rows): pa.array([partition.uri]).take(pa.array(np.zeros(n, dtype=np.int32))), "idx": lambda a=at, b=until: pa.array(np.arange(a, b, dtype=np.int64))}
                yield pa.RecordBatch.from_arrays([pa.array(rows[f"c{places[c]}"].astype(np.float64)) if c in places else columns[c]() for c in self.schema.names], names=self.schema.names)


class FcsSource(DataSource):
    """spark.read.format("fcs").load(path): file, idx and a double column for each channel that all files have.

    Headers alone give the schema. A file is read in parts of about bytesPerPartition bytes, each by a task of its own.
    With `.schema(...)` only the channels it names are made. Paths are those that the pyarrow file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def schema(self) -> str:
        found = [_layout_of(f).short for f in _files(self.options["path"])]
        if not found:
            raise ValueError(f"no FCS files under {self.options['path']}")
        shared = [c for c in found[0] if all(c in short for short in found)]
        return "file string, idx long" + "".join(f", `{c.replace('`', '``')}` double" for c in shared)

    def reader(self, schema: StructType) -> FcsReader:
        return FcsReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format "fcs" known to a session."""
    spark.dataSource.register(FcsSource)


def channels(spark: SparkSession, path: str) -> list[tuple[str, list[str], list[str]]]:
    """(file, short names, long names) of each file; no event is decoded, and only names travel to the driver."""

    def run(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                found = layout(lambda at, size, c=c: c[at : at + size])
                yield pd.DataFrame({"file": [p], "short": [found.short], "long": [found.long]})

    files = spark.read.format("binaryFile").load(path)
    return [tuple(r) for r in files.select("path", "content").mapInPandas(run, "file string, short array<string>, long array<string>").orderBy("file").collect()]


def read_fcs(spark: SparkSession, path: str) -> DataFrame:
    """file, idx and a double column for each channel that all files under `path` have, from any store that Spark reads.

    A file is one value here (2 GB at most); the format "fcs" splits files where pyarrow can open their store.
    """
    found = channels(spark, path)
    shared = [c for c in found[0][1] if all(c in short for _, short, _ in found)]

    def run(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                short, _, values = decode(c)
                out = pd.DataFrame({"file": p, "idx": np.arange(len(values), dtype="int64")})
                yield out.assign(**{name: values[:, short.index(name)] for name in shared})

    schema = "file string, idx long, " + ", ".join(f"`{c}` double" for c in shared)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


#: Ways back from a transform, of a column and the transform's factor. The logarithm is the natural one.
BACK = {"asinh": lambda c, factor: F.sinh(c) * factor, "log": lambda c, factor: F.exp(c), "none": lambda c, factor: F.col(c)}


def write_fcs(df: DataFrame, folder: str, cols: list[str], by: str, back: float | None = None, kind: str = "asinh", rows_per_file: int = 1_000_000) -> DataFrame:
    """FCS files for each value of `by` (a cluster, or an annotation's term) in `folder` (a path that all tasks share); the files written.

    `back` undoes a transform of that `kind` with that factor. A value of more than `rows_per_file` rows has several
    files of about that many at most, "<value>_<number>.fcs", so no task holds a large cluster.
    """
    if kind not in BACK:
        raise ValueError(f"unknown transform: {kind}; known: {', '.join(sorted(BACK))}")
    shown = [(BACK[kind](c, back) if back else F.col(c)).cast("double").alias(c) for c in cols]
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("part"), *shown)
    files = rows.groupBy("part").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("files"))
    dealt = rows.join(files, "part").withColumn("number", F.when(F.col("files") > 1, F.pmod(F.xxhash64(*cols), "files").cast("int")).otherwise(0))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        first = frame.iloc[0]
        name = f"{root}/{first['part']}{'_' + str(first['number']) if first['files'] > 1 else ''}.fcs"
        with system.open_output_stream(name, compression=None) as out:
            out.write(encode(cols, cols, frame[cols].to_numpy()))
        return pd.DataFrame({"file": [name], "events": [len(frame)]})

    return dealt.groupBy("part", "number").applyInPandas(run, "file string, events long")


def write_with_clusters(clusters: DataFrame, folder: str, name: str = "cluster", rows_per_file: int = 1_000_000) -> DataFrame:
    """FCS files in `folder` with the events and keywords of the files that (file, idx, cluster) name, and the cluster as a further channel.

    A task for each `rows_per_file` events of a file reads just those and writes "<name>_<part>.fcs" (without the part
    where one holds the file). An event without a row, or a null cluster, gets -1 (in files of unsigned integers their
    greatest number). The files written, with their events.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        uri, part = frame["file"].iloc[0], int(frame["part"].iloc[0])
        found, (system, root), (target, into) = _layout_of(uri), _system(uri), _system(folder)
        begin, end = part * rows_per_file, min((part + 1) * rows_per_file, found.events)
        values = np.full(end - begin, -1.0)
        own = frame[frame["cluster"].notna()]
        values[own["idx"].to_numpy() - begin] = own["cluster"].to_numpy()
        with system.open_input_file(root) as f:
            raw = f.read_at((end - begin) * found.event.itemsize, found.start + begin * found.event.itemsize)
        target.create_dir(into, recursive=True)
        stem = root.rpartition("/")[2].removesuffix(".fcs")
        out = f"{into}/{stem}{f'_{part}' if found.events > rows_per_file else ''}.fcs"
        with target.open_output_stream(out, compression=None) as f:
            f.write(with_channel(found, raw, name, values))
        return pd.DataFrame({"file": [out], "events": [end - begin]})

    def parts(frames):
        for frame in frames:
            for uri in frame["file"]:
                begins = np.arange(0, _layout_of(uri).events, rows_per_file, dtype=np.int64)
                yield pd.DataFrame({"file": uri, "idx": begins, "cluster": np.nan})

    rows = clusters.select("file", F.col("idx").cast("long").alias("idx"), F.col("cluster").cast("double").alias("cluster"))
    rows = rows.unionByName(rows.select("file").distinct().mapInPandas(parts, "file string, idx long, cluster double"))  # so that each part has a row
    return rows.withColumn("part", F.floor(F.col("idx") / rows_per_file).cast("int")).groupBy("file", "part").applyInPandas(run, "file string, events long")
