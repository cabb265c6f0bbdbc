"""The FCS format as a data source, and files with a further channel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import fcs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("fcs")
    rng = np.random.default_rng(3)
    rows = {"a": np.round(rng.normal(size=(1000, 3)), 3).astype("f4"), "b": np.round(rng.normal(size=(7, 3)), 3).astype("f4")}
    (path / "a.fcs").write_bytes(fcs.encode(["X", "Y", "Odd `name`/2"], ["long X", "Y", "Z"], rows["a"]))
    (path / "b.fcs").write_bytes(fcs.encode(["Y", "X", "Other"], ["Y", "X", "O"], rows["b"]))
    (path / "empty.fcs").write_bytes(fcs.encode(["X", "Y"], ["X", "Y"], np.zeros((0, 2), "f4")))
    return path, rows


def test_a_file_is_read_by_several_tasks(spark, folder):
    path, rows = folder
    fcs.register(spark)
    df = spark.read.format("fcs").option("bytesPerPartition", 1200).load(f"file://{path}")
    assert df.columns == ["file", "idx", "X", "Y"]  # what all files have
    parts = df.where(F.col("file").endswith("/a.fcs")).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) == 10 and {r["count"] for r in parts} == {100}
    got = {(r.file.rpartition("/")[2], r.idx): (r.X, r.Y) for r in df.collect()}
    want = {("a.fcs", i): (float(v[0]), float(v[1])) for i, v in enumerate(rows["a"])} | {("b.fcs", i): (float(v[1]), float(v[0])) for i, v in enumerate(rows["b"])}
    assert got == want


def test_names_need_no_events(folder, monkeypatch):
    path, _ = folder
    monkeypatch.setattr(fcs, "_columns", None)
    with open(path / "a.fcs", "rb") as f:
        sizes = []
        found = fcs.layout(lambda at, size: (f.seek(at), sizes.append(size), f.read(size))[2])
    assert found.long == ["long X", "Y", "Z"] and found.events == 1000 and found.start == fcs.HEADER + sizes[1] and len(sizes) == 2


def test_a_schema_prunes_channels(spark, folder):
    path, rows = folder
    fcs.register(spark)
    one = spark.read.format("fcs").schema("`Odd `name`/2` double".replace("`name`", "``name``")).load(f"{path}/a.fcs")
    assert [r[0] for r in one.collect()] == rows["a"][:, 2].astype(float).tolist()
    with pytest.raises(Exception, match="no channel"):
        spark.read.format("fcs").schema("Other double").load(f"{path}/a.fcs").collect()
    with pytest.raises(Exception, match="no FCS files"):
        spark.read.format("fcs").load(f"{path}/*.txt").collect()


@pytest.mark.parametrize("kind,order", [("F", "1,2,3,4"), ("D", "4,3,2,1"), ("I", "1,2,3,4")])
def test_clusters_become_a_channel(spark, tmp_path, kind, order):
    """Files of every type keep their events, type and keywords; parts and events without a row get the mark."""
    code = ("<" if order[0] == "1" else ">") + {"F": "f4", "D": "f8", "I": "u4"}[kind]
    values = np.arange(60).reshape(30, 2)
    words = {"$BYTEORD": order, "$DATATYPE": kind, "$MODE": "L", "$PAR": "2", "$TOT": "30", "MINE": "kept/as it is", "$BEGINANALYSIS": "9"}
    for i, c in enumerate("AB", 1):
        words |= {f"$P{i}N": c, f"$P{i}B": str(8 * np.dtype(code).itemsize), f"$P{i}E": "0,0", f"$P{i}R": "64"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.fcs").write_bytes(fcs._laid_out(words, values.astype(code).tobytes(), b"FCS3.0"))
    rows = [(f"file:{tmp_path}/in/x.fcs", i, i % 3) for i in range(12) if i != 5] + [(f"file:{tmp_path}/in/x.fcs", 6, None)][:0]
    made = fcs.write_with_clusters(spark.createDataFrame(rows, "file string, idx long, cluster int"), f"file://{tmp_path}/out", "group", 8).collect()
    assert sorted((r.file.rpartition("/")[2], r.events) for r in made) == [("x_0.fcs", 8), ("x_1.fcs", 8), ("x_2.fcs", 8), ("x_3.fcs", 6)]
    none = 2.0**32 - 1 if kind == "I" else -1.0
    got = []
    for n in range(4):
        data = (tmp_path / "out" / f"x_{n}.fcs").read_bytes()
        found = fcs.layout(lambda at, size, data=data: data[at : at + size])
        assert found.words["MINE"] == "kept/as it is" and found.words["$DATATYPE"] == kind and "$BEGINANALYSIS" not in found.words
        short, _, rows = fcs.decode(data)
        assert short == ["A", "B", "group"]
        got += rows.tolist()
    assert got == [[2.0 * i, 2.0 * i + 1, float(i % 3) if i < 12 and i != 5 else none] for i in range(30)]
