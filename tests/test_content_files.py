"""Contents as files: all of them after a commit, none after a failure."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from egresslens.session import shared_dir
from egresslens.sources import files
from egresslens.sources.files import read_content_files, safe_path, write_content_files


def test_paths_stay_below_the_folder():
    assert [safe_path(p) for p in ("/a/b.txt", "../../x", "c:\\d\\e", "", "/", "a//./b")] == [
        "a/b.txt", "x", "c:/d/e", "unnamed", "unnamed", "a/b"]


def test_contents_come_back(spark, tmp_path):
    rows = [(f"/d{i % 3}/é {i}.bin", bytes([i]) * i) for i in range(40)] + [("../up", b"x"), (None, None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    write_content_files(df, str(tmp_path / "out"))
    got = {(r["path"], bytes(r["content"])) for r in read_content_files(spark, str(tmp_path / "out")).collect()}
    assert got == {(safe_path(p or ""), c) for p, c in rows if c}
    names = {f for _, _, files in os.walk(tmp_path / "out") for f in files}
    assert {"é 0.bin", "unnamed"} <= names  # Spark's readers pass empty files over
    one = df.limit(0).union(spark.createDataFrame([("a", b"1"), ("a", b"2")], df.schema)).coalesce(1)
    write_content_files(one, str(tmp_path / "twice"))
    assert {r["path"] for r in read_content_files(spark, str(tmp_path / "twice")).collect()} == {"a", "a~1"}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(40).repartition(4).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") == 17, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("content"))
    with pytest.raises(Exception):
        write_content_files(df, str(tmp_path / "out"))
    left = [f for _, _, files in os.walk(tmp_path) for f in files]
    assert left == []


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(files.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    writer = files.ContentFiles({"path": str(tmp_path / "out")}).writer(None, False)

    def batches():
        yield pa.RecordBatch.from_pydict({"path": ["a/b"], "content": [b"1"]})
        writer.abort([])
        yield pa.RecordBatch.from_pydict({"path": ["c/d", "e"], "content": [b"2", b"3"]})

    with pytest.raises(OSError):
        writer.write(batches())
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []


def test_files_are_listed_by_tasks(spark, tmp_path):
    """No name of a file passes through the driver, however many there are; hidden files stay out."""
    rows = spark.range(300).select(F.concat("id", F.lit("/a.txt")).alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    hidden = spark.createDataFrame([(".h/a", b"1"), ("b/_h", b"2"), ("_k=1/b", b"3")], rows.schema)
    write_content_files(rows.union(hidden).repartition(3), str(tmp_path / "out"))
    found = read_content_files(spark, str(tmp_path / "out"))
    assert found.inputFiles() == []
    got = {r["path"]: bytes(r["content"]) for r in found.collect()}
    assert got == {f"{i}/a.txt": str(i).encode() for i in range(300)} | {"_k=1/b": b"3"}


def test_a_directory_of_targets_is_moved_by_task(spark, tmp_path):
    from egresslens.plans import disk_queries  # noqa: F401
    from egresslens.plans.registry import QUERIES
    rows = [(i, f"s/{i % 2}", f"text {i}") for i in range(200)] + [(7, None, None), (300, "", "x"), (301, "s=%", "a"), (301, "s=%", "a")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(shared_dir(spark)))
    got = {r["source"]: r["files"] for r in QUERIES["s06_directory_targets"](spark, str(tmp_path)).collect()}
    assert got == {"s%2F0": 100, "s%2F1": 100, "__HIVE_DEFAULT_PARTITION__": 2, "s%3D%25": 1}
    tree = next(n for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("tree-"))
    folders = [d for _, found, _ in os.walk(os.path.join(shared_dir(spark), tree)) for d in found]
    assert len(folders) < 40
