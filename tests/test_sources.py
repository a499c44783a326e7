"""Sources whose files differ from one another or are damaged."""

import pandas as pd
from pyspark.sql import functions as F
import pytest

from egresslens.functions import digests
from egresslens.functions.binary import lossy_utf8
from egresslens.operators import fuzzy
from egresslens.sources import readers


def test_labelled_files_are_read_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,class\n1,100,given\n")
    (tmp_path / "b.csv").write_text("y,x,class\n200,2,\n")
    (tmp_path / "c.csv").write_text("x\n3\n")
    (tmp_path / "d.csv").write_text("")
    rows = readers.load_labelled(spark, f"{tmp_path}/*.csv", "benign").select("x", "y", "class").collect()
    assert sorted(map(tuple, rows)) == [(1, 100, "given"), (2, 200, "benign"), (3, None, "benign")]


def test_labelled_columns_have_one_type_in_all_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,class\n1,2,\n")
    (tmp_path / "b.csv").write_text("y,x,class\n5,abc,m\n")
    (tmp_path / "c.csv").write_text('z,"q,r",x\n1.5,"a ""b"", c",7\n,true,\n2e3,x,8\n')
    loaded = readers.load_labelled(spark, f"{tmp_path}/*.csv", "benign")
    assert dict(loaded.dtypes) == {"x": "string", "y": "bigint", "z": "double", "q,r": "string", "class": "string"}
    rows = {(r["x"], r["y"], r["z"], r["q,r"], r["class"]) for r in loaded.collect()}
    assert rows == {("1", 2, None, None, "benign"), ("abc", 5, None, None, "m"), ("7", None, 1.5, 'a "b", c', "benign"),
                    (None, None, None, "true", "benign"), ("8", None, 2000.0, "x", "benign")}
    both = readers.load_category(spark, f"{tmp_path}/a.csv", f"{tmp_path}/b.csv")
    assert dict(both.dtypes)["x"] == "string" and {(r["x"], r["class"]) for r in both.collect()} == {("1", "benign"), ("abc", "m")}
    (tmp_path / "empty.txt").write_text("")
    assert readers.load_labelled(spark, f"{tmp_path}/empty.txt", "benign").dtypes == [("class", "string")]


def test_log_lines_are_numbered_over_splits_at_any_byte(spark, tmp_path):
    texts = [b"", b"\n", b"one", b"one\r\ntwo\r\n", b"a\rb\x0bc\n\nd\r", b"\xff\xe2\x80\nx\xc3\xa9\r\xff\ny\xe2\x80\xa8z\n", b"\r\n\r\n",
             b"idVendor=07\xff81\r\n" * 9 + b"end"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.log").write_bytes(text)
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"), lossy_utf8(F.col("content")).alias("text"))
    key = lambda df: sorted((r["file"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in df.collect())
    want = key(readers.log_lines(whole))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = [spark.conf.get(n) for n in names]
    try:
        for width in (1, 2, 3, 7, 1000):
            spark.conf.set(names[0], width)
            spark.conf.set(names[1], 0)
            assert key(readers.read_log_lines(spark, str(tmp_path))) == want, width
    finally:
        for name, value in zip(names, held):
            spark.conf.set(name, value)


def test_log_lines_drop_damaged_bytes_and_know_all_line_ends(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"idVendor=07\xff81\x0bsecond\r\nthird")
    rows = readers.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["idVendor=0781", "second", "third"]


def test_overlong_and_foreign_signatures_are_no_digests(spark):
    good, long, foreign = "96:abcdefghij:klmno", "96:" + "a1b2" * 19 + ":x", "96:abcdéfghij:x"
    df = spark.createDataFrame([(d,) for d in (good, long, foreign)], "digest string")
    assert {r["digest"] for r in fuzzy._signatures(df, "digest").collect()} == {good}
    with pytest.raises(ValueError):
        digests.common_subsequence(pd.Series(["a" * 65]), pd.Series(["a"]))
