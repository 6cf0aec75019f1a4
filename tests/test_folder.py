"""The folder source: same rows as Spark's own format, rules that reach the listing, partitions by bytes, a stream that resumes."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringEndsWith

from ledgerspark.sources import folder
from ledgerspark.sources.admission import admit
from ledgerspark.sources.files import read_files


def fill(path, files):
    path.mkdir(exist_ok=True)
    for name, data in files.items():
        (path / name).write_bytes(data)


def test_same_rows_as_spark(spark, tmp_path):
    fill(tmp_path / "in", {"a.pdf": b"%PDF", "b.PNG": b"p", "c.pdf": b"x" * (10 * 1024 * 1024 + 1), "d.exe": b"x", "name with blank.txt": "é".encode(), ".hidden": b"h", "_SUCCESS": b""})
    fill(tmp_path / "in" / "below", {"e.txt": b"e"})
    uri = f"file://{tmp_path}/in"
    key = lambda r: r.file_name
    got = folder.documents_of(folder.read_folder(spark, uri))
    assert sorted(got.collect(), key=key) == sorted(read_files(spark, uri).select(got.columns).collect(), key=key)
    assert len(folder.read_folder(spark, uri, recursive="true").collect()) == got.count() + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1


def test_empty_files_and_folders(spark, tmp_path):
    fill(tmp_path / "in", {"zero.pdf": b""})
    (row,) = admit(folder.documents_of(folder.read_folder(spark, str(tmp_path / "in"))).withColumn("page_count", F.lit(None).cast("int"))).collect()
    assert (row.content, row.error_message) == (b"", "File is empty")
    (tmp_path / "none").mkdir()
    assert folder.read_folder(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        folder.read_folder(spark, str(tmp_path / "missing")).count()


def test_rules_narrow_the_listing(spark, tmp_path):
    fill(tmp_path / "in", {f"f{k}.{'txt' if k % 2 else 'pdf'}": b"x" * k for k in range(20)})
    reader = folder.FolderReader({"path": str(tmp_path / "in")})
    left = list(reader.pushFilters([StringEndsWith(("file_name",), ".txt"), GreaterThan(("length",), 5), LessThanOrEqual(("length",), 15), IsNotNull(("path",)), Not(EqualTo(("file_name",), "f7.txt"))]))
    assert left == [Not(EqualTo(("file_name",), "f7.txt"))]
    assert [f.length for p in reader.partitions() for f in p.files] == [15, 13, 11, 9, 7]
    assert folder.rule(In(("file_name",), ("a", "b")))[1]("b") and folder.rule(EqualTo(("content",), b"")) is None
    got = folder.read_folder(spark, str(tmp_path / "in")).where("file_name LIKE '%.txt' AND length > 5 AND file_name <> 'f7.txt'")
    assert sorted(r.length for r in got.collect()) == [9, 11, 13, 15, 17, 19]
    # a file that a rule leaves out is not opened: here it cannot be
    os.symlink("/proc/self/mem", tmp_path / "in" / "f99.bin")
    assert folder.read_folder(spark, str(tmp_path / "in")).where("file_name = 'f3.txt'").collect()[0].content == b"xxx"


def test_partitions_by_bytes(spark, tmp_path):
    files = [folder.File(f"/{k}", s, 0) for k, s in enumerate([9, 1, 5, 5, 30, 200])]
    mb = 1 << 20
    sizes = [[f.length // mb for f in p.files] for p in folder.pack([folder.File(f.path, f.length * mb, 0) for f in files], 12 * mb, limit=100 * mb)]
    assert sizes == [[30], [9], [5, 5], [1, 200]] and folder.pack([], mb) == []
    fill(tmp_path / "in", {f"{k}": b"x" * 1000 for k in range(40)})
    df = folder.read_folder(spark, str(tmp_path / "in"), partition_bytes=10 * (1 << 20))
    assert df.rdd.getNumPartitions() == 5 and df.agg(F.sum(F.length("content"))).first()[0] == 40_000
    assert folder.read_folder(spark, str(tmp_path / "in"), content="false").where("content IS NULL").count() == 40


def test_stream_resumes(spark, tmp_path):
    where, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"

    def run():
        q = folder.stream_folder(spark, f"file://{where}", settle="0").select("file_name", "length").writeStream.format("parquet").option("checkpointLocation", mark).trigger(once=True).start(out)
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
        return sorted((r.file_name, r.length) for r in spark.read.schema("file_name string, length long").parquet(out).collect())

    fill(where, {"a": b"1", "b": b"22"})
    assert run() == [("a", 1), ("b", 2)]
    assert run() == [("a", 1), ("b", 2)]
    fill(where, {"c": b"333"})
    assert run() == [("a", 1), ("b", 2), ("c", 3)]
    fill(where, {"a": b"4444"})
    assert run() == [("a", 1), ("a", 4), ("b", 2), ("c", 3)]


def test_files_of_one_moment_wait(tmp_path):
    fill(tmp_path, {"a": b"1", "b": b"2"})
    os.utime(tmp_path / "a", (10, 10))
    s = folder.FolderStream({"path": str(tmp_path), "settle": "60"})
    assert s.latestOffset() == {"changed": 10 * 10**9, "path": f"{tmp_path}/a"}
    (part,) = s.partitions(s.initialOffset(), s.latestOffset())
    assert [f.file_name for f in part.files] == ["a"] and s.partitions(s.latestOffset(), s.latestOffset()) == []
