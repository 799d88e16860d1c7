"""The committed sink and the ranged archive source; archives rebuilt entry by entry."""

import io
import os
import pickle
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.sources import archives as ar
from foliospark.sources import files


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_sink_keeps_names_and_sub_folders(spark, tmp_path):
    rows = [("a/image1.png", b"1"), ("b/image1.png", b"2"), ("../up.txt", b"3"), ("x\\y.txt", b""), ("none", None), (None, b"4"), ("", b"5")]
    df = spark.createDataFrame([(n, c if c is None else bytearray(c)) for n, c in rows], "n string, c binary").repartition(3)
    files.write_folder(df, str(tmp_path / "out"), "n", "c")
    assert tree(tmp_path / "out") == ["a/image1.png", "b/image1.png", "up.txt", "x/y.txt"]
    assert (tmp_path / "out/b/image1.png").read_bytes() == b"2"
    files.write_folder(df.where("n = 'a/image1.png'").withColumn("n", F.lit("new")), f"file://{tmp_path}/out", "n", "c")
    assert len(tree(tmp_path / "out")) == 5 and os.listdir(tmp_path / "out").count("new") == 1
    files.write_folder(df.where("n = 'b/image1.png'"), str(tmp_path / "out"), "n", "c", overwrite=True)
    assert tree(tmp_path / "out") == ["b/image1.png"]
    files.write_folder(df.limit(0), str(tmp_path / "none"), "n", "c")
    assert tree(tmp_path / "none") == []


def test_sink_leaves_nothing_of_a_failed_job(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    (tmp_path / "kept.txt").write_text("old")
    with pytest.raises(Exception, match="broken"):
        files.write_folder(rows, str(tmp_path))
    assert tree(tmp_path) == ["kept.txt"] and os.listdir(tmp_path) == ["kept.txt"]


def archive(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in entries:
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), data, method)
    return out.getvalue()


def test_archives_are_read_by_ranges(spark, tmp_path):
    big = os.urandom(400_000)
    data = archive(("word/document.xml", b"<x/>" * 1000, 8), ("word/media/a.png", big, 0), ("word/media/b.JPG", b"b" * 5000, 8), ("word/media/sub/", b"", 0), ("notes/c.png", b"c", 0))
    for name, content in (("one.docx", data), ("TWO.DOCX", data), ("~$one.docx", b"lock"), ("bad.docx", data[:-30]), ("other.zip", data)):
        (tmp_path / name).write_bytes(content)
    every = files.read_entries(spark, str(tmp_path), prefix="word/media/").collect()
    good = [r for r in every if r.error is None]
    assert sorted((os.path.basename(r.doc_path), r.entry_idx, r.original_name, r.size, r.format) for r in good) == [(n, i, f, s, e) for n in ("TWO.DOCX", "one.docx") for i, f, s, e in ((1, "a.png", 400_000, "png"), (2, "b.JPG", 5000, "jpg"))]
    assert all(bytes(r.content) == (big if r.original_name == "a.png" else b"b" * 5000) for r in good)
    assert [(os.path.basename(r.doc_path), r.content) for r in every if r.error] == [("bad.docx", None)]
    one = files.read_entries(spark, str(tmp_path)).where("path_in_zip = 'word/media/b.JPG' and size > 10")
    rows = one.collect()
    assert len(rows) == 2 and all(r.bytes_read < 3000 < r.doc_size for r in rows)
    assert files.read_entries(spark, f"file://{tmp_path}").where(F.col("format").isin("png") & (F.col("size") >= 2) & F.col("doc_path").endswith("one.docx")).select("original_name").collect() == [("a.png",)]
    listed = files.read_entries(spark, str(tmp_path), content="false").where(F.col("path_in_zip").startswith("word/")).agg(F.sum("bytes_read"), F.count("content"), F.count("*")).first()
    assert listed[0] < 4000 and tuple(listed[1:]) == (0, 6)
    least = files.read_entries(spark, str(tmp_path), least="5000").where("format = 'png'").collect()
    assert sorted((r.original_name, r.content is None) for r in least) == [("a.png", False)] * 2 + [("c.png", True)] * 2
    (tmp_path / "empty").mkdir()
    assert files.read_entries(spark, str(tmp_path / "empty")).count() == 0


def test_rebuild_by_entry(spark):
    data = archive(("s.bin", b"stored" * 10, 0), ("twice", b"first", 8), ("twice", b"second", 8), ("word/media/i.png", b"old", 8), ("word/", b"", 0))
    docs = spark.createDataFrame([("a", bytearray(data)), ("none", bytearray(data)), ("bad", bytearray(b"x")), ("null", None)], "doc_path string, archive binary")
    new = spark.createDataFrame([("a", "word/media/i.png", bytearray(b"new")), ("none", "missing", bytearray(b"new"))], "doc_path string, path_in_zip string, new_content binary")
    got = {r.doc_path: r for r in ar.rebuild_archives(docs, new).collect()}
    assert got["none"].archive is None and got["none"].error is None and got["bad"].error and got["null"].error and got["a"].replaced == 1
    with zipfile.ZipFile(io.BytesIO(bytes(got["a"].archive))) as z:
        found = [(i.filename, z.read(i), i.compress_type, i.date_time) for i in z.infolist()]
    date = (2001, 2, 3, 4, 5, 6)
    assert found == [("s.bin", b"stored" * 10, 0, date), ("twice", b"first", 8, date), ("twice", b"second", 8, date), ("word/media/i.png", b"new", 8, date), ("word/", b"", 0, date)]
    both = ar.rebuild_archive(data, {"twice": b"x"})
    with zipfile.ZipFile(io.BytesIO(both[0])) as z:
        assert both[1] == 2 and [z.read(i) for i in z.infolist()][1:3] == [b"x", b"x"]


def test_rebuild_keeps_what_it_does_not_change(spark, monkeypatch):
    """With keep, untouched and unreadable archives come back as they are, one row for each given; only changed ones are written anew."""
    data, torn = archive(("word/media/i.png", b"old" * 100, 8)), bytearray(archive(("word/media/i.png", b"old" * 100, 8)))
    torn[50] ^= 255
    docs = spark.createDataFrame([("a", bytearray(data)), ("a", bytearray(data)), ("none", bytearray(data)), ("torn", torn), ("bad", bytearray(b"x"))], "doc_path string, archive binary")
    new = spark.createDataFrame([("a", "word/media/i.png", bytearray(b"new")), ("none", "missing", bytearray(b"new"))], "doc_path string, path_in_zip string, new_content binary")
    got = sorted((r.doc_path, bytes(r.archive), r.replaced, r.error is None) for r in ar.rebuild_archives(docs, new, keep=True).collect())
    changed = ar.rebuild_archive(data, {"word/media/i.png": b"new"})[0]
    assert got == [("a", changed, 1, True), ("a", changed, 1, True), ("bad", b"x", 0, False), ("none", data, 0, True), ("torn", bytes(torn), 0, False)]
    monkeypatch.setattr(ar, "rebuild_archive", lambda *_: pytest.fail("written in vain"))
    assert ar.replace_entries(data, {"missing": b"new"}) == ar.replace_entries(data, {}) == (None, 0)


def test_rows_of_many_archives_come_together(monkeypatch):
    rows = [(f"d{i}", b"x" * 10) for i in range(10)]
    together = lambda: [len(t) for t in ar.in_batches(iter(rows), ["name", "content"], 1)]
    assert together() == [10] and [*ar.in_batches([], ["name", "content"], 1)] == []
    monkeypatch.setattr(ar, "BATCH_BYTES", 40)
    assert together() == [4, 4, 2]
    monkeypatch.setattr(ar, "BATCH_ROWS", 3)
    assert together() == [3, 3, 3, 1]


def test_driver_holds_little_of_each_file(spark, tmp_path, monkeypatch):
    """What tasks say to commit doesn't grow with their files, moves aren't queued one by one, listings are packed: few bytes a file."""
    from concurrent.futures import ThreadPoolExecutor

    writer = files.FileWriter(str(tmp_path / "out"), "job", False)
    table = pa.table({"name": [f"doc{i}.docx" for i in range(5000)], "content": pa.array([b"x"] * 5000, pa.binary())})
    messages = [writer.write(iter(table.slice(at, 2500).to_batches())) for at in (0, 2500)] + [writer.write(iter([])), None]
    assert all(len(pickle.dumps(m)) < 300 for m in messages)
    queued = []

    class Pool(ThreadPoolExecutor):
        def submit(self, *args, **more):
            queued.append(args)
            return super().submit(*args, **more)

    monkeypatch.setattr(files, "ThreadPoolExecutor", Pool)
    writer.commit(messages)
    assert len(queued) == 20 and len(os.listdir(tmp_path / "out")) == 5000 and tree(tmp_path / "out")[0] == "doc0.docx"
    parts = files.ArchiveReader({"path": str(tmp_path / "out")}).partitions()
    assert len(parts) == 20 and sum(len(pickle.dumps(p)) for p in parts) < 10 * 5000
    assert sorted(f for p in parts for f in p.files) == sorted((f"doc{i}.docx", 1) for i in range(5000))
    one = files.read_entries(spark, str(tmp_path / "out/doc7.docx")).first()
    assert one.doc_path == str(tmp_path / "out/doc7.docx") and one.error
    assert files.read_entries(spark, str(tmp_path / "missing")).count() == 0


def test_folder_is_read_in_packed_parts(spark, tmp_path):
    """Whole files of all sub-folders, empty and hidden names too, but not what isn't committed; few bytes a file in the driver."""
    made = {"a/1.txt": b"1", "a/_2.txt": b"", "a/b/3 %20.txt": "é".encode(), ".top": b"t", "é/x": b"x" * 3000}
    for name, content in (made | {".attempts-1/u/lost.txt": b"lost"}).items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    for uri in (str(tmp_path / "in"), f"file://{tmp_path}/in/"):
        got = files.read_folder(spark, uri).collect()
        assert {os.path.relpath(r.path, tmp_path / "in"): bytes(r.content) for r in got} == made and all(r.size == len(r.content) for r in got) and len(got) == 5
    assert files.read_folder(spark, str(tmp_path / "missing")).count() == 0
    for i in range(3000):
        (tmp_path / "in/a" / f"{i}.txt").touch()
    parts = files.FolderReader(str(tmp_path / "in")).partitions()
    assert len(parts) == 12 and sum(len(pickle.dumps(p)) for p in parts) < 10 * 3000


def test_committed_folder_reads_without_a_status_of_each_file(spark):
    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    plan = e.queries()["committed_folder"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert files.WHOLE in plan and "binaryFile" not in plan
