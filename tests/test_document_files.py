import os

import pytest
from pyspark.sql import functions as F

from lexigrid.sources import document_files as D
from lexigrid.sources import readers

ROWS = [("b.tsv", 3, "last"), ("a.tsv", 2, 'tab\there "quoted"\nand a line'), ("a.tsv", 1, None), ("sub/c.tsv", 1, "é"), ("b.tsv", 1, "first"), (None, 9, "no name"), ("", 9, "blank")]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, "filename string, start int, text string").repartition(3)
    D.write_documents(df, path, order=["start"])
    assert sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith(".")) == ["a.tsv", "b.tsv", "sub/c.tsv"]
    back = readers.tsv(spark, [f"{path}/a.tsv", f"{path}/b.tsv", f"{path}/sub/c.tsv"]).withColumn("filename", F.col("_metadata.file_name"))
    assert sorted((r["filename"], r["start"], r["text"]) for r in back.collect()) == sorted((n.split("/")[-1], str(s), t or "") for n, s, t in ROWS if n)
    assert open(f"{path}/b.tsv").read() == "start\ttext\n1\tfirst\n3\tlast\n"
    D.write_documents(df.filter("start = 3"), path)  # overwrites: nothing of before stays
    assert os.listdir(path) == ["b.tsv"]
    D.write_documents(df.filter("start = 2"), path, mode="append")
    assert sorted(os.listdir(path)) == ["a.tsv", "b.tsv"]


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "out")
    D.write_documents(spark.createDataFrame([("x.txt", "one\ntwo"), ("y.txt", None)], "filename string, text string"), path, kind="text")
    assert open(f"{path}/x.txt").read() == "one\ntwo\n" and open(f"{path}/y.txt").read() == "\n"


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("kept.tsv", 1)], "filename string, n int")
    D.write_documents(good, path)
    bad = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("filename"), F.when(F.col("id") == 1999, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="killed"):
        D.write_documents(bad, path)
    assert os.listdir(path) == ["kept.tsv"]


def test_an_attempt_without_a_message_leaves_nothing(tmp_path):
    path = str(tmp_path / "out")
    make = lambda: D.FileWriter({"path": path}, ["filename", "n"], True)
    make().write(iter([("lost", 1)]))  # its executor dies before Spark hears of it
    message = make().write(iter([("lost", 1), ("other", 2)]))
    make().commit([message, None])
    assert sorted(os.listdir(path)) == ["lost", "other"] and open(f"{path}/lost").read() == "n\n1\n"


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a//b", "_temporary/x", "."])
def test_names_stay_below_the_folder(name):
    with pytest.raises(ValueError):
        D.checked_name(name)


def test_tasks_move_and_read_the_files(spark, tmp_path, monkeypatch):
    """The driver neither moves a file nor lists the folder, and small files are not one task's."""
    path = str(tmp_path / "out")
    monkeypatch.setattr(D, "ThreadPoolExecutor", None)
    df = spark.createDataFrame([(f"{'sub/' if i % 2 else ''}f{i}.tsv", n, 'a\r"b"' if n else None) for i in range(40) for n in (1, 0)], "filename string, n int, text string")
    names = D.write_documents(df, path, order=["n"])
    assert names.rdd.getNumPartitions() > 1 and sorted(r[0] for r in names.collect()) == sorted(f"{'sub/' if i % 2 else ''}f{i}.tsv" for i in range(40))
    assert sorted(os.listdir(path)) == sorted([f"f{i}.tsv" for i in range(0, 40, 2)] + ["sub"])
    lines = D.document_lines(names, path)
    assert "FileScan" not in lines._jdf.queryExecution().sparkPlan().toString()
    got = sorted(tuple(r) for r in lines.collect())
    assert len(got) == 120 and got[:3] == [("f0.tsv", 0, "n\ttext"), ("f0.tsv", 1, "0\t"), ("f0.tsv", 2, '1\t"a\r""b"""')]


def test_a_move_that_runs_again_finds_what_was_moved(tmp_path):
    path = str(tmp_path / "out")
    store, _ = D.file_system(path)
    message = D.FileWriter({"path": path}, ["filename", "n"], True).write(iter([("a", 1), ("b", 2), ("c/d", 3)]))
    first = D.moved(store, path, message.folder)
    assert next(first) == "a"  # the task is lost here
    first.close()
    assert list(D.moved(store, path, message.folder)) == ["a", "b", "c/d"]
    os.remove(f"{path}/b")
    with pytest.raises(OSError):
        list(D.moved(store, path, message.folder))
