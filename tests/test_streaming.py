from pyspark.sql import functions as F

from lexigrid.plans import pipelines
from lexigrid.streaming import text


def test_stream_equals_batch(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("filename"), "text")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = text.run_to_table(text.document_stats(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), pipelines.document_stats(source)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_windows_and_first_rows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("w", text.counts_by_window(stream, "ts", "event_type")), ("f", text.first_seen(stream, "ts", ["event_id"]))):
        text.run_to_table(df, str(tmp_path / name), str(tmp_path / f"{name}-check")).awaitTermination(120)
    assert 0 < spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] <= events.count()
    assert spark.read.parquet(str(tmp_path / "f")).count() == events.select("event_id").distinct().count()
