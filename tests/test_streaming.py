"""Streams into a table, and windows."""

from recordspark.plans.model import Config
from recordspark.sources.table import RecordTable
from recordspark.streaming.ingest import ingest, windows


def test_ingest_once(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "key string, ts long, value binary, n long"
    spark.createDataFrame([("a", 1, bytearray(b"1"), 1), ("a", 1, bytearray(b"2"), 2), ("b", 1, bytearray(b"x"), 1)], schema).write.parquet(source)
    table = RecordTable(spark, str(tmp_path / "t"), Config(), clock=lambda: 0)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest(stream(), table, str(tmp_path / "c"), ["n"]).awaitTermination()
    assert bytes(table.get("a", 1)["value"]) == b"2" and table.manifest.current().number == 1
    spark.createDataFrame([("a", 1, bytearray(b"3"), 3)], schema).write.mode("append").parquet(source)
    ingest(stream(), table, str(tmp_path / "c"), ["n"]).awaitTermination()
    assert bytes(table.get("a", 1)["value"]) == b"3" and table.manifest.current().number == 2
    ingest(stream(), table, str(tmp_path / "c2"), ["n"]).awaitTermination()  # batch 0 again: skipped
    assert table.manifest.current().number == 2


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", s * 1_000_000) for s in (1, 2, 61, 125)], "key string, ts long").write.parquet(source)
    out = windows(spark.readStream.schema("key string, ts long").parquet(source), "1 minute", "10 seconds")
    q = out.writeStream.outputMode("complete").format("memory").queryName("by_minute").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("by_minute").collect()) == [1, 1, 2]
