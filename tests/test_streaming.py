from pyspark.sql import functions as F

from lensframe.operators import zset
from lensframe.streaming import live


def test_appended_files_only(spark, tmp_path):
    seen = []
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "k": "x"}\n{"id": 2, "k": "y"}\n')
    schema = spark.read.json(str(src)).schema
    grown = live.GrowingTable(spark, str(tmp_path / "t"))
    grown.watch(lambda d, n: seen.append((n, zset.size(d))))
    grown.run(live.follow(spark, str(src), schema)).awaitTermination()
    (src / "b.json").write_text('{"id": 3, "k": "x"}\n')
    grown.run(live.follow(spark, str(src), schema)).awaitTermination()
    assert [n for _, n in seen] == [2, 1] and grown.rows().count() == 3
    assert live.trigger("interval 30") == {"processingTime": "30 seconds"} and live.trigger("snapshot") == {"availableNow": True} and live.trigger("odd") == {"processingTime": "0 seconds"}


def test_windows_with_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("g")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, g bigint").parquet(src)
    out = live.windowed_counts(stream, "ts", "g", "10 minutes", "5 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("win").collect()) == 20
