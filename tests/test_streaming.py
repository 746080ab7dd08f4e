"""Streaming adapters on a file stream."""

from pyspark.sql import functions as F

from tessera.streaming import sessions, windowed


def test_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 AS k, id AS v FROM range(100)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("w", windowed(stream, "ts", "30 minutes", "1 minute", ["k"], F.sum("v").alias("s"))), ("g", sessions(stream, "ts", "5 minutes", "1 minute", ["k"], F.count("*").alias("s")))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("s")).first()[0] == 4950
    assert spark.table("w").count() == 8
