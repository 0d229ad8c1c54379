"""The streamed error table equals the batch one."""

from pyspark.sql import functions as F

from residuum.streaming.errors import windowed_errors


def test_streamed_errors_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).select("at", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    table = lambda df: windowed_errors(df, "at", F.col("value"), F.lit(50.0), ["event_type"], "1 day", "90 days")
    query = table(stream).writeStream.format("memory").queryName("errors").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.rmse, 9)) for r in df.collect())
    assert key(spark.table("errors")) == key(table(events))
