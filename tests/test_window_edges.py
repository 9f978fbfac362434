"""The first second of a running window is in it, also for rows that come late, and the second before is not."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.streaming import live
from logloom.sources.tables import put

END = datetime(2024, 1, 2, 0, 0, 0)
SCHEMA = "key_type string, key string, event_id string, at timestamp, tactics array<string>, score int, detections int"


def test_edges(spark, tmp_path):
    folder, start = str(tmp_path), END - timedelta(minutes=30)
    two = ["Discovery", "Impact"]
    parts = [
        [("IP", "end", "e", END, two, 1, 1), ("IP", "before", "b", start - timedelta(seconds=1), two, 1, 1), ("IP", "inside", "i", start, two, 1, 1)],
        [("IP", "late", "l", start, two, 1, 1), ("IP", "too late", "t", start - timedelta(seconds=1), two, 1, 1)],
    ]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={n}")
        found = live.running_incidents(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/part=*"), 30, event_time=True)
        writer = found.writeStream.foreachBatch(lambda part, b: put(part, f"{folder}/out/batch={b}")).outputMode("update")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = live.latest_incidents(spark.read.parquet(f"{folder}/out"))
    assert {r.correlation_key for r in kept.collect()} == {"end", "inside", "late"}
    assert kept.select(F.max("last_seen_at")).first()[0] == END
