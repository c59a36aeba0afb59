import datetime as dt
import json

from pyspark.sql import functions as F

from pressmill.sources.sinks import merged
from pressmill.streaming import ingest

AS_OF = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    row = lambda u, t: {"source": "gma", "title": t, "url": u, "content": "A great win for all", "published_at": "2025-01-02T00:00:00Z"}
    drop(landing, "1.json", [row("https://A.com/x/", "one"), row("https://a.com/x", "copy"), row("https://a.com/y", " two "), row("https://a.com/z", "")])
    ingest.start_ingest(spark, str(landing), out, str(tmp_path / "cp"), AS_OF).awaitTermination()
    drop(landing, "2.json", [row("https://a.com/y?ref=1", "again"), row("https://a.com/w", "new")])
    ingest.start_ingest(spark, str(landing), out, str(tmp_path / "cp"), AS_OF).awaitTermination()
    a = spark.read.parquet(out + "/articles")
    assert sorted(r.url for r in a.collect()) == ["https://a.com/w", "https://a.com/x", "https://a.com/y"]
    assert {r.source for r in a.collect()} == {"GMA"}
    b = merged(spark, out + "/analysis")
    assert b.count() == 3 and {r.sentiment_label for r in b.collect()} == {"positive"}
    batch = spark.read.schema(ingest.ARTICLE).json(str(landing))
    ingest.ingest_batch(batch, out, AS_OF)  # a replay changes nothing
    assert spark.read.parquet(out + "/articles").count() == 3 and merged(spark, out + "/analysis").count() == 3


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    src.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "e"))
    q = ingest.tumbling(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.start, r.event_type, r.n) for r in spark.table("tumbled").collect()}
    want = {(r.start, r.event_type, r.n) for r in ingest.tumbling(src, "ts", ["event_type"]).collect()}
    assert got == want and len(got) > 10
    assert all(r[0].hour == 16 for r in got)
    assert ingest.sessions(src, "ts", "user_id").agg(F.sum("n")).first()[0] == src.count()
    d = ingest.deduplicated(stream.withColumnRenamed("event_type", "url"), "url", "ts", "60 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    d.awaitTermination()
    assert spark.table("once").count() == src.select("event_type").distinct().count()
