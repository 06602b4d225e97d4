import json

from pyspark.sql import functions as F

from lakewright.sources import readers, sinks
from lakewright.streaming import live


def test_catalogue_feed(spark, tmp_path):
    rows = [{"slug": "a", "title": "1"}, {"slug": "a", "title": "2"}, {"slug": " ", "title": "3"}, {"slug": "b", "title": "4", "tags": ["x"]}]
    (tmp_path / "f.jsonl").write_text("\n".join([json.dumps(r) for r in rows[:2]] + ["{broken", ""] + [json.dumps(r) for r in rows[2:]]))
    assert {(r.slug, r.title) for r in readers.catalogue_feed(spark, str(tmp_path / "f.jsonl")).collect()} == {("a", "1"), ("b", "4")}


def test_registry(spark):
    specs = readers.registry(spark, [{"slug": "a", "name": "A", "tier": 1, "owner": "x"}, {"slug": "b", "name": "B"}])
    assert specs.where("slug = 'a'").first().extra == {"owner": "x"}
    old = specs.where("slug = 'a'").withColumn("robots_allows", F.lit(True)).drop("extra")
    new, counts = sinks.sync_registry(old, specs)
    assert tuple(counts.first()) == (1, 1) and new.where("slug = 'a'").first().robots_allows


def test_api_pages(spark):
    bodies = spark.createDataFrame([(1, json.dumps({"d": {"results": [{"id": i} for i in range(10)], "total": 12}})), (2, json.dumps({"d": {"results": [{"id": 11}]}})), (3, "broken")], "page int, body string")
    assert [r.is_last for r in readers.api_pages(bodies).orderBy("page").collect()] == [False, True, True]
    assert readers.api_items(bodies, "id int").count() == 11


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "x", ["a", "b"]), ("s", "x", ["c"]), ("t", "y", None)], "source string, text string, tags array<string>")
    sinks.bodies(rows, str(tmp_path / "bodies"))
    assert spark.read.parquet(str(tmp_path / "bodies")).count() == 2
    sinks.csv(rows, str(tmp_path / "csv"), ["source", "tags", "missing"])
    assert {r.tags for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"a | b", "c", None}
    sinks.report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_streams_equal_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.source(spark, str(tmp_path / "in"), events.schema, 1)
    live.drain(stream.withColumn("text", F.col("props")).transform(lambda x: live.first_copies(x, "event_type", "text")), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_type", "props").distinct().count()
    for _ in range(2):  # the second load finds nothing new
        live.load_once(live.source(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "table"), str(tmp_path / f"c{_}x"), ["user_id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == events.select("user_id").distinct().count()
    query = live.hourly(stream, "ts", "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM hours").collect()} == {tuple(r) for r in live.hourly(events, "ts").collect()}


def test_quota_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = live.quota_stream(live.source(spark, str(tmp_path / "in"), events.schema, 1), 5, key="event_type")
    query = stream.writeStream.format("memory").queryName("quota").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.sql("SELECT key, day, max(used) AS used, max(refused) AS refused FROM quota GROUP BY key, day")
    want = events.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.least(F.count("*"), F.lit(5)).alias("used"), F.greatest(F.count("*") - 5, F.lit(0)).alias("refused"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}
