from pyspark.sql import functions as F

from lakewright import api
from lakewright.plans import base


def tables(spark, d):
    return api.Tables(base.catalogue(spark, d), base.records(spark, d), base.queue(spark, d), base.archive(spark, d))


def test_routes(spark, small):
    t = tables(spark, small)
    assert api.home(t)["stats"].first().schemes == t.catalogue.count()
    found = api.browse(t, q=" tion ", category="long", page=99)
    assert found["pages"].first().total <= found["cleared"].first().n
    assert found["items"].count() > 0 and found["states"].count() > 0
    assert api.scheme(t, "d4")["detail"].count() == 1 and api.scheme(t, "none")["related"] is None
    assert '"items"' in api.listing_json(t, state="Central").first().body
    assert api.status(t, F.lit(base.AS_OF).cast("timestamp")).first().total == t.queue.count()


def test_ask(spark, small):
    t = tables(spark, small)
    v = spark.read.parquet(f"{small}/embeddings.parquet").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("slug"), "embedding")
    assert api.ask(t, "which thing is that", [1.0] * 64, v, v.limit(50)).count() == 6
    assert api.ask(t, "  ", [1.0] * 64, v, v).count() == 0


def test_embed_and_shortlist(spark):
    class Lengths:
        def encode(self, texts):
            return [[float(len(x))] for x in texts]

    rows = spark.createDataFrame([("a", "T", "D", ["x"], None), ("b", "", None, None, None), ("c", "T", None, None, [9.0])], "slug string, title string, description string, tags array<string>, embedding array<float>")
    assert [(r.slug, r.embedding) for r in api.embed(rows, Lengths).collect()] == [("a", [9.0])]
    entries = spark.createDataFrame([("List of blood banks", ["District"]), ("Monthly list of banks", ["State"]), ("List of x", ["rank"])], "title string, fields array<string>")
    assert [(r.title, r.theme) for r in api.shortlist(entries).collect()] == [("List of blood banks", "health")]


def test_loads(spark):
    c = spark.createDataFrame([("a", "old", [1.0])], "slug string, title string, embedding array<float>")
    feed = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "y")], "slug string, title string").coalesce(1)
    assert {(r.slug, r.title, bool(r.embedding)) for r in api.load_catalogue(c, feed).collect()} == {("a", "new", True), ("b", "y", False)}
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    pages = spark.createDataFrame([("a", "T", "Goa\nT")], "slug string, title string, text string")
    said = spark.createDataFrame([("a", "Assam"), ("b", "Orissa"), ("c", "?")], "slug string, state string")
    assert {tuple(r) for r in api.backfill_states(cat, pages, said).collect()} == {("a", "Goa", "page"), ("b", "Odisha", "extraction"), ("c", None, None)}
