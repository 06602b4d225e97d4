"""Scans of feeds and captured responses, and what sinks leave: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import parsed_time
from ..operators.filters import audit_listing as active_sources
from ..shared import new_path
from ..sources import readers, sinks
from .base import AS_OF, Registry, table

register = Registry()


def _text(k):
    return F.col(k).cast("string")


@register("jsonl_rows", "SELECT 's' || (p_partkey % 700) AS slug, arg_min(p_name, p_partkey) AS title, arg_min(['t' || p_size, p_brand], p_partkey)::VARCHAR AS tags FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def jsonl_rows(spark, d):
    """A feed with broken and blank lines and repeated slugs: the first row of each slug."""
    part = table(spark, d, "part").where("p_partkey % 5 <> 0")
    row = F.to_json(F.struct(F.concat(F.lit("s"), (F.col("p_partkey") % 700).cast("string")).alias("slug"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("t"), _text("p_size")), "p_brand").alias("tags")))
    lines = F.array(row, F.when(F.col("p_partkey") % 3 == 0, "{broken").otherwise(""), F.lit('{"slug": " ", "title": "none"}'))
    path = new_path(spark, "feed")
    # One sorted file: which row of a slug is first must be known.
    part.coalesce(1).sortWithinPartitions("p_partkey").select(F.explode(lines).alias("value")).write.text(path)
    return readers.catalogue_feed(spark, path).select("slug", "title", F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")).alias("tags"))


@register("newest_captures", "SELECT 'u' || user_id AS slug, arg_max(event_id, ts)::VARCHAR AS text FROM events WHERE event_type <> 'error' GROUP BY 1")
def newest_captures(spark, d):
    """Captures as a feed: the newest good one of each page."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), _text("user_id")).alias("slug"), (F.col("event_type") != "error").alias("ok"), stamp.alias("fetched_at"), _text("event_id").alias("text"))
    path = new_path(spark, "captures")
    rows.repartition(4).write.json(path)
    return readers.page_captures(spark, path).select("slug", "text")


@register("long_captures", "SELECT url, substring(text, 1, 40) AS head, sha256(text) AS content_hash FROM (SELECT 'https://x/' || (doc_id % 300) AS url, text, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS n FROM documents WHERE length(text) >= 200) WHERE n = 1")
def long_captures(spark, d):
    """Documents as one feed in the order of their ids, in files that follow each other by name: of each url the first that is long enough."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("https://x/"), (F.col("doc_id") % 300).cast("string")).alias("url"), "text", "doc_id")
    path = new_path(spark, "static")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(path)
    return readers.static_captures(spark, path).select("url", F.substring("text", 1, 40).alias("head"), "content_hash")


_NUMBERED = "(SELECT c_nationkey AS scan, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)"


@register("api_items", f"SELECT scan, id FROM {_NUMBERED} WHERE scan % 5 <> 0 OR n <= 10")
def api_items(spark, d):
    """Captured pages of ten: a scan ends at the first short page, or when the total that it was told is reached."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("scan"), F.col("c_custkey").alias("id"), F.ceil(n / 10).cast("int").alias("page"))
    total = F.when(F.col("scan") % 5 == 0, F.lit(10)).otherwise(F.lit(1_000_000))
    items = F.sort_array(F.collect_list(F.struct("id")))
    bodies = rows.groupBy("scan", "page").agg(items.alias("results")).select("scan", "page", F.to_json(F.struct(F.struct("results", total.alias("total")).alias("data"))).alias("body"))
    late = rows.select("scan").distinct().select("scan", F.lit(100_000).alias("page"), F.lit('{"data": {"results": [{"id": -1}]}}').alias("body"))
    scanned = readers.api_scan(bodies.unionByName(late))
    return readers.api_items(scanned.select("scan", "body"), "id bigint").where("id >= 0").select("scan", "id")


@register("api_totals", "SELECT c_nationkey AS scan, count(*) AS total, least(count(*), 10) AS items, count(*) < 10 AS is_last FROM customer GROUP BY 1")
def api_totals(spark, d):
    """Where the first page says how many there are, however deep it says so."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scan")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("c_custkey")), 1, 10).alias("ids"))
    deep = F.struct(F.lit("x").alias("head"), F.struct(F.struct(F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("results")).alias("inner"), F.col("n").alias("totalCount")).alias("data"))
    pages = readers.api_pages(rows.select("scan", F.to_json(deep).alias("body")))
    return pages.select("scan", "total", F.size("items").cast("long").alias("items"), "is_last")


@register("embedded_items", "SELECT page_id, k::VARCHAR AS id, 'a&b' || k AS t FROM (SELECT page_id, unnest([page_id, page_id + 1]) AS k FROM pages)")
def embedded_items(spark, d):
    """Objects that a page embeds in a script, escaped as such pages have them."""
    one = lambda k: F.concat(F.lit('{\\"id\\":\\"'), k.cast("string"), F.lit('\\",\\"t\\":\\"a\\u0026b'), k.cast("string"), F.lit('\\"}'))
    k = F.col("page_id")
    html = F.concat(F.lit('<script>x({\\"subs\\":{\\"results\\":['), one(k), F.lit(","), one(k + 1), F.lit("]}})</script>"), "html")
    return readers.embedded(table(spark, d, "pages").select("page_id", html.alias("html")), "subs", "id string, t string")


@register("resume_offsets", "SELECT (count(DISTINCT o_custkey) // 100) * 100 AS \"offset\" FROM orders")
def resume_offsets(spark, d):
    return readers.resume_offset(table(spark, d, "orders"), "o_custkey", 100).select(F.col("offset").cast("long").alias("offset"))


_SPECS = [{"slug": f"s{i}", "name": f"Source {i}", "tier": i % 3, "adapter": "static", "owner": f"team {i % 2}", "rank": i} for i in range(12)]


@register("registry_rows", "SELECT 's' || i AS slug, (i % 3)::INT AS tier, 'team ' || (i % 2) AS owner, i::VARCHAR AS rank, NULL::BOOLEAN AS robots_allows FROM range(12) t(i)")
def registry_rows(spark, d):
    """Specifications with keys of their own, which go to `extra`."""
    return readers.registry(spark, _SPECS).select("slug", "tier", F.col("extra")["owner"].alias("owner"), F.col("extra")["rank"].alias("rank"), "robots_allows")


@register("registry_sync", "SELECT 's' || i AS slug, 'Source ' || i AS name, CASE WHEN i < 8 THEN i % 2 = 0 END AS robots_allows, 4 AS created, 8 AS updated FROM range(12) t(i)")
def registry_sync(spark, d):
    """Eight sources are known and audited: new names are taken, what the audit found stays."""
    specs = readers.registry(spark, _SPECS).drop("extra")
    number = F.substring("slug", 2, 9).cast("int")
    old = specs.where(number < 8).withColumn("robots_allows", number % 2 == 0).withColumn("name", F.lit("old"))
    new, counts = sinks.sync_registry(old, specs)
    return new.join(counts).select("slug", "name", "robots_allows", F.col("created").cast("int").alias("created"), F.col("updated").cast("int").alias("updated"))


@register("audit_listing", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey % 4, s_name, s_suppkey) - 1 AS position FROM supplier WHERE s_suppkey % 3 <> 0")
def audit_listing(spark, d):
    """Active sources as an audit lists them: by tier, then slug."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("tier"), F.col("s_name").alias("slug"), (F.col("s_suppkey") % 3 != 0).alias("active"))
    order = Window.orderBy("tier", "slug", "s_suppkey")  # a registry's few rows
    return active_sources(rows).select("s_suppkey", (F.row_number().over(order) - 1).alias("position"))


@register("bodies_written", "SELECT source, substring(sha256(text), 1, 2) AS prefix, count(DISTINCT text) AS n FROM documents GROUP BY 1, 2")
def bodies_written(spark, d):
    """Texts by source and hash, each once, read back from where they were put."""
    path = new_path(spark, "bodies")
    sinks.bodies(table(spark, d, "documents"), path)
    kept = spark.read.schema("content_hash string, body string, source string, prefix string").parquet(path)
    return kept.where(F.sha2("body", 256).eqNullSafe(F.col("content_hash"))).groupBy("source", "prefix").agg(F.count("body").alias("n"))


@register("flat_files", "SELECT p_partkey::VARCHAR AS id, p_brand || ' | ' || p_size AS tags, NULL::VARCHAR AS missing FROM part")
def flat_files(spark, d):
    """The columns wanted as CSV: lists joined, columns that rows lack empty."""
    path = new_path(spark, "csv")
    rows = table(spark, d, "part").select(_text("p_partkey").alias("id"), F.array("p_brand", _text("p_size")).alias("tags"), "p_name")
    sinks.csv(rows, path, ["id", "tags", "missing"])
    return spark.read.schema("id string, tags string, missing string").option("header", True).csv(path)


@register("report_rows", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def report_rows(spark, d):
    path = new_path(spark, "report")
    sinks.report(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("status string, n bigint").json(path)


@register("event_lines", """SELECT '{"conv":' || conv_id || ',"n":' || count(*) || '}' || chr(10) AS line FROM conversations GROUP BY conv_id""")
def event_lines(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return sinks.ndjson(rows.select(F.to_json(F.struct(F.col("conv_id").alias("conv"), "n")).alias("event")))


@register("json_fields", """SELECT event_id, (props->>'$.k')::INT + 1 AS k, '{"key":' || ((props->>'$.k')::INT + 1) || ',"type":"' || event_type || '"}' AS dumped FROM events""")
def json_fields(spark, d):
    """JSON read with a schema, its keys renamed, and written again."""
    k = F.from_json("props", "k int")["k"] + 1
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("key"), F.col("event_type").alias("type"))).alias("dumped"))


@register("fetch_stamps", f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN TIMESTAMP '{AS_OF}' ELSE make_timestamp((1700000000 + page_id * 61) * 1000000) END AS fetched_at FROM pages")
def fetch_stamps(spark, d):
    """Stamps of captures, the time of the load where one is missing."""
    stamp = F.when(F.col("page_id") % 4 != 0, F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "pages").select("page_id", parsed_time(stamp, F.lit(AS_OF).cast("timestamp")).alias("fetched_at"))


def queries():
    return register.queries


def oracle_sql():
    return register.sql
