"""Loads, dedup, the work queue, quotas and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalars
from ..functions.records import snippet
from ..operators import conversation as conv, dedup, facets, filters, queue as q
from ..operators.audit import EVIDENCE, audit_pages
from ..shared import spread
from .records import SNIPPET
from .base import AS_OF, ARCHIVE, CATALOGUE, QUEUE, RECORDS, Registry, archive, catalogue, queue, records, table

register = Registry()
NOW = f"TIMESTAMP '{AS_OF}'"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@register("extraction_progress", f"""WITH {QUEUE} SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'parked') AS parked, count(*) AS total,
  count(*) FILTER (completed_at > {NOW} - INTERVAL 1 HOUR) AS completed_last_hour, max(completed_at) AS last_completed_at,
  round_even(100.0::DOUBLE * count(*) FILTER (status = 'done') / greatest(count(*), 1), 1) AS pct, count(*) FILTER (completed_at > {NOW} - INTERVAL 1 HOUR) > 0 AS running FROM queue""")  # fmt: skip
def extraction_progress(spark, d):
    return facets.progress(queue(spark, d), _as_of())


@register("status_counts", f"WITH {QUEUE} SELECT status, count(*) AS n FROM queue GROUP BY status")
def status_counts(spark, d):
    return queue(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


@register("queue_claim", f"""WITH {QUEUE}, next AS (SELECT id FROM queue WHERE status = 'pending' ORDER BY tier, id LIMIT 25)
SELECT id, CASE WHEN id IN (FROM next) THEN 'in_flight' ELSE status END AS status, attempts + (id IN (FROM next))::INT AS attempts FROM queue""")  # fmt: skip
def queue_claim(spark, d):
    return q.claim(queue(spark, d), 25, _as_of()).select("id", "status", "attempts")


@register("queue_release", f"""WITH {QUEUE} SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 5 = 1 THEN 'parked' ELSE status END AS status,
  CASE WHEN id % 5 = 0 THEN {NOW} ELSE completed_at END AS completed_at, CASE WHEN id % 5 = 1 THEN 'broken ' || id END AS last_error, CASE WHEN id % 5 = 0 THEN 'm' END AS model_used FROM queue""")  # fmt: skip
def queue_release(spark, d):
    k = F.col("id")
    results = queue(spark, d).where(k % 5 < 2).select("id", F.when(k % 5 == 0, "done").otherwise("parked").alias("new_status"), F.when(k % 5 == 1, F.concat(F.lit("broken "), k.cast("string"))).alias("error"), F.when(k % 5 == 0, "m").alias("model"))
    return q.release(queue(spark, d), results, _as_of()).select("id", "status", "completed_at", "last_error", "model_used")


@register("queue_reclaim", f"WITH {QUEUE} SELECT CASE WHEN status = 'in_flight' THEN 'pending' ELSE status END AS status, count(*) AS n FROM queue GROUP BY 1")
def queue_reclaim(spark, d):
    return q.reclaim(queue(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("queue_outcomes", f"""WITH {QUEUE} SELECT id, CASE WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'pending' WHEN id % 4 = 2 THEN 'parked' WHEN attempts >= 2 THEN 'parked' ELSE 'pending' END AS status FROM queue""")
def queue_outcomes(spark, d):
    k = F.col("id") % 4
    outcome = F.when(k == 0, "ok").when(k == 1, "quota").when(k == 2, "unreadable").otherwise("invalid")
    return queue(spark, d).select("id", q.outcome_status(outcome, F.col("attempts")).alias("status"))


@register("queue_enqueue", f"""WITH {CATALOGUE}, {ARCHIVE}, {QUEUE}
SELECT a.id AS raw_document_id, CASE WHEN c.ministry IS NOT NULL THEN 0 ELSE 5 END AS tier, 'pending' AS status FROM archive a LEFT JOIN catalogue c ON c.slug = a.slug WHERE a.id NOT IN (SELECT id FROM queue WHERE id % 4 <> 0)""")  # fmt: skip
def queue_enqueue(spark, d):
    """Every fourth document has no task yet."""
    return q.enqueue(queue(spark, d).where("id % 4 <> 0"), archive(spark, d), catalogue(spark, d), 5, _as_of()).select("raw_document_id", "tier", "status")


@register("daily_quota", "SELECT ts::DATE::VARCHAR AS day, count(*) AS requests, least(count(*), 300) AS used, greatest(count(*) - 300, 0) AS refused, greatest(300 - count(*), 0) AS remaining FROM events GROUP BY 1")
def daily_quota(spark, d):
    return q.quota_summary(table(spark, d, "events"), 300).withColumn("day", F.col("day").cast("string"))


@register("quota_running", "SELECT event_id, count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 2 AS allowed FROM events")
def quota_running(spark, d):
    return q.quota_use(table(spark, d, "events"), 2, key="user_id").select("event_id", "used", "allowed")


@register("quota_refunds", "SELECT ts::DATE::VARCHAR AS day, greatest(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END), 0)::BIGINT AS used, greatest(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END), 0) > 180 AS over FROM events GROUP BY 1")
def quota_refunds(spark, d):
    return q.net_use(table(spark, d, "events").withColumn("amount", F.when(F.col("event_type") == "error", -1).otherwise(1)), 180).withColumn("day", F.col("day").cast("string"))


@register("token_bucket", """WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS arr, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
l AS (SELECT event_id, arr, i, max(arr - i * 3600.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) AS lead FROM e)
SELECT event_id, round(greatest(lead + (i - 0) * 3600.0::DOUBLE - arr, 0.0), 3) AS waited FROM l""")  # fmt: skip
def token_bucket(spark, d):
    """One token an hour and no burst, so that the sparse log shows waits."""
    return q.bucket_waits(table(spark, d, "events"), 1 / 60, key="event_type", burst=1).select("event_id", "waited")


@register("liveness_hours", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def liveness_hours(spark, d):
    from ..streaming.live import hourly

    return hourly(table(spark, d, "events").where("event_type = 'purchase'"), "ts")


@register("seconds_to_midnight", "SELECT event_id, 86400 - epoch(date_trunc('second', ts))::BIGINT % 86400 AS seconds FROM events")
def seconds_to_midnight(spark, d):
    return table(spark, d, "events").select("event_id", scalars.seconds_to_midnight("ts").alias("seconds"))


@register("parsed_times", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {NOW} ELSE date_trunc('second', ts) END AS t FROM events")
def parsed_times(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "events").select("event_id", scalars.parsed_time(raw, _as_of()).alias("t"))


@register("newest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def newest_per_key(spark, d):
    rows = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error").withColumn("fetched_at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return dedup.newest_ok(rows, "user_id", "fetched_at", "event_id").select("user_id", "event_id", "event_type")


@register("newest_by_aggregate", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def newest_by_aggregate(spark, d):
    return dedup.newest_by_aggregate(table(spark, d, "events"), "user_id", "ts", "event_id", "event_id", "event_type")


@register("first_by_url", "SELECT host, page_id FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) ORDER BY md5(url || '/9'), page_id) AS n FROM pages) WHERE n = 1")
def first_by_url(spark, d):
    """One page a host, in a seeded order."""
    from ..functions.text import host

    rows = table(spark, d, "pages").select(host("url").alias("host"), "page_id", F.md5(F.concat("url", F.lit("/9")).cast("binary")).alias("h"))
    return dedup.first_by(rows, ["host"], "h", "page_id").select("host", "page_id")


@register("long_pages", "SELECT doc_id FROM documents WHERE length(text) >= 200")
def long_pages(spark, d):
    return dedup.long_enough(table(spark, d, "documents")).select("doc_id")


@register("insert_ignore", f"WITH {ARCHIVE} SELECT content_hash, min(url) AS url FROM archive WHERE content_hash NOT IN (SELECT content_hash FROM archive WHERE id % 2 = 0) GROUP BY content_hash")
def insert_ignore(spark, d):
    a = archive(spark, d).select("url", "content_hash", "id")
    return dedup.insert_ignore(a.where("id % 2 = 0"), a, ["content_hash"]).select("content_hash", "url")


@register("upsert_last", """SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(o.size, n.size) AS size
FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0) o
FULL JOIN (SELECT k, name, size FROM (SELECT p_partkey // 2 AS k, 'new ' || p_name AS name, p_size + 100 AS size, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1) n ON o.k = n.k""")  # fmt: skip
def upsert_last(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = part.select(F.floor(F.col("p_partkey") / 2).alias("k"), F.concat(F.lit("new "), "p_name").alias("name"), (F.col("p_size") + 100).alias("size"), F.col("p_partkey").alias("position"))
    return dedup.upsert(old, new, ["k"], "position", keep=["size"])


@register("merged_sources", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY o_custkey")
def merged_sources(spark, d):
    rows = table(spark, d, "orders").withColumn("first_order", F.col("o_orderkey"))
    return dedup.merge_sources(rows, "o_custkey", "o_orderpriority", "o_orderkey", "first_order")


@register("sweep_gains", "WITH f AS (SELECT c, min(s) AS s FROM (SELECT o_custkey AS c, year(o_orderdate) AS s FROM orders) GROUP BY c) SELECT y.s AS sweep, count(f.c) AS new_keys FROM (SELECT DISTINCT year(o_orderdate) AS s FROM orders) y LEFT JOIN f ON f.s = y.s GROUP BY y.s")
def sweep_gains(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("sweep"))
    return dedup.sweep_gains(rows, ["c"])


@register("canonical_states", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Tamil Nadu' WHEN 1 THEN 'Puducherry' WHEN 2 THEN 'Jammu and Kashmir' WHEN 3 THEN 'Odisha' END AS canonical_state FROM nation")
def canonical_states(spark, d):
    raw = F.get(F.array(*[F.lit(x) for x in ("Tamil Nadu", " PONDICHERRY.", "Jammu & Kashmir", "orissa", "Nowhere")]), F.col("n_nationkey") % 5)
    return dedup.canonical_states(table(spark, d, "nation").withColumn("raw", raw), "raw").select("n_nationkey", "canonical_state")


@register("states_from_pages", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Goa' WHEN 1 THEN 'Assam' WHEN 2 THEN 'Central' END AS state FROM part")
def states_from_pages(spark, d):
    forms = F.array(F.concat(F.lit("top\nGoa\n"), "p_name", F.lit("\nmore")), F.concat(F.lit(" "), "p_name", F.lit("\n\nASSAM\nrest")), F.concat("p_name", F.lit("\nnone\nBihar")), F.lit("other\nBihar"))
    pages = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.get(forms, (F.col("p_partkey") % 4).cast("int")).alias("text"))
    return dedup.state_from_page(pages, "p_partkey")


@register("preferred_states", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'page' || c_custkey WHEN c_custkey % 3 = 0 THEN 'ext' || c_custkey END AS state, CASE WHEN c_custkey % 2 = 0 THEN 'page' WHEN c_custkey % 3 = 0 THEN 'extraction' END AS came_from FROM customer")
def preferred_states(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    side = lambda n, k: c.where(F.col("c_custkey") % k == 0).select("c_custkey", F.concat(F.lit(n), F.col("c_custkey").cast("string")).alias("state"))
    return dedup.prefer(side("page", 2), side("ext", 3), c, "c_custkey", "state")


@register("resumable_targets", "SELECT url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 4 NOT IN (0, 1))")
def resumable_targets(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id") % 4
    done = pages.withColumn("status", F.when(k == 0, "http_error").when(k == 1, "unreachable").otherwise("ok"))
    return filters.resumable(pages, done, "page_id", ~F.col("status").isin(filters.RETRYABLE)).select("url")


@register("fetch_targets", "SELECT url, min(page_id) AS page_id FROM (SELECT trim(CASE WHEN page_id % 3 = 0 THEN url ELSE ['', ' '][(page_id % 2 + 1)::INT] || 'https://x.example/' || (page_id % 10) || ['.PDF', '.html', '.pdf?v=1', '.pdf#p2 '][(page_id % 4 + 1)::INT] END) AS url, page_id FROM pages) WHERE url LIKE 'http%' AND NOT lower(url) LIKE '%.pdf' GROUP BY url")
def fetch_targets(spark, d):
    """Urls with blanks around them, and with something behind .pdf, which are no documents by their name."""
    k = F.col("page_id")
    ends = F.get(F.array(*[F.lit(x) for x in (".PDF", ".html", ".pdf?v=1", ".pdf#p2 ")]), (k % 4).cast("int"))
    url = F.when(k % 3 == 0, F.col("url")).otherwise(F.concat(F.when(k % 2 == 0, "").otherwise(" "), F.lit("https://x.example/"), (k % 10).cast("string"), ends))
    return filters.fetch_targets(table(spark, d, "pages").select(url.alias("url"), "page_id"), order="page_id", only_html=True)


@register("settled_counts", "SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS captured, count(DISTINCT CASE WHEN event_type IN ('view', 'error') THEN user_id END) AS settled FROM events")
def settled_counts(spark, d):
    return dedup.settled_counts(table(spark, d, "events"), "user_id", F.col("event_type") == "view", F.col("event_type").isin("view", "error"))


@register("clean_history", """SELECT conv_id, turn, role, content FROM (SELECT conv_id, turn, role, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 700) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n <= 6 AND role IN ('user', 'assistant') AND content <> ''""")  # fmt: skip
def clean_history(spark, d):
    return filters.clean_history(table(spark, d, "conversations"))


@register("merge_context", """WITH u AS (SELECT conv_id, 'd' || (turn % 4) AS slug, 0 AS f, turn AS p FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'd' || (turn % 5), 1, turn FROM conversations WHERE role <> 'user'),
b AS (SELECT conv_id, slug, min(f * 1000 + p) AS first FROM u GROUP BY conv_id, slug)
SELECT conv_id, slug, rank FROM (SELECT conv_id, slug, row_number() OVER (PARTITION BY conv_id ORDER BY first, slug) AS rank FROM b) WHERE rank <= 6""")  # fmt: skip
def merge_context(spark, d):
    c = table(spark, d, "conversations")
    fresh = c.where("role = 'user'").select("conv_id", F.concat(F.lit("d"), (F.col("turn") % 4).cast("string")).alias("slug"), F.col("turn").alias("position"))
    carried = c.where("role <> 'user'").select("conv_id", F.concat(F.lit("d"), (F.col("turn") % 5).cast("string")).alias("slug"), F.col("turn").alias("position"))
    return dedup.merge_context(fresh, carried)


@register("context_blocks", "SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_blocks(spark, d):
    return conv.context_block(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("text").alias("snippet")))


@register("prompt_messages", """WITH h AS (SELECT conv_id, turn, role, content FROM (SELECT conv_id, turn, role, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 700) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role IN ('user', 'assistant') AND content <> '')
SELECT c.conv_id, 2 + count(h.turn) AS n, 'SCHEME RECORDS:' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) || 'QUESTION: q' || c.conv_id AS last FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id = c.conv_id GROUP BY c.conv_id""")  # fmt: skip
def prompt_messages(spark, d):
    c = table(spark, d, "conversations")
    asked = c.select("conv_id").distinct().select("conv_id", F.lit("ctx").alias("context"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"))
    m = conv.messages(filters.clean_history(c), asked, "Answer only from the records.")
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["content"].alias("last"))


@register("event_rows", """SELECT conv_id, 3 + ((length(t) + 4) // 5 + 2) // 3 AS events FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def event_rows(spark, d):
    """Whole conversations as deltas of five characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    deltas = F.regexp_extract_all(F.array_join(ordered, ""), F.lit("(?s)(.{1,5})"), 1)
    said = table(spark, d, "conversations").groupBy("conv_id").agg(deltas.alias("deltas"))
    rows = conv.events(said.withColumn("error", F.lit(None).cast("string")).withColumn("citations", F.array(F.lit("d1"))))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"))


@register("event_log", """WITH said AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
cut AS (SELECT conv_id, unnest(range(0, (length(t) + 14) // 15)) AS k, t FROM said)
SELECT conv_id, seq, event FROM (
  SELECT conv_id, 0 AS seq, '{"type":"status","data":"searching"}' AS event FROM said UNION ALL SELECT conv_id, 1, '{"type":"status","data":"answering"}' FROM said
  UNION ALL SELECT conv_id, 2 + k, '{"type":"token","data":' || to_json(substring(t, k * 15 + 1, 15)) || '}' FROM cut
  UNION ALL SELECT conv_id, 2 + (length(t) + 14) // 15, CASE WHEN conv_id % 3 = 0 THEN '{"type":"error","data":"lost"}' ELSE '{"type":"citations","data":"[\\"d' || conv_id || '\\"]"}' END FROM said)""")  # fmt: skip
def event_log(spark, d):
    """Whole conversations as deltas of five characters: the events, their texts and their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    deltas = F.regexp_extract_all(F.array_join(ordered, ""), F.lit("(?s)(.{1,5})"), 1)
    said = table(spark, d, "conversations").groupBy("conv_id").agg(deltas.alias("deltas"))
    return conv.events(said.withColumn("error", F.when(F.col("conv_id") % 3 == 0, "lost")).withColumn("citations", F.array(F.concat(F.lit("d"), F.col("conv_id").cast("string")))))


@register("citations", "SELECT conv_id, '[' || string_agg('{\"slug\":\"d' || turn || '\",\"title\":\"' || role || '\"}', ',' ORDER BY turn) || ']' AS citations FROM conversations GROUP BY conv_id")
def citations(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), F.concat(F.lit("d"), F.col("turn").cast("string")).alias("slug"), F.col("role").alias("title"))
    return conv.citations(rows).select("conv_id", F.to_json("citations").alias("citations"))


_CHAINS = [["a ok"], ["a invalid", "a ok"], ["a invalid", "a invalid", "b ok"], ["a truncated", "a ok"], ["a rate_limited", "a failed", "b ok"], ["a failed", "b failed"], ["a truncated", "a truncated", "b truncated"]]


@register("model_fallbacks", "SELECT o_orderkey AS request, model, attempts, fell_back, budget, refunds FROM orders JOIN (VALUES (0, 'a', 1, FALSE, 8000, 0), (1, 'a', 2, FALSE, 8000, 0), (2, 'b', 3, TRUE, 8000, 0), (3, 'a', 2, FALSE, 32000, 0), (4, 'b', 3, TRUE, 8000, 1), (5, NULL, 2, TRUE, 8000, 0), (6, NULL, 3, TRUE, 32000, 0)) t(k, model, attempts, fell_back, budget, refunds) ON k = o_orderkey % 7")
def model_fallbacks(spark, d):
    """Seven recorded courses of a fallback chain."""
    courses = F.array(*[F.array(*[F.lit(r) for r in c]) for c in _CHAINS])
    said = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.posexplode(F.get(courses, (F.col("o_orderkey") % 7).cast("int"))).alias("seq", "r"))
    return conv.fallbacks(said.select("request", "seq", F.split("r", " ")[0].alias("model"), F.split("r", " ")[1].alias("kind")), ["a", "b"])


@register("stream_fallbacks", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 2 = 0 THEN 'interrupted' ELSE 'next_model' END AS outcome FROM events")
def stream_fallbacks(spark, d):
    return table(spark, d, "events").select("event_id", conv.stream_outcome(F.col("event_id") % 2 == 0, F.col("event_type") == "error").alias("outcome"))


@register("context_snippets", f"""WITH {CATALOGUE}, {RECORDS}, best AS (SELECT *, row_number() OVER (PARTITION BY ministry ORDER BY length(text) DESC, doc_id) AS rank FROM catalogue WHERE ministry IS NOT NULL QUALIFY rank <= 6)
SELECT conv_id, string_agg(snippet, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT c.ministry AS conv_id, rank, {SNIPPET} AS snippet FROM best c LEFT JOIN records r ON r.id = 'catalogue:' || c.slug) GROUP BY conv_id""")  # fmt: skip
def context_snippets(spark, d):
    """Blocks of the six longest entries of each source, as a prompt would hold them."""
    r = records(spark, d).select("id", "payload")
    place = F.row_number().over(Window.partitionBy("ministry").orderBy(F.desc(F.length("text")), "doc_id"))
    best = catalogue(spark, d).where("ministry is not null").withColumn("rank", place).where("rank <= 6")
    c = best.join(r, F.concat(F.lit("catalogue:"), "slug") == F.col("id"), "left")
    s = c.select(F.col("ministry").alias("conv_id"), "rank", snippet(F.col("title"), F.col("ministry"), F.col("categories"), F.col("description"), F.col("payload")).alias("snippet"))
    return conv.context_block(s)


@register("sampled_rows", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '/3'), doc_id LIMIT 50")
def sampled_rows(spark, d):
    """A seeded sample; a limit is what this operator is."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/3")).cast("binary"))
    return table(spark, d, "documents").select("doc_id").orderBy(h, "doc_id").limit(50)


_EVIDENCE = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in EVIDENCE.items())


@register("null_audit", f"""WITH rows AS (SELECT doc_id, field, page, regexp_matches(page, pattern, 'i') AS evidence FROM (SELECT doc_id, 'Fee Rs 100. How to apply: step 1. ' || text AS page FROM documents), (VALUES {_EVIDENCE}) t(field, pattern))
SELECT doc_id, field, evidence, CASE WHEN NOT evidence THEN 'confirmed_absent' WHEN field <> 'fee_amount' OR doc_id % 2 = 1 THEN 'uncertain'
  WHEN NOT contains(lower(trim(regexp_replace(page, '\\s+', ' ', 'g'))), CASE WHEN doc_id % 4 = 0 THEN 'fee rs 100' ELSE 'fee rs 999' END) THEN 'uncertain' ELSE 'missed' END AS verdict FROM rows""")  # fmt: skip
def null_audit(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    pages = docs.select("doc_id", F.array(*[F.lit(x) for x in EVIDENCE]).alias("fields"), F.concat(F.lit("Fee Rs 100. How to apply: step 1. "), "text").alias("page"))
    asked = table(spark, d, "documents").where("doc_id % 2 = 0")
    answers = asked.select("doc_id", F.lit("fee_amount").alias("field"), F.lit(True).alias("stated"), F.when(F.col("doc_id") % 4 == 0, "Fee Rs 100").otherwise("Fee Rs 999").alias("quote"))
    return audit_pages(pages, answers)


@register("reachable_pages", "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 7 <> 3)")
def reachable_pages(spark, d):
    """Pages whose link check was fine, by a semi join."""
    pages = table(spark, d, "pages")
    checked = pages.select("url", F.when(F.col("page_id") % 7 == 3, "dns_fail").otherwise("ok").alias("status"))
    return pages.join(checked.where("status = 'ok'"), "url", "left_semi").select("page_id", "url")


@register("category_distribution", f"WITH {CATALOGUE} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM catalogue) GROUP BY category")
def category_distribution(spark, d):
    return facets.category_facet(catalogue(spark, d))


@register("state_distribution", f"WITH {CATALOGUE} SELECT coalesce(state, 'unknown') AS state, count(*) AS n FROM catalogue GROUP BY 1")
def state_distribution(spark, d):
    return catalogue(spark, d).groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


_TITLED = "['Blood Bank', 'PIN code list', 'Colleges', 'Toll free', 'ATM', 'Railway', 'Court', 'Other'][(p_partkey % 8 + 1)::INT] || ' ' || p_name"


@register("theme_counts", "SELECT coalesce(" + "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p in filters.THEMES) + f" END, 'other') AS theme, count(*) AS n FROM (SELECT {_TITLED} AS t FROM part) GROUP BY 1")
def theme_counts(spark, d):
    names = F.array(*[F.lit(x) for x in ("Blood Bank", "PIN code list", "Colleges", "Toll free", "ATM", "Railway", "Court", "Other")])
    title = F.concat(F.get(names, (F.col("p_partkey") % 8).cast("int")), F.lit(" "), "p_name")
    return table(spark, d, "part").groupBy(F.coalesce(filters.theme(title), F.lit("other")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))


@register("title_order", "SELECT p_partkey, row_number() OVER (ORDER BY lower(coalesce(p_name, '')), p_partkey) AS place FROM part ORDER BY lower(coalesce(p_name, '')), p_partkey LIMIT 100")
def title_order(spark, d):
    """The head of a listing by title, case aside."""
    from ..operators.retrieval import positioned, top

    rows = table(spark, d, "part").select("p_partkey", F.lower(F.coalesce("p_name", F.lit(""))).alias("t"))
    return positioned(top(rows, 100, "t", "p_partkey"), "t", "p_partkey").select("p_partkey", (F.col("position") + 1).alias("place"))


@register("vectors_missing", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) AND text <> ''")
def vectors_missing(spark, d):
    """Rows an incremental embedding run would take."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").where("text <> ''").join(v, "doc_id", "left_anti").select("doc_id")


@register("retry_waits", "SELECT o_orderkey, least(power(2, o_orderkey % 8), 30)::INT AS wait FROM orders")
def retry_waits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.backoff(F.col("o_orderkey") % 8).alias("wait"))


@register("page_megabytes", "SELECT page_id, (strlen(html) * 1000 // 1048576)::BIGINT AS mb FROM pages")
def page_megabytes(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.megabytes(scalars.utf8_bytes("html") * 1000).cast("long").alias("mb"))


def queries():
    return register.queries


def oracle_sql():
    return register.sql
