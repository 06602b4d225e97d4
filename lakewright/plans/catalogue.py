"""Browse, facets, detail and retrieval over the catalogue."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..functions import records as rec
from ..functions.scalars import cosine_distance
from ..functions.text import trigram_similarity, trigrams
from ..operators import dedup, facets, fulltext, retrieval, vectors
from ..operators.filters import catalogue_filter
from ..shared import spread
from .base import ARCHIVE, CATALOGUE, QUEUE, RECORDS, Registry, archive, catalogue, queue, records, table, text_index, vector_index

register = Registry()
Q = "tion"
QUESTION = "Is there any thre for the aneaing of thor?"
#: Every word of the tables that has one of the question's stems.
FORMS = {"thre": ["thre", "threing", "threingly"], "anea": ["anea", "aneaed", "aneaing", "aneaes", "aneaingly"], "thor": ["thor", "thorly", "thorlying", "thorlyed"]}

_SEARCHED = "coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(array_to_string(tags, ' '), '')"


def _where(q: bool = False, category: str = "", ministry: str = "", state: str = "") -> str:
    parts = ["TRUE"]
    if q:
        parts.append(f"(title ILIKE '%{Q}%' OR description ILIKE '%{Q}%' OR len(list_filter(tags, lambda t: t ILIKE '%{Q}%')) > 0)")
    parts += [f"list_contains(categories, '{category}')"] * bool(category) + [f"ministry = '{ministry}'"] * bool(ministry) + [f"state = '{state}'"] * bool(state)
    return " AND ".join(parts)


_LISTING = f"""WITH {CATALOGUE}, {RECORDS},
found AS (SELECT c.*, CASE WHEN title ILIKE '%{Q}%' THEN 0 WHEN description ILIKE '%{Q}%' THEN 1 ELSE 2 END AS rank FROM catalogue c WHERE {_where(True, "long")})
SELECT slug, title, f.ministry, f.state, r.confidence, r.id IS NOT NULL AS has_detail, r.who_is_eligible AS eligibility_preview
FROM (SELECT * FROM found ORDER BY rank, title, slug LIMIT 24 OFFSET 24) f LEFT JOIN records r ON r.id = 'catalogue:' || f.slug"""


@register("browse_search", _LISTING)
def browse_search(spark, d):
    return facets.search(catalogue(spark, d), records(spark, d), q=Q, category="long", page=2)


@register("listing_order", f"WITH {CATALOGUE}, found AS (SELECT slug, title, CASE WHEN title ILIKE '%{Q}%' THEN 0 WHEN description ILIKE '%{Q}%' THEN 1 ELSE 2 END AS rank FROM catalogue WHERE {_where(True)}) SELECT slug, row_number() OVER (ORDER BY rank, title, slug) - 1 AS position FROM found QUALIFY position < 100")
def listing_order(spark, d):
    """The places of the first hundred rows of a search."""
    found = catalogue(spark, d).where(catalogue_filter(Q)).withColumn("rank", facets.relevance(Q))
    return retrieval.ranking(found, 100, "rank", "title", "slug", keep=("slug",))


@register("browse_last_page", f"WITH {CATALOGUE}, n AS (SELECT count(*) AS n FROM catalogue WHERE ministry = 'src3') SELECT c.slug, c.title FROM catalogue c WHERE ministry = 'src3' ORDER BY title, slug LIMIT 24 OFFSET (SELECT (greatest(1, ((n + 23) // 24)) - 1) * 24 FROM n)")
def browse_last_page(spark, d):
    """A page beyond any count, clamped; the page alone, as no record can add to it."""
    return facets.page_of(catalogue(spark, d), ministry="src3", page=sys.maxsize).select("slug", "title")


@register("filter_all", f"WITH {CATALOGUE} SELECT slug FROM catalogue WHERE {_where(True, 'medium', 'src3', 'Central')}")
def filter_all(spark, d):
    return catalogue(spark, d).where(catalogue_filter(Q, "medium", "src3", "Central")).select("slug")


@register("facet_categories", f"WITH {CATALOGUE} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM catalogue WHERE {_where(True, '', 'src3')}) GROUP BY category")
def facet_categories(spark, d):
    return facets.category_facet(catalogue(spark, d), q=Q, ministry="src3", category="long")


@register("facet_ministries", f"WITH {CATALOGUE} SELECT ministry, count(*) AS n FROM catalogue WHERE {_where(True)} AND ministry <> '' GROUP BY ministry ORDER BY n DESC, ministry LIMIT 10")
def facet_ministries(spark, d):
    return facets.ministry_facet(catalogue(spark, d), 10, q=Q, ministry="src1")


@register("facet_states", f"WITH {CATALOGUE} SELECT state, count(*) AS n FROM catalogue WHERE {_where(False, 'long')} AND state IS NOT NULL GROUP BY state")
def facet_states(spark, d):
    return facets.state_facet(catalogue(spark, d), category="long", state="fr")


@register("total_matching", f"WITH {CATALOGUE} SELECT count(*) AS n FROM catalogue WHERE {_where(True)}")
def total_matching(spark, d):
    return facets.total_matching(catalogue(spark, d), q=Q, category="long")


@register("page_counts", f"WITH {CATALOGUE} SELECT count(*) AS total, greatest(1, (count(*) + 23) // 24)::BIGINT AS pages FROM catalogue WHERE {_where(True)}")
def page_counts(spark, d):
    return facets.pages_of(catalogue(spark, d), q=Q)


@register("stats_headline", f"""WITH {CATALOGUE}, {RECORDS}, {ARCHIVE}, {QUEUE}
SELECT (SELECT count(*) FROM catalogue) AS schemes,
       (SELECT count(*) FROM records WHERE who_is_eligible IS NOT NULL AND (len(documents_required) > 0 OR len(how_to_apply) > 0)) AS detailed,
       (SELECT count(*) FROM queue WHERE status = 'done') AS pages_read, (SELECT count(*) FROM archive) AS documents,
       (SELECT count(DISTINCT ministry) FROM catalogue) AS ministries,
       (SELECT count(DISTINCT state) FROM catalogue WHERE state <> 'Central') AS states, (SELECT max(fetched_at) FROM archive) AS last_read""")  # fmt: skip
def stats_headline(spark, d):
    return facets.headline(catalogue(spark, d), records(spark, d), queue(spark, d), archive(spark, d))


@register("scheme_detail", f"""WITH {CATALOGUE}, {RECORDS}, {ARCHIVE}
SELECT c.slug, c.title, r.confidence, r.state AS extracted_state, a.id AS raw_document_id, a.url AS source_url
FROM catalogue c LEFT JOIN records r ON r.id = 'catalogue:' || c.slug
LEFT JOIN (SELECT * FROM archive WHERE slug = 'd4' ORDER BY fetched_at DESC, id DESC LIMIT 1) a ON TRUE WHERE c.slug = 'd4'""")  # fmt: skip
def scheme_detail(spark, d):
    return facets.detail(catalogue(spark, d), records(spark, d), archive(spark, d), "d4").select("slug", "title", "confidence", "extracted_state", "raw_document_id", "source_url")


@register("related_rows", f"WITH {CATALOGUE} SELECT slug, title FROM catalogue WHERE slug <> 'd4' AND list_has_any(categories, ['fr', 'short']) ORDER BY md5(slug || '/5'), slug LIMIT 6")
def related_rows(spark, d):
    return facets.related(catalogue(spark, d), "d4", ["fr", "short"], seed=5).select("slug", "title")


@register("display_states", f"""WITH {CATALOGUE}, {RECORDS}, {ARCHIVE}
SELECT c.slug, CASE WHEN r.id IS NOT NULL AND r.who_is_eligible IS NOT NULL AND r.who_is_eligible <> '' THEN 'present' WHEN r.id IS NOT NULL THEN 'source_silent'
  WHEN a.slug IS NOT NULL THEN 'not_read_yet' ELSE 'page_unavailable' END AS eligibility_state
FROM catalogue c LEFT JOIN records r ON r.id = 'catalogue:' || c.slug LEFT JOIN (SELECT DISTINCT slug FROM archive) a ON a.slug = c.slug""")  # fmt: skip
def display_states(spark, d):
    c, r = catalogue(spark, d), records(spark, d).select("id", "payload")
    read = archive(spark, d).select(F.col("meta")["slug"].alias("seen")).where("seen is not null").distinct()
    met = c.join(r, F.concat(F.lit("catalogue:"), "slug") == F.col("id"), "left").join(read, F.col("slug") == F.col("seen"), "left")
    filled = F.coalesce(rec.is_filled(F.col("payload.who_is_eligible")), F.lit(False))
    return met.select("slug", rec.display_state(filled, F.col("id").isNotNull(), F.col("seen").isNotNull()).alias("eligibility_state"))


@register("searchable_text", f"WITH {CATALOGUE} SELECT slug, {_SEARCHED} AS body FROM catalogue")
def searchable_text(spark, d):
    return catalogue(spark, d).select("slug", rec.searchable(F.col("title"), F.col("description"), F.col("tags")).alias("body"))


@register("catalogue_text", f"WITH {CATALOGUE} SELECT slug, substring(concat_ws(' — ', nullif(title, ''), nullif(description, ''), nullif(array_to_string(tags, ', '), '')), 1, 1000) AS body FROM catalogue")
def catalogue_text(spark, d):
    return catalogue(spark, d).select("slug", rec.catalogue_text(F.col("title"), F.col("description"), F.col("tags")).alias("body"))


@register("primary_category", f"WITH {CATALOGUE}, looks AS (SELECT * FROM (VALUES ('en', 'globe', 'blue'), ('fr', 'star', 'rose')) t(k, icon, tone)) SELECT slug, coalesce(categories[1], '?') AS category, coalesce(icon, 'default') AS icon, coalesce(tone, 'slate') AS tone FROM catalogue LEFT JOIN looks ON k = categories[1]")
def primary_category(spark, d):
    looks = spark.createDataFrame([("en", "globe", "blue"), ("fr", "star", "rose")], "k string, icon string, tone string")
    c = catalogue(spark, d).withColumn("category", rec.primary_category(F.col("categories")))
    return c.join(F.broadcast(looks), F.col("category") == F.col("k"), "left").select("slug", "category", F.coalesce("icon", F.lit("default")).alias("icon"), F.coalesce("tone", F.lit("slate")).alias("tone"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@register("trigram_titles", f"""SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity
FROM (SELECT p_partkey, {_TRI.format("p_name")} AS a, {_TRI.format("'small brass'")} AS b FROM part)
WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE > 0.25 ORDER BY similarity DESC, p_partkey LIMIT 20""")  # fmt: skip
def trigram_titles(spark, d):
    like = trigram_similarity(trigrams("p_name"), trigrams(F.lit("small brass")))
    rows = table(spark, d, "part").select("p_partkey", F.round(like, 6).alias("similarity")).where("similarity > 0.25")
    return retrieval.top(rows, 20, F.desc("similarity"), "p_partkey")


def _vector(spark, d, vec_id=0):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("slug"), "embedding", "label")


_NEAR = "list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COSINE = f"round(1 - {_DOT('e.embedding', 'q.embedding')} / sqrt({_DOT('e.embedding', 'e.embedding')} * {_DOT('q.embedding', 'q.embedding')}), 6) + 0.0"


_TOPK = f"SELECT 'd' || e.vec_id AS slug, {_COSINE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, slug LIMIT 30"


@register("vector_topk", _TOPK)
def vector_topk(spark, d):
    return retrieval.vector_candidates(_vectors(spark, d), _vector(spark, d)).select("slug", (F.round("distance", 6) + 0.0).alias("distance"))


@register("vector_index_topk", _TOPK)
def vector_index_topk(spark, d):
    """The same rows from the cells of the index that can hold them."""
    near = vectors.search(vector_index(spark, d), _vector(spark, d), 30)
    return near.select("slug", (F.round("distance", 6) + 0.0).alias("distance"))


@register("rules_topk", f"SELECT 'd' || e.vec_id AS slug, {_COSINE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY distance, slug LIMIT 10")
def rules_topk(spark, d):
    near = retrieval.vector_candidates(_vectors(spark, d).where("label = 3"), _vector(spark, d), 10)
    return near.select("slug", (F.round("distance", 6) + 0.0).alias("distance"))


@register("nearest_same_label", f"""SELECT e.vec_id, round({_DOT('e.embedding', 'q.embedding')}, 6) + 0.0 AS likeness FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 1) q WHERE e.label = q.label""")
def nearest_same_label(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 1").first()
    v = F.array(*[F.lit(float(x)) for x in q.embedding])
    return e.where(F.col("label") == q.label).select("vec_id", (F.round(1 - cosine_distance(F.col("embedding"), v), 6) + 0.0).alias("likeness"))


_WORDS = "regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[\\p{L}\\p{N}]+')"
_TERMS = "['thing', 'needed', 'inering']"
_RANK = "list_sum(list_transform(terms, lambda t: CASE WHEN len(list_filter(doc, lambda w: w = t)) > 0 THEN 0.1 * list_sum(list_transform(range(1, len(list_filter(doc, lambda w: w = t)) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 ELSE 0.0::DOUBLE END)) / len(terms)"


@register("lexical_any_rank", f"""WITH {CATALOGUE}, words AS (SELECT slug, {_WORDS} AS doc, ['the', 'reed', 'and'] AS terms FROM catalogue)
SELECT slug, round({_RANK}, 6) AS score FROM words WHERE list_has_any(doc, terms) ORDER BY round({_RANK}, 6) DESC, slug LIMIT 40""")  # fmt: skip
def lexical_any_rank(spark, d):
    """Words as they stand, from the texts: no stems, no index."""
    from ..functions.text import words_among

    words = ["the", "reed", "and"]
    terms = F.array(*[F.lit(t) for t in words])
    doc = words_among(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))), words)
    rows = catalogue(spark, d, all_cores=True).select("slug", doc.alias("doc"))
    rows = rows.where(F.size("doc") > 0).select("slug", F.round(retrieval.any_rank(F.col("doc"), terms), 6).alias("score"))
    return retrieval.top(rows, 40, F.desc("score"), "slug")


@register("rrf_fusion", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS p FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40),
b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS p FROM documents WHERE n_chars > 4000 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 40),
u AS (SELECT doc_id, p, 0 AS list FROM a UNION ALL SELECT doc_id, p, 1 FROM b)
SELECT doc_id, round(sum(1.0::DOUBLE / (61 + p)), 9) AS score FROM u GROUP BY doc_id""")  # fmt: skip
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    a = retrieval.positioned(retrieval.top(docs, 40, F.desc("n_chars"), "doc_id"), F.desc("n_chars"), "doc_id")
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    b = docs.where("n_chars > 4000").withColumn("h", h)
    b = retrieval.positioned(retrieval.top(b, 40, "h", "doc_id"), "h", "doc_id")
    return retrieval.fuse([a, b], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


_STEM = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(w) for w in words)}) THEN '{stem}'" for stem, words in FORMS.items()) + " END"
_GRAMS = _TRI.format("'" + QUESTION + "'")
_TIERS = f"""{CATALOGUE},
said AS (SELECT slug, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT slug, regexp_extract_all(lower({_SEARCHED}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM catalogue)),
stems AS (SELECT slug, stem, p, row_number() OVER (PARTITION BY slug, stem ORDER BY p) AS j FROM (SELECT slug, {_STEM} AS stem, least(i, 16383) AS p FROM said) WHERE stem IS NOT NULL),
places AS (SELECT * FROM stems WHERE j <= 255),
one AS (SELECT slug, stem, 0.1 * sum(1.0::DOUBLE / (j * j)) / 1.64493406685 AS r FROM places GROUP BY slug, stem),
loose AS (SELECT slug, 1 AS tier, round(sum(r) / {len(FORMS)}, 9) AS score FROM one GROUP BY slug ORDER BY score DESC, slug LIMIT 40),
pairs AS (SELECT a.slug, sqrt(0.01 * CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5::DOUBLE - 2)) END) AS c FROM places a JOIN places b ON a.slug = b.slug AND a.stem < b.stem AND a.p <> b.p),
precise AS (SELECT slug, 0 AS tier, round(1 - exp(sum(ln(1 - c))), 9) AS score FROM pairs WHERE slug IN (SELECT slug FROM one GROUP BY slug HAVING count(*) = {len(FORMS)}) GROUP BY slug ORDER BY score DESC, slug LIMIT 40),
fuzzy AS (SELECT slug, 2 AS tier, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS score FROM (SELECT slug, {_TRI.format("title")} AS a, {_GRAMS} AS b FROM catalogue)
  WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE > 0.25 ORDER BY score DESC, slug LIMIT 20),
tiers AS (SELECT slug, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY tier, score DESC) AS n FROM (FROM precise UNION ALL FROM loose UNION ALL FROM fuzzy)) WHERE n = 1)"""
_NEAREST = lambda where: f"SELECT slug, row_number() OVER (ORDER BY distance, slug) - 1 AS p FROM (SELECT 'd' || e.vec_id AS slug, {_COSINE.replace(', 6)', ', 9)')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY distance, slug LIMIT 30)"


@register("retrieve_fused", f"""WITH {_TIERS},
lists AS (SELECT slug, row_number() OVER (ORDER BY tier, score DESC, slug) - 1 AS p, 0 AS list FROM (SELECT * FROM tiers ORDER BY tier, score DESC, slug LIMIT 30)
  UNION ALL SELECT slug, p, 1 FROM ({_NEAREST("TRUE")}) UNION ALL SELECT slug, p, 2 FROM ({_NEAREST("e.label < 5")})),
fused AS (SELECT slug, sum(1.0::DOUBLE / (61 + p)) AS score, min(list * 1000 + p) AS first FROM lists GROUP BY slug),
pool AS (SELECT slug, score, row_number() OVER (ORDER BY round(score, 12) DESC, first, slug) - 1 AS position FROM fused QUALIFY position < 30)
SELECT slug, title, round(score, 9) AS score, position FROM pool JOIN catalogue USING (slug) ORDER BY position LIMIT 6""")  # fmt: skip
def retrieve_fused(spark, d):
    v = _vectors(spark, d)
    doc = rec.searchable(F.col("title"), F.col("description"), F.col("tags"))
    return retrieval.retrieve(catalogue(spark, d), v, v.where("label < 5"), QUESTION, _vector(spark, d), doc, index=text_index(spark, d))


@register("retrieve_lexical_tiers", f"WITH {_TIERS} SELECT slug, tier, round(score, 9) AS score FROM tiers")
def retrieve_lexical_tiers(spark, d):
    return retrieval.lexical_tiers(text_index(spark, d), QUESTION).select("slug", "tier", F.round("score", 9).alias("score"))


@register("lexical_candidates", f"WITH {_TIERS} SELECT slug, row_number() OVER (ORDER BY tier, score DESC, slug) - 1 AS position FROM (SELECT * FROM tiers ORDER BY tier, score DESC, slug LIMIT 30)")
def lexical_candidates(spark, d):
    found = retrieval.lexical_tiers(text_index(spark, d), QUESTION)
    return retrieval.ranking(found, retrieval.POOL, "tier", F.desc("score"), "slug", keep=("slug",))


@register("fulltext_build", f"WITH {CATALOGUE}, said AS (SELECT DISTINCT slug, unnest(regexp_extract_all(lower({_SEARCHED}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM catalogue) SELECT count(*) AS postings, count(DISTINCT w) AS terms, (SELECT count(*) FROM catalogue) AS titles FROM said")
def fulltext_build(spark, d):
    """Builds the index anew and counts what it holds."""
    index = text_index(spark, d, fresh=True)
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    return count(index.postings, "postings").join(count(index.vocabulary, "terms")).join(count(index.titles, "titles"))


@register("reranked", f"""WITH {CATALOGUE}, said AS (SELECT slug, ['thre', 'aneaing', 'thor'] AS terms, regexp_extract_all(lower({_SEARCHED}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM catalogue),
pool AS (SELECT slug, terms, ws, row_number() OVER (ORDER BY md5(slug || '/4'), slug) - 1 AS position FROM said QUALIFY position < 300)
SELECT slug, position, round(len(list_intersect(terms, list_distinct(ws))) / 3.0::DOUBLE, 9) AS rerank_score FROM pool ORDER BY rerank_score DESC, position LIMIT 6""")  # fmt: skip
def reranked(spark, d):
    """A pool of 300 ordered anew by the terms that each text has, equal ones as they came."""
    doc = rec.searchable(F.col("title"), F.col("description"), F.col("tags"))
    h = F.md5(F.concat("slug", F.lit("/4")).cast("binary"))
    rows = catalogue(spark, d).select("slug", doc.alias("doc"), h.alias("h"))
    pool = retrieval.ranking(rows, 300, "h", "slug", keep=("slug", "doc"))
    terms = F.array(*[F.lit(t) for t in ("thre", "aneaing", "thor")])
    return retrieval.rerank(pool, F.round(retrieval.lexical_overlap(terms, F.col("doc")), 9)).select("slug", "position", "rerank_score")


@register("postings", """WITH w AS (SELECT doc_id, term, i - 1 AS place FROM (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents)))
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM w GROUP BY term""")  # fmt: skip
def postings(spark, d):
    p = fulltext.postings(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("places")).alias("places"))


@register("ordered_lookup", f"WITH {CATALOGUE} SELECT slug, title, CASE WHEN list_position(['d9', 'd3', 'd77'], slug) > 0 THEN list_position(['d9', 'd3', 'd77'], slug) - 1 ELSE 999 END AS place FROM catalogue WHERE slug IN ('d3', 'd9', 'd77', 'd500')")
def ordered_lookup(spark, d):
    rows = catalogue(spark, d).where(F.col("slug").isin("d3", "d9", "d77", "d500")).select("slug", "title")
    return retrieval.in_order(rows, ["d9", "d3", "d77"])


@register("shares_by_source", "SELECT source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1)::DOUBLE AS pct FROM documents GROUP BY source")
def shares_by_source(spark, d):
    return facets.shares(table(spark, d, "documents"), "source")


@register("coverage_of_records", f"WITH {CATALOGUE}, {RECORDS} SELECT count(*) AS total, count(r.id) AS covered FROM catalogue c LEFT JOIN records r ON r.id = 'catalogue:' || c.slug")
def coverage_of_records(spark, d):
    r = records(spark, d).select("id")
    return facets.coverage(catalogue(spark, d).join(r, F.concat(F.lit("catalogue:"), "slug") == F.col("id"), "left"), "id")


@register("unused_states", f"WITH {CATALOGUE} SELECT n_name AS state FROM nation WHERE n_name NOT IN (SELECT DISTINCT 'NATION_' || (doc_id % 20) FROM catalogue)")
def unused_states(spark, d):
    used = catalogue(spark, d).select(F.concat(F.lit("NATION_"), (F.col("doc_id") % 20).cast("string")).alias("state")).distinct()
    return dedup.missing_keys(table(spark, d, "nation").select(F.col("n_name").alias("state")), used, "state")


def queries():
    return register.queries


def oracle_sql():
    return register.sql
