"""The driver's synthetic tables bound to the entities that the operators expect.

The data are invented; documents stand for catalogue entries, labels for records that
were extracted for some of them, pages for archived pages, orders for a work queue,
events for a request log.  Each binding exists twice, as a frame and as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.records import searchable
from ..operators import fulltext, vectors
from ..shared import new_path, spread, stamp

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL where it can express them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str, all_cores: bool = False) -> DataFrame:
    """With `all_cores` a small table is dealt to all of them before anything is computed from its texts."""
    docs = table(spark, sf_dir, "documents")
    if all_cores:
        docs = spread(docs, "doc_id")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"),
        F.substring("text", 1, 48).alias("title"),
        F.col("text").alias("description"),
        F.array("lang", F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")).alias("categories"),
        F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), 1), 1, 4).alias("tags"),
        F.when(F.col("source") != "src7", F.col("source")).alias("ministry"),
        F.when(F.col("lang") == "en", "Central").when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("state"),
        F.col("doc_id"),
        F.col("text"),
    )


_indexes: dict[tuple, fulltext.Index] = {}


def text_index(spark: SparkSession, sf_dir: str, fresh: bool = False) -> fulltext.Index:
    """The catalogue's full-text index, written once an application for the files as they are."""
    source = f"{sf_dir}/documents.parquet"
    mark = (spark.sparkContext.applicationId, source, stamp(spark, source))
    if fresh or mark not in _indexes:
        path = new_path(spark, "fulltext")
        rows = catalogue(spark, sf_dir, all_cores=True)
        fulltext.write(fulltext.describe(rows, "slug", searchable(F.col("title"), F.col("description"), F.col("tags")), "title"), path)
        _indexes[mark] = fulltext.read(spark, path)
    return _indexes[mark]


_vector_indexes: dict[tuple, vectors.VectorIndex] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The index of all vectors, written once an application for the files as they are."""
    source = f"{sf_dir}/embeddings.parquet"
    mark = (spark.sparkContext.applicationId, source, stamp(spark, source))
    if mark not in _vector_indexes:
        path = new_path(spark, "vectors")
        vectors.write(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("slug"), "embedding"), path)
        _vector_indexes[mark] = vectors.read(spark, path)
    return _vector_indexes[mark]


CATALOGUE = """catalogue AS (
  SELECT 'd' || doc_id AS slug, substring(text, 1, 48) AS title, text AS description,
         [lang, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END] AS categories,
         regexp_extract_all(text, '[A-Za-z]{5,}')[1:4] AS tags,
         CASE WHEN source <> 'src7' THEN source END AS ministry,
         CASE WHEN lang = 'en' THEN 'Central' WHEN doc_id % 11 <> 0 THEN lang END AS state, doc_id, text
  FROM documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the labelled documents; the payload's fields vary with the id."""
    from ..schemas import schema

    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    made = {
        "canonical_name": F.substring("text", 1, 30),
        "ministry": F.when(F.col("doc_id") % 4 != 0, F.col("source")),
        "what_it_is": F.col("text"),
        "who_is_eligible": F.when(F.col("quality") == 1, F.substring("text", 31, 80)),
        "exclusions": F.when(F.col("toxic") == 1, F.lit("persons with income; persons abroad")),
        "documents_required": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("form"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")),
        "fee_amount": F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 7).cast("double")),
        "fee_notes": F.when(F.col("doc_id") % 5 == 1, F.lit("see notice")),
        "how_to_apply": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("fill"), F.lit("send"))).otherwise(F.array().cast("array<string>")),
        "application_modes": F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("online"))),
        "helpline": F.when(F.col("doc_id") % 8 == 0, F.lit("1800 100")),
        "email": F.when(F.col("doc_id") % 9 == 0, F.lit("")),
        "page_is_about_a_service": F.col("doc_id") % 13 != 0,
    }
    fields = [made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("payload")]
    return met.select(F.concat(F.lit("catalogue:d"), F.col("doc_id").cast("string")).alias("id"), F.struct(*fields).alias("payload"), F.round(F.col("doc_id") % 17 / 16, 3).alias("confidence"), F.col("lang").alias("state"), "doc_id")


RECORDS = """records AS (
  SELECT 'catalogue:d' || doc_id AS id, doc_id, round((doc_id % 17) / 16.0, 3)::DOUBLE AS confidence, lang AS state,
         substring(text, 1, 30) AS canonical_name, CASE WHEN doc_id % 4 <> 0 THEN source END AS ministry,
         text AS what_it_is, CASE WHEN quality = 1 THEN substring(text, 31, 80) END AS who_is_eligible,
         CASE WHEN toxic = 1 THEN 'persons with income; persons abroad' END AS exclusions,
         CASE WHEN doc_id % 3 = 0 THEN ['form', lang] WHEN doc_id % 3 = 1 THEN []::VARCHAR[] END AS documents_required,
         CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7)::DOUBLE END AS fee_amount, CASE WHEN doc_id % 5 = 1 THEN 'see notice' END AS fee_notes,
         CASE WHEN doc_id % 2 = 0 THEN ['fill', 'send'] ELSE []::VARCHAR[] END AS how_to_apply,
         CASE WHEN doc_id % 6 = 0 THEN ['online'] END AS application_modes,
         CASE WHEN doc_id % 8 = 0 THEN '1800 100' END AS helpline, CASE WHEN doc_id % 9 = 0 THEN '' END AS email,
         doc_id % 13 <> 0 AS about
  FROM labels JOIN documents USING (doc_id))"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived pages; two of three belong to a catalogue entry."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("id"),
        "url",
        F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"),
        F.create_map(F.lit("slug"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("d"), F.col("page_id").cast("string")))).alias("meta"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 61).alias("fetched_at"),
        "html",
    )


ARCHIVE = """archive AS (
  SELECT page_id AS id, url, sha256(html) AS content_hash, CASE WHEN page_id % 3 <> 0 THEN 'd' || page_id END AS slug,
         make_timestamp((1700000000 + page_id * 61) * 1000000) AS fetched_at, html FROM pages)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 20 == 0, "parked").otherwise("done")).when(F.col("o_orderstatus") == "P", "pending").otherwise("in_flight")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("raw_document_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"),
        status.alias("status"),
        (F.col("o_orderkey") % 3).cast("int").alias("attempts"),
        F.lit(None).cast("string").alias("model_used"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("claimed_at"),
        F.when(status == "done", F.col("o_orderdate")).alias("completed_at"),
    )


QUEUE = """queue AS (
  SELECT o_orderkey AS id, substring(o_orderpriority, 1, 1)::INT AS tier, (o_orderkey % 3)::INT AS attempts,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 20 = 0 THEN 'parked' ELSE 'done' END
              WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'in_flight' END AS status,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 20 <> 0 THEN o_orderdate END AS completed_at FROM orders)"""

AS_OF = "1998-01-01 12:00:00"
