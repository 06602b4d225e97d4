"""The application's surface, one function a route or command, each giving frames.

`Tables` names the frames that a deployment holds; serving over HTTP is not the
engine's business.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .boundaries import embed_missing
from .functions.records import catalogue_text, rules_text, searchable
from .operators import conversation, dedup, facets, filters, queue as work, retrieval

PER_PAGE = 24


@dataclass
class Tables:
    catalogue: DataFrame
    records: DataFrame
    queue: DataFrame
    documents: DataFrame


def home(t: Tables) -> dict[str, DataFrame]:
    return {"stats": facets.headline(t.catalogue, t.records, t.queue, t.documents), "categories": facets.category_facet(t.catalogue), "states": facets.state_facet(t.catalogue)}


def browse(t: Tables, q: str = "", category: str = "", ministry: str = "", state: str = "", page: int = 1, source: str = "catalogue") -> dict[str, DataFrame]:
    """One page, the facets under the other filters, and the total with the category cleared."""
    given = {"q": q.strip(), "category": category, "ministry": ministry, "state": state}
    return {
        "items": facets.search(t.catalogue, t.records, **given, page=page, per_page=PER_PAGE, source=source),
        "pages": facets.pages_of(t.catalogue, PER_PAGE, **given),
        "categories": facets.category_facet(t.catalogue, **given),
        "ministries": facets.ministry_facet(t.catalogue, 25, **given),
        "states": facets.state_facet(t.catalogue, **given),
        "cleared": facets.total_matching(t.catalogue, **given),
    }


def scheme(t: Tables, slug: str, source: str = "catalogue", seed: int = 0) -> dict[str, DataFrame | None]:
    """A row in detail and its related rows; no row, no related ones."""
    found = facets.detail(t.catalogue, t.records, t.documents, slug, source)
    row = t.catalogue.where(F.col("slug") == slug).select("categories").first()
    return {"detail": found, "related": facets.related(t.catalogue, slug, list(row.categories), seed=seed) if row and row.categories else None}


def listing_json(t: Tables, q: str = "", category: str = "", state: str = "", page: int = 1) -> DataFrame:
    """One JSON text with the page's items."""
    items = facets.search(t.catalogue, t.records, q=q, category=category, state=state, page=page, per_page=PER_PAGE)
    return items.agg(F.to_json(F.struct(F.lit(page).alias("page"), F.collect_list(F.struct(*items.columns)).alias("items"))).alias("body"))  # a page's rows


def status(t: Tables, as_of: Column) -> DataFrame:
    return facets.headline(t.catalogue, t.records, t.queue, t.documents).join(facets.progress(t.queue, as_of))


def ask(t: Tables, question: str, query: list[float], vectors: DataFrame, rules: DataFrame, k: int = retrieval.TOP) -> DataFrame:
    """Retrieved rows for a question; blank questions retrieve nothing."""
    text = question.strip()[:500]
    if not text:
        return t.catalogue.limit(0).select("slug", "title", F.lit(0.0).alias("score"), F.lit(0).alias("position"))
    return retrieval.retrieve(t.catalogue, vectors, rules, text, query, searchable(F.col("title"), F.col("description"), F.col("tags")), k)


def prompts(history: DataFrame, questions: DataFrame, system: str) -> DataFrame:
    return conversation.messages(filters.clean_history(history), questions, system)


def load_catalogue(existing: DataFrame, feed: DataFrame, dry_run: bool = False) -> DataFrame:
    """The catalogue after a feed, or on a dry run its category counts."""
    if dry_run:
        return facets.category_facet(feed)
    return dedup.upsert(existing, feed.withColumn("position", F.monotonically_increasing_id()), ["slug"], "position", keep=["embedding"])


def load_corpus(existing: DataFrame, captures: DataFrame) -> DataFrame:
    return dedup.insert_ignore(existing, captures, ["url", "content_hash"])


def backfill_states(catalogue: DataFrame, pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """The catalogue with states from pages, else from extraction."""
    from_records = dedup.canonical_states(extracted, "state").select("slug", F.col("canonical_state").alias("state")).where("state is not null")
    return dedup.prefer(dedup.state_from_page(pages).where("state is not null"), from_records, catalogue.drop("state"), "slug", "state")


def extract_pass(queue: DataFrame, results: DataFrame | None, n: int, as_of: Column) -> DataFrame:
    """A queue after results, if any, with the next n tasks claimed."""
    return work.claim(queue if results is None else work.release(queue, results, as_of), n, as_of)


def embed(rows: DataFrame, make_encoder, target: str = "catalogue") -> DataFrame:
    """Vectors for rows without one, of the catalogue's or the records' text."""
    body = catalogue_text(F.col("title"), F.col("description"), F.col("tags")) if target == "catalogue" else rules_text(F.col("canonical_name"), F.col("payload"))
    return embed_missing(rows.withColumn("body", body), make_encoder)


def shortlist(entries: DataFrame) -> DataFrame:
    """Directory entries with their theme."""
    judged = entries.withColumn("x", filters.directory_verdict("title", "fields")).where("x.is_directory")
    return judged.select("title", filters.theme("title").alias("theme"), F.col("x.why").alias("why")).orderBy(F.lower(F.coalesce("title", F.lit(""))), "title")
