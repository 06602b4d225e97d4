"""Counts, shares and pages over a filtered catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import is_detailed
from ..functions.scalars import page_count, percent
from .filters import catalogue_filter, substring_match


def headline(catalogue: DataFrame, records: DataFrame, queue: DataFrame, documents: DataFrame, central: str = "Central") -> DataFrame:
    """One row of headline counts: four aggregates of one row each, side by side."""
    a = catalogue.agg(F.count(F.lit(1)).alias("schemes"), F.countDistinct("ministry").alias("ministries"), F.countDistinct(F.when(F.col("state") != central, F.col("state"))).alias("states"))
    b = records.agg(F.count_if(is_detailed(F.col("payload"))).alias("detailed"))
    c = queue.agg(F.count_if(F.col("status") == "done").alias("pages_read"))
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.max("fetched_at").alias("last_read"))
    return a.join(b).join(c).join(d)


def category_facet(catalogue: DataFrame, **others: str) -> DataFrame:
    """Categories by count, under the filters other than the category."""
    rows = catalogue.where(catalogue_filter(**{k: v for k, v in others.items() if k != "category"}))
    return rows.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def ministry_facet(catalogue: DataFrame, limit: int = 40, **others: str) -> DataFrame:
    rows = catalogue.where(catalogue_filter(**{k: v for k, v in others.items() if k != "ministry"})).where("ministry <> ''")
    return rows.groupBy("ministry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ministry").limit(limit)


def state_facet(catalogue: DataFrame, central: str = "Central", **others: str) -> DataFrame:
    """States, the central one first; rows without a state are left out."""
    rows = catalogue.where(catalogue_filter(**{k: v for k, v in others.items() if k != "state"})).where("state is not null")
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("state") != central, "state")


def total_matching(catalogue: DataFrame, **filters: str) -> DataFrame:
    """Rows under the filters with the category cleared."""
    return catalogue.where(catalogue_filter(**{k: v for k, v in filters.items() if k != "category"})).agg(F.count(F.lit(1)).alias("n"))


def relevance(q: str) -> Column:
    """0 where the title matches, 1 where the description does, else 2."""
    return F.when(substring_match("title", q), 0).when(substring_match("description", q), 1).otherwise(2) if q else F.lit(0)


def listed(slug: str = "slug", title: str = "title") -> list[Column]:
    """The order of a listing: by relevance, title and key, rows without a title last."""
    return [F.col("__rank"), F.asc_nulls_last(title), F.col(slug)]


def page_of(catalogue: DataFrame, q: str = "", category: str = "", ministry: str = "", state: str = "", page: int = 1, per_page: int = 24) -> DataFrame:
    """The catalogue's rows on one page of the listing, with their __rank; pages outside the range are clamped, which takes a count."""
    found = catalogue.where(catalogue_filter(q, category, ministry, state))
    last = max(1, -(-found.count() // per_page))
    page = min(max(1, page), last)
    return found.withColumn("__rank", relevance(q)).orderBy(*listed()).offset((page - 1) * per_page).limit(per_page)


def search(catalogue: DataFrame, records: DataFrame, q: str = "", category: str = "", ministry: str = "", state: str = "", page: int = 1, per_page: int = 24, source: str = "catalogue") -> DataFrame:
    """One page of the listing, title matches first, and whether details exist.

    The page is cut from the catalogue alone, by a bounded top-k; only its few rows
    meet the records.
    """
    rows = page_of(catalogue, q, category, ministry, state, page, per_page)
    sr = records.select(F.col("id").alias("__id"), "confidence", F.col("payload.who_is_eligible").alias("eligibility_preview"))
    met = rows.join(sr, F.concat(F.lit(f"{source}:"), F.col("slug")) == F.col("__id"), "left")
    # A join keeps no order: the page's few rows are sorted again.
    met = met.orderBy(*listed())
    return met.select("slug", "title", "ministry", "state", "confidence", F.col("__id").isNotNull().alias("has_detail"), "eligibility_preview")


def pages_of(catalogue: DataFrame, per_page: int = 24, **filters: str) -> DataFrame:
    return catalogue.where(catalogue_filter(**filters)).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", page_count(F.col("total"), per_page))


def detail(catalogue: DataFrame, records: DataFrame, documents: DataFrame, slug: str, source: str = "catalogue") -> DataFrame:
    """A catalogue row with its record and its newest archived page."""
    row = catalogue.where(F.col("slug") == slug)
    sr = records.where(F.col("id") == f"{source}:{slug}").select(F.col("id").alias("record_id"), "payload", "confidence", F.col("state").alias("extracted_state"))
    newest = documents.where(F.col("meta")["slug"] == slug).select(F.col("id").alias("raw_document_id"), "fetched_at", F.col("url").alias("source_url")).orderBy(F.desc("fetched_at"), F.desc("raw_document_id")).limit(1)
    return row.join(sr, F.lit(True), "left").join(newest, F.lit(True), "left")


def related(catalogue: DataFrame, slug: str, categories: list[str], limit: int = 6, seed: int = 0) -> DataFrame:
    """Other rows that share a category, in a seeded order by hash."""
    shared = F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories]))
    order = F.md5(F.concat(F.col("slug"), F.lit(f"/{seed}")).cast("binary"))
    return catalogue.where((F.col("slug") != slug) & shared).orderBy(order, "slug").limit(limit).select("slug", "title", "categories")


def progress(queue: DataFrame, as_of: Column) -> DataFrame:
    """Counts by state, the share done, and whether the last hour saw any completed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("done", "pending", "parked")]
    out = queue.agg(*counts, F.count(F.lit(1)).alias("total"), F.count_if(F.col("completed_at") > as_of - F.expr("interval 1 hour")).alias("completed_last_hour"), F.max("completed_at").alias("last_completed_at"))
    return out.withColumn("pct", percent(F.col("done"), F.col("total"))).withColumn("running", F.col("completed_last_hour") > 0)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value of a column."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("__total"))
    return counted.join(F.broadcast(total)).select(key, "n", percent(F.col("n"), F.col("__total")).alias("pct"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count(column).alias("covered"))


def null_rates(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, nulls, rate) of each field; the column given says whether it is filled.  One pass."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in fields.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("nulls")) for k in fields])
    return sums.select("n", F.explode(pairs).alias("x")).select("x.field", "x.nulls", F.bround(100 * F.col("x.nulls") / F.greatest("n", F.lit(1)), 1).alias("rate"))


def section_coverage(pages: DataFrame, headings: list[str], text: str = "text") -> DataFrame:
    """Share of pages that contain each heading, case aside, in one pass."""
    sums = pages.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.lower(text).contains(h.lower())).alias(f"h{i}") for i, h in enumerate(headings)])
    rows = F.array(*[F.struct(F.lit(h).alias("heading"), F.col(f"h{i}").alias("pages")) for i, h in enumerate(headings)])
    return sums.select("n", F.explode(rows).alias("x")).select("x.heading", "x.pages", percent(F.col("x.pages"), F.col("n")).alias("pct"))


def hidden_gain(pages: DataFrame, text: str = "text", visible: str = "text_len_visible_only") -> DataFrame:
    """Characters gained over the visible ones, and the whole number of them a page: a loss is cut towards zero, as a gain is."""
    gain = F.sum(F.length(text) - F.col(visible))
    average = F.call_function("div", gain, F.nullif(F.count(F.lit(1)), F.lit(0)))
    return pages.agg(gain.alias("gained"), average.alias("average"))


#: Values that one task sorts for the last step of nth().
FEW_VALUES = 10_000


def nth(rows: DataFrame, column: str, n: int, bins: int = 256) -> float | None:
    """The n-th smallest value (from 0) of a numeric column, nulls aside.

    Each pass counts the values in equal bins between two bounds and goes on with the
    bin that holds the n-th, until it has few values or only one: only counts are
    shuffled, and no task sorts more than FEW_VALUES.
    """
    v = F.col(column).cast("double")
    held = rows.where(v.isNotNull()).select(v.alias("v"))
    ends = held.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    lo, hi, count = ends.lo, ends.hi, ends.n
    if not 0 <= n < count:
        return None
    while count > FEW_VALUES and lo < hi:
        place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        inside = held.where(F.col("v").between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for b in inside.orderBy("bin").collect():  # at most `bins` rows
            if n < b.n:
                lo, hi, count = b.lo, b.hi, b.n
                break
            n -= b.n
    if lo == hi:
        return lo
    return held.where(F.col("v").between(lo, hi)).orderBy("v").offset(n).limit(1).first().v


def upper_median(rows: DataFrame, column: str) -> float | None:
    """The element behind the middle of the sorted values, without interpolation."""
    return nth(rows, column, rows.where(F.col(column).isNotNull()).count() // 2)
