"""Predicates, and classifiers made of patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import col

# --- Fixed values: patterns, names and orders that define the classes. ---
DIRECTORY = r"(?i)(?:\bdirector(?:y|ies)\b|^\s*list of\b|\bpin\s?code\b|\b(?:list|register|roster|index)\s+of\s+(?:all\s+)?(?:the\s+)?(?:hospital|school|college|centre|center|office|bank|clinic|institut|univers|village|panchayat|kendra|helpline))"
STATISTICAL = r"(?i)\b(number of|no\.? of|count of|total|statistics|census|year[\s-]?wise|month[\s-]?wise|quarter[\s-]?wise|scheme[\s-]?wise|(?:state|district|city|region)[\s-]?wise\s+(?:number|total|count|status|progress|fund|amount|allocation|release)|status of|progress of|performance of|achievement|fund(?:s)? (?:released|allocated|sanctioned|utilis)|production|consumption|expenditure|revenue|budget|allocation|growth|rate of|percentage|per capita|index|survey|during \d{4}|for the year|as per census|daily|weekly|monthly|annual|hourly|real[\s-]?time|rainfall|temperature|weather|water level|discharge|data from|readings?|observations?|forecast)\b"
LOCATORS = ["pincode", "pin_code", "district", "districtname", "state", "statename", "address", "latitude", "longitude", "lat", "lon", "long", "location", "city", "town", "village", "taluk", "block", "phone", "contact", "telephone", "email"]
THEMES = [
    ("health", "hospital|dispensar|blood bank|clinic|medical|health|ayush|wellness"),
    ("postal-geo", r"pin\s?code|postal|village|panchayat|ward"),
    ("education", r"school|college|univers|institut|\biti\b|polytechnic|navodaya"),
    ("helpline", r"helpline|toll[\s-]?free|grievance"),
    ("finance", r"\bbank\b|\batm\b|insurance|post office"),
    ("transport", r"transport|railway|airport|\brto\b|bus stand"),
    ("legal", "advocate|court|legal aid|lok adalat"),
]
LICENCES = [
    ("GODL-India", r"government open data licen[cs]e|\bGODL\b"),
    ("CC-BY-4.0", r"creative commons attribution 4\.0|CC[\s-]?BY[\s-]?4\.0"),
    ("CC-BY", "creative commons attribution"),
    ("public-domain", "public domain"),
    ("free-to-reuse", "may be reproduced free of charge|freely (?:be )?(?:used|reproduced)"),
    ("all-rights-reserved", "all rights reserved"),
]
TERMS_PATHS = ["/website-policy", "/website-policies", "/copyright-policy", "/copyright", "/terms-and-conditions", "/terms", "/disclaimer", "/hyperlinking-policy"]
RETRYABLE = ["http_error", "unreachable"]
# --- End of fixed values. ---


def substring_match(c: Column | str, q: str) -> Column:
    """Case-insensitive; % and _ in the search act as wildcards."""
    return col(c).ilike(f"%{q}%")


def any_tag_matches(tags: Column | str, q: str) -> Column:
    return F.exists(col(tags), lambda t: t.ilike(f"%{q}%"))


def catalogue_filter(q: str = "", category: str = "", ministry: str = "", state: str = "") -> Column:
    """The conjunction of the filters given; a blank one does not filter."""
    clauses = [F.lit(True)]
    if q:
        clauses.append(substring_match("title", q) | substring_match("description", q) | F.coalesce(any_tag_matches("tags", q), F.lit(False)))
    if category:
        clauses.append(F.array_contains("categories", category))
    if ministry:
        clauses.append(F.col("ministry") == ministry)
    if state:
        clauses.append(F.col("state") == state)
    return reduce(lambda a, b: a & b, clauses)


def all_terms(doc_terms: Column, terms: Column) -> Column:
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, doc_terms)) == 0)


def any_term(doc_terms: Column, terms: Column) -> Column:
    return (F.size(terms) > 0) & F.arrays_overlap(doc_terms, terms)


def first_match(c: Column | str, named_patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that is found, null if none is."""
    return F.coalesce(*[F.when(F.coalesce(col(c), F.lit("")).rlike(f"(?i){p}"), name) for name, p in named_patterns])


def theme(title: Column | str) -> Column:
    return first_match(title, THEMES)


def directory_verdict(title: Column | str, fields: Column | str) -> Column:
    """struct(is_directory, why)."""
    title = F.coalesce(col(title), F.lit(""))
    found = F.sort_array(F.array_intersect(F.transform(F.coalesce(col(fields), F.array()), F.lower), F.array(*[F.lit(x) for x in LOCATORS])))
    why = (
        F.when(~title.rlike(DIRECTORY), "title not directory-shaped")
        .when(title.rlike(STATISTICAL), "title reads statistical")
        .when(F.size(found) == 0, "no locator field")
        .otherwise(F.concat(F.lit("locators: "), F.array_join(F.slice(found, 1, 4), ", ")))
    )
    return F.struct(why.startswith("locators: ").alias("is_directory"), why.alias("why"))


def licence(pages: DataFrame) -> DataFrame:
    """(site, licence, path) of (site, path, body): the first terms path with a licence, its first pattern."""
    plain = F.regexp_replace("body", "<[^>]+>", " ")
    place = F.array_position(F.array(*[F.lit(p) for p in TERMS_PATHS]), F.col("path"))
    found = pages.select("site", "path", first_match(plain, LICENCES).alias("licence"), place.alias("place")).where("licence is not null and place > 0")
    return found.groupBy("site").agg(F.min_by(F.struct("licence", "path"), "place").alias("x")).select("site", "x.licence", "x.path")


def robots_decision(status: Column, parsed: Column, manual: Column) -> Column:
    """404 allows, 200 as parsed, all else unknown; a note by hand counts only where unknown."""
    read = F.when(status == 404, True).when(status == 200, parsed)
    return F.coalesce(read, manual)


def resumable(targets: DataFrame, done: DataFrame, key: str, settled: Column) -> DataFrame:
    """Targets that no settled row covers."""
    return targets.join(done.where(settled).select(key).distinct(), key, "left_anti")


def fetch_targets(rows: DataFrame, url: str = "url", order: str = "position", only_pdfs: bool = False, only_html: bool = False) -> DataFrame:
    """The first row of each http url, by position; a url is taken without the blanks around it, and as it stands."""
    rows = rows.withColumn(url, F.regexp_replace(url, r"^\s+|\s+$", ""))
    keep = F.col(url).startswith("http")
    pdf = F.lower(url).endswith(".pdf")
    if only_pdfs:
        keep &= pdf
    if only_html:
        keep &= ~pdf
    first = Window.partitionBy(url).orderBy(order)
    return rows.where(keep).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def clean_history(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", last: int = 6, length: int = 700) -> DataFrame:
    """The last messages of each conversation, then those of known roles, trimmed, cut, not blank."""
    recent = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = messages.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= last).where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    content = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, length)
    return kept.select(conversation, turn, "role", content.alias("content")).where("content <> ''")


def clamp_page(page: Column, last: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), last)


def clean_question(c: Column | str, length: int = 500) -> Column:
    """Trimmed and cut; blank questions become null."""
    return F.nullif(F.substring(F.trim(col(c)), 1, length), F.lit(""))


def audit_listing(sources: DataFrame) -> DataFrame:
    """Active sources in the order in which an audit goes through them."""
    return sources.where("active").orderBy("tier", "slug")
