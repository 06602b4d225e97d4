"""Columns derived from catalogue rows and extracted records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, clip, col

# --- Fixed values: the fields that count, and the labels of a snippet. ---
CONTENT_FIELDS = (
    "what_it_is who_is_eligible exclusions documents_required fee_amount fee_notes how_to_apply application_modes "
    "online_url processing_time validity helpline email office_address grievance_route ministry"
).split()
LIST_FIELDS = {"documents_required", "how_to_apply", "application_modes", "colloquial_names", "fields_not_stated"}
NUMBER_FIELDS = {"fee_amount"}
NOT_EXTRACTED = "(details not extracted yet — only the official summary below is available)"
# --- End of fixed values. ---


def is_filled(value: Column, kind: str = "text") -> Column:
    """Not null, not an empty list, not an empty text; zero and false are filled."""
    if kind == "list":
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull() & (value != "") if kind == "text" else value.isNotNull()


def field_kind(name: str) -> str:
    return "list" if name in LIST_FIELDS else "number" if name in NUMBER_FIELDS else "text"


def confidence(payload: Column) -> Column:
    """Share of the content fields that are filled, to three places; 0 when the page is about no service."""
    filled = F.lit(0)
    for name in CONTENT_FIELDS:
        filled = filled + F.coalesce(is_filled(payload[name], field_kind(name)), F.lit(False)).cast("int")
    return F.when(F.coalesce(payload["page_is_about_a_service"], F.lit(True)), F.bround(filled / F.lit(len(CONTENT_FIELDS)), 3)).otherwise(F.lit(0.0))


def record_key(source: Column | str, slug: Column, number: Column) -> Column:
    """source:slug, or source:doc<number> where there is no slug."""
    return F.concat(col(source), F.lit(":"), F.coalesce(blank_to_null(slug), F.concat(F.lit("doc"), number.cast("string"))))


def strip_key(key: Column | str, source: str) -> Column:
    return F.replace(col(key), F.lit(f"{source}:"), F.lit(""))


def best_name(model: Column, title: Column, url: Column) -> Column:
    """struct(name, name_from): the model's name, else the source's title, else the url's last part."""
    last = F.try_element_at(F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda x: x != ""), F.lit(-1))
    model, title = blank_to_null(F.trim(model)), blank_to_null(F.trim(title))
    return F.struct(F.coalesce(model, title, last).alias("name"), F.when(model.isNotNull(), "model").when(title.isNotNull(), "title").otherwise("url").alias("name_from"))


def display_state(value_filled: Column, extracted: Column, archived: Column) -> Column:
    """present, source_silent, not_read_yet or page_unavailable."""
    return F.when(extracted & value_filled, "present").when(extracted, "source_silent").when(archived, "not_read_yet").otherwise("page_unavailable")


def is_detailed(payload: Column) -> Column:
    """Says who qualifies, and the documents or the steps; missing lists do not count."""
    listed = (F.size(payload["documents_required"]) > 0) | (F.size(payload["how_to_apply"]) > 0)
    return payload["who_is_eligible"].isNotNull() & F.coalesce(listed, F.lit(False))


def searchable(title: Column, description: Column, tags: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(F.array_join(tags, " "), F.lit("")))


def catalogue_text(title: Column, description: Column, tags: Column, limit: int = 1000) -> Column:
    """Title, description and tags that exist, joined by a dash, cut."""
    return clip(F.concat_ws(" — ", blank_to_null(title), blank_to_null(description), blank_to_null(F.array_join(tags, ", "))), limit)


def rules_text(name: Column, payload: Column, limit: int = 1500) -> Column:
    """The rules of a record as text; empty when it has none."""
    said = [blank_to_null(payload["who_is_eligible"]), blank_to_null(payload["what_it_is"])]
    said += [blank_to_null(F.array_join(payload[f], "; ")) for f in ("documents_required", "how_to_apply", "application_modes")]
    any_said = F.coalesce(*said).isNotNull()
    return F.when(any_said, clip(F.concat_ws(" — ", blank_to_null(name), *said), limit)).otherwise(F.lit(""))


def snippet(title: Column, ministry: Column, categories: Column, description: Column, payload: Column, limit: int = 1400) -> Column:
    """Labelled lines of a record for a prompt; a fee of zero is left out, as any empty value."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), blank_to_null(value))
    listed = lambda f, sep="; ": F.array_join(payload[f], sep)
    head = [F.concat(F.lit("SCHEME: "), title), line("Ministry", ministry), line("Category", F.array_join(categories, ", "))]
    short = F.concat_ws("\n", *head, F.lit(NOT_EXTRACTED), line("Summary", description))
    fee = F.when(payload["fee_amount"].isNull(), payload["fee_notes"]).when(payload["fee_amount"] != 0, payload["fee_amount"].cast("string"))
    full = F.concat_ws(
        "\n",
        *head,
        line("What it is", F.coalesce(blank_to_null(payload["what_it_is"]), description)),
        line("Who is eligible", payload["who_is_eligible"]),
        line("NOT eligible", payload["exclusions"]),
        line("Documents required", listed("documents_required")),
        line("How to apply", listed("how_to_apply")),
        line("Apply by", listed("application_modes")),
        line("Fee", fee),
        line("Processing time", payload["processing_time"]),
        line("Helpline", payload["helpline"]),
        line("Email", payload["email"]),
    )
    return clip(F.when(payload.isNull(), short).otherwise(full), limit)


def split_exclusions(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "; "), lambda x: x != "")


def fee_display(amount: Column, notes: Column, length: int = 40) -> Column:
    return F.when(amount.isNotNull(), F.concat(F.lit("₹"), F.format_number(amount, 0))).otherwise(F.substring(notes, 1, length))


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit("?"))


def is_crawlable(active: Column, audited_at: Column, robots_allows: Column) -> Column:
    return active & audited_at.isNotNull() & F.coalesce(robots_allows, F.lit(False))


def document_ok(status: Column, text: Column) -> Column:
    return (status == "ok") & (F.length(text) > 100)


def page_ok(error: Column, text: Column) -> Column:
    return error.isNull() & (F.length(text) > 200)


def queue_tier(ministry: Column, tier: Column | int) -> Column:
    return F.when(ministry.isNotNull(), 0).otherwise(F.lit(tier) if isinstance(tier, int) else tier)


def provenance_in_range(provenance: Column, sources: Column) -> Column:
    """No field points outside of the record's sources."""
    return F.size(F.map_filter(provenance, lambda k, v: (v < 0) | (v >= F.size(sources)))) == 0


def source_of(field: str, provenance: Column, sources: Column) -> Column:
    return F.try_element_at(sources, F.try_element_at(provenance, F.lit(field)) + 1)


def is_answerable(field: str, value: Column, provenance: Column) -> Column:
    return is_filled(value, field_kind(field)) & F.map_contains_key(provenance, F.lit(field))


def level_has_state(level: Column, state: Column) -> Column:
    """State and district records name their state."""
    return ~F.coalesce(level.isin("state", "district"), F.lit(False)) | F.coalesce(state != "", F.lit(False))
