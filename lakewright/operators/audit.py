"""Audits: what a null field means, how much of a source a stored text has, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.batches import bag_recall, searches
from ..functions.text import common_share, flat, is_corrupt, spacing, squeeze
from ..shared import broadcast_few

#: Answered documents up to which their quotes are broadcast to the pages.
FEW_ANSWERS = 500_000

# --- Fixed values: lexical evidence of each field. ---
EVIDENCE = {
    "fee_amount": r"(?:₹|rs\.?|inr)\s*[\d,]+|\b(?:fee|charge|cost|amount payable)\b[^.\n]{0,60}?[\d,]+|\bno fee\b|\bfree of cost\b|\bnil\b",
    "fee_notes": r"\b(fee|charge|concession|waiver|exempt)\w*\b",
    "documents_required": r"\bdocuments?\s+(?:required|needed)\b|\brequired documents?\b|\b(?:aadhaar|voter\s*id|ration card|passport size photo)\b",
    "who_is_eligible": r"\beligib\w+|\bwho can apply\b|\bcriteria\b|\bqualif\w+\b|\bapplicant (?:should|must)\b",
    "how_to_apply": r"\bhow to apply\b|\bapplication process\b|\bstep\s*\d|\bprocedure\b|\bregistration process\b",
    "processing_time": r"\b\d+\s*(?:working\s*)?(?:day|week|month)s?\b|\bwithin\s+\d+|\bprocessing time\b|\btimeline\b",
    "validity": r"\bvalid(?:ity)?\s+(?:for|up\s?to|till|until)\b|\bexpir\w+|\brenew\w+\b",
    "helpline": r"\b(?:1800|1[89]\d{2})[\s-]?\d{3,}|\bhelpline\b|\btoll[\s-]?free\b|\b\+?91[\s-]?\d{10}\b|\b\d{3,5}[\s-]\d{6,8}\b",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "office_address": r"\b(?:address|office|directorate|bhavan|bhawan|room no|floor)\b|\b\d{6}\b",
    "grievance_route": r"\bgrievance\b|\bcomplaint\b|\bappeal\b|\bombudsman\b|\bcpgrams\b",
    "online_url": r"https?://\S+",
    "ministry": r"\bministry\b|\bdepartment\b|\bdirectorate\b",
    "what_it_is": r"\b(scheme|service|programme|program|yojana|award)\b",
}
# --- End of fixed values. ---
ABSENT, MISSED, UNCERTAIN = "confirmed_absent", "missed", "uncertain"


def has_evidence(field: Column, text: Column) -> Column:
    out = F.lit(False)
    for name, pattern in EVIDENCE.items():
        out = F.when(field == name, text.rlike(f"(?iu){pattern}")).otherwise(out)
    return out


def verdict(evidence: Column, answered: Column, stated: Column, on_page: Column, matches: Column) -> Column:
    """What a null field means.  A claim without a quote on the page is uncertain."""
    return (
        F.when(~evidence, ABSENT)
        .when(~answered, UNCERTAIN)
        .when(~F.coalesce(stated, F.lit(False)), ABSENT)
        .when(~F.coalesce(on_page, F.lit(False)), UNCERTAIN)
        .when(matches, MISSED)
        .otherwise(ABSENT)
    )


#: The evidence of every field in a text, in one pass over a batch of texts.
evidence = searches(EVIDENCE)


def null_audit(nulls: DataFrame, answers: DataFrame) -> DataFrame:
    """audit_pages() of rows with one null field each: (doc_id, field, page)."""
    return audit_pages(nulls.select("doc_id", F.array("field").alias("fields"), "page"), answers)


def audit_pages(pages: DataFrame, answers: DataFrame, quoted: int = 60) -> DataFrame:
    """(doc_id, field, evidence, verdict) of the null fields of (doc_id, fields, page).

    `answers` (doc_id, field, stated, quote) are recorded replies to targeted questions.
    The text is read once a page: evidence of its null fields and the presence of its
    quotes are found there, and only flags are exploded.  Quotes come to the pages by
    broadcast while they are few, else the two meet by document.
    """
    said = F.col("stated") & (F.col("quote") != "")
    needle = F.when(said, F.substring(flat("quote"), 1, quoted))
    match = F.coalesce(F.when(said, has_evidence(F.col("field"), F.col("quote"))), F.lit(False))
    told = answers.select("doc_id", F.struct("field", "stated", needle.alias("needle"), match.alias("match")).alias("x"))
    told = told.groupBy("doc_id").agg(F.collect_list("x").alias("told"))
    met = pages.join(broadcast_few(told, FEW_ANSWERS), "doc_id", "left")
    met = met.withColumn("flat", F.when(F.col("told").isNotNull(), flat("page")))
    # Named twice, so that the page is flattened once and not for each quote.
    here = F.transform("told", lambda t: F.struct(t["field"].alias("field"), t["stated"].alias("stated"), t["match"].alias("match"), F.col("flat").contains(t["needle"]).alias("here")))
    met = met.withColumn("seen", evidence(F.col("page")))
    found = [F.when(F.array_contains("fields", name), F.struct(F.lit(name).alias("field"), F.col("seen")[name].alias("evidence"))) for name in EVIDENCE]
    other = F.filter("fields", lambda f: ~f.isin(list(EVIDENCE)))
    flags_ = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.transform(other, lambda f: F.struct(f.alias("field"), F.lit(False).alias("evidence"))))
    flagged = met.select("doc_id", F.when(F.col("flat").isNotNull(), here).alias("told"), F.explode_outer(flags_).alias("x")).where("x is not null")
    rows = flagged.select("doc_id", "x.field", "x.evidence", F.get(F.filter("told", lambda t: t["field"] == F.col("x.field")), F.lit(0)).alias("answer"))
    judged = verdict(F.col("evidence"), F.col("answer").isNotNull(), F.col("answer.stated"), F.col("answer.here"), F.coalesce("answer.match", F.lit(False)))
    return rows.select("doc_id", "field", "evidence", judged.alias("verdict"))


#: How a quote finds its pages: by three words in a row, by one word, by its first characters (as many).
PHRASE, WORD, CHARS = 5, 4, 3


def find_quotes(pages: DataFrame, quotes: DataFrame, page_id: str, quote_id: str, text: str = "text", quote: str = "quote", length: int = 60) -> DataFrame:
    """(quote_id, page_id) of quotes whose first characters are on a page, white space and case aside.

    Inner words of a quote's start stand whole on any page that has it, so an equality
    join finds the candidates, which are then searched: of five words or more by the
    second to fourth in a row, of three or four by the second, of fewer by the first
    CHARS characters.  Pages are read once for each of these kinds that the quotes have.
    """
    flat = lambda c: F.lower(squeeze(c))
    run = lambda w, i, n, between: F.concat_ws(between, *[F.get(w, i + k) for k in range(n)])
    needles = quotes.select(quote_id, F.substring(flat(quote), 1, length).alias("needle")).where("needle <> ''")
    words = F.split("needle", " ")
    kind = F.when(F.size(words) >= 5, PHRASE).when(F.size(words) >= 3, WORD).otherwise(F.least(F.length("needle"), F.lit(CHARS)))
    anchor = F.when(kind == PHRASE, run(words, F.lit(1), 3, " ")).when(kind == WORD, F.get(words, F.lit(1))).otherwise(F.substring("needle", 1, CHARS))
    needles = needles.select(quote_id, "needle", kind.alias("kind"), anchor.alias("anchor"))
    # The pieces are a column of their own: an expression inside the lambda would be split for every piece.
    own, found = F.col("own"), None
    for k in sorted(r.kind for r in needles.select("kind").distinct().collect()):  # five kinds at most
        pieces = F.split(flat(text), " ") if k in (PHRASE, WORD) else F.regexp_extract_all(flat(text), F.lit("(?s)."), F.lit(0))
        n, between = (3, " ") if k == PHRASE else (1, "") if k == WORD else (k, "")
        grams = F.array_distinct(F.transform(own, lambda _, i: run(own, i, n, between)))  # noqa: B023
        placed = pages.select(page_id, pieces.alias("own")).select(page_id, F.explode(grams).alias("anchor"))
        near = placed.join(needles.where(F.col("kind") == k), "anchor").select(page_id, quote_id, "needle")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return pages.select(page_id).limit(0).join(needles.select(quote_id).limit(0), F.lit(True)).select(quote_id, page_id)
    met = pages.select(page_id, flat(text).alias("flat")).join(found, page_id).where(F.col("flat").contains(F.col("needle")))
    return met.select(quote_id, page_id).distinct()


def token_recall(pairs: DataFrame, key: str = "doc_id", stored: str = "stored", source: str = "source") -> DataFrame:
    """(key, recall, extra) of each row: share of the source's tokens that are stored, and of the stored ones that are not the source's.

    Tokens are bags, met inside the row: nothing is shuffled.
    """
    return pairs.select(key, bag_recall(F.col(stored), F.col(source)).alias("x")).select(key, "x.recall", "x.extra")


def flags(recall: Column, text: Column) -> Column:
    """Names of what is wrong with a stored text."""
    lex = common_share(text)
    found = F.array(
        F.when(recall < 90, "low_recall"),
        F.when(is_corrupt(spacing(text)), "boundaries"),
        F.when((lex["common_pct"] < 4) & (lex["words"] > 200), "not_prose"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def link_bucket(status: Column, strict_error: Column, error: Column) -> Column:
    """ok, http_error, tls_broken, dns_fail, timeout, refused or unreachable, of a recorded check."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status.between(200, 399) & strict_error.isNull(), "ok")
        .when(status >= 400, "http_error")
        .when(status.isNotNull(), "tls_broken")
        .when(low.rlike("name or service not known|nodename nor servname|getaddrinfo|temporary failure in name"), "dns_fail")
        .when(low.rlike("timed out|timeout"), "timeout")
        .when(low.contains("connection refused"), "refused")
        .otherwise("unreachable")
    )


def method_summary(measures: DataFrame, method: str = "method", *values: str) -> DataFrame:
    """Interpolated medians of each method, and its failures (all values null)."""
    failed = F.count_if(F.coalesce(*values).isNull()).alias("failed")
    return measures.groupBy(method).agg(*[F.median(v).alias(f"median_{v}") for v in values], failed)
