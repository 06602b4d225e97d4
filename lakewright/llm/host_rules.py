"""Quality rules judged by host, in DataFrame functions only.

Each document is measured (words, symbols, repeated lines, words in repeated
three-word windows) and held against rules; the rules a document fails are summed by
host, and each host's failure rate of each rule is shrunk towards the corpus by a
beta prior fitted by moments over the hosts: with prior a, b a host with f failures in
n documents has rate (f + a) / (n + a + b).  A host is rejected when the shrunk rate
of any rule lies more than DEVIATIONS standard deviations of that prior above its mean
and is MIN_RATE or more, or when it exceeds MAX_RATE whatever the prior; its verdict
is joined back to its documents.  So in a corpus of like hosts none is rejected, and
among good hosts one of which a third or half of the documents fail is.

Defined cases: a null text has no words and fails the base rule; a null host is a
host of its own; with one host, or hosts that differ no more than chance allows, the
prior is as strong as the corpus, so every host has the corpus rate; an empty table
gives an empty result; a kept column named like a result is replaced by it, other
names do not matter.

Scale: texts never leave their task.  The measures, a few numbers a document, are
written once to the shared folder, since both the sums by host and the verdicts read
them; sums combine before the shuffle, and the join with hosts is left to the planner
with skew splitting unless the hosts are counted to be few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_broadcast, cut, own_name

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_RATE, MAX_RATE, DEVIATIONS = 0.3, 0.6, 2.0
FEW_HOSTS = 50_000

#: Names of the rules and when a document fails them, by its measures.
RULES: dict[str, Column | str] = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    t, w, l, s, r = (own_name(df, x) for x in ("text", "words", "lines", "windows", "again"))
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(t, SEPARATORS), lambda x: x != ""))
    df = df.withColumn(l, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Windows of three words as (hash, place), sorted so that equal ones are neighbours.
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn(s, F.sort_array(windows))
    met = F.filter(F.col(s), lambda x, i: (x["h"] == F.get(F.col(s), i - 1)["h"]) | (x["h"] == F.get(F.col(s), i + 1)["h"]))
    df = df.withColumn(r, F.sort_array(F.transform(met, lambda x: x["i"])))
    # A window covers its three words, less those that the next repeated window covers.
    steps = F.transform(F.col(r), lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col(r), i + 1) - x, F.lit(3))))
    measures = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
        "n_lines": F.size(l).cast("long"),
        "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"),
    }
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (t, w, l, s, r) and c not in measures]
    return df.select(*kept, *[v.alias(k) for k, v in measures.items()])


def shrunk_hosts(measured: DataFrame, host: str = "source", rules: dict[str, str] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """One row a host: n_docs, for each rule failed_<rule>, rate_<rule> (shrunk), limit_<rule>, and rejected."""
    rules = rules or RULES
    sums = [F.count(F.lit(1)).alias("n_docs")] + [F.count_if(F.expr(rule)).alias(f"failed_{k}") for k, rule in rules.items()]
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(*sums)
    # Moments over the hosts: mean rate m, and the variance beyond what sampling alone gives.
    moments = [F.sum("n_docs").alias("n_all")]
    for k in rules:
        rate = F.col(f"failed_{k}") / F.col("n_docs")
        moments += [(F.sum(f"failed_{k}") / F.sum("n_docs")).alias(f"m_{k}"), F.var_pop(rate).alias(f"v_{k}"), F.avg(1 / F.col("n_docs")).alias(f"s_{k}")]
    prior = hosts.agg(*moments)
    for k in rules:
        m = F.col(f"m_{k}")
        between = F.col(f"v_{k}") - m * (1 - m) * F.col(f"s_{k}")
        strength = F.when(between > 1e-12, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), "n_all")).otherwise(F.col("n_all"))
        spread = F.when(between > 1e-12, F.sqrt(between)).otherwise(F.lit(0.0))
        prior = prior.withColumn(f"strength_{k}", strength).withColumn(f"limit_{k}", F.least(F.lit(max_rate), F.greatest(F.lit(MIN_RATE), m + DEVIATIONS * spread)))
    prior = prior.select(*[f"{x}_{k}" for k in rules for x in ("m", "strength", "limit")])
    hosts = hosts.join(F.broadcast(prior))  # one row
    rates = {k: (F.col(f"failed_{k}") + F.col(f"m_{k}") * F.col(f"strength_{k}")) / (F.col("n_docs") + F.col(f"strength_{k}")) for k in rules}
    hosts = hosts.select("host", "n_docs", *[f"failed_{k}" for k in rules], *[v.alias(f"rate_{k}") for k, v in rates.items()], *[f"limit_{k}" for k in rules])
    over = F.lit(False)
    for k in rules:
        over = over | (F.col(f"rate_{k}") > F.col(f"limit_{k}"))
    return hosts.withColumn("rejected", over)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(df: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), rules: dict[str, str] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """`keep` columns with the measures, base_failed and kept for every row."""
    rules = rules or RULES
    keep = [c for c in keep if c not in RESULTS]
    # Under names of their own on the way, so that none meets a measure's.
    held = [f"kept {i}" for i in range(len(keep))]
    narrow = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, held)], F.col(f"`{host}`").alias("its host"), F.col(f"`{text}`").alias("its body"))
    measured = cut(measure(narrow, "its body").drop("its body"))
    hosts = shrunk_hosts(measured, "its host", rules, max_rate).select(F.col("host").alias("known"), "rejected")
    met = measured.join(bounded_broadcast(hosts, FEW_HOSTS), F.col("`its host`").eqNullSafe(F.col("known")), "left")
    base_failed = F.expr(rules["base"])
    return met.select(*[F.col(f"`{k}`").alias(c) for c, k in zip(keep, held)], *RESULTS[:5], base_failed.alias("base_failed"), (~base_failed & ~F.coalesce("rejected", F.lit(False))).alias("kept"))
