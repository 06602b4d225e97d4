"""Sinks: content-addressed bodies, JSON lines and CSV, idempotent table loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_hash
from ..operators.dedup import insert_ignore, upsert

LIST_SEPARATOR = " | "


def bodies(rows: DataFrame, path: str, source: str = "source", text: str = "text") -> None:
    """Texts by source and the first two digits of their hash, each once.

    A folder's texts meet in one task, or few if they are large, so that there are about
    as many files as folders, however many tasks there are.
    """
    made = rows.select(F.col(source).alias("source"), content_hash(text).alias("content_hash"), F.col(text).alias("body")).dropDuplicates(["source", "content_hash"])
    placed = made.withColumn("prefix", F.substring("content_hash", 1, 2)).hint("rebalance", F.col("source"), F.col("prefix"))
    placed.write.mode("append").partitionBy("source", "prefix").parquet(path)


def flat(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, lists joined; columns that rows lack are null."""
    from pyspark.sql.types import ArrayType

    def one(c: str):
        if c not in rows.columns:
            return F.lit(None).cast("string").alias(c)
        return F.array_join(c, LIST_SEPARATOR).alias(c) if isinstance(rows.schema[c].dataType, ArrayType) else F.col(c)

    return rows.select(*[one(c) for c in columns])


def jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    flat(rows, columns).write.mode("overwrite").option("header", True).csv(path)


#: Rows up to which a report is one file.
REPORT_ROWS = 100_000


def report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, one file while it is counted to be small."""
    few = rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    (rows.coalesce(1) if few else rows).write.mode("overwrite").json(path)


def ndjson(events: DataFrame, event: str = "event") -> DataFrame:
    """Event rows as single lines of text."""
    return events.select(F.concat(F.col(event), F.lit("\n")).alias("line"))


def load_ignore(incoming: DataFrame, existing: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key a table does not have."""
    insert_ignore(existing, incoming, keys).write.mode("append").parquet(path)


def load_upsert(incoming: DataFrame, existing: DataFrame, path: str, keys: list[str], position: str, keep: list[str] | None = None) -> None:
    """Write a table's next version; `path` is not the one that `existing` is read from."""
    upsert(existing, incoming, keys, position, keep).write.mode("overwrite").parquet(path)


def sync_registry(existing: DataFrame, specs: DataFrame, audited: tuple[str, ...] = ("audited_at", "robots_allows", "robots_crawl_delay", "licence")) -> tuple[DataFrame, DataFrame]:
    """(registry, counts): specifications by slug; what audits found is never cleared."""
    old = existing.select("slug", F.struct(*[c for c in existing.columns if c != "slug"]).alias("__old"))
    met = specs.join(old, "slug", "left")
    held = [F.coalesce(F.col(c), F.col("__old")[c]).alias(c) if c in audited and c in existing.columns else F.col(c) for c in specs.columns]
    counts = met.agg(F.count_if(F.col("__old").isNull()).alias("created"), F.count_if(F.col("__old").isNotNull()).alias("updated"))
    return met.select(*held), counts
