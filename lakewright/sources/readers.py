"""Readers of feeds, captures and registries; schemas are explicit, bad lines are dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import content_hash, embedded_json, find_results, find_total
from ..operators.dedup import first_by, newest_ok
from ..schemas import schema


def jsonl(spark: SparkSession, path: str | list[str], name: str, position: bool = False) -> DataFrame:
    """A JSON-lines feed of a known schema; malformed and blank lines are skipped.

    `position` adds where a line stands: file, split, and a number that grows inside
    the split.  Splits are dealt by size, so a bare row number would not follow the feed.
    """
    rows = spark.read.schema(schema(name)).option("mode", "DROPMALFORMED").json(path)
    if not position:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("position"))


def catalogue_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row a slug, the first; blank slugs are dropped."""
    rows = jsonl(spark, path, "catalogue_feed", position=True).where(F.trim("slug") != "")
    return first_by(rows, ["slug"], "position").drop("position")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """The newest successful capture of each slug."""
    return newest_ok(jsonl(spark, path, "page_feed", position=True)).drop("position")


def static_captures(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """The first long enough document of each url, with a hash of its text."""
    rows = jsonl(spark, path, "static_feed", position=True).where(F.length("text") >= least)
    return first_by(rows, ["url"], "position").drop("position").withColumn("content_hash", content_hash("text"))


def registry(spark: SparkSession, specs: Iterable[dict]) -> DataFrame:
    """Source specifications as rows; keys outside of the schema go to `extra`."""
    known = [f.name for f in schema("sources") if f.name != "id"]
    fields = [f for f in schema("sources").fields if f.name != "id"]
    from pyspark.sql.types import MapType, StringType, StructField, StructType

    rows = [(*[s.get(k) for k in known], {k: str(v) for k, v in s.items() if k not in known}) for s in specs]
    return spark.createDataFrame(rows, StructType([*fields, StructField("extra", MapType(StringType(), StringType()))]))


def yaml_registry(spark: SparkSession, path: str) -> DataFrame:
    """registry() of a YAML file with a list of sources, where PyYAML is installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f)
    return registry(spark, held.get("sources", held) if isinstance(held, dict) else held)


def api_pages(responses: DataFrame, body: str = "body", page_size: int = 10) -> DataFrame:
    """Captured JSON responses with their items, total, and whether a page is the last one."""
    out = responses.withColumn("items", find_results(F.col(body))).withColumn("total", find_total(F.col(body)))
    return out.withColumn("is_last", F.coalesce(F.size("items"), F.lit(0)) < page_size)


def api_scan(responses: DataFrame, scan: str = "scan", page: str = "page", body: str = "body", page_size: int = 10) -> DataFrame:
    """The captured pages that a scan takes: up to the first short one, or the one that reaches the total."""
    w = Window.partitionBy(scan).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.size("items"), F.lit(0))
    seen = api_pages(responses, body, page_size).withColumn("__seen", F.sum(n).over(w))
    ends = F.col("is_last") | F.coalesce(F.col("__seen") >= F.first("total", ignorenulls=True).over(w), F.lit(False))
    ended = seen.withColumn("__end", ends).withColumn("__ends", F.sum(F.col("__end").cast("int")).over(w))
    taken = ended.where((F.col("__ends") == 0) | (F.col("__end") & (F.col("__ends") == 1)))
    return taken.withColumn("is_last", F.col("__end")).drop("__seen", "__end", "__ends")


def api_items(responses: DataFrame, item_schema: str, body: str = "body") -> DataFrame:
    """One row an item of captured responses."""
    kept = [c for c in responses.columns if c != body]
    return responses.select(*kept, F.explode(find_results(F.col(body))).alias("__item")).select(*kept, F.from_json("__item", item_schema).alias("item")).select(*kept, "item.*")


def embedded(pages: DataFrame, key: str, item_schema: str, html: str = "html") -> DataFrame:
    """One row an object of the keyed list that a page embeds."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.explode(embedded_json(html, key)).alias("__item")).select(*kept, F.from_json("__item", item_schema).alias("item")).select(*kept, "item.*")


def resume_offset(cache: DataFrame, key: str, page_size: int) -> Column:
    """Where a paged scan goes on: whole pages of distinct keys already held."""
    return cache.agg((F.floor(F.countDistinct(key) / page_size) * page_size).alias("offset"))
