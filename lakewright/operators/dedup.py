"""First, newest and merged rows per key; sets of rows; idempotent loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import blank_to_null, content_hash, fold

# --- Fixed values: the place names that a listing is filtered by, and their other spellings. ---
CENTRAL = "Central"
STATES = [
    "Andaman and Nicobar Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chandigarh",
    "Chhattisgarh", "Dadra & Nagar Haveli and Daman & Diu", "Delhi", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jammu and Kashmir", "Jharkhand", "Karnataka", "Kerala", "Ladakh", "Lakshadweep",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Puducherry",
    "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand",
    "West Bengal",
]
STATE_ALIASES = {
    "pondicherry": "Puducherry",
    "orissa": "Odisha",
    "uttaranchal": "Uttarakhand",
    "nct of delhi": "Delhi",
    "delhi ncr": "Delhi",
    "national capital territory of delhi": "Delhi",
    "jammu and kashmir (ut)": "Jammu and Kashmir",
    "daman and diu and dadra and nagar haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra and nagar haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "daman and diu": "Dadra & Nagar Haveli and Daman & Diu",
    "the dadra and nagar haveli and daman and diu": "Dadra & Nagar Haveli and Daman & Diu",
    "andaman and nicobar": "Andaman and Nicobar Islands",
    "pondichery": "Puducherry",
}
# --- End of fixed values. ---


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def newest_ok(captures: DataFrame, key: str = "slug", stamp: str = "fetched_at", position: str = "position") -> DataFrame:
    """The newest successful row of each key; of equal stamps the earlier row, a missing stamp oldest."""
    return first_by(captures.where("ok"), [key], F.desc(F.coalesce(stamp, F.lit(""))), F.asc(position))


def newest_by_aggregate(rows: DataFrame, key: str, stamp: str, position: str, *columns: str) -> DataFrame:
    """newest_ok without a sort: a grouped maximum, which combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(F.col(stamp), -F.col(position)))
    return rows.groupBy(key).agg(best.alias("x")).select(key, *[f"x.{c}" for c in columns])


def long_enough(pages: DataFrame, least: int = 200, text: str = "text") -> DataFrame:
    return pages.where(F.length(text) >= least)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one a key, whose key does not exist yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], position: str, keep: list[str] | None = None) -> DataFrame:
    """existing with incoming's last row of each key written over it; `keep` columns stay where they exist."""
    last = first_by(incoming, keys, F.desc(position)).drop(position)
    names = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*names).alias("__old"))
    new = last.select(*keys, F.struct(*[F.col(c) if c in last.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in names]).alias("__new"))
    met = old.join(new, keys, "full_outer")
    held = lambda c: F.coalesce(F.col("__old")[c], F.col("__new")[c]) if c in (keep or []) else F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c])
    return met.select(*keys, *[held(c).alias(c) for c in names])


def merge_sources(rows: DataFrame, key: str, source: str, position: str, *columns: str) -> DataFrame:
    """One row a key: the first row's columns, and all its sources sorted and joined by commas."""
    grouped = rows.groupBy(key).agg(F.min_by(F.struct(*columns), position).alias("x"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))
    return grouped.select(key, *[f"x.{c}" for c in columns], "sources")


def fresh_keys(sweep: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return sweep.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def sweep_gains(sightings: DataFrame, keys: list[str], sweep: str = "sweep") -> DataFrame:
    """(sweep, new_keys): keys first seen in each sweep, sweeps without any among them."""
    first = sightings.groupBy(*keys).agg(F.min(sweep).alias(sweep))
    gains = first.groupBy(sweep).agg(F.count(F.lit(1)).alias("new_keys"))
    return sightings.select(sweep).distinct().join(gains, sweep, "left").select(sweep, F.coalesce("new_keys", F.lit(0)).alias("new_keys"))


def saturate(scan, keys: list[str], barren: int = 4, most: int = 40) -> tuple[DataFrame, int]:
    """Union of scan(0), scan(1), ... until `barren` of them in a row add nothing; and how many ran."""
    seen, idle, n = scan(0).dropDuplicates(keys), 0, 1
    while idle < barren and n < most:
        new = fresh_keys(scan(n), seen, keys).checkpoint()
        n += 1
        idle = idle + 1 if new.isEmpty() else 0
        seen = seen.unionByName(new)
    return seen, n


def exact_groups(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(content_hash, n, first_id): groups of equal texts."""
    return rows.groupBy(content_hash(text).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def merge_context(fresh: DataFrame, carried: DataFrame, conversation: str = "conv_id", key: str = "slug", position: str = "position", most: int = 6) -> DataFrame:
    """Fresh rows, then carried ones, each key once, as many as fit."""
    both = fresh.select(conversation, key, F.lit(0).alias("__from"), F.col(position).alias("__at")).unionByName(carried.select(conversation, key, F.lit(1).alias("__from"), F.col(position).alias("__at")))
    best = both.groupBy(conversation, key).agg(F.min(F.struct("__from", "__at")).alias("__first"))
    order = Window.partitionBy(conversation).orderBy("__first", key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(conversation, key, "rank")


def state_names(spark) -> DataFrame:
    """(folded, state), a fixed table."""
    from pyspark.sql import Row

    plain = spark.createDataFrame([Row(state=s) for s in STATES]).select(fold("state").alias("folded"), "state")
    other = spark.createDataFrame([Row(folded=k, state=v) for k, v in STATE_ALIASES.items()])
    return plain.unionByName(other)


def canonical_states(rows: DataFrame, raw: str, out: str = "canonical_state") -> DataFrame:
    """rows with the standard name of a place, null where no spelling matches."""
    names = F.broadcast(state_names(rows.sparkSession).withColumnRenamed("state", out))
    return rows.withColumn("__folded", fold(raw)).join(names, F.col("__folded") == F.col("folded"), "left").drop("__folded", "folded")


def state_from_page(pages: DataFrame, key: str = "slug", title: str = "title", text: str = "text") -> DataFrame:
    """(key, state): the place named by a line next to the title's, Central without one, null without the title."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(lines, F.trim(title))
    near = pages.select(key, F.when(F.trim(title) != "", at).alias("at"), F.array(F.get(lines, (at - 2).cast("int")), F.get(lines, at.cast("int"))).alias("near"))
    sides = near.select(key, "at", F.posexplode("near").alias("side", "line"))
    found = canonical_states(sides, "line").groupBy(key).agg(F.max("at").alias("at"), F.min_by("canonical_state", F.when(F.col("canonical_state").isNotNull(), F.col("side"))).alias("hit"))
    return found.select(key, F.when(F.col("at") > 0, F.coalesce("hit", F.lit(CENTRAL))).alias("state"))


def prefer(first: DataFrame, second: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """base with `value` from first, else from second, and where it came from."""
    met = base.join(first.select(key, F.col(value).alias("__a")), key, "left").join(second.select(key, F.col(value).alias("__b")), key, "left")
    return met.select(*base.columns, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), "page").when(F.col("__b").isNotNull(), "extraction").alias("came_from"))


def missing_keys(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    return dimension.join(facts, key, "left_anti")


def settled_counts(rows: DataFrame, key: str, ok: Column, settled: Column) -> DataFrame:
    return rows.agg(F.countDistinct(F.when(ok, F.col(key))).alias("captured"), F.countDistinct(F.when(settled, F.col(key))).alias("settled"))


def blank(c: str) -> Column:
    return blank_to_null(F.trim(c)).isNull()
