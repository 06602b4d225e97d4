"""A work queue as snapshots, and quotas over a request log.

A snapshot transition is a pure function of the queue; concurrent claims that are safe
against each other need a store with transactions, which plain Parquet is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.records import queue_tier

MAX_ATTEMPTS = 2


def enqueue(queue: DataFrame, documents: DataFrame, catalogue: DataFrame, tier: int, as_of: Column) -> DataFrame:
    """Pending rows for documents that have none; those of a known ministry first in line."""
    new = documents.join(queue.select(F.col("raw_document_id").alias("id")), "id", "left_anti")
    known = catalogue.select(F.col("slug").alias("__slug"), "ministry")
    met = new.join(known, F.col("meta")["slug"] == F.col("__slug"), "left")
    return met.select(F.col("id").alias("raw_document_id"), queue_tier(F.col("ministry"), tier).alias("tier"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), as_of.alias("created_at"))


def next_tasks(queue: DataFrame, n: int) -> DataFrame:
    """Ids of the next n pending tasks by tier and id."""
    return queue.where("status = 'pending'").orderBy("tier", "id").limit(n).select("id")


def claim(queue: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The queue with the next n tasks in flight."""
    taken = F.broadcast(next_tasks(queue, n).withColumn("__taken", F.lit(True)))  # n rows
    met = queue.join(taken, "id", "left")
    mine = F.coalesce("__taken", F.lit(False))
    return met.withColumns({"status": F.when(mine, "in_flight").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "claimed_at": F.when(mine, as_of).otherwise(F.col("claimed_at"))}).drop("__taken")


def release(queue: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The queue after results (id, new_status, error, model); only done tasks get a completion time."""
    met = queue.join(results, "id", "left")
    told = F.col("new_status").isNotNull()
    return met.withColumns(
        {
            "completed_at": F.when(F.col("new_status") == "done", as_of).otherwise(F.col("completed_at")),
            "last_error": F.when(told, F.substring("error", 1, 500)).otherwise(F.col("last_error")),
            "model_used": F.when(told, F.col("model")).otherwise(F.col("model_used")),
            "status": F.coalesce("new_status", "status"),
        }
    ).drop("new_status", "error", "model")


def reclaim(queue: DataFrame) -> DataFrame:
    """Tasks left in flight are pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "in_flight", "pending").otherwise(F.col("status")))


def outcome_status(outcome: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Next status: quota hands back, an unreadable body parks, a bad answer is tried `most` times."""
    return F.when(outcome == "ok", "done").when(outcome == "quota", "pending").when(outcome == "unreadable", "parked").when(attempts >= most, "parked").otherwise("pending")


def quota_use(requests: DataFrame, cap: int, ts: str = "ts", key: str | None = None, order: str = "event_id") -> DataFrame:
    """requests with their number on their UTC day and whether the cap allows them."""
    day = F.to_date(ts)
    w = Window.partitionBy(*([key] if key else []), day).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("used", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("used") <= cap)


def quota_summary(requests: DataFrame, cap: int, ts: str = "ts") -> DataFrame:
    """(day, requests, used, refused, remaining) without ordering any day's rows."""
    n = F.count(F.lit(1))
    return requests.groupBy(F.to_date(ts).alias("day")).agg(n.alias("requests"), F.least(n, F.lit(cap)).alias("used"), F.greatest(n - cap, F.lit(0)).alias("refused"), F.greatest(cap - n, F.lit(0)).alias("remaining"))


def net_use(log: DataFrame, cap: int, ts: str = "ts", amount: str = "amount") -> DataFrame:
    """(day, used, over): reservations less refunds, never below zero."""
    total = F.greatest(F.sum(amount), F.lit(0))
    return log.groupBy(F.to_date(ts).alias("day")).agg(total.alias("used"), (total > cap).alias("over"))


def bucket_waits(requests: DataFrame, rate_per_min: float, ts: str = "ts", key: str = "user_id", order: str = "event_id", burst: int | None = None) -> DataFrame:
    """requests with the seconds each waits for a token of its key's bucket.

    The bucket starts full, with `burst` tokens (a minute's), and refills at the rate.  With
    s seconds a token, request i (from 0) is served at t(i) = max(arrival(i), best over
    j <= i of arrival(j) + (i - j - burst + 1) * s), so a running maximum of
    arrival(j) - j * s answers it without a sequential fold.
    """
    s, full = 60.0 / rate_per_min, burst or int(rate_per_min)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    # A key may hold a large share of all requests: its days are ordered apart, and meet by one row a day.
    head = requests.withColumn("__at", at).withColumn("__day", F.to_date(ts))
    day = Window.partitionBy(key, "__day").orderBy(ts, order)
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    numbered = head.withColumn("__i", F.row_number().over(day) - 1)
    counted = head.groupBy(key, "__day").agg(F.count(F.lit(1)).alias("__n"))
    starts = counted.select(F.col(key).alias("__key"), F.col("__day").alias("__on"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    met = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__day").eqNullSafe(F.col("__on"))).drop("__key", "__on")
    placed = met.withColumn("__i", F.col("__i") + F.col("__start")).withColumn("__lead", F.col("__at") - F.col("__i") * s)
    most = placed.groupBy(key, "__day").agg(F.max("__lead").alias("__most"))
    ahead = most.select(F.col(key).alias("__key"), F.col("__day").alias("__on"), F.max("__most").over(before).alias("__ahead"))
    met = placed.withColumn("__lead", F.max("__lead").over(day.rowsBetween(Window.unboundedPreceding, 0))).join(ahead, F.col(key).eqNullSafe(F.col("__key")) & F.col("__day").eqNullSafe(F.col("__on")))
    lead = F.greatest("__lead", "__ahead")  # greatest() passes over null
    wait = lead + (F.col("__i") - full + 1) * s - F.col("__at")
    return met.withColumn("waited", F.round(F.greatest(wait, F.lit(0.0)), 3)).drop("__at", "__i", "__day", "__start", "__lead", "__ahead", "__key", "__on")
