"""Streaming forms of the durable-state operators.

Each works on a streaming frame as on a batch one where Spark allows it, so the tests
hold a drained stream against the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_hash
from ..shared import exists


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(rows: DataFrame, ts: str = "completed_at", late: str | None = None) -> DataFrame:
    """(hour, n) by tumbling hours; `late` sets how long a stream waits for late rows."""
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n")


def first_copies(rows: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """Rows whose (url, content hash) was not seen before: a repeated load adds nothing."""
    return rows.withColumn("content_hash", content_hash(text)).dropDuplicates([url, "content_hash"])


def load_once(rows: DataFrame, target: str, checkpoint: str, keys: list[str]):
    """Append rows with new keys to a Parquet table, batch by batch; returns the query.

    A batch that is run again after a failure finds its own keys and adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # Only a missing table means that nothing is seen yet; a table that cannot be read stops the query.
        seen = spark.read.parquet(target).select(*keys) if exists(spark, target) else None
        new = batch.dropDuplicates(keys)
        (new.join(seen, keys, "left_anti") if seen is not None else new).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Write all that is available to a Parquet table and stop."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def quota_stream(requests: DataFrame, cap: int, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, day, used, refused) updates of a request stream, with state by key and day."""
    import pandas as pd

    def fold(group, frames, state):
        used = state.get[0] if state.exists else 0
        refused = state.get[1] if state.exists else 0
        for pdf in frames:
            room = min(len(pdf), max(0, cap - used))
            used, refused = used + room, refused + len(pdf) - room
        state.update((used, refused))
        yield pd.DataFrame({"key": [group[0]], "day": [group[1]], "used": [used], "refused": [refused]})

    rows = requests.select(F.col(key).cast("string").alias("key"), F.to_date(ts).alias("day"))
    return rows.groupBy("key", "day").applyInPandasWithState(fold, "key string, day date, used long, refused long", "used long, refused long", "update", "NoTimeout")
