"""Incremental upserts and counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts by key hash that a target is kept in; a batch rewrites only those that it has rows for.
BUCKETS = 64


def windowed_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts by event-time window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def present(seen: DataFrame, user: str, at: str, now: Column, window: str = "300 seconds") -> DataFrame:
    """One row: how many users were last seen within a window before now."""
    last = seen.groupBy(user).agg(F.max(at).alias("last"))
    return last.agg(F.count_if((F.col("last") > now - F.expr(f"INTERVAL {window}")) & (F.col("last") <= now)).alias("n_present"))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def latest_by_user(spark: SparkSession, source: DataFrame, target: str, checkpoint: str) -> None:
    """Each batch is merged into the target by user, the latest event wins.

    The target has a folder for each bucket of users, in it one for each batch that changed the bucket: a batch reads the newest version of the
    buckets that it has rows for and writes their next, so its cost is that of these buckets. A batch that runs again writes the same folders once more.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = _latest(batch)
        touched = [r.bucket for r in new.select(_bucket("user_id").alias("bucket")).distinct().collect()]  # at most BUCKETS
        versions = {b: v for b, v in _versions(spark, target, batch_id).items() if b in touched}
        if versions:
            old = spark.read.schema(new.schema).parquet(*[f"{target}/bucket={b}/batch={v}" for b, v in versions.items()])
            new = _latest(old.unionByName(new))
        new.withColumns({"bucket": _bucket("user_id"), "batch": F.lit(batch_id)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)

    source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _latest(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def _versions(spark: SparkSession, target: str, before: int) -> dict[int, int]:
    """For each bucket the newest batch before one that wrote it, from the names of folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/batch=*")
    found: dict[int, int] = {}
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        bucket, batch = (int(part.split("=")[1]) for part in status.getPath().toString().split("/")[-2:])
        if batch < before:
            found[bucket] = max(found.get(bucket, -1), batch)
    return found


def current(spark: SparkSession, target: str) -> DataFrame:
    """The target's rows as of its newest batches."""
    versions = _versions(spark, target, 1 << 62)
    return spark.read.parquet(*[f"{target}/bucket={b}/batch={v}" for b, v in sorted(versions.items())])
