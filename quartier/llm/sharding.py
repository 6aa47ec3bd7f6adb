"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of their keys and texts. Pass two
brings each bucket into memory, shuffles it by Fisher-Yates (Spark's `shuffle`) and gives every record its
place in the whole order, from which the shards are cut in turn: their row counts are at most one apart.

A partition holds several buckets, so that partitions are much of one size, and MAX_PARTITIONS bounds their number however large the table is; a task
holds a bounded number of buckets and goes through the others one after the other, sorted.

Null keys are hashed like any other value; rows that share a key, or have none, are told apart by their texts, and rows that repeat in
every key and the text by a number, so they don't gather in one bucket. Empty and very long texts are records like others; a record is
never split, so a bucket may exceed its size by one record. An empty table gives an empty one. Extra columns stay; columns named
`shard` and `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.llm.store import fresh, numbered, quoted

LAW = "rows"
SHARDS = 16
SEED = 20_240_607
BUCKET_BYTES = 1 << 20
#: Buckets that a partition has on average, up to MAX_PARTITIONS partitions.
PER_PARTITION = 16
LEAST_BUCKETS = 64
#: More shuffle partitions than this weigh on the driver more than they help.
MAX_PARTITIONS = 20_000


def record_size() -> "F.Column":
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def bucket_of(keys: tuple[str, ...], seed: int, n_buckets: int) -> "F.Column":
    return F.pmod(F.xxhash64(F.lit(seed), *keys, "text"), F.lit(n_buckets)).cast("int")


def shuffled_shards(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The table's rows with `shard` and `slot`, which counts the rows of a shard from 0 in shuffled order.

    bucket_bytes bounds what one task holds in memory at once, on average; the number of buckets follows
    from the table's total size.
    """
    docs = docs.drop("shard", "slot")
    bucket, copy, hashed, before, rows, at, record, order = fresh(docs.columns, "__bucket", "__copy", "__hash", "__before", "__rows", "__at", "__record", "__order")
    total = docs.agg(F.coalesce(F.sum(record_size()), F.lit(0)), F.count(F.lit(1))).first()
    n_bytes, n_rows = int(total[0]), int(total[1])
    n_buckets = max(LEAST_BUCKETS, -(-n_bytes // bucket_bytes))
    n_parts = min(-(-n_buckets // PER_PARTITION), MAX_PARTITIONS)
    own = numbered(docs.withColumn(hashed, F.xxhash64("text")), (*keys, hashed), copy)
    scattered = own.withColumn(bucket, bucket_of((*keys, copy), seed, n_buckets))
    # rows before each bucket: within its partition, and in the partitions before, which are at most MAX_PARTITIONS
    counts = scattered.groupBy(F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("b") % n_parts)
    parts = counts.groupBy("p").agg(F.sum("n").alias("n")).select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("start"))
    inside = F.sum("n").over(W.partitionBy("p").orderBy("b")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(parts, "p").select(F.col("b").alias(bucket), (F.col("start") + F.col("inside")).alias(before))
    held = scattered.select(bucket, F.struct(F.xxhash64(F.lit(seed + 1), *keys, copy).alias(order), F.struct(*quoted(docs.columns)).alias(record)).alias(record))
    # the order of arrival must not matter, so that a task that runs again gives the same shuffle
    held = held.repartition(n_parts, bucket).groupBy(bucket).agg(F.array_sort(F.collect_list(record)).alias(rows))
    # nor must the order of buckets in a partition, along which Spark's generator of random places goes on
    placed = held.join(offsets.hint("shuffle_hash"), bucket).sortWithinPartitions(bucket).select(before, F.posexplode(F.shuffle(rows, seed)).alias(at, record))
    place = f"(`{before}` + `{at}`)"
    shard = f"({place} * {n_shards} div {max(n_rows, 1)})"
    first = f"(({n_rows} * {shard} + {n_shards - 1}) div {n_shards})"
    return placed.select(*[F.col(f"`{record}`.`{record}`.{c}") for c in quoted(docs.columns)], F.expr(shard).cast("int").alias("shard"), F.expr(f"{place} - {first}").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows keep their slots."""
    sharded.write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shuffled_shards(docs).select("doc_id", record_size().alias("size"), crc.cast("long").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
