"""Tables that cut lineage, in the folder that all executors share, and keys that tell equal rows apart."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one in local mode, and an error on a cluster.

    Executors of a cluster would each write to a disk of their own, and nothing could be read back.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark then removes a query's shuffle files when the query ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: By session, how many writes go on and what CLEANUP was before the first of them.
_writing: dict[int, tuple[int, str | None]] = {}


def _begin(spark: SparkSession) -> None:
    with _lock:
        n, before = _writing.get(id(spark), (0, None))
        if not n:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing[id(spark)] = (n + 1, before)


def _end(spark: SparkSession) -> None:
    with _lock:
        n, before = _writing.pop(id(spark))
        if n > 1:
            _writing[id(spark)] = (n - 1, before)
        elif before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table as written to the shared folder and read back: an executor's loss costs no more than the running stage.

    Shuffle files of the write aren't needed after it and go at once.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    _begin(spark)
    try:
        df.write.parquet(path)
    finally:
        _end(spark)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ddl(df: DataFrame, *more: str) -> str:
    """Schema string of a table and further columns, for mapInArrow."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """The table with its columns of these names renamed, in place, so that an operator's own columns of that name don't replace them."""
    taken = {n.lower() for n in names}
    return docs.toDF(*[fresh([*docs.columns, *names], f"__{c}")[0] if c.lower() in taken else c for c in docs.columns])


def numbered(docs: DataFrame, keys: tuple[str, ...], copy: str, counted: DataFrame | None = None) -> DataFrame:
    """The table with a long column `copy` that tells rows with equal keys (nulls equal too) apart: 0 for one of them, another number for each other.

    Rows whose keys repeat are found by a count of the keys alone. Only they, if there are any, are written with a number of their own, so
    that a task that runs again finds the same numbers. `counted`, where it is given, has the keys of all rows, in the same
    order, and then how many rows each of its own stands for.
    """
    uid, n, k = fresh(docs.columns, "__uid", "__n", "__key")
    keyed = docs.withColumn(k, F.struct(*quoted(keys)))
    counted = (docs.select(*quoted(keys), F.lit(1)) if counted is None else counted).toDF(*keys, n)
    again = counted.groupBy(*quoted(keys)).agg(F.sum(n).alias(n)).filter(F.col(n) > 1).select(F.struct(*quoted(keys)).alias(k))
    again = written(again, "repeated-keys")
    if again.isEmpty():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    one, many = (keyed.join(again, k, how).drop(k) for how in ("left_anti", "left_semi"))
    many = written(many.withColumn(uid, F.monotonically_increasing_id() + 1), "repeated-rows")
    first = many.groupBy(F.struct(*quoted(keys)).alias(k)).agg(F.min(uid).alias(uid)).select(uid, F.lit(0).cast("long").alias(n))
    many = many.join(first, uid, "left").withColumn(copy, F.coalesce(n, uid))
    return one.withColumn(copy, F.lit(0).cast("long")).unionByName(many.select(*quoted(docs.columns), copy))
