"""Master-data operators: latest rows, merges, validity intervals, audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to as many tasks as a shuffle has: work of many steps a row on a table of few files would otherwise run in as many tasks as the table has blocks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: Parts into which rows of a join's key are dealt where a key may have very many.
DEALS = 32


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], deal_by: str) -> DataFrame:
    """An inner join whose keys may be few and have very many rows: left rows are dealt into DEALS parts of each key, and each part meets all the key's right rows."""
    a = left.withColumn("__deal", F.pmod(F.xxhash64(deal_by), F.lit(DEALS)))
    b = right.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    return a.join(b.hint("shuffle_hash"), [*on, "__deal"]).drop("__deal")


def agreeing_and_holding(left: DataFrame, right: DataFrame, name: str, text: str, part: str, deal_by: str) -> DataFrame:
    """Pairs of left rows (name, text) and right rows (name, part) that agree in the name, where the text holds the part. That is judged between distinct names, texts and parts; rows then meet by
    equality alone."""
    links = left.select(name, text).distinct().join(right.select(name, part).distinct(), name).filter(F.contains(text, part))
    return dealt_join(left.join(links.hint("merge"), [name, text]), right, [name, part], deal_by)


def once_per_value(df: DataFrame, values: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table with the columns that `work` adds to a table of some columns' distinct values, nulls included, so that equal rows cost the work once.

    The join is sorted, and none of its sides is broadcast: a table of derived texts is larger than its estimate.
    """
    done = work(df.select(*values).distinct())
    added = [c for c in done.columns if c not in values]
    other = done.toDF(*(f"__{c}" if c in values else c for c in done.columns)).hint("merge")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in values))
    return df.join(other, same).select(*df.columns, *added)


def merge_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], take: dict[str, str]) -> DataFrame:
    """Full outer merge: take names for each column how both values combine: greatest, new or old."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in take])
    how = {"greatest": lambda c: F.greatest(c, f"__{c}"), "new": lambda c: F.coalesce(f"__{c}", c), "old": lambda c: F.coalesce(c, f"__{c}")}
    return old.join(n, list(keys), "full_outer").select(*keys, *[how[h](c).alias(c) for c, h in take.items()])


def validity(df: DataFrame, key: str, order: Sequence[str], end: Column) -> DataFrame:
    """valid_from and valid_to of each version of a key, by the first column of the order; the last one is open."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("valid_from", F.col(order[0])).withColumn("valid_to", F.coalesce(F.lead(order[0]).over(w), end))


#: Percentiles are looked for between values whose ranks, by a sketch of this accuracy, are so many of its steps below and above.
ACCURACY, MARGIN = 10_000, 8


def percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(key, p): an array of exact percentiles by linear interpolation, nulls left out.

    A sketch, which is merged from all tasks, gives two values for each share between which its rank must lie, whatever the values are. What is below the first is counted, and
    only values between them, some thousandth of all, are ordered; no task holds all values of a key.
    """
    own = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("v"))
    step = MARGIN / ACCURACY
    around = F.array(F.lit(0.0), F.lit(1.0), *(F.lit(min(max(p + d, 0.0), 1.0)) for p in shares for d in (-step, step)))
    # of a key with few values all are ordered, as a step is no whole rank
    few = F.col("total") * step < 4
    sketch = own.groupBy(key).agg(F.percentile_approx("v", around, ACCURACY).alias("q"), F.count(F.lit(1)).alias("total"))
    counts = own.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n")).join(sketch, key)
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * p).alias("at"), F.get("q", F.when(few, 0).otherwise(2 * i + 2)).alias("lo"), F.get("q", F.when(few, 1).otherwise(2 * i + 3)).alias("hi")) for i, p in enumerate(shares)))
    each = counts.select(key, "v", "n", F.explode(wanted).alias("w")).select(key, "v", "n", "w.*").filter("v <= hi")
    below = each.filter("v < lo").groupBy(key, "i").agg(F.sum("n").alias("below"))
    inside = each.filter("v >= lo").join(below, [key, "i"], "left").withColumn("first", F.coalesce("below", F.lit(0)) + F.sum("n").over(W.partitionBy(key, "i").orderBy("v")) - F.col("n"))
    covers = lambda x: (x >= F.col("first")) & (x < F.col("first") + F.col("n"))
    value_at = inside.groupBy(key, "i", "at").agg(F.max(F.when(covers(F.floor("at")), F.col("v"))).alias("a"), F.max(F.when(covers(F.ceil("at")), F.col("v"))).alias("b"))
    # equal neighbours need no arithmetic, which infinities wouldn't stand
    found = value_at.withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))))
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(key, F.col("p.x").alias("p"))


def unambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter("__n = 1").drop("__n")


def conditional_counts(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def share(part: Column, whole: Column) -> Column:
    """Percent to two places; of nothing 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 2))
