"""Changes of tables as new tables: what an insert, update, merge or delete leaves. A caller writes the result to a new path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """The table and those new rows whose key it doesn't have; of new rows with equal keys the first in the order. A null key is never a conflict."""
    once = new.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or keys))))
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    fresh = once.filter((F.col("__rn") == 1) | nulls).drop("__rn").join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), stamp: Mapping[str, Column] | None = None) -> DataFrame:
    """New rows replace those with equal keys; columns in `keep` stay as they were, `stamp` gives columns of every row written."""
    changed = new.withColumns(dict(stamp or {}))
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__old"))
    written = changed.join(old, list(keys), "left")
    written = written.select(*[F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in table.columns])
    return table.join(new.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(written)


def upsert_counts(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys of the new rows are inserted, and how many updated."""
    mark = table.select(*keys).distinct().withColumn("__old", F.lit(True))
    return new.select(*keys).distinct().join(mark, list(keys), "left").agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old")).alias("updated"))


def update_from(table: DataFrame, source: DataFrame, keys: Sequence[str], sets: Mapping[str, Column | str]) -> DataFrame:
    """Columns of rows that have a source row are set to expressions of `s.` columns and their own; others stay. Source keys are distinct."""
    s = source.select(*keys, F.struct(*source.columns).alias("s"))
    joined = table.join(s, list(keys), "left")
    return joined.select(*[F.when(F.col("s").isNotNull(), F.expr(v) if isinstance(v, str) else v).otherwise(F.col(c)).alias(c) if (v := sets.get(c)) is not None else F.col(c) for c in table.columns])


def count_usage(table: DataFrame, calls: DataFrame, key: str, count: str, at: str, now: Column) -> DataFrame:
    """`count` goes up by one for each call that names the row, however often it does, and `at` is now. calls: call, key."""
    n = calls.filter(F.col(key).isNotNull()).select("call", key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    joined = table.join(n, key, "left")
    return joined.withColumns({count: F.coalesce(count, F.lit(0)) + F.coalesce("__n", F.lit(0)), at: F.when(F.col("__n").isNotNull(), now).otherwise(F.col(at))}).select(*table.columns)


def soft_delete(table: DataFrame, where: Column, flag: str = "is_deleted") -> DataFrame:
    """The flag of rows that the condition holds for is true; where it is null nothing changes."""
    return table.withColumn(flag, F.when(F.coalesce(where, F.lit(False)), True).otherwise(F.col(flag)))


def retain_newest(table: DataFrame, run: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the k newest runs, by run number, of all or of each group; a run's rows go or stay together."""
    runs = table.select(*by, run).distinct()
    if by:
        newest = runs.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(run)))).filter(F.col("__rn") <= k).drop("__rn")
    else:
        newest = runs.orderBy(F.desc_nulls_last(run)).limit(k)
    return table.join(newest, [*by, run], "left_semi")


def fill_column(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """The table with a column written from (key, column): added if it isn't there, and only where a value comes. Done twice, it changes nothing more."""
    v = values.select(key, F.col(column).alias("__v"))
    base = table if column in table.columns else table.withColumn(column, F.lit(None).cast(values.schema[column].dataType))
    return base.join(v, key, "left").withColumn(column, F.coalesce("__v", column)).drop("__v").select(*base.columns)


def remap_ids(table: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each of some id columns through one mapping (old_id, new_id) of distinct old ids; ids that aren't mapped, and nulls, stay."""
    for c in columns:
        m = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        table = table.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new").select(*table.columns)
    return table
