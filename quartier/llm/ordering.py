"""Places of rows in the order of their group, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.llm.store import fresh, quoted, written


def placed(rows: DataFrame, group: str, order: tuple[str, ...], name: str) -> DataFrame:
    """The rows with `pos`, their place from 0 in their group, and `n`, the rows of the group. Nulls come first; ties are told apart by where they were read.

    Rows are dealt by ranges of group and order, so a group that holds a third of all rows lies in many tasks. They are written in that order, once; what comes
    before a task's share of a group is a running sum over at most as many rows as there are tasks.
    """
    uid, at, part, first, before = fresh([*rows.columns, "pos", "n"], "__uid", "__at", "__part", "__first", "__before")
    keys = quoted((group, *order, uid))
    dealt = rows.withColumn(uid, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = written(dealt.drop(uid).withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(at, 33))
    shares = own.groupBy(group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    shares = shares.withColumn(before, F.sum("n").over(W.partitionBy(group).orderBy(part)) - F.col("n")).withColumn("n", F.sum("n").over(W.partitionBy(group)))
    return own.join(shares, [group, part]).select(*quoted(rows.columns), (F.col(at) - F.col(first) + F.col(before)).alias("pos"), "n")
