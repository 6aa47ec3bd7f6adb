"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.store import new_path, removed, written

#: Parts into which the rows of one key are dealt when something is looked up by the key.
SALTS = 8


def looked_up(rows: DataFrame, table: DataFrame, by: str, spread: Column, how: str = "left") -> DataFrame:
    """rows joined to the narrow table, whose keys are distinct; `spread` deals the rows of one key into SALTS tasks, and the table goes to all of them. Its part of a task is held, and nothing is sorted."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return dealt.join(copies.hint("shuffle_hash"), [by, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); the component is its smallest id.

    A large-star step links every larger neighbour of a node to the least id of its neighbourhood, a small-star step every smaller one to the
    least of them. Only nodes that have smaller and larger neighbours change anything in the first, and only those with two
    smaller ones in the second; their new ends are looked up with the edges of one node dealt into SALTS parts, so a hub's edges never gather
    in one task. Each round is written to the shared folder, and the round before goes. Null ends and loops are dropped; an empty
    table gives none.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges", path)
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        middle = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).filter("m < u AND u < top").select(F.col("u").alias("a"), "m")
        large = looked_up(now, middle, "a", F.col("b")).select(F.coalesce("m", "a").alias("a"), "b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("b", "m")
        small = looked_up(large, lower, "b", F.col("a")).select(F.explode(F.when(F.col("m").isNull(), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b")))).alias("e")).select("e.*")
        before, path = path, new_path(spark, "edges")
        new = written(small.filter("a < b").distinct(), "edges", path)
        removed(spark, before)
        # a star forest stays as it is: every end has one edge, to an end that is nobody's larger one
        ends = new.select(F.col("b").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("a", F.lit(0), F.lit(1)))
        loose = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
        now = new
        if loose.isEmpty():
            break
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
