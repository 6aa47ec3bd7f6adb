"""An inverted-file index of vectors: approximate search with measured recall.

Vectors are filed under the nearest of some centroids, and a query looks only into the lists of the centroids nearest to it. The centroids are fitted on at
most SAMPLE rows, those of least digest; every row is filed. How many lists a query looks into is measured: the least number with which the search finds
the wanted share of what exact search finds for at most CHECKED rows. Looking into all lists is exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.operators.retrieval import BLOCK, QUERY_NUMBERS, SCORES, _Best, _Vectors, block_top_k, dot, passes_of

SAMPLE = 20_000
CHECKED = 200
MOST_LISTS = 4096
#: Distances of queries from centroids that the driver holds at once.
DISTANCES = 1 << 22
SEED = 7


@dataclass
class Index:
    """Rows filed by list at a path, the centroids as rows of a matrix, and how many lists a query looks into."""

    path: str
    centroids: np.ndarray
    probes: int = 1
    recall: float = 0.0

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _sampled(vectors: DataFrame, rows: int) -> DataFrame:
    return vectors.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(rows)


def build(vectors: DataFrame, path: str, lists: int | None = None, k: int = 10, recall: float = 0.95) -> Index:
    """Files vectors (id, v: arrays of one length) and measures how many lists to look into. Nulls are left out; zero vectors are filed like others.

    Lists are about the square root of the rows, MOST_LISTS at most. A list that many rows fall into is written as several files.
    """
    spark = vectors.sparkSession
    vectors = vectors.toDF("id", "v").filter("id IS NOT NULL AND v IS NOT NULL").withColumn("v", F.col("v").cast("array<double>"))
    n = vectors.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    # lists by angle: of vectors without a direction, or whose numbers aren't ones, none is a centroid
    fit = _sampled(vectors.filter(~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (dot("v", "v") > 0)), SAMPLE).select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, seed=SEED, maxIter=10, distanceMeasure="cosine").fit(fit) if lists > 1 and not fit.isEmpty() else None
    centroids = np.array([np.asarray(c, np.float64) for c in model.clusterCenters()]) if model else np.zeros((1, n and len(vectors.first().v)))
    centroids /= np.maximum(np.sqrt((centroids * centroids).sum(axis=1)), 1e-300)[:, None]
    held = spark.sparkContext.broadcast(centroids)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                at = np.argmax(_Vectors.of(b, False).v @ held.value.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["id", "v", "list"])

    vectors.mapInArrow(filed, "id bigint, v array<double>, list int").hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, v array<double>").write.parquet(f"{path}/centroids")
    index = Index(path, centroids, len(centroids), 1.0)
    if len(centroids) > 1:
        queries = _sampled(vectors, CHECKED)
        exact = block_top_k(vectors, queries, k).select("query_id", "id").toPandas()
        wanted, probes = set(map(tuple, exact.to_numpy().tolist())), 1
        while probes < len(centroids):
            found = set(map(tuple, search(index, spark, queries, k, probes, False).select("query_id", "id").toPandas().to_numpy().tolist()))
            share = len(wanted & found) / max(len(wanted), 1)
            if share >= recall:
                index.probes, index.recall = probes, share
                break
            probes = min(2 * probes, len(centroids))
    spark.createDataFrame([(index.probes, index.recall)], "probes int, recall double").write.parquet(f"{path}/measured")
    return index


def load(spark: SparkSession, path: str) -> Index:
    m = spark.read.parquet(f"{path}/measured").first()
    c = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()
    return Index(path, np.array(c["v"].tolist()), m.probes, m.recall)


def search(index: Index, spark: SparkSession, queries: DataFrame, k: int, probes: int | None = None, whole: bool = True) -> DataFrame:
    """query_id, id, score and rank of the k rows nearest to each query (id, v) that its lists hold, as of `block_top_k`. Only these lists are read.

    With `whole`, queries whose lists hold fewer than k other rows are searched for exactly.
    """
    queries = queries.toDF("id", "v").filter("id IS NOT NULL AND v IS NOT NULL").withColumn("v", F.col("v").cast("array<double>"))
    probes, lists = min(probes or index.probes, len(index.centroids)), len(index.centroids)
    n, numbers = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    # what is held of a pass: the queries, their candidates, and where lists are chosen each one's distance from all centroids
    passes, out = max(passes_of(n, k), -(-numbers // QUERY_NUMBERS), -(-n * lists // DISTANCES) if probes < lists else 1), None
    for i in range(passes):
        found = _pass(index, spark, queries if passes == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i), k, probes)
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    if not whole or probes >= len(index.centroids):
        return out
    full = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = queries.join(full, "id", "left_anti")
    if short.isEmpty():
        return out
    return out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(block_top_k(index.rows(spark).select("id", "v"), short, k))


def _pass(index: Index, spark: SparkSession, queries: DataFrame, k: int, probes: int) -> DataFrame:
    table = queries.toArrow().combine_chunks()
    if not len(table):
        return spark.createDataFrame([], "query_id bigint, id bigint, score double")
    q = _Vectors.of(table.to_batches()[0], False)
    rows, start, of = index.rows(spark), None, None
    if probes < len(index.centroids):
        near = np.argsort(-(q.v @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        some, order = np.unique(near), np.argsort(near.ravel(), kind="stable")
        if len(some) < len(index.centroids):
            rows = rows.filter(F.col("list").isin(some.tolist()))  # folders of other lists aren't read
        start, of = np.searchsorted(near.ravel()[order], np.arange(len(index.centroids) + 1)), order // near.shape[1]
    held = spark.sparkContext.broadcast((q, start, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, start, of = held.value
        best = _Best(len(q.ids), k, -1.0)
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                at, m = b.column(2).to_numpy(), _Vectors.of(b.select([0, 1]), False)
                for one in np.unique(at).tolist() if start is not None else [None]:
                    own, here = (of[start[one] : start[one + 1]], np.flatnonzero(at == one)) if start is not None else (np.arange(len(q.ids)), np.arange(b.num_rows))
                    step = max(1, SCORES // max(len(own), 1))
                    for some in (here[j : j + step] for j in range(0, len(here), step)):
                        score = np.round(q.v[own] @ m.v[some].T, 6) + 0.0
                        score[q.ids[own][:, None] == m.ids[some][None, :]] = -np.inf
                        best.add(score, m.ids[some], own)
        i, s, ids = best.result()
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(ids), pa.array(s)], names=["query_id", "id", "score"])

    return rows.select("id", "v", F.col("list").cast("int").alias("list")).mapInArrow(run, "query_id bigint, id bigint, score double")
