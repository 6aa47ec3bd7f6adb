"""Frequent words of a corpus, for a global order of tokens from rare to frequent.

Every word of every text is counted. The words counted `floor` times or more are frequent; `floor` starts at
LEAST and doubles until at most MOST words are frequent, so what is broadcast is bounded however large the corpus
is, and every word that isn't in it is known to be rarer than `floor`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.store import written

LEAST = 64
MOST = 1_000_000
HELD = 1 << 20


@dataclass
class Frequent:
    """Sorted hashes of the frequent words, how often each occurs and its rank, with an entry of zeros behind; and where each bucket of leading bits starts.
    All other words occur fewer than `floor` times."""

    floor: int
    words: Broadcast

    def counts(self, h: np.ndarray) -> np.ndarray:
        """For each word its count, or 0 for a rare one."""
        return self.counts_and_ranks(h)[0]

    def counts_and_ranks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its count and its place from 1 in the order of count and hash; both 0 for a rare one."""
        known, n, rank, start, shift = self.words.value
        bucket = (h >> K.U64(shift)).astype(np.int64)
        # the known words of a word's bucket, one after the other; most buckets have one
        at = start[bucket].astype(np.int64)
        hit = known[at] == h
        count, place = np.where(hit, n[at], 0), np.where(hit, rank[at], 0)
        live = np.flatnonzero(~hit)
        at, end = at[live] + 1, start[bucket[live] + 1]
        while len(live):
            on = at < end
            live, at, end = live[on], at[on], end[on]
            hit = known[at] == h[live]
            count[live[hit]], place[live[hit]] = n[at[hit]], rank[at[hit]]
            live, at, end = live[~hit], at[~hit] + 1, end[~hit]
        return count, place


def count_words(docs: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], least: int = LEAST, most: int = MOST) -> Frequent:
    """of(bytes, offsets) gives the hashes of all words of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words are summed up in the worker first, so that each is shuffled about once for each task
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            h, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            a = K.column(batch, "text")
            for i, j in K.chunks(a):
                held.append(np.unique(of(*K.raw(a.slice(i, j - i))), return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [summed()]
                    if len(held[0][0]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(run, "word bigint, n bigint").repartition("word").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = written(counted, "frequent-words")
    doubled = F.floor(F.log2(F.col("n") / least)).cast("int")
    floor, total = least, 0
    for row in sorted(found.groupBy(doubled.alias("k")).count().collect(), reverse=True):  # at most 60 rows
        total += row["count"]
        if total > most:
            floor = least << (row.k + 1)
            break
    table = found.filter(F.col("n") >= floor).toPandas()
    h = table["word"].to_numpy(np.int64).view(K.U64)
    order = np.argsort(h)
    h, n = h[order], table["n"].to_numpy(np.int64)[order]
    rank = np.zeros(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    bits = max(1, int(len(h)).bit_length())
    start = np.searchsorted(h, np.arange(1 << bits, dtype=K.U64) << K.U64(64 - bits)).astype(np.int32)
    return Frequent(floor, docs.sparkSession.sparkContext.broadcast((*(np.append(x, x.dtype.type(0)) for x in (h, n, rank)), np.append(start, np.int32(len(h))), 64 - bits)))
