"""Substring dedup by difference-cover anchors: words of any long passage that occurs earlier are removed, wherever it stands.

A window is WINDOW consecutive words. A word goes if a window covers it whose words also start earlier: in a smaller doc_id, or in the same document before.
Windows are judged on the input, not on what is left.

Anchors are short runs of words that start at the places of a difference cover: places whose remainders modulo PERIOD are in a set that has every
difference. Whatever places two equal windows start at, some place within PERIOD words of both starts is in the cover of both, so both hold that anchor, whole.
So only anchors that occur twice are looked at again: they are extended to the windows around them, which are compared by 96 bits of hashes,
and all but the first of equal ones are marked. Pairs of occurrences are never listed.

What a task sees twice it settles itself: of an anchor that repeats it passes on one record, of equal windows the first, so a passage that stands in a third of
all documents has a record for each task. Records are packed by buckets of hashes, a few to a partition, and a task holds one
bucket at a time. Texts are read anew where they are needed.

Null and empty texts have no words; a text without WINDOW words keeps them all. Null doc_ids come last. Rows that share a doc_id are
documents of their own, in the order of a hash of theirs, equal rows too. Texts are read whole. An empty table gives an empty one. Extra columns stay;
those named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.segments import ragged
from quartier.llm.store import ddl, fresh, numbered, quoted, written

WINDOW = 20
PERIOD = 13
#: Records that a task gathers before it passes them on.
HELD = 1 << 19
NEW = ("n_words", "n_removed", "removed")
_LAST = np.iinfo(np.int64).max
_SECOND = 0xD6E8FEB86659FD93

_ANCHOR = np.dtype([("hash", "<u8"), ("row", "<i8"), ("at", "<u4")])
#: What stands for an anchor that a task has seen more than once.
MANY = np.uint32(2**32 - 1)
_WINDOW = np.dtype([("hash", "<u8"), ("check", "<u4"), ("at", "<u4"), ("doc", "<i8"), ("row", "<i8")])
_HIT = np.dtype([("row", "<i8"), ("at", "<u4")])
_PACKED = "deal int, kind int, data binary"


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set that has every difference modulo period."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
    raise ValueError("period must be positive")


class _Packer:
    """Gathers records and hands them out by buckets of their leading hash bits; `settle` gives the records to pass on, sorted by hash, and what is settled."""

    def __init__(self, bits: int, settle: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.bits, self.settle, self.held, self.n = bits, settle, [], 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(records)
        self.n += len(records)
        if self.n >= HELD:
            yield self.flushed()

    def flushed(self) -> pa.RecordBatch:
        records, settled = self.settle(np.concatenate(self.held)) if self.n else (np.zeros(0, _HIT), np.zeros(0, _HIT))
        self.held, self.n = [], 0
        bucket = (records["hash"] >> K.U64(64 - self.bits)).astype(np.int64) if len(records) else np.zeros(0, np.int64)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        data = [records[i:j].tobytes() for i, j in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True)] if len(start) else []
        deal, kind = bucket[start].tolist(), [0] * len(data)
        for i in range(0, len(settled), HELD // 16):
            part = settled[i : i + HELD // 16]
            deal.append(int(K.mix(part["row"][:1].astype(np.int64).view(K.U64))[0] >> K.U64(64 - self.bits)))
            kind.append(1)
            data.append(part.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(deal, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["deal", "kind", "data"])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and its length."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(h)))


def _hits(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _HIT)
    out["row"], out["at"] = records["row"], records["at"]
    return out


def settle_anchors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that occur once, one record for each other; and where the others occur."""
    a = a[np.argsort(a["hash"], kind="stable")]
    start, n = _runs(a["hash"])
    once = np.repeat(n == 1, n)
    out = a[start]
    out["at"][n > 1] = MANY
    return out, _hits(a[~once])


def repeated_anchors(a: np.ndarray) -> np.ndarray:
    """Where anchors occur that several records have."""
    a = a[np.argsort(a["hash"], kind="stable")]
    start, n = _runs(a["hash"])
    many = n > 1
    if len(start):
        many |= np.maximum.reduceat(a["at"] == MANY, start)
    return _hits(a[np.repeat(many, n) & (a["at"] != MANY)])


def settle_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each window, and the others."""
    w = w[np.lexsort((w["at"], w["row"], w["doc"], w["check"], w["hash"]))]
    again = np.zeros(len(w), bool)
    again[1:] = (w["hash"][1:] == w["hash"][:-1]) & (w["check"][1:] == w["check"][:-1])
    return w[~again], _hits(w[again])


def _gathered(kind: np.dtype, judge: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From packed records sorted by bucket: what is settled, and judge's hits in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hits["row"])), pa.array(hits["at"].astype(np.int32))], names=["row", "at"])

        now, held = -1, []
        for batch in batches:
            for deal, settled, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                records = np.frombuffer(data.as_buffer(), _HIT if settled else kind)
                if settled:
                    yield out(records)
                    continue
                if deal != now and held:
                    yield out(judge(np.concatenate(held)))
                    held = []
                now = deal
                held.append(records.copy())
        if held:
            yield out(judge(np.concatenate(held)))

    return run


def _anchor_records(bits: int, window: int, period: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size, inside = window - period + 1, np.isin(np.arange(period), difference_cover(period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(bits, settle_anchors)
        for batch in batches:
            row, a = batch.column(0).to_numpy(), K.column(batch, "text")
            for i, j in K.chunks(a):
                w = K.words(*K.raw(a.slice(i, j - i)))
                place = np.arange(len(w.hash)) - np.repeat(w.off[:-1], w.count)
                h = K.rolling(w.hash, size)
                n = np.repeat(w.count, w.count)
                at = np.flatnonzero((inside[place % period] & (place + size <= n) & (n >= window))[: len(h)])
                records = np.zeros(len(at), _ANCHOR)
                records["hash"], records["at"], records["row"] = h[at], place[at], np.repeat(row[i:j], w.count)[at]
                yield from packer.add(records)
        if packer.n:
            yield packer.flushed()

    return run


def _window_records(bits: int, window: int, period: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows around the anchors at the places in `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(bits, settle_windows)
        for batch in batches:
            row, doc, a, places = batch.column(0).to_numpy(), batch.column(1).fill_null(_LAST).to_numpy(), K.column(batch, "text"), batch.column(3)
            off = places.offsets.to_numpy()
            places = places.values.to_numpy()
            for i, j in K.chunks(a):
                w = K.words(*K.raw(a.slice(i, j - i)))
                h, check = K.rolling(w.hash, window), K.rolling(w.hash, window, _SECOND)
                wanted = np.zeros(len(w.hash) + 1, np.int64)
                at = np.repeat(w.off[:-1], np.diff(off[i : j + 1])) + places[off[i] : off[j]]
                first = np.repeat(w.off[:-1], np.diff(off[i : j + 1]))
                np.add.at(wanted, np.maximum(at - period + 1, first), 1)
                np.add.at(wanted, at + 1, -1)
                place = np.arange(len(w.hash)) - np.repeat(w.off[:-1], w.count)
                fits = place + window <= np.repeat(w.count, w.count)
                at = np.flatnonzero(((np.cumsum(wanted[:-1]) > 0) & fits)[: len(h)])
                records = np.zeros(len(at), _WINDOW)
                records["hash"], records["check"], records["at"] = h[at], (check[at] >> K.U64(32)).astype(np.uint32), place[at]
                records["doc"], records["row"] = np.repeat(doc[i:j], w.count)[at], np.repeat(row[i:j], w.count)[at]
                yield from packer.add(records)
        if packer.n:
            yield packer.flushed()

    return run


def _cut(window: int, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the words of the windows that start at the places in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            places = batch.column(batch.num_columns - 1)
            off, flat, null = places.offsets.to_numpy(), places.values.to_numpy(), places.is_null().to_numpy(zero_copy_only=False)
            kept: list[bytes | None] = []
            n_words, n_removed, removed = [], [], []
            for k, value in enumerate(batch.column(text)):
                # bytes.split cuts at 0x20 and 0x09-0x0D, no others
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                ranges = []
                if not null[k] and off[k] < off[k + 1]:
                    at = np.unique(flat[off[k] : off[k + 1]])
                    apart = np.flatnonzero(at[1:] > at[:-1] + window) + 1
                    ranges = list(zip(at[np.concatenate([[0], apart])].tolist(), (at[np.concatenate([apart - 1, [len(at) - 1]])] + window).tolist(), strict=True))
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in ranges))
                removed.append([{"start": s, "end": e} for s, e in ranges])
                if ranges:
                    stays = np.ones(len(words), bool)
                    stays[ragged(*(np.array(x) for x in zip(*((s, e - s) for s, e in ranges), strict=True)))] = False
                    words = compress(words, stays.tolist())
                kept.append(b" ".join(words) if value.is_valid else None)
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in range(batch.num_columns - 1)]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *NEW])

    return run


def _buckets(spark: SparkSession) -> int:
    """Leading hash bits of a bucket: at least four buckets for each shuffle partition."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def dedup_substrings(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """The table with texts of the kept words joined by single spaces, `n_words` (before), `n_removed` and `removed`, ranges of word numbers."""
    bits = _buckets(docs.sparkSession)
    docs = docs.select(*quoted(c for c in docs.columns if c.lower() not in NEW))
    row, copy, at = fresh([*docs.columns, *NEW], "__row", "__copy", "__at")
    # two rows whose hashes are equal, whatever they hold, get another by their copy number
    own = numbered(docs.withColumn(row, F.xxhash64("doc_id", "text")), (row,), copy)
    own = own.withColumn(row, F.when(F.col(copy) == 0, F.col(row)).otherwise(F.xxhash64(row, copy))).drop(copy)

    def places(packed: DataFrame, kind: np.dtype, judge: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
        # what is found is written, so that the records' shuffle files go before texts are shuffled
        found = packed.repartition("deal").sortWithinPartitions("deal").mapInArrow(_gathered(kind, judge), "row bigint, at int")
        return written(found.groupBy(F.col("row").alias(row)).agg(F.collect_list("at").alias(at)), name)

    anchors = own.select(row, "text").mapInArrow(_anchor_records(bits, window, period), _PACKED)
    some = own.join(places(anchors, _ANCHOR, repeated_anchors, "repeated-anchors"), row).select(row, F.col("doc_id").cast("long").alias("doc_id"), "text", at)
    windows = some.mapInArrow(_window_records(bits, window, period), _PACKED)
    marked = own.join(places(windows, _WINDOW, lambda w: settle_windows(w)[1], "repeated-windows"), row, "left").select(*quoted(docs.columns), at)
    return marked.mapInArrow(_cut(window, docs.columns.index("text")), ddl(docs, "n_words bigint", "n_removed bigint", "removed array<struct<start:int,end:int>>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
