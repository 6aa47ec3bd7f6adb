"""Token-id files with a minimal perfect hash index.

A store is a table of blocks, written by Spark in ascending key order: range partitions are shards, and each
shard is a run of blocks of bounded size. A block holds the raw ids of its documents (16 bits each where the
vocabulary allows, else 32), their keys and where in the payload each starts, and a minimal perfect hash over its distinct
keys: displacement seeds, and for each slot the key's fingerprint, the place of its first document and
how many follow with the same key. A key is looked up in the block whose range holds it by two hashes, one
comparison of fingerprints, by which most unlisted keys are turned away, and one of keys; the place gives the offsets of its ids, so
an access takes constant time.

Ids are those of the library's plain call with add_special_tokens=False, so a special token that stands in a text has its own id.
Null texts are encoded as empty ones, so they hold the end id alone. Null keys come first; they have a place in the
order but none in the index. Rows that repeat a key follow each other, ordered by a hash of their texts; the
index leads to the first. A document of any length is one run of ids in one block. An empty table gives no blocks. Extra columns aren't stored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartier.llm import textkernel as K
from quartier.llm.segments import CACHE_CHARS, TEXT_BYTES, SegmentEncoder, flattened
from quartier.llm.store import new_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_DOCS = 8192
#: Ranges of keys that a fetch hands to the scan.
INTERVALS = 64
BLOCK_IDS = 1 << 20
NULL_KEY = -(2**63)
#: Letters, and the marks that are cut off from a letter before them: no token goes from one to the other.
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
SCHEMA = "shard int, block int, first_key bigint, last_key bigint, n_docs int, n_ids bigint, width int, seeds binary, prints binary, places binary, runs binary, keys binary, starts binary, ids binary"


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def _special(path: str) -> tuple[str, dict[str, int]]:
    """A pattern of the vocabulary's special tokens, and the id of each."""
    ids = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items() if t.special}
    return "|".join(map(re.escape, ids)), ids


def lowered(a: pa.Array) -> list[bytes]:
    """Texts lower-cased in A-Z, as the vocabulary does with all letters, with a blank between a letter and a mark after it.

    The vocabulary drops white space, so that no token, and no composed character, goes across it, and bytes.split cuts at what it takes for that.
    """
    data, off = K.raw(pc.ascii_lower(a))
    cut = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
    # the ends of texts move with the blanks before them; one that stands between two texts does no harm to the first
    blob, off = np.insert(data, cut, 32).tobytes(), off + np.searchsorted(cut, off)
    return [blob[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


@functools.cache
def _encoder(path: str) -> SegmentEncoder:
    t, mark = Tokenizer.from_file(path), "\x01"
    # words reach it lower-cased, so that what looks like a special token here was written otherwise
    t.encode_special_tokens = True
    stop = t.encode(mark, add_special_tokens=False).ids

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """New words in few calls, a control character as a word of its own between each two; words that hold it go alone."""
        new = [w.decode() for w in words]
        if len(stop) != 1 or any(mark in x for x in new):
            return flattened([t.encode(x, add_special_tokens=False).ids for x in new])
        ids = np.concatenate([np.array(t.encode(f" {mark} ".join([*new[i : i + 1024], ""]), add_special_tokens=False).ids, np.uint32) for i in range(0, len(new), 1024)])
        ends = np.flatnonzero(ids == stop[0])
        return ids[ids != stop[0]], np.diff(ends, prepend=-1) - 1

    return SegmentEncoder(bytes.split, encode, 3 * CACHE_CHARS)


def _encoded(path: str, a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of each; special tokens are segments of their own, found before letters are lowered."""
    enc, (pattern, special) = _encoder(path), _special(path)
    if not special or not pc.any(pc.match_substring_regex(a, pattern)).as_py():
        return enc(lowered(a))
    parts = [re.split(f"({pattern})", t) for t in a.to_pylist()]
    flat = list(chain.from_iterable(parts))
    at = np.flatnonzero([x in special for x in flat])
    ids, n = enc(lowered(pa.array(["" if x in special else x for x in flat], pa.string())))
    ids = np.insert(ids, np.cumsum(n)[at], [special[flat[i]] for i in at.tolist()])
    n[at] = 1
    total = np.concatenate([[0], np.cumsum(n)])
    return ids, np.diff(total[np.cumsum([0, *map(len, parts)])])


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(keys.astype(np.int64).view(K.U64) ^ K.mix(np.full(1, salt, K.U64)))


class PerfectHash:
    """Hash and displace: each key's bucket has a seed that sends its keys to free slots, as many slots as keys.

    A bucket of one key keeps minus the slot less one instead of a seed.
    """

    PER_BUCKET = 3
    TRIES = 64

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        m = max(1, n // cls.PER_BUCKET)
        keys = keys.astype(np.int64)
        bucket = (_hash(keys, 1) % K.U64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        start = np.cumsum(size) - size
        seeds, free = np.zeros(m, np.int32), np.ones(n, bool)
        salts = functools.cache(lambda d: K.mix(np.arange(d + 2, d + 2 + cls.TRIES, dtype=K.U64)))
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            own, d = keys[order[start[b] : start[b] + size[b]]].view(K.U64), 0
            while True:  # many seeds at a time
                slots = (K.mix(own[None, :] ^ salts(d)[:, None]) % K.U64(n)).astype(np.int64)
                fits = free[slots].all(axis=1)
                for i in range(size[b]):
                    for j in range(i):
                        fits &= slots[:, i] != slots[:, j]
                if fits.any():
                    d, slot = d + int(fits.argmax()), slots[fits.argmax()]
                    break
                d += cls.TRIES
            free[slot], seeds[b] = False, d
        single = np.flatnonzero(size == 1)
        seeds[single] = -np.flatnonzero(free)[: len(single)] - 1
        return cls(seeds, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.seeds[(_hash(keys, 1) % K.U64(len(self.seeds))).astype(np.int64)].astype(np.int64)
        salt = K.mix((np.maximum(d, 0) + 2).astype(K.U64))
        spread = (K.mix(keys.astype(np.int64).view(K.U64) ^ salt) % K.U64(max(self.n, 1))).astype(np.int64)
        return np.where(d < 0, -d - 1, spread)


def _block(shard: int, block: int, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> dict:
    own, first, run = np.unique(keys, return_index=True, return_counts=True)
    listed = own != NULL_KEY
    own, first, run = own[listed], first[listed], run[listed]
    mph = PerfectHash.build(own) if len(own) else PerfectHash(np.zeros(1, np.int32), 0)
    slot = mph.slots(own)
    prints, places, runs = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
    prints[slot], places[slot], runs[slot] = (_hash(own, 0) >> K.U64(32)).astype(np.uint32), first, run
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return {"shard": shard, "block": block, "first_key": int(keys[0]), "last_key": int(keys[-1]), "n_docs": len(keys), "n_ids": len(ids), "width": width, "seeds": mph.seeds.tobytes(), "prints": prints.tobytes(), "places": places.tobytes(), "runs": runs.tobytes(), "keys": keys.astype("<i8").tobytes(), "starts": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes(), "ids": ids.astype(f"<u{width}").tobytes()}


def write_store(docs: DataFrame, path: str, key: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encodes the texts of a table and writes them in ascending order of the key."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, n_docs, n_ids = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            row = _block(shard, block, *(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            keys = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.int64)
            a = K.column(batch, "text")
            for i, j in K.chunks(a, TEXT_BYTES):
                ids, n = _encoded(vocabulary, a.slice(i, j - i))
                at = np.cumsum(n)
                held.append((keys[i:j], n + 1, np.insert(ids, at, end_id)))
                n_docs, n_ids = n_docs + j - i, n_ids + int(at[-1]) + j - i
                if n_docs >= BLOCK_DOCS or n_ids >= BLOCK_IDS:
                    yield flush()
                    held, block, n_docs, n_ids = [], block + 1, 0, 0
        if held:
            yield flush()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
    ordered = docs.select(F.col(key).cast("long").alias("__key"), "text", F.xxhash64("text").alias("__tie")).repartitionByRange("__key", "__tie").sortWithinPartitions("__key", "__tie").drop("__tie")
    # each block becomes a row group
    rows = {"parquet.block.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": 1 << 16}
    ordered.mapInArrow(run, SCHEMA).write.options(**rows).parquet(path)


def _lookup(b: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the place of its first document in the block, or -1, and the number of its documents."""
    seeds, prints = np.frombuffer(b["seeds"], np.int32), np.frombuffer(b["prints"], np.uint32)
    if not len(prints):
        return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
    slot = PerfectHash(seeds, len(prints)).slots(keys)
    place, own = np.frombuffer(b["places"], np.int32)[slot], np.frombuffer(b["keys"], "<i8")
    there = (prints[slot] == (_hash(keys, 0) >> K.U64(32)).astype(np.uint32)) & (own[place] == keys)
    return np.where(there, place, -1), np.where(there, np.frombuffer(b["runs"], np.int32)[slot], 0)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, found by its key through the index: key, shard, block, place, start in its block, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                keys, starts = np.frombuffer(b["keys"], "<i8"), np.frombuffer(b["starts"], "<i8")
                ids, start, lengths = np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4"), starts[:-1], np.diff(starts)
                place = np.arange(len(keys))
                listed = keys != NULL_KEY
                first, run_ = _lookup(b, keys[listed])
                again = place[listed] - np.searchsorted(keys[listed], keys[listed]) - (~listed).sum()
                if ((first < 0) | (again >= run_)).any():
                    raise ValueError(f"the index of block {b['shard']}/{b['block']} doesn't lead to all of its keys")
                place[listed] = first + again
                flat = ids.tobytes()
                out = [flat[4 * start[p] : 4 * (start[p] + lengths[p])] for p in place.tolist()]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~listed), pa.array(np.full(n, b["shard"], np.int32)), pa.array(np.full(n, b["block"], np.int32)), pa.array(place), pa.array(start[place]), pa.array(lengths[place]), pa.array(out, pa.binary())], names=["key", "shard", "block", "place", "start", "n_ids", "ids"])

    table = spark.read.schema(SCHEMA).parquet(path)
    return table.mapInArrow(run, "key bigint, shard int, block int, place bigint, start bigint, n_ids bigint, ids binary")


def _intervals(keys: np.ndarray, most: int = INTERVALS) -> list[tuple[int, int]]:
    """Sorted keys as at most so many intervals, split at the widest gaps."""
    gaps = np.sort(np.argsort(-np.diff(keys.astype(np.float64)), kind="stable")[: most - 1])
    return [(int(x[0]), int(x[-1])) for x in np.split(keys, gaps + 1) if len(x)]


def fetch(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The documents of some keys: each key takes one look-up in its block, and its ids are cut from the payload.

    The keys are the caller's and few enough for a list. They reach the scan as at most INTERVALS ranges of keys; each block is a row group of its own, whose first and last key
    stand in the file's footer, so only blocks that may hold a key are read, whatever the size of the store.
    """
    wanted = np.unique(np.asarray(keys, np.int64))
    blocks = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                own = wanted[(wanted >= b["first_key"]) & (wanted <= b["last_key"])]
                first, n = _lookup(b, own)
                starts, payload, width = np.frombuffer(b["starts"], "<i8"), b["ids"], b["width"]
                found = [(int(k), int(p) + r) for k, p, m in zip(own, first, n, strict=True) for r in range(m)]
                out = [np.frombuffer(payload[width * starts[p] : width * starts[p + 1]], f"<u{width}").astype("<u4").tobytes() for _, p in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array(out, pa.binary())], names=["key", "ids"])

    near = F.lit(False)
    for low, high in _intervals(wanted):
        near = near | ((F.col("first_key") <= high) & (F.col("last_key") >= low))
    return blocks.filter(near).mapInArrow(run, "key bigint, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """For each block the number of ids before it: within its shard, and in the shards before."""
    blocks = spark.read.schema(SCHEMA).parquet(path).select("shard", "block", "n_ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return blocks.withColumn("inside", inside).join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    rows = read_store(spark, path).select("key", "shard", "block", "start", "n_ids", F.crc32("ids").alias("ids_crc32"))
    return rows.join(block_starts(spark, path), ["shard", "block"]).select(F.col("key").alias("doc_id"), (F.col("block_start") + F.col("start")).alias("start"), F.col("n_ids").alias("n_tokens"), F.col("ids_crc32").cast("long").alias("ids_crc32"))
