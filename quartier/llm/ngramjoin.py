"""N-gram Jaccard join with signature trees.

A document's set is its distinct lower-cased 5-word shingles (its whole word sequence, if shorter), by their 64-bit hashes. Two
documents link when the Jaccard similarity of their sets is at least 0.8; documents with equal sets are one from the start.

The texts are read once for their words' counts, once for all that follows, and once more for the sets of groups.

1. Shingles are ordered from rare to frequent, a shingle being at most as frequent as its rarest word. Each set is dealt
   out by the shingles of its prefix, of which any linked pair shares one. The least set id of a shingle is its
   hub; the sets of a hub form a block. Any pair that may link lies in one block, and pairs aren't listed.
2. In each block, by size class, a signature tree of the sets' bitmaps is traversed against itself; node pairs whose
   greatest possible overlap is too small are left out. What no bitmap can rule out becomes a group.
3. Groups are connected over all blocks. The sets of a group come together once, in full; a signature tree leads to the
   pairs, which are verified on the sets, except between sets that are linked already.
4. The verified links are connected; a component is named by its smallest doc_id.

Rows of frequent shingles are dealt by shingle and set, and take their hub from an aggregation and a look-up that is dealt
likewise; cold shingles have fewer than `floor` rows. A block or group
of more than CHUNK_SETS sets is cut into chunks, and each pair of chunks meets in a task, so no task holds more than two.

Null, empty and blank texts have an empty set, link with nothing and are components of their own. Ties: rows that repeat a
doc_id have one component each, by their texts. Null doc_ids take part; a component is named by its smallest doc_id that isn't
null, and has a null name if there is none. An empty table gives none. Extra columns don't matter to `join`; `stage` keeps them, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import signaturetree as T
from quartier.llm import textkernel as K
from quartier.llm.components import connected_components, looked_up
from quartier.llm.frequent import Frequent, count_words
from quartier.llm.segments import ragged
from quartier.llm.store import fresh, numbered, quoted, written

CHUNK_SETS = 2048
#: Shingles with so many rows are frequent: their rows are dealt into HOT_PARTS tasks.
HOT = 2048
HOT_PARTS = 64


def _word_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return K.words(data, off, lower=True).hash


class ShingleSets:
    """Sets of all texts of a batch: shingles by text, in order of count and hash, and each set's id and size."""

    def __init__(self, data: np.ndarray, off: np.ndarray, frequent: Frequent | None):
        w = K.words(data, off, lower=True)
        n_texts, size = len(off) - 1, K.WINDOW
        count = frequent.counts(w.hash) if frequent else np.zeros(len(w.hash), np.int64)
        full = np.maximum(w.count - size + 1, 0)
        at = ragged(w.off[:-1], full)
        h, of = K.windows(w.hash)[at], np.repeat(np.arange(n_texts), full)
        c = np.lib.stride_tricks.sliding_window_view(count, size).min(axis=1)[at] if len(at) else np.zeros(0, np.int64)
        short = np.flatnonzero((w.count > 0) & (w.count < size))
        whole = np.array([K.mix(np.sum(w.hash[w.off[t] : w.off[t + 1]] * K._COEF[8 : 8 + w.count[t]], keepdims=True) + K._COEF[20 + w.count[t]])[0] for t in short], K.U64)
        least = np.array([count[w.off[t] : w.off[t + 1]].min() for t in short], np.int64)
        h, of, c = np.concatenate([h, whole]), np.concatenate([of, short]), np.concatenate([c, least])
        order = np.lexsort((h, c, of))
        h, of, c = h[order], of[order], c[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.shingle, self.count = h[first], c[first]
        self.size = np.bincount(of[first], minlength=n_texts)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(self.shingle + K.U64(0x2545F491)), dtype=K.U64)])
        self.id = K.mix(total[self.off[1:]] - total[self.off[:-1]] + self.size.astype(K.U64)).view(np.int64)

    def set(self, t: int) -> np.ndarray:
        return np.sort(self.shingle[self.off[t] : self.off[t + 1]])

    def least(self, t: int) -> int:
        return int(self.shingle[self.off[t] : self.off[t + 1]].min().view(np.int64))


#: What stands for rows with equal doc and tie of one batch, and what a set's bitmap of one class begins with.
_ROW = np.dtype([("kind", "u1"), ("null", "u1"), ("doc", "<i8"), ("tie", "<i8"), ("n", "<i8"), ("rows", "<i8")])
_SET = np.dtype([("kind", "u1"), ("cls", "<i4"), ("n", "<i8"), ("least", "<i8")])
_PASS = "deal bigint, key bigint, id bigint, data binary"
_FOUND = "hub bigint, id bigint, key bigint, doc bigint, tie bigint, n bigint, rows bigint, cls int, bits binary, least bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie and text: rows with equal doc and tie are the same for this module."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("tie"), "text")


def _binary(records: np.ndarray) -> pa.Array:
    """Records of one width as binaries."""
    off = np.arange(len(records) + 1, dtype=np.int32) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(records.tobytes())])


def _pass(texts: DataFrame, frequent: Frequent) -> DataFrame:
    """All that is read from the texts, in one pass: a row for each shingle of each set's prefix, and with a null key and packed `data` the rows, and
    each set's bitmaps by class. Equal sets of one batch give their rows once, as do rows with equal doc and tie.

    deal says which rows come together: the shingle for a cold one; for a frequent one the shingle with a part of the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PASS.split(", ")]

        def out(deal: np.ndarray, key: np.ndarray | None, ids: pa.Array, data: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.nulls(len(deal), pa.int64()) if key is None else pa.array(key.view(np.int64)), ids, data], names=names)

        for batch in batches:
            doc, tie, a, seen = batch.column(0), batch.column(1).to_numpy(), K.column(batch, "text"), np.zeros(0, np.int64)
            for i, j in K.chunks(a):
                s = ShingleSets(*K.raw(a.slice(i, j - i)), frequent)
                own = doc.slice(i, j - i)
                r = np.zeros(j - i, _ROW)
                r["kind"], r["null"], r["doc"], r["tie"], r["n"] = 1, own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(), tie[i:j], s.size
                _, at, r_n = np.unique(r[["null", "doc", "tie"]], return_index=True, return_counts=True)
                r = r[at]
                r["rows"] = r_n
                yield out(K.mix(r["tie"].view(K.U64) ^ r["doc"].astype(np.int64).view(K.U64)), None, pa.array(s.id[at], mask=s.size[at] == 0), _binary(r))
                ids, keep = np.unique(s.id, return_index=True)
                keep = keep[~np.isin(ids, seen) & (s.size[keep] > 0)]
                seen = np.union1d(seen, ids)
                some = [(t, c) for t, classes in zip(keep.tolist(), _classes(s.size[keep]), strict=True) for c in classes]
                data = [np.array((2, c, s.size[t], s.least(t)), _SET).tobytes() + T.bitmap(s.shingle[s.off[t] : s.off[t + 1]], c).tobytes() for t, c in some]
                ids = s.id[[t for t, _ in some]]
                yield out(K.mix(ids.view(K.U64)), None, pa.array(ids), pa.array(data, pa.binary()))
                n = s.size[keep] - -(-4 * s.size[keep] // 5) + 1
                at = ragged(s.off[keep], n)
                key, own = s.shingle[at], np.repeat(s.id[keep], n)
                part = K.mix(own.view(K.U64)) % K.U64(HOT_PARTS) + K.U64(1)
                yield out(np.where(s.count[at] >= HOT, K.mix(key + part), key), key, pa.array(own), pa.nulls(len(key), pa.binary()))

    return texts.mapInArrow(run, _PASS)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: for cold keys (hub, id) for each other set that shares a key with its least one;
    for frequent keys (id, key), with no hub yet; and what is packed, unpacked. The rows of a key may go on over batches."""
    none = [np.zeros(0, np.int64)] * 3
    rest = none
    for batch in batches:
        packed = batch.column(1).is_null()
        if packed.true_count:
            yield from _unpacked(batch.filter(packed))
            batch = batch.filter(pc.invert(packed))
        rows = [np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for old, c in zip(rest, ("key", "id", "deal"), strict=True)]
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if len(rows[0]) and (rows[0] != rows[0][-1]).any() else 0
        if cut:
            yield _hub_rows(*(r[:cut] for r in rows))
        rest = [r[cut:] for r in rows]
        if len(rest[0]) and rest[2][0] != rest[0][0]:  # a frequent key needs no other rows of its own
            yield _hub_rows(*rest)
            rest = none
    if len(rest[0]):
        yield _hub_rows(*rest)


def _found(length: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = dict(c.split() for c in _FOUND.split(", "))
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(length, kinds[kind])) for name, kind in names.items()], names=list(names))


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data = batch.column(3).to_pylist()
    row = np.array([x[0] == 1 for x in data], bool)
    r = np.frombuffer(b"".join(x for x in data if x[0] == 1), _ROW)
    if len(r):
        yield _found(len(r), id=batch.column(2).filter(pa.array(row)), doc=pa.array(r["doc"], mask=r["null"] == 1), **{c: pa.array(r[c]) for c in ("tie", "n", "rows")})
    sets = [x for x in data if x[0] == 2]
    if sets:
        h = np.frombuffer(b"".join(x[: _SET.itemsize] for x in sets), _SET)
        yield _found(len(h), id=batch.column(2).filter(pa.array(~row)), n=pa.array(h["n"]), cls=pa.array(h["cls"]), least=pa.array(h["least"]), bits=pa.array([x[_SET.itemsize :] for x in sets], pa.binary()))


def _hub_rows(key: np.ndarray, id_: np.ndarray, deal: np.ndarray) -> pa.RecordBatch:
    hot = deal != key
    where = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    hub = np.repeat(np.minimum.reduceat(id_, where), np.diff(np.append(where, len(key))))
    hub, key = np.where(hot, 0, hub), np.where(hot, key, 0)
    other = np.flatnonzero(hot | (hub != id_))
    order = other[np.lexsort((id_[other], key[other], hub[other]))]
    first = np.ones(len(order), bool)
    first[1:] = (hub[order][1:] != hub[order][:-1]) | (id_[order][1:] != id_[order][:-1]) | (key[order][1:] != key[order][:-1])
    order = order[first]
    return _found(len(order), hub=pa.array(hub[order], mask=hot[order]), id=pa.array(id_[order]), key=pa.array(key[order], mask=~hot[order]))


def _blocks(found: DataFrame) -> DataFrame:
    """(hub, id) of all blocks of two sets or more, without the hub itself."""
    hot = found.filter("key IS NOT NULL").select("key", "id").distinct()
    hubs = hot.groupBy("key").agg(F.min("id").alias("hub"))
    return found.filter("hub IS NOT NULL").select("hub", "id").union(looked_up(hot, hubs, "key", F.col("id"), "inner").filter("hub <> id").select("hub", "id")).distinct()


def chunked(rows: DataFrame, by: str) -> DataFrame:
    """Rows with `part`, a task's worth: a group of up to CHUNK_SETS rows, or two chunks of a larger one; and `side`, as in line dedup."""
    sizes = rows.groupBy(by).count().filter(F.col("count") > CHUNK_SETS).select(by, F.ceil(F.col("count") / CHUNK_SETS).cast("int").alias("chunks"))
    dealt = looked_up(rows, sizes, by, F.col("id")).withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("part", part).withColumn("side", side.cast("int")).drop("own", "other", "chunks")


def grouped(judge: Callable[[dict[str, list]], list[tuple[int, int]]], names: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """judge's links for each part of rows sorted by part and class; a part may go on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            part, cls = table.column("part").to_numpy(), table.column("cls").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (cls[1:] != cls[:-1])]))
            out: list[tuple[int, int]] = []
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
                if y - x > 1:
                    out += judge({n: table.column(n).slice(x, y - x).to_pylist() for n in names} | {"cls": int(cls[x])})
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            part, cls = table.column("part").to_numpy(), table.column("cls").to_numpy()
            before = np.flatnonzero((part != part[-1]) | (cls != cls[-1])) if len(part) else []
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield links(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _judge_bitmaps(rows: dict) -> list[tuple[int, int]]:
    ids, size = rows["id"], np.array(rows["n"], np.int64)
    bits = np.stack([np.frombuffer(b, K.U64) for b in rows["bits"]])
    order = np.lexsort((size, np.array(rows["least"], np.int64)))
    found = T.join(size, bits, order, T.Groups(len(ids)), lambda a, b: ids[a] != ids[b], np.array(rows["side"]))
    return [(ids[a], ids[b]) for a, b in found]


def _judge_sets(rows: dict) -> list[tuple[int, int]]:
    ids, sets = rows["id"], [np.frombuffer(s, K.U64) for s in rows["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    bits = np.stack([T.bitmap(s, rows["cls"]) for s in sets])

    def similar(a: int, b: int) -> bool:
        x, y = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 5 * both >= 4 * (len(x) + len(y) - both)

    order = np.lexsort((size, np.array([s[0] for s in sets], K.U64)))
    return [(ids[a], ids[b]) for a, b in T.join(size, bits, order, T.Groups(len(ids)), similar, np.array(rows["side"]))]


def _classes(n: np.ndarray) -> list[list[int]]:
    """The classes in which a set meets its partners: that of its size, and that of its smallest partner's."""
    own, low = T.size_class(n), T.size_class(-(-4 * n // 5))
    return [[int(a)] if a == b else [int(b), int(a)] for a, b in zip(own, low, strict=True)]


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, class and the set itself for the ids in `wanted` (id, doc, tie), each from the row named there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, id_, seen = K.column(batch, "text"), batch.column(1).to_numpy(), set()
            for i, j in K.chunks(a):
                s = ShingleSets(*K.raw(a.slice(i, j - i)), None)
                at = np.array([t for t in np.flatnonzero(s.id == id_[i:j]).tolist() if not (s.id[t] in seen or seen.add(s.id[t]))], np.int64)
                rows = [(int(s.id[t]), c, s.set(t).tobytes()) for t, classes in zip(at.tolist(), _classes(s.size[at]), strict=True) for c in classes]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "cls", "shingles"])

    w = wanted.select("id", F.col("doc").alias("wdoc"), F.col("tie").alias("wtie"))
    few = texts.join(w, texts["doc"].eqNullSafe(w["wdoc"]) & (texts["tie"] == w["wtie"])).select("text", "id")
    return few.mapInArrow(run, "id bigint, cls int, shingles binary").dropDuplicates(["id", "cls"])


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as (doc, tie, id, n, rows); for each set id the row that stands for it and how many rows have it; and (id, component) of all linked sets."""
    texts = keyed(docs)
    found = _pass(texts, count_words(docs, _word_hashes)).repartition("deal").sortWithinPartitions("key").mapInArrow(_hubs, _FOUND)
    # few rows are left: dealt once more, they are written by a few tasks, in a stage of its own after the sort
    found = written(found.repartition(F.xxhash64("id", "hub", "key", "doc", "tie")), "shingle-sets")
    sets = found.filter("rows IS NOT NULL").select("doc", "tie", "id", "n", "rows")
    place = F.min(F.struct(F.col("doc").isNull().alias("null"), "doc", "tie")).alias("p")
    reps = written(sets.filter("id IS NOT NULL").groupBy("id").agg(place, F.sum("rows").alias("n_rows")).select("id", "p.doc", "p.tie", "n_rows"), "set-places")
    blocks = written(_blocks(found), "blocks")
    members = blocks.union(blocks.select("hub", "hub").distinct())
    bitmaps = found.filter("bits IS NOT NULL").select("id", "cls", "n", "bits", "least").join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "cls"])
    parts = chunked(members.withColumnRenamed("hub", "block"), "block").join(bitmaps, "id").select("part", "cls", "id", "n", "bits", "least", "side")
    near = parts.repartition("part", "cls").sortWithinPartitions("part", "cls").mapInArrow(grouped(_judge_bitmaps, ("id", "n", "bits", "least", "side")), "a bigint, b bigint")
    groups = written(connected_components(near), "groups")
    full = _full_sets(texts, groups.select("id").join(reps, "id").select("id", "doc", "tie"))
    parts = chunked(groups, "component").join(full, "id").select("part", "cls", "id", "shingles", "side")
    links = parts.repartition("part", "cls").sortWithinPartitions("part", "cls").mapInArrow(grouped(_judge_sets, ("id", "shingles", "side")), "a bigint, b bigint")
    return sets, reps, written(connected_components(links), "components")


def _named(reps: DataFrame, linked: DataFrame) -> DataFrame:
    """For each set that others are linked with, or that several rows have: its component's first row (doc, tie)."""
    place = F.min(F.struct(F.col("doc").isNull().alias("null"), "doc", "tie")).alias("p")
    own = linked.join(reps, "id")
    first = own.groupBy("component").agg(place).select("component", F.col("p.doc").alias("first_doc"), F.col("p.tie").alias("first_tie"))
    alone = reps.filter("n_rows > 1").join(linked, "id", "left_anti").select("id", F.col("doc").alias("first_doc"), F.col("tie").alias("first_tie"))
    return looked_up(own, first, "component", F.col("id")).select("id", "first_doc", "first_tie").union(alone)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sets, reps, linked = _components(docs)
    names = _named(reps, linked).select("id", "first_doc", F.lit(True).alias("known"))
    own = looked_up(sets, names, "id", F.struct("doc", "tie")).withColumn("each", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return own.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("first_doc")).otherwise(F.col("doc")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the first by doc_id (nulls last) and a hash of the text; of rows equal in both one stays. Rows without words stay."""
    doc, tie, gdoc, gtie, copy = fresh(docs.columns, "__doc", "__tie", "__gone_doc", "__gone_tie", "__copy")
    sets, reps, linked = _components(docs)
    own = looked_up(sets, _named(reps, linked), "id", F.struct("doc", "tie")).filter("first_tie IS NOT NULL")
    gone = own.filter("NOT (doc <=> first_doc AND tie = first_tie)").select(F.col("doc").alias(gdoc), F.col("tie").alias(gtie)).distinct()
    marked = docs.withColumns({doc: F.col("doc_id").cast("long"), tie: F.xxhash64("text")})
    kept = marked.join(gone, F.col(doc).eqNullSafe(F.col(gdoc)) & (F.col(tie) == F.col(gtie)), "left_anti")
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return numbered(kept, (doc, tie), copy, sets.filter("id IS NOT NULL").select("doc", "tie", "rows")).filter((F.col(copy) == 0) | ~F.coalesce(worded, F.lit(False))).select(*quoted(docs.columns))
