"""Line de-duplication by an exact set-similarity join.

A line's set is its distinct lower-cased words. Every line with a word takes part; blank lines are kept as they are.
Two lines match when the Jaccard similarity of their sets is at least 0.8. A line goes if an earlier line, by doc_id and
then line number, matches it, whether or not that one is kept; so of equal lines the first stays.

The join: lines with equal sets are reduced to one row first. Words are ordered from rare to frequent, and of each set only the prefix that any
match must share a word with is shuffled by word (prefix filter), none of sets below LEAST_JOINED words; rows that meet are compared by
size (length filter), by what can still follow the shared word (positional filter) and by a bitmap of the
set. What remains is connected into groups, pair lists of which would be as long as the square of their sizes; the sets of a group come
together once, in full, and each is verified against those before it until one matches. Words so frequent that one task should not get all
their rows are split: their rows are dealt into chunks, and every pair of chunks meets in a task.

Null and empty texts have no lines that take part; they stay as they are. Nulls in other columns don't matter, but rows with a null doc_id
come first. Rows that repeat a doc_id are in the order of a hash of the text; of rows that repeat both, one, it isn't said which, counts as
the first, and the others lose all lines with a word. An empty table gives none. Extra columns stay, whatever their names; a column `n_removed` is
replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.components import connected_components
from quartier.llm.frequent import Frequent, count_words
from quartier.llm.ngramjoin import chunked, grouped
from quartier.llm.segments import ragged
from quartier.llm.store import aside, ddl, fresh, numbered, quoted, written

#: Smaller sets match equal ones only, which are one row already: 3 of 4 words are less than 0.8.
LEAST_JOINED = 4
#: Rows of one word that one task takes; words with more are split into chunks.
CHUNK_ROWS = 2048
#: Rows of one word that are compared at once; those of a chunk pair of a frequent word are fewer.
OVERFLOW = 16 * CHUNK_ROWS
BROADCAST_ROWS = 100_000
#: A size from here down stands for the number of the line in which a set stands first.
FIRST = -1
#: Edges, and rows by word: bitmaps have their first 64 bits in `b0`, and the others, which only sets above SMALL have, in `more`.
_MET = ("a", "b", "key", "packed", "id", "b0", "more")
_KINDS = {n: "binary" if n == "more" else "bigint" for n in _MET}
_MORE = 24
#: Sets of more words have bitmaps of 128 bits, and of 256, instead of 64.
SMALL, MIDDLE = 48, 112


def _word_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return K.words(data, off, lower=True).hash


def _taking_part(data: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line that takes part: its text, its number, its first word and how many words it has."""
    start, end, text = K.lines(data, off)
    a = np.searchsorted(word_start, start)
    n_words = np.searchsorted(word_start, end) - a
    number = np.arange(len(text)) - np.searchsorted(text, text)
    use = n_words > 0
    return text[use], number[use], a[use], n_words[use]


def _order(of: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by line, rank and hash: one sort of all three packed into 64 bits, or of the three where the bits left for the hash don't tell words apart."""
    line_bits, rank_bits = (max(1, int(x.max()).bit_length()) if len(x) else 1 for x in (of, rank))
    left = 64 - line_bits - rank_bits
    key = of.astype(K.U64) << K.U64(64 - line_bits) | rank.astype(K.U64) << K.U64(left) | h >> K.U64(64 - left)
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        return np.lexsort((h, rank, of))
    return order


class LineSets:
    """Sets of all lines of a batch that take part: text and number of each line, and its words from rare to frequent."""

    def __init__(self, data: np.ndarray, off: np.ndarray, frequent: Frequent | None):
        w = K.words(data, off, lower=True)
        self.text, self.number, a, n_words = _taking_part(data, off, w.start)
        of = np.repeat(np.arange(len(self.text)), n_words)
        h = w.hash[ragged(a, n_words)]
        count, rank = frequent.counts_and_ranks(h) if frequent else (None, np.zeros(len(h), np.int64))
        order = _order(of, rank, h)
        h, of = h[order], of[order]
        # equal words of a line come together
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.word = h[first]
        self.count = count[order][first] if frequent else np.zeros(0, np.int64)
        self.size = np.bincount(of[first], minlength=len(self.text))
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self._mixed = K.mix(self.word + K.U64(0x51ED270B))
        self.id = K.mix(np.add.reduceat(self._mixed, self.off[:-1]) + self.size.astype(K.U64)).view(np.int64) if len(self.text) else np.zeros(0, np.int64)

    def bits(self) -> np.ndarray:
        """Bitmaps: four words of 64 bits, of which smaller sets use two or one. A bit is the parity of the words that fall on it, so sets that differ
        in d words differ in d bits at most, however full the bitmaps are."""
        out = np.zeros((4, len(self.text)), K.U64)
        if len(self.text):
            bit, n = K.U64(1) << (self._mixed >> K.U64(58)), np.repeat(self.size, self.size)
            word = self._mixed >> K.U64(56) & np.where(n > MIDDLE, 3, np.where(n > SMALL, 1, 0)).astype(K.U64)
            for k in range(4):
                out[k] = np.bitwise_xor.reduceat(np.where(word == K.U64(k), bit, K.U64(0)), self.off[:-1])
        return out


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of these sizes with a similarity of 0.8: 5 o >= 4 (a + b - o)."""
    return -(-4 * (a + b) // 9)


def prefix(n: np.ndarray) -> np.ndarray:
    """Words that at least one of must be shared: any match shares 4/5 of the set."""
    return n - -(-4 * n // 5) + 1


def _wide(more: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of three 64-bit words as binaries, null where they aren't valid."""
    off = np.concatenate([[0], np.cumsum(np.where(valid, _MORE, 0))]).astype(np.int32)
    mask = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(valid), [mask, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(more[valid]).tobytes())])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """key, packed, id and b0 of a batch, and `more` as three words, 0 where it is null."""
    wide = batch.column(4)
    valid = wide.is_valid().to_numpy(zero_copy_only=False)
    more = np.zeros((len(wide), 3), np.int64)
    if valid.any():
        off = np.frombuffer(wide.buffers()[1], np.int32, len(wide) + 1, 4 * wide.offset)
        more[valid] = np.frombuffer(wide.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.int64).reshape(-1, 3)
    return [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), more]


def _rows(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """A row for each word of each set's prefix: the word, the set's id, its size with the word's place, and its bitmap; and a row for the first place of
    each set in a batch: dealt by the set, with FIRST less the line's number for the size, and the document and its tie in the bitmap's columns.

    Equal sets of one batch give rows once. A word that occurs in more than CHUNK_ROWS places has its rows dealt into chunks
    by id, and each row goes to every pair of chunks that its own is one of; side 1 and 2 are the two
    chunks of a pair, side 3 stands for a chunk with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_MET[2:])

        def out(key: np.ndarray, packed: np.ndarray, id_: np.ndarray, first: np.ndarray, more: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in (key, packed, id_, first)), more], names=names)

        for batch in batches:
            doc, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            a, seen = K.column(batch, "text"), np.zeros(0, np.int64)
            for i, j in K.chunks(a):
                s = LineSets(*K.raw(a.slice(i, j - i)), frequent)
                # the least place of each set: lines are in order of place within a text
                order = np.lexsort((s.number, tie[i + s.text], doc[i + s.text], s.id))
                first = order[np.flatnonzero(np.concatenate([[True], s.id[order][1:] != s.id[order][:-1]]))] if len(order) else order
                place = np.zeros((len(first), 3), np.int64)
                place[:, 0] = tie[i + s.text[first]]
                yield out(K.mix(s.id[first].view(K.U64)), FIRST - s.number[first], s.id[first], doc[i + s.text[first]], _wide(place, np.ones(len(first), bool)))
                ids, keep = s.id[first], first
                fresh_ = ~np.isin(ids, seen)
                seen, keep = np.union1d(seen, ids), keep[fresh_]
                keep = keep[s.size[keep] >= LEAST_JOINED]
                n, bits = prefix(s.size[keep]), s.bits()
                at = ragged(s.off[keep], n)
                row = np.repeat(keep, n)
                word, id_, packed = s.word[at], s.id[row], s.size[row] << 34 | at - s.off[row] << 2
                first, more, large = bits[0], np.ascontiguousarray(bits[1:].T), s.size > SMALL
                chunks = -(-s.count[at] // CHUNK_ROWS)
                whole = np.flatnonzero(chunks <= 1)
                yield out(word[whole], packed[whole] | 3, id_[whole], first[row[whole]], _wide(more[row[whole]], large[row[whole]]))
                split = np.flatnonzero(chunks > 1)
                if not len(split):
                    continue
                own = (id_[split].view(K.U64) % chunks[split].astype(K.U64)).astype(np.int64)
                back = np.repeat(split, chunks[split])
                mine, other = np.repeat(own, chunks[split]), ragged(np.zeros(len(split), np.int64), chunks[split])
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                key = K.mix(word[back] ^ K.mix((low << 32 | high).astype(K.U64)))
                yield out(key, packed[back] | np.where(mine == other, 3, np.where(mine < other, 1, 2)), id_[back], first[row[back]], _wide(more[row[back]], large[row[back]]))

    return docs.select("doc", "tie", "text").mapInArrow(run, ", ".join(f"{n} {_KINDS[n]}" for n in _MET[2:]))


def _met(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pairs that pass the filters, and each set's first place, from rows sorted by key; the rows of a key may go on over batches.

    A key of more than `limit` rows, which only one that is rarer than `floor` can be, isn't compared here: its rows go out again as
    (key, packed, id, b0, more), to be dealt into chunks by their true number.
    """
    none = [*[np.zeros(0, np.int64)] * 4, np.zeros((0, 3), np.int64)]
    rest, held, over = none, none, None
    for batch in batches:
        rows = [np.concatenate([old, new]) for old, new in zip(rest, _columns(batch), strict=True)]
        if not len(rows[0]):
            continue
        place = rows[1] < 0
        if place.any():
            held = _least_places([np.concatenate([old, r[place]]) for old, r in zip(held, rows, strict=True)])
            done = held[0] != held[0][-1]
            yield _places([h[done] for h in held])
            held, rows = [h[~done] for h in held], [r[~place] for r in rows]
            if not len(rows[0]):
                rest = rows
                continue
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
        for some in ([r[:cut] for r in rows],) if cut else ():
            yield from _compared(some, over, limit)
        rest = [r[cut:] for r in rows]
        if cut:
            over = None
        if len(rest[0]) > limit:
            over = int(rest[0][0])
            yield from _compared(rest, over, limit)
            rest = none
    yield _places(held)
    if len(rest[0]):
        yield from _compared(rest, over, limit)


def _least_places(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of the rows of first places the least one for each key and id."""
    key, packed, id_, doc, tie = rows
    order = np.lexsort((-packed, tie[:, 0], doc, id_, key))
    order = order[np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (id_[order][1:] != id_[order][:-1])]))]
    return [r[order] for r in rows]


def _places(rows: list[np.ndarray]) -> pa.RecordBatch:
    _, packed, id_, doc, tie = rows
    return _met_rows(len(id_), b=tie[:, 0], packed=packed, id=id_, b0=doc)


def _met_rows(length: int, more: pa.Array | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    wide = pa.nulls(length, pa.binary()) if more is None else more
    return pa.RecordBatch.from_arrays([*(pa.array(columns[n]) if n in columns else pa.nulls(length, pa.int64()) for n in _MET[:-1]), wide], names=_MET)


def _compared(rows: list[np.ndarray], over: int | None, limit: int) -> Iterator[pa.RecordBatch]:
    """The pairs of these rows, and those rows that are too many, or whose key is `over`, as they are."""
    key = rows[0]
    where = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(where, len(key)))
    much = np.repeat((n > limit) | ((key[where] == over) if over is not None else False), n)
    if much.any():
        key_, packed, id_, first, more = (r[much] for r in rows)
        yield _met_rows(len(key_), _wide(more, packed >> 34 > SMALL), key=key_, packed=packed, id=id_, b0=first)
        rows = [r[~much] for r in rows]
    key, packed, id_, first, more = rows
    if not len(key):
        return
    # by key, then size, then id, in one sort of what a batch needs of each
    run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])).astype(K.U64)
    order = np.argsort(run << K.U64(44) | np.minimum(packed >> 34, (1 << 24) - 1).astype(K.U64) << K.U64(20) | id_.view(K.U64) >> K.U64(44), kind="stable")
    yield from _pairs(key[order], packed[order], id_[order], np.concatenate([first[None, order], more[order].T]))


def _pairs(key: np.ndarray, packed: np.ndarray, id_: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    again = np.zeros(len(key), bool)  # copies of a set from other batches
    again[1:] = (key[1:] == key[:-1]) & (id_[1:] == id_[:-1]) & (packed[1:] == packed[:-1])
    key, packed, id_, bits = key[~again], packed[~again], id_[~again], bits[:, ~again].view(K.U64)
    two = np.stack([bits[0] ^ bits[2], bits[1] ^ bits[3]])
    one = two[0] ^ two[1]
    size, place, side = packed >> 34, packed >> 2 & 0xFFFFFFFF, packed & 3
    n, found = len(key), []
    # rows of a key are in order of size, so a row's partners follow it up to 5/4 of its size
    change = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1
    last = change[np.searchsorted(change, np.arange(n), "right")]
    a, step = np.flatnonzero(last > np.arange(n) + 1), 1
    while len(a):
        b = a + step
        near = b < last[a]
        near[near] = 4 * size[b[near]] <= 5 * size[a[near]]
        a, b = a[near], b[near]
        need = needed(size[a], size[b])
        ahead = np.minimum(size[a] - place[a], size[b] - place[b]) + np.minimum(place[a], place[b])
        ok = (id_[a] != id_[b]) & ((side[a] == 3) | (side[a] != side[b])) & (ahead >= need)
        x, y, most = a[ok], b[ok], (size[a] + size[b] - 2 * need)[ok]
        # both bitmaps as narrow as the smaller set's
        differ = np.bitwise_count(one[x] ^ one[y]).astype(np.int64)
        for least, words in ((SMALL, two), (MIDDLE, bits)):
            wide = np.flatnonzero(size[x] > least)
            differ[wide] = np.bitwise_count(words[:, x[wide]] ^ words[:, y[wide]]).sum(axis=0, dtype=np.int64)
        x, y = x[differ <= most], y[differ <= most]
        found.append(np.stack([id_[x], id_[y]]))
        step += 1
        if sum(x.shape[1] for x in found) > 1 << 20:
            found = [_stars(np.concatenate(found, axis=1))]
    if found:
        hub, other = _stars(np.concatenate(found, axis=1))
        yield _met_rows(len(hub), a=hub, b=other)


def _stars(pairs: np.ndarray) -> np.ndarray:
    """As many edges as nodes less groups that connect what the pairs connect: each group's least id with each other one."""
    ids, at = np.unique(pairs, return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[label[other]], ids[other]])


def _candidates(docs: DataFrame, frequent: Frequent) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect all set ids whose prefixes share a word and that pass all filters; pairs aren't listed. And the first place of each set: id, doc, tie, number."""
    kinds = ", ".join(f"{n} {k}" for n, k in _KINDS.items())

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(functools.partial(_met, limit=OVERFLOW), kinds)

    found = written(met(_rows(docs, frequent)).repartition(F.when(F.col("a").isNull(), F.col("id")).otherwise(F.col("b"))), "line-meetings")
    firsts = found.filter("packed < 0").select("id", F.col("b0").alias("doc"), F.col("b").alias("tie"), (F.lit(FIRST) - F.col("packed")).cast("int").alias("number"))
    edges = found.filter("a IS NOT NULL").select("a", "b")
    over = found.filter("key IS NOT NULL").select(*_MET[2:])
    if not over.isEmpty():
        rows = chunked(over, "key").withColumn("key", F.col("part")).withColumn("packed", F.expr("packed - (packed & 3) + side"))
        edges = edges.union(met(rows.select(*_MET[2:])).filter("a IS NOT NULL").select("a", "b"))
    return edges, firsts


def _judge(rows: dict) -> list[tuple[int, int]]:
    """Each set of a group that an earlier one matches, with that one."""
    order = sorted(range(len(rows["id"])), key=lambda k: (rows["doc"][k], rows["tie"][k], rows["number"][k]))
    sets = [np.frombuffer(rows["words"][k], K.U64) for k in order]
    ids, side, size = [rows["id"][k] for k in order], np.array(rows["side"])[order], np.array(list(map(len, sets)))
    bits = np.array([np.bitwise_or.reduce(K.U64(1) << (K.mix(s + K.U64(0x51ED270B)) >> K.U64(58))) for s in sets], K.U64)
    out = []
    for k in range(1, len(ids)):
        need = needed(size[:k], size[k])
        ok = (np.minimum(size[:k], size[k]) >= need) & (np.bitwise_count(bits[:k] ^ bits[k]) <= size[:k] + size[k] - 2 * need) & ((side[k] == 3) | (side[:k] != side[k]))
        for e in np.flatnonzero(ok).tolist():
            if len(np.intersect1d(sets[e], sets[k], assume_unique=True)) >= need[e]:
                out.append((ids[k], ids[e]))
                break
    return out


def _gone(docs: DataFrame, edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """Ids of the sets that match one that stands earlier, each verified on the words of both."""
    groups = written(connected_components(edges), "line-groups")
    places = firsts.join(groups.hint("shuffle_hash"), "id")
    own = written(places.groupBy("doc", "tie").agg(F.collect_set("number").alias("numbers")), "line-candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, wanted = K.column(batch, "text"), batch.column(1).to_pylist()
            for i, j in K.chunks(a):
                s = LineSets(*K.raw(a.slice(i, j - i)), None)
                at = np.searchsorted(s.text, np.arange(j - i + 1))
                keep = np.array([k for t in range(j - i) for k in range(at[t], at[t + 1]) if s.number[k] in set(wanted[i + t])], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.id[keep]), pa.array([s.word[s.off[k] : s.off[k + 1]].tobytes() for k in keep.tolist()], pa.binary())], names=["id", "words"])

    few = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    sets = docs.join(few, ["doc", "tie"]).select("text", "numbers").mapInArrow(run, "id bigint, words binary").dropDuplicates(["id"])
    parts = chunked(places, "component").withColumn("cls", F.lit(0)).join(sets, "id").select("part", "cls", "id", "doc", "tie", "number", "words", "side")
    found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(grouped(_judge, ("id", "doc", "tie", "number", "words", "side")), "a bigint, b bigint")
    return found.select(F.col("a").alias("id")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The table with its texts less all lines that match an earlier one, and `n_removed`, how many these are."""
    kept = docs.drop("n_removed")
    doc, tie, copy, stay, at, by = fresh(kept.columns, "__doc", "__tie", "__copy", "__stays", "__at", "__by")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = kept.select(key.alias("doc"), F.xxhash64("text").alias("tie"), "text")
    frequent = count_words(docs, _word_hashes)
    edges, firsts = _candidates(keyed, frequent)
    gone = written(_gone(keyed, edges, firsts), "lines-gone")
    # a line that takes part stays only where its set stands first, and if no match of the set stands earlier
    stays = firsts.join(gone.hint("shuffle_hash"), "id", "left_anti").groupBy(F.col("doc").alias(at), F.col("tie").alias(by)).agg(F.collect_set("number").alias(stay))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            texts, stays_, a, again = column("text"), column(stay), K.column(batch, "text"), column(copy).to_numpy() != 0
            n_removed, changed, new = np.zeros(len(a), np.int64), np.zeros(len(a), bool), []
            # the lines that stay as one number each: the row and the line
            some = stays_.value_lengths().fill_null(0).to_numpy()
            staying = np.repeat(np.arange(len(a)), some) << 32 | stays_.flatten().to_numpy(zero_copy_only=False)
            staying = np.sort(staying[~again[staying >> 32]])
            for i, j in K.chunks(a):
                data, off = K.raw(a.slice(i, j - i))
                text, number, *_ = _taking_part(data, off, K.word_starts(data, off))
                line = (i + text) << 32 | number
                lost = line[~np.isin(line, staying, assume_unique=True)]
                row, start, n = np.unique(lost >> 32, return_index=True, return_counts=True)
                n_removed[row], changed[row] = n, True
                for t, x, m in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
                    gone = set((lost[x : x + m] & 0xFFFFFFFF).tolist())
                    new.append("\n".join(x for k, x in enumerate(a[t].as_py().split("\n")) if k not in gone))
            out = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
            names = [n for n in batch.schema.names if n not in ("text", stay, copy)]
            yield pa.RecordBatch.from_arrays([*(column(n) for n in names), out, pa.array(n_removed)], names=[*names, "text", "n_removed"])

    marked = numbered(kept.withColumns({doc: key, tie: F.xxhash64("text")}), (doc, tie), copy)
    joined = marked.join(stays.hint("shuffle_hash"), (F.col(doc) == F.col(at)) & (F.col(tie) == F.col(by)), "left").select(*quoted(c for c in kept.columns if c != "text"), "text", copy, stay)
    return joined.mapInArrow(run, ddl(joined.drop(stay, copy), "n_removed bigint")).select(*quoted(kept.columns), "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that match an earlier one. A document that loses its last line with a word, as an exact copy does, goes."""
    own = aside(docs, "n_removed")
    kept = dedup_lines(own).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*quoted(own.columns)).toDF(*docs.columns)
