"""Benchmark decontamination with spaced seeds.

Words are lower-cased runs of letters, digits and non-ASCII characters. Each fixed mask takes the words at its
ones and ignores those at its zeros, so a seed still hits where words at ignored places have been substituted. Masked
hashes of the benchmark's items are looked up among those of every position of every text; a hit fixes how
item and text lie against each other, and along that diagonal every maximal run of matches and substitutions (a match
counts 1, a substitution -3) is verified word by word. A run with enough matches makes the document contaminated.

An item of fewer words than SPAN, but at least MIN_SHORT, is too short for such a run: it is found by shorter masks and must
occur whole, with one word in eight substituted at most. Items of fewer than MIN_SHORT words are ordinary phrases and not searched for,
nor are nulls and empty items. Null and empty texts are clean, and an empty table gives none. Texts are searched whole. Repeated
rows and repeated items get the same result each; extra columns stay, those named like the new ones are replaced.
The benchmark is searched for in blocks of at most BLOCK_SEEDS seeds, so no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.store import aside, ddl, quoted

#: Fixed masks, one of which hits in every run that is accepted: each end part of a run scores above 0, so its last eight words
#: hold at most one substitution (two would leave 6 - 2 * 3), and the last four hold none.
MASKS = ("1111111", "10111111", "11011111", "11101111")
#: Masks for short items, one of which hits in every item of 5 to 7 words that is unchanged and of 8 to 11 with one substitution.
SHORT_MASKS = ("11111", "1110111")
#: Items of fewer words must occur whole.
SPAN = 12
MIN_MATCHES = 11
MIN_SHORT = 5
BLOCK_SEEDS = 2_000_000
SUBSTITUTION = 3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(data: np.ndarray, off: np.ndarray) -> K.Spans:
    """Words without ASCII punctuation, lower-cased in Latin-1 letters too (0xC3 leads these in UTF-8)."""
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    if len(second):
        data = data.copy()
        data[second] += 0x20
    return K.Spans(data, off, _WORD[data], True)


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Masked hash of the mask's span from each word on; SHORT_MASKS follow MASKS."""
    ones = (*MASKS, *SHORT_MASKS)[mask]
    n = len(h) - len(ones) + 1
    if n <= 0:
        return np.zeros(0, K.U64)
    out = np.full(n, mask + 1, K.U64)
    for j, used in enumerate(ones):
        if used == "1":
            out += h[j : n + j] * K._COEF[j + 16]
    return K.mix(out)


class Items:
    """A block of benchmark items with a sorted table of their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        data, off = K.raw(pa.array([t or "" for _, t in rows], pa.string()))
        w = plain_words(data, off)
        self.words = [w.hash[a:b] for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)]
        found, short = [], range(len(MASKS), len(MASKS) + len(SHORT_MASKS))
        for k, h in enumerate(self.words):
            if len(h) >= MIN_SHORT:
                found += [(s, k, p, m) for m in (range(len(MASKS)) if len(h) >= SPAN else short) for p, s in enumerate(seeds(h, m).tolist())]
        found.sort()
        self.seed = np.array([f[0] for f in found], K.U64)
        self.item, self.place = (np.array([f[c] for f in found], np.int64) for c in (1, 2))
        self.masks = sorted({f[3] for f in found})
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seed >> K.U64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, item, place in item) of every seed that text and items share."""
        out = []
        for m in self.masks:
            s = seeds(h, m)
            at = np.flatnonzero(self.sieve[(s >> K.U64(42)).astype(np.int64)])
            a, b = (np.searchsorted(self.seed, s[at], side) for side in ("left", "right"))
            for p, x, y in zip(at[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                out += [(p, int(self.item[z]), int(self.place[z])) for z in range(x, y)]
        return out


def best_run(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the most matches over SUBSTITUTION times its substitutions."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()), end


def runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every maximal run with MIN_MATCHES matches.

    In a run no start part scores below 0 and every end part above 0. Runs that overlap join into one, so maximal runs are disjoint: the
    best run is one of them, and the others lie wholly before or after it. A match more never takes a run away.
    """
    out, rest = [], [(0, len(same))]
    while rest:
        a, b = rest.pop()
        if np.count_nonzero(same[a:b]) < MIN_MATCHES:
            continue
        x, y = best_run(same[a:b])
        if np.count_nonzero(same[a + x : a + y]) >= MIN_MATCHES:
            out.append((a + x, a + y))
        rest += [(a, a + x), (a + y, b)]
    return sorted(out)


def overlaps(h: np.ndarray, start: int, stop: int, hits: list[tuple[int, int, int]], items: Items) -> list[tuple[int, int, int, int]]:
    """Verified (item id, first word, end word, matches) of the text at words start .. stop of h."""
    out, seen = [], set()
    for p, k, q in hits:
        d = p - q
        if (k, d) in seen:
            continue
        seen.add((k, d))
        item = items.words[k]
        a, b = max(start - d, 0), min(stop - d, len(item))
        same = h[a + d : b + d] == item[a:b]
        if len(item) < SPAN:
            if b - a == len(item) and same.sum() >= len(item) - len(item) // 8:
                out.append((items.ids[k], a + d - start, b + d - start, int(same.sum())))
            continue
        out += [(items.ids[k], a + x + d - start, a + y + d - start, int(same[x:y].sum())) for x, y in runs(same)]
    return sorted(set(out), key=lambda r: (r[1], r[2], r[0]))


OVERLAPS = "array<struct<item_id: bigint, first_word: bigint, end_word: bigint, matches: bigint>>"


def _search(docs: DataFrame, rows: list[tuple[int, str]], first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "end_word", "matches")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in batches:
            a = K.column(batch, "text")
            old = [[] for _ in range(len(a))] if first else batch.column(batch.schema.get_field_index("overlaps")).to_pylist()
            for i, j in K.chunks(a):
                w = plain_words(*K.raw(a.slice(i, j - i)))
                by: dict[int, list] = {}
                hits = items.hits(w.hash)
                for hit, text in zip(hits, np.searchsorted(w.off, [p for p, _, _ in hits], "right") - 1, strict=True):
                    by.setdefault(int(text), []).append(hit)
                for text, own in by.items():
                    old[i + text] += [dict(zip(("item_id", "first_word", "end_word", "matches"), o, strict=True)) for o in overlaps(w.hash, int(w.off[text]), int(w.off[text + 1]), own, items)]
            keep = [n for n in batch.schema.names if n != "overlaps"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(old, kind)], names=[*keep, "overlaps"])

    return docs.mapInArrow(run, ddl(docs.drop("overlaps"), f"overlaps {OVERLAPS}"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The table with `overlaps`, the verified runs that each text shares with benchmark items."""
    bench = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    words = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 2
    blocks = max(1, -(-int(words * len(MASKS)) // BLOCK_SEEDS))
    out = docs.drop("overlaps")
    for b in range(blocks):
        own = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        out = _search(out, sorted({(r.item_id, r.text) for r in own.toLocalIterator()}), b == 0)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o.item_id)))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("overlaps", lambda o: o.matches)), F.lit(0)).cast("long").alias("max_matches"), "overlaps")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified overlap."""
    own = aside(docs, "overlaps")
    found = find_overlaps(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("overlaps") == 0).select(*quoted(own.columns)).toDF(*docs.columns)
