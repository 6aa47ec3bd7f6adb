"""Exact URL lists by Bloom filter cascades.

A cascade answers for a known universe of keys. Level 0 is a Bloom filter of the listed keys; level 1 holds the
keys of the universe that level 0 lets through by mistake, level 2 the listed keys that level 1 lets
through, and so on until a level makes no mistake. A key is listed if the first level that it fails is an
odd one, or if it passes all and their number is odd. For the universe that it was built from the answer is exact,
though no task holds the list itself and nothing is joined.

Level 0's rate is set so that its mistakes over the whole universe number about as many as listed keys, so
all levels together stay in proportion to the list however large the corpus is. The list's size is checked
against MAX_LISTED; a longer list is cut into parts by key hash, one cascade each. A list may be a table of hosts as well as a
Python one; it comes to the driver as hashes, 8 bytes a key, a part at a time.

The universe: for every url its host and parent domains, each with every prefix of its path that is as long as some
rule's. Rules are stored as `host/path`, the longest listed one decides. A null url, or one without `://`, has
an empty host and path and gets the default verdict, as does a url that nothing fits. Repeated
urls are judged row by row; extra columns stay; no rules and an empty table are allowed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.store import ddl, written

MAX_LISTED = 5_000_000
#: (host, path, verdict), as given for the pages.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts that are blocked where no rule fits.
HOSTS = ("cheap-pills.example.com", "spam-farm.example.org")


def key_hash(keys: list[str]) -> np.ndarray:
    data, off = K.raw(pa.array(keys, pa.string()))
    return K.Spans(data, off, np.ones(len(data), bool), False).hash if keys else np.zeros(0, K.U64)


class Bloom:
    def __init__(self, keys: np.ndarray, rate: float, level: int):
        rate = min(max(rate, 1e-9), 0.5)
        self.n_hashes = max(1, round(-np.log2(rate)))
        self.n_bits = max(64, int(len(keys) * self.n_hashes / np.log(2)) + 1)
        self.level, self.bits = level, np.zeros(-(-self.n_bits // 8), np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = K.mix(keys ^ K.U64(0xA5A5 + 977 * self.level))
        b = K.mix(a) | K.U64(1)
        for i in range(self.n_hashes):
            yield ((a + b * K.U64(i)) % K.U64(self.n_bits)).astype(np.int64)

    def __contains__(self, key: object) -> bool:
        raise TypeError("ask for many keys at once: passes()")

    def passes(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in self._places(keys):
            ok &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return ok


@dataclass
class Cascade:
    levels: list[Bloom]

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), len(self.levels) % 2 == 1), np.ones(len(keys), bool)
        for i, level in enumerate(self.levels):
            fails = open_ & ~level.passes(keys)
            out[fails] = i % 2 == 1
            open_ &= ~fails
        return out


def _hashed(listed: DataFrame) -> tuple[int, Iterator[np.ndarray]]:
    """Hashes of a list's distinct keys in parts of at most about MAX_LISTED: how many parts, and one after the other, so that the driver holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_hash(batch.column(0).drop_null().to_pylist()).view(np.int64))], names=["h"])

    hashes = written(listed.select(F.lower(listed.columns[0]).alias("key")).mapInArrow(run, "h bigint").distinct(), "listed-keys")
    parts = max(1, -(-hashes.count() // MAX_LISTED))

    def each() -> Iterator[np.ndarray]:
        for p in range(parts):
            # as unsigned numbers modulo the parts, in halves that fit into signed ones
            own = hashes.filter(F.expr(f"pmod(pmod(shiftrightunsigned(h, 1), {parts}) * 2 + (h & 1), {parts}) = {p}"))
            yield np.unique(own.toPandas()["h"].to_numpy(np.int64).view(K.U64))

    return parts, each()


def build(universe: DataFrame, listed: Iterable[str] | DataFrame, n_universe: int) -> list[Cascade]:
    """A cascade for each part of a list over the keys of `universe` (a column `key`, distinct).

    Tasks have level 0 alone, not the list. Of the universe's keys those come to the driver that it lets through: listed ones, and by mistake about as many as the list has.
    """
    if isinstance(listed, DataFrame):
        parts, of = _hashed(listed)
    else:
        own = np.unique(key_hash(sorted(set(listed))))
        parts = max(1, -(-len(own) // MAX_LISTED))
        of = (own[own % K.U64(parts) == p] for p in range(parts))
    out = []
    for p, part in enumerate(of):
        first = Bloom(part, len(part) / max(n_universe, 1), 0)

        def passing(batches: Iterator[pa.RecordBatch], first=first, p=p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = key_hash(batch.column(0).to_pylist())
                h = h[h % K.U64(parts) == p]
                yield pa.RecordBatch.from_arrays([pa.array(h[first.passes(h)].view(np.int64))], names=["h"])

        passed = universe.select("key").mapInArrow(passing, "h bigint").distinct().toPandas()["h"].to_numpy(np.int64).view(K.U64)
        levels, inside, outside = [first], part, np.setdiff1d(passed, part)
        while len(outside):
            level = Bloom(outside, 0.5, len(levels))
            levels.append(level)
            inside, outside = outside, inside[level.passes(inside)]
        out.append(Cascade(levels))
    return out


def is_listed(cascades: list[Cascade], keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for p, c in enumerate(cascades):
        own = keys % K.U64(len(cascades)) == p
        out[own] = c.listed(keys[own])
    return out


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """`host/path` keys that a rule that fits may have, longest first."""
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [h + path[:n] for h in hosts for n in lengths if n <= len(path)]
    return sorted(found, key=len, reverse=True)


def parts(url: str = "url") -> tuple["F.Column", "F.Column"]:
    """Host, lower-cased in A-Z alone, and path of a url."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, hosts: Iterable[str] | DataFrame = HOSTS, default: str = "allow") -> DataFrame:
    """The table with `host`, `path`, `rule` and `verdict`."""
    rules = list(rules)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    host, path = parts()
    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in [*_candidates(h, p, lengths), *_candidates(h, "", [0])]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    universe = written(split.select("host", "path").mapInArrow(keys, "key string").distinct(), "url-keys")
    n = universe.count()
    allow, block, bad = (build(universe, which, n) for which in ([h + p for h, p, v in rules if v == "allow"], [h + p for h, p, v in rules if v == "block"], hosts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ps = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            rule, verdict = [], []
            own = [_candidates(h, p, lengths) for h, p in zip(hs, ps, strict=True)]
            bare = [_candidates(h, "", [0]) for h in hs]
            flat = key_hash([k for c in own for k in c])
            a, b, at = is_listed(allow, flat), is_listed(block, flat), 0
            spam, on = is_listed(bad, key_hash([k for c in bare for k in c])), 0
            for c, h in zip(own, bare, strict=True):
                hit = next((i for i in range(len(c)) if a[at + i] or b[at + i]), None)
                rule.append(None if hit is None else c[hit])
                verdict.append(("allow" if a[at + hit] else "block") if hit is not None else "block" if spam[on : on + len(h)].any() else default)
                at, on = at + len(c), on + len(h)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return split.mapInArrow(run, ddl(split, "rule string", "verdict string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule,
       CASE WHEN v IS NOT NULL THEN v
            WHEN regexp_matches(host, '(^|\.)(cheap-pills\.example\.com|spam-farm\.example\.org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id AND n = 1
"""
