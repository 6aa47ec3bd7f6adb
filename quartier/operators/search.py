"""Search for many texts in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all needles together up to which one automaton holds them; it takes some hundred bytes for each in every worker.
AUTOMATON_CHARS = 1_000_000
#: Length of the pieces by which texts and needles meet beyond that, and of which each needle has one; shorter needles meet whole.
PIECE = 4

_built: dict[int, ahocorasick.Automaton] = {}


def _automaton(needles: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of needles; a worker builds it once."""
    key = needles._jbroadcast.id() if needles._jbroadcast is not None else hash(needles._path)
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, needle in enumerate(needles.value):
            a.add_word(needle, (i, len(needle)))
        a.make_automaton()
        _built[key] = a
    return _built[key]


def _hits(text: str, a: ahocorasick.Automaton, tokens: bool) -> set[int]:
    """Numbers of the needles that a text holds; with `tokens`, between white space or the text's ends."""
    if not tokens:
        return {i for _, (i, _) in a.iter(text)}
    n, out = len(text), set()
    for end, (i, length) in a.iter(text):
        if i not in out and (end + 1 == n or text[end + 1].isspace()) and (end + 1 == length or text[end - length].isspace()):
            out.add(i)
    return out


def contained(texts: DataFrame, needles: DataFrame, least: int = 1, tokens: bool = False) -> DataFrame:
    """(row, needle): for each text (row, text) the distinct needles (needle) that it holds, in any case and lower-cased, of at least so many characters.

    Rows are told apart by `row`. With `tokens` a needle has to stand between white space or the text's ends, where runs of white space count as one blank. Needles of up to AUTOMATON_CHARS in all become one
    Aho-Corasick automaton, which goes over each text once, whatever the number of needles. Larger lists aren't brought together: each needle is filed under
    that one of its pieces which the fewest needles have, texts meet it by an equality join on their pieces, of which there is one for each character, and what meets is
    looked at in full. Null texts and needles, and empty needles, are in nothing.
    """
    plain = (lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))) if tokens else F.lower
    t = texts.toDF("row", "text").select("row", plain(F.col("text")).alias("text")).filter("text <> ''")
    own = needles.toDF("needle").select(plain(F.col("needle")).alias("needle")).filter(F.length("needle") >= max(least, 1)).distinct()
    total = own.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    if total > AUTOMATON_CHARS:
        return _by_pieces(t, own, tokens)
    words = texts.sparkSession.sparkContext.broadcast([r.needle for r in own.collect()])
    kind = t.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words.value:
            return
        a, names = _automaton(words), pa.array(words.value, pa.string())
        for batch in batches:
            found = [sorted(_hits(x, a, tokens)) for x in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            at = np.repeat(np.arange(len(found)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), names.take(pa.array([i for f in found for i in f], pa.int64()))], names=["row", "needle"])

    return t.mapInArrow(run, f"row {kind}, needle string")


def _by_pieces(t: DataFrame, own: DataFrame, tokens: bool) -> DataFrame:
    def pieces(c: str, size: int):
        return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(F.col(c), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))

    long = own.filter(F.length("needle") >= PIECE).select("needle", F.explode(pieces("needle", PIECE)).alias("piece"))
    shared = long.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    filed = long.join(shared, "piece").groupBy("needle").agg(F.min(F.struct("n", "piece")).alias("p")).select("needle", "p.piece")
    filed = filed.union(own.filter(F.length("needle") < PIECE).select("needle", F.col("needle").alias("piece")))
    # a text's pieces of each length that a filed piece has; the texts themselves stay where they are until few are left
    each = t.select("row", F.explode(F.concat(*(pieces("text", n) for n in range(1, PIECE + 1)))).alias("piece")).distinct()
    met = each.join(filed, "piece").select(F.col("row").alias("__row"), "needle").distinct()
    holds = F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "needle", F.lit(" "))) if tokens else F.contains("text", "needle")
    return t.join(met, F.col("row").eqNullSafe(F.col("__row"))).filter(holds).select("row", "needle")
