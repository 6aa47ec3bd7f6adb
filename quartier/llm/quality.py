"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps its measurements and one bit for each rule that a
document fails. A policy is a version name and the mask of rules that it enforces, so policies can
be changed, compared and ablated by bitwise aggregation over the ledger, without reading a text again.

Nulls and empty texts have no words and all measurements 0, so they fail `few_words` under every policy.
Repeated rows and equal doc_ids are judged row by row. Extra columns stay as they are; a column of the
table that has the name of a ledger column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.store import aside, quoted

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"

#: Rule names with what fails, in bit order. A bit keeps its place for good; new rules take new bits.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_words >= 10 and 10 * n_dup_lines > 3 * n_lines",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version.
POLICIES = {"v1": BASE, "v2": BASE | BIT["symbols"] | BIT["repeated_lines"], "v3": sum(BIT.values())}
PRODUCTION = "v3"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
    for batch in batches:
        a = K.column(batch, "text")
        found = []
        for i, j in K.chunks(a):
            data, off = K.raw(a.slice(i, j - i))
            w = K.words(data, off)
            h = K.windows(w.hash)
            of = w.text_of()
            at = np.flatnonzero(of[: len(h)] == of[K.WINDOW - 1 :][: len(h)])
            key = K.mix(h[at] + of[at].astype(K.U64) * K.U64(0xD6E8FEB86659FD93))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = at[count[inverse] > 1]
            open_ = np.zeros(len(of) + 1, np.int64)
            np.add.at(open_, again, 1)
            np.add.at(open_, again + K.WINDOW, -1)
            start, end, text = K.lines(data, off)
            worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
            line = K.Spans(data, off, data != 10, False)
            start, text = start[worded], text[worded]
            key = K.mix(line.hash[np.searchsorted(line.start, start)] + text.astype(K.U64) * K.U64(0xD6E8FEB86659FD93))
            first = np.zeros(len(key), bool)
            first[np.unique(key, return_index=True)[1]] = True
            in_words = np.zeros(len(data) + 1, np.int64)
            in_words[w.start] += 1
            np.subtract.at(in_words, w.end, 1)
            inside = np.cumsum(in_words[:-1]) > 0
            found.append(np.stack([w.count, K.per_text(inside & ((data & 0xC0) != 0x80), off), K.per_text(symbol[data], off), np.bincount(text[~first], minlength=j - i), K.per_text(np.cumsum(open_[:-1]) > 0, w.off), np.bincount(text, minlength=j - i)]))
        m = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
        keep = [n for n in batch.schema.names if n not in (*MEASURES, "n_lines")]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [pa.array(x.astype(np.int64)) for x in m], names=[*keep, *MEASURES, "n_lines"])


def measure(docs: DataFrame) -> DataFrame:
    """The table with its measurements: words, code points in words, symbols, repeated lines and windows."""
    kept = docs.drop(*MEASURES, "n_lines")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{m} bigint" for m in (*MEASURES, "n_lines"))])
    return kept.mapInArrow(_measure, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """The measured table with `fail_bits`, in which a bit is set for each rule that the row fails."""
    bits = [F.when(F.expr(rule) if isinstance(rule, str) else rule, F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total.cast("int"))


def apply_policy(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with `kept`: no rule that the policy enforces has failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects, which would come back without it.

    The rows are first counted by `fail_bits`, of which there are at most 2 to the number of rules.
    """
    mask = POLICIES[version]
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask])
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    return counts.withColumn("r", F.explode(rules)).groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(ledger(docs))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return led.select("doc_id", *MEASURES, base.alias("base_failed"), "kept", "fail_bits", "n_lines")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the production policy keeps."""
    own = aside(docs, *MEASURES, "n_lines", "fail_bits", "kept")
    return apply_policy(ledger(own)).filter("kept").select(*quoted(own.columns)).toDF(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * word_chars < 25 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN n_words >= 10 AND 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines FROM b
"""
