"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split at safe boundaries before they are encoded: no match of the splitting pattern goes on
from a character that isn't white space into one that is, nor from a letter into a digit or back,
nor from a letter into a mark. Decoding
joins the raw bytes of the ids, so it gives back any text, however its characters were cut.

A null text is encoded as the empty one: no ids. Texts of any length are encoded whole. Repeated rows are
encoded row by row; extra columns stay, and those named like the new columns are replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import textkernel as K
from quartier.llm.segments import TEXT_BYTES, SegmentEncoder, flattened, ragged
from quartier.llm.store import ddl

RANKS = "byte_bpe_50k.tiktoken"
#: White space as the pattern has it (fixed values of Unicode's White_Space).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of Latin letters is cut off from marks after it, as letters and marks never share a match (but for `'`).
_SEGMENT = re.compile(f"[{_WHITE}]*[A-Za-zß-öø-ÿ]+(?=[.,;:!?|]*(?:[{_WHITE}]|$))|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_SHIFT = re.compile(r"(?<=[^\W\d_])(?=[0-9])|(?<=[0-9])(?=[^\W\d_])")
LONG = 100_000


def split(text: str) -> list[str]:
    """Segments that can be encoded one by one."""
    found = _SEGMENT.findall(text)
    if len(text) > LONG and any(len(x) > LONG for x in found):
        found = [y for x in found for y in (filter(None, _SHIFT.split(x)) if len(x) > LONG else (x,))]
    return found


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _encoder(path: str, pattern: str) -> SegmentEncoder:
    one = encoding(path, pattern).encode_ordinary
    return SegmentEncoder(split, lambda new: flattened(list(map(one, new))))


@functools.cache
def _token_bytes(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = _by_rank(encoding(path, pattern))
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def _by_rank(enc: tiktoken.Encoding) -> list[bytes]:
    out = [b""] * enc.n_vocab
    for i in range(enc.n_vocab):
        try:
            out[i] = enc.decode_single_token_bytes(i)
        except KeyError:
            continue
    return out


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = _encoder(path, pattern)
    for batch in batches:
        a = K.column(batch, "text")
        for i, j in K.chunks(a, TEXT_BYTES):
            ids, n = enc(a.slice(i, j - i).to_pylist())
            off = np.concatenate([[0], np.cumsum(n)]) * 4
            flat = ids.astype("<u4").tobytes()
            out = pa.array([flat[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n.astype(np.int64)), out], names=[*rows.schema.names, "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    data, start, length = _token_bytes(path, pattern)
    for batch in batches:
        out = []
        for x in batch.column(batch.schema.get_field_index("ids")):
            ids = np.frombuffer(x.as_py() or b"", "<u4")
            out.append(data[ragged(start[ids], length[ids])].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The table with `n_tokens` and `ids`, the ids as little-endian unsigned 32-bit integers."""
    path, kept = path or public_tokenizers.path(RANKS), docs.drop("n_tokens", "ids")
    return kept.mapInArrow(lambda b: _encoded(b, path, pattern), ddl(kept, "n_tokens bigint", "ids binary"))


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The table with `decoded`, the bytes that its `ids` stand for; null ids give no bytes."""
    path, kept = path or public_tokenizers.path(RANKS), encoded.drop("decoded")
    return kept.mapInArrow(lambda b: _decoded(b, path, pattern), ddl(kept, "decoded binary"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """decode(encode(docs)) in one pass of one Python worker."""
    path, kept = path or public_tokenizers.path(RANKS), docs.drop("n_tokens", "ids", "decoded")
    return kept.mapInArrow(lambda b: _decoded(_encoded(b, path, pattern), path, pattern), ddl(kept, "n_tokens bigint", "ids binary", "decoded binary"))


def digests(docs: DataFrame) -> DataFrame:
    done = round_trip(docs)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and the digest of the bytes that they decode to."""
    done = round_trip(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
