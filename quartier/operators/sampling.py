"""Reproducible sampling by digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.functions.normalize import lowered


# What makes an address a complex urban one, and how often it must be asked for to count as urban; degrees from a boundary that count as near.
URBAN = r"(?iu)(ngõ|ngách|hẻm|kiệt|sn(?![\p{L}\p{N}_])|lô\s*\d|đường\s+số|hem|ngo\s)"
POPULAR = 500
NEAR_BOUNDARY = 0.0011


def temporal_signal(pairs: Sequence[tuple[str, str]], old_address: str, address: str) -> Column:
    """Whether an id differs from its old one, or the address from the old address but for case and white space; missing values say nothing."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | F.coalesce(F.col(a) != F.col(b), F.lit(False))
    texts = [F.nullif(F.col(c), F.lit("")) for c in (old_address, address)]
    return out | F.coalesce(lowered(texts[0]) != lowered(texts[1]), F.lit(False))


def urban_signal(popular: str, address: str) -> Column:
    return (F.coalesce(F.col(popular), F.lit(0)) >= POPULAR) | F.coalesce(F.col(address).rlike(URBAN), F.lit(False))


def stratum(temporal: Column, urban: Column, degrees: Column | None = None, lat: Column | None = None, lon: Column | None = None) -> Column:
    """D4 near a boundary, D3 for a temporal signal, D1 for an urban one, else D2; without distances, what has coordinates and no other signal is D4."""
    near = F.coalesce(degrees < NEAR_BOUNDARY, F.lit(False)) if degrees is not None else F.lit(False)
    out = F.when(near, "D4").when(temporal, "D3").when(urban, "D1")
    return (out if degrees is not None else out.when(lat.isNotNull() & lon.isNotNull(), "D4")).otherwise("D2")


def digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def md5_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least digests, the same for any layout of the table; a top-n, so nothing is sorted whole."""
    return df.withColumn("digest", digest(key, seed)).orderBy("digest", key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """For each stratum its quota of rows with the least digests."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(digest(key, seed), key)))
    wanted = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    return ranked.filter(F.col("rank") <= wanted)


def quotas(n: int, shares: Sequence[tuple[str, float]]) -> dict[str, int]:
    """Rounded shares of n; the last stratum has what the others leave."""
    out = {s: round(n * share) for s, share in shares[:-1]}
    return out | {shares[-1][0]: max(0, n - sum(out.values()))}


def quota_sample(df: DataFrame, key: str, stratum: str, n: int, shares: Sequence[tuple[str, float]], seed: int, filler: str) -> DataFrame:
    """n rows by quotas: of each stratum those with the least digests, and, where strata fall short, further rows of the whole table in the order of
    their digests, whose stratum is then `filler`. Keys are distinct. Each stratum contributes a top-n, so no stratum is sorted whole.
    """
    order = [digest(key, seed), F.col(key)]
    picked = None
    for name, quota in quotas(n, shares).items():
        own = df.filter(F.col(stratum) == name).orderBy(*order).limit(quota)
        picked = own if picked is None else picked.unionByName(own)
    # at most n rows are missing, and at most n of the first 2 n rows are picked already
    pool = df.orderBy(*order).limit(2 * n).join(picked.select(key), key, "left_anti").withColumn(stratum, F.lit(filler)).withColumn("__fill", F.lit(1))
    both = picked.withColumn("__fill", F.lit(0)).unionByName(pool)
    return both.orderBy("__fill", *order).limit(n).drop("__fill")


def escalating_sample(df: DataFrame, n: int, seed: int, fractions: Sequence[float] = (0.001, 0.005, 0.03)) -> DataFrame:
    """n rows of the smallest Bernoulli sample that has as many, at last of the whole table: small samples read all files but shuffle little."""
    for f in fractions:
        some = df.sample(fraction=f, seed=seed).orderBy(F.rand(seed)).limit(n)
        if some.count() >= n:
            return some
    return df.orderBy(F.rand(seed)).limit(n)


def replicates(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seeds: Sequence[int]) -> DataFrame:
    """(seed, .., rank): for each seed and stratum its quota of rows with the least digests, all seeds in one reading of the table. Keys are distinct.

    Each task keeps its best of each seed and stratum before anything is shuffled, so what is shuffled grows with the quotas and not with the table.
    """
    each = df.filter(F.col(stratum).isin(list(quotas))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    own = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("seed").cast("string")))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("seed", stratum).orderBy(own, key))).filter(F.col("rank") <= max(quotas.values(), default=0))
    wanted = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    return ranked.filter(F.col("rank") <= wanted).select("seed", *df.columns, "rank")


def paired_interval(runs: DataFrame, seed: str, a: str, b: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """One row: over runs of several seeds (seed and two systems' metrics) their number, the mean of b - a, and its interval by bootstrap over the seeds.

    Resamples draw seeds by digests of their numbers, so they are the same in every run; runs in which one metric is null don't count. The runs are few: they are one row's array.
    """
    own = runs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), (F.col(b) - F.col(a)).cast("double").alias("d")))).alias("x")).select(F.transform("x", lambda r: r["d"]).alias("d"))
    n = F.size("d")
    mean = lambda v: F.aggregate(v, F.lit(0.0).cast("double"), lambda t, d: t + d) / n
    draw = lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.get(F.col("d"), F.pmod(F.xxhash64(i, j), n).cast("int")))
    means = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda i: mean(draw(i))))
    at = lambda share: F.get("m", F.lit(min(resamples - 1, max(0, round(share * (resamples - 1))))))
    tail = (1 - confidence) / 2
    found = own.withColumn("m", F.when(n > 0, means))
    return found.select(n.alias("n"), F.when(n > 0, mean(F.col("d"))).alias("difference"), at(tail).alias("low"), at(1 - tail).alias("high"))
