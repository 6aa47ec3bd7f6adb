"""Confidence of a normalized address, and which administrative epoch an address is written in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, which add up to 1.1, and thresholds of decisions.
WEIGHTS = {"text": 0.30, "semantic": 0.35, "hierarchy": 0.25, "temporal": 0.10, "geo": 0.10}
DECISIONS = ((0.90, "AUTO_ACCEPT"), (0.70, "AUTO_CONVERT"), (0.50, "SUGGEST"))
# Words and patterns of addresses before and after the reform of 2025.
BEFORE_WORDS = ("quận", "huyện", "thị xã", "thị trấn", "thị tứ")
BEFORE_PATTERNS = (r"quận\s+\d+(?:$|[^\p{L}\p{N}_])", r"(?:quận|huyện|thị\s+xã|thị\s+trấn)\s+[a-zÀ-ỹ]")
AFTER_WORDS = ("thành phố trực thuộc", "đặc khu")
CONFIDENT = 0.6


def _words(x: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")), " ")), "")


def token_overlap(raw: Column, standard: Column) -> Column:
    """Shared words over all words of two texts; 0 where either is null or has none."""
    a, b = (_words(F.coalesce(x, F.lit(""))) for x in (raw, standard))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def temporal_weight(version: Column) -> Column:
    return F.when(version.isNull(), 0.9).when(version >= 2, 1.0).otherwise(0.8)


def geo_weight(lat: Column, lon: Column) -> Column:
    """1 inside the country's box, 0.7 elsewhere on earth, 0 for impossible coordinates, 0.5 for none."""
    return F.when(lat.isNull() | lon.isNull(), 0.5).when(~(lat.between(-90, 90) & lon.between(-180, 180)), 0.0).when(lat.between(8, 24) & lon.between(102, 110), 1.0).otherwise(0.7)


def hierarchy_validity(ward_in_district: Column, district_in_province: Column) -> Column:
    """Share of the checks passed; each is true, false, or null where an id is missing. Without any check 0.5."""
    total = F.lit(0.0)
    passed = F.lit(0.0)
    for check in (ward_in_district, district_in_province):
        total = total + check.isNotNull().cast("int")
        passed = passed + F.coalesce(check, F.lit(False)).cast("int")
    return F.coalesce(F.try_divide(passed, total), F.lit(0.5))


def score(text: Column, semantic: Column, hierarchy: Column, temporal: Column, geo: Column, normalize: bool = False) -> Column:
    """The weighted sum, rounded to four digits; `normalize` divides by the sum of the weights, which is more than 1."""
    parts = {"text": text, "semantic": F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic)), "hierarchy": hierarchy, "temporal": temporal, "geo": geo}
    total = sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(total / sum(WEIGHTS.values()) if normalize else total, 4)


def decision(value: Column) -> Column:
    out = F.lit("REJECT")
    for least, name in reversed(DECISIONS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def epoch_scores(address: Column, n_before: Column | None = None, n_after: Column | None = None) -> tuple[Column, Column]:
    """Scores for before and after the reform: 0.4 for a word of each side, 0.2 for a pattern of the first, 0.3 for each unit name.

    n_before and n_after are how many names that only one side knows stand in the address, as a search for them gives it.
    """
    a = F.lower(address)

    def any_of(conditions: Sequence[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out | c
        return F.coalesce(out, F.lit(False))

    before = F.when(any_of([F.contains(a, F.lit(w)) for w in BEFORE_WORDS]), 0.4).otherwise(0.0) + F.when(any_of([a.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){p}") for p in BEFORE_PATTERNS]), 0.2).otherwise(0.0)
    after = F.when(any_of([F.contains(a, F.lit(w)) for w in AFTER_WORDS]), 0.4).otherwise(0.0)
    if n_before is not None:
        before = before + 0.3 * n_before
    if n_after is not None:
        after = after + 0.3 * n_after
    return tuple(F.round(F.least(x, F.lit(1.0)), 4) for x in (before, after))


def epoch(before: Column, after: Column) -> tuple[Column, Column]:
    """PRE_2025, POST_2025 or AMBIGUOUS, and the confidence: a side wins with at least CONFIDENT and more than the other."""
    name = F.when((before >= CONFIDENT) & (before > after), "PRE_2025").when((after >= CONFIDENT) & (after > before), "POST_2025").otherwise("AMBIGUOUS")
    return name, F.greatest(before, after)
