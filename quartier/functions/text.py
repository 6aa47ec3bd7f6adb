"""Text normalisation in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartier.functions.normalize import unmarked


def strip_marks(c: Column) -> Column:
    """Lower case without marks, of all Latin letters; letters with a stroke as their plain ones."""
    return F.translate(unmarked(F.lower(c)), "đøłħŧ", "dolht")


def normalized(c: Column) -> Column:
    """Lower case without marks, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_marks(c), "[^a-z0-9]+", " "), " +", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; of two empty ones 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
