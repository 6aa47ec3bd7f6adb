"""Joins of administrative masters: name matching, versions, lineage, and histories of changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.operators.matching import numbered
from quartier.operators.search import contained

OPEN_END = "9999-12-31"


def latest_mapping(mapping: DataFrame, level: str, old: str, new: str, version: str) -> DataFrame:
    """Each (level, old id) with the new id of its highest version; ties by the greater new id."""
    return mapping.filter(F.col(old).isNotNull()).groupBy(level, old).agg(F.max_by(new, F.struct(version, new)).alias(new))


def mapped_or_same(df: DataFrame, mapping: DataFrame, level: str, old: str, new: str) -> DataFrame:
    """The table with `new`: the mapped id, or the old one itself where there is no mapping. Mapping keys are distinct."""
    m = mapping.select(level, old, F.col(new).alias("__new"))
    return df.join(m, [level, old], "left").withColumn(new, F.coalesce("__new", old)).drop("__new")


def by_code_or_name(left: DataFrame, right: DataFrame, lookup: str, codes: Sequence[str], row: str, order: Sequence[Column] = ()) -> DataFrame:
    """Each left row with the right row of which one of `codes` equals the looked-up text; of several the earlier code, then the order.

    One equality join for all codes: right rows are listed once for each code that they have.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("__step"), F.col(c).cast("string").alias("__code")) for i, c in enumerate(codes, 1)])
    listed = right.withColumn("__k", F.explode(keys)).select(*right.columns, "__k.*").filter("__code IS NOT NULL")
    hit = left.join(listed, left[lookup] == listed["__code"])
    return hit.withColumn("__rn", F.row_number().over(W.partitionBy(row).orderBy("__step", *order))).filter("__rn = 1").drop("__rn", "__step", "__code")


def contains_join(left: DataFrame, text: str, right: DataFrame, needle: str, row: str, needle_row: str, least: int = 2) -> DataFrame:
    """(row, needle_row) for each left text that holds a right one in any case; needles of fewer than `least` characters are not looked for."""
    hits = contained(left.select(row, text), right.select(needle), least).withColumnRenamed("row", row)
    named = right.select(needle_row, F.lower(needle).alias("__needle"))
    return hits.join(named, hits["needle"] == named["__needle"]).select(row, needle_row)


def exclusive_fallback(df: DataFrame, masters: Sequence[tuple[DataFrame, str]], key: str, columns: Sequence[str]) -> DataFrame:
    """Columns from the first of several masters that has the key, and `which`, from 1; null where none has it."""
    out = df
    for i, (master, id_) in enumerate(masters):
        m = master.select(F.col(id_).alias(key), F.struct(*columns).alias(f"__m{i}"))
        out = out.join(m, key, "left")
    found = F.coalesce(*[F.when(F.col(f"__m{i}").isNotNull(), F.struct(F.lit(i + 1).alias("which"), F.col(f"__m{i}").alias("m"))) for i in range(len(masters))])
    out = out.withColumn("__f", found)
    return out.select(*df.columns, *[F.col(f"__f.m.{c}").alias(c) for c in columns], F.col("__f.which").alias("which"))


def left_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, str, Column]]) -> DataFrame:
    """Left joins one after the other, each on a key of its master and an expression of what is joined so far, such as a coalesce of two columns."""
    for i, (master, id_, value) in enumerate(steps):
        m = master.withColumnRenamed(id_, f"__k{i}")
        df = df.withColumn(f"__v{i}", value).join(m, F.col(f"__v{i}") == F.col(f"__k{i}"), "left").drop(f"__v{i}", f"__k{i}")
    return df


def best_match(left: DataFrame, right: DataFrame, row: str, match: str, steps: Sequence[tuple[Column, Column]], order: Sequence[Column]) -> DataFrame:
    """Each left row's match by the first step that has one, of several the first in the order (of right columns), and `step` from 1.

    A step is a pair of expressions, structs of a parent and a name for a scoped one; a value with a null matches nothing. All steps share one hash
    join, for which right rows are first reduced to the best one of each value.
    """

    def listed(df: DataFrame, values: Sequence[Column]) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("step"), F.to_json(F.struct(v.alias("v"))).alias("value"), v.isNull().alias("none")) for i, v in enumerate(values, 1)]
        return df.withColumn("__k", F.explode(F.array(*keys))).filter("NOT __k.none")

    right = listed(right, [y for _, y in steps]).withColumn("__rn", F.row_number().over(W.partitionBy("__k").orderBy(*order))).filter("__rn = 1")
    joined = listed(left, [x for x, _ in steps]).select(row, "__k").join(right.select("__k", match), "__k")
    return joined.groupBy(row).agg(F.min_by(F.struct(F.col(match), F.col("__k.step").alias("step")), "__k.step").alias("m")).select(row, "m.*")


def scoped(*parts: Column) -> Column:
    """A key of several parts that is null where any part is."""
    some = F.lit(True)
    for p in parts:
        some = some & p.isNotNull()
    return F.when(some, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose ends both occur once."""
    a, b = (F.count(F.lit(1)).over(W.partitionBy(c)) for c in (left, right))
    return pairs.withColumns({"__a": a, "__b": b}).filter("__a = 1 AND __b = 1").drop("__a", "__b")


def top_down(levels: Sequence[tuple[DataFrame, DataFrame]], passes: Sequence) -> DataFrame:
    """(level, id, old_id) of units matched from the top level down, one to one.

    levels: new and old units (id, parent, name) from the top on. A unit is matched by equal names within matched parents, at the top without;
    passes are functions of a name, and a later one only sees units that are still open on both sides.
    """
    out, parents = None, None
    for n, (new, old) in enumerate(levels):
        found = None
        for f in passes:
            a = new.select(F.col("id"), "parent", f(F.col("name")).alias("key"))
            b = old.select(F.col("id").alias("old_id"), F.col("parent").alias("old_parent"), f(F.col("name")).alias("key"))
            if found is not None:
                a, b = a.join(found, "id", "left_anti"), b.join(found, "old_id", "left_anti")
            if parents is not None:
                up = parents.select(F.col("id").alias("parent"), F.col("old_id").alias("__up"))
                pairs = a.join(up, "parent").join(b, (F.col("__up") == b["old_parent"]) & (a["key"] == b["key"]))
            else:
                pairs = a.join(b, "key")
            pairs = one_to_one(pairs.select("id", "old_id"), "id", "old_id")
            found = pairs if found is None else found.union(pairs)
        parents = found
        own = found.select(F.lit(n).alias("level"), "id", "old_id")
        out = own if out is None else out.union(own)
    return out


def checksum(columns: Sequence[str]) -> Column:
    """SHA-256 of a JSON object of the columns' texts, by name, with blanks after commas and colons; nulls as "None"."""

    def text(c: str) -> Column:
        t = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        return F.concat(F.lit(f'"{c}": '), F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))

    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *[text(c) for c in sorted(columns)]), F.lit("}")), 256)


def scd2(current: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], at: Column, new_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The history after a load, and its log (key, change_type).

    current: open and closed rows with valid_from, valid_to, version_id. Rows whose checksum over the tracked columns is unchanged stay (NO_CHANGE),
    unknown keys begin (CREATE), changed ones are closed at `at` and follow with the next version (UPDATE). With new_id, an update takes its key from
    that column, and one whose new key is missing or the same is an ERROR that changes nothing.

    Where current has these columns: deleted rows (`is_deleted`) are no open ones, closed rows are no longer `is_active`, rows that begin are active and not deleted, and have the
    `row_id` of the row that they follow as `predecessor_id`.
    """
    open_end = F.lit(OPEN_END).cast("timestamp")
    open_ = F.col("valid_to") == open_end
    if "is_deleted" in current.columns:
        open_ = open_ & ~F.coalesce("is_deleted", F.lit(False))
    now = current.filter(open_)
    row_id = F.col("row_id") if "row_id" in current.columns else F.lit(None)
    old = now.select(key, checksum(tracked).alias("__old"), F.col("version_id").alias("__version"), row_id.alias("__row"))
    new = incoming.withColumn("__new", checksum(tracked)).join(old, key, "left")
    change = F.when(F.col("__old").isNull(), "CREATE").when(F.col("__old") == F.col("__new"), "NO_CHANGE")
    change = (change.when(F.col(new_id).isNull() | (F.col(new_id) == F.col(key)), "ERROR") if new_id else change).otherwise("UPDATE")
    new = new.withColumn("change_type", change)
    closing = new.filter("change_type = 'UPDATE'").select(key, F.lit(True).alias("__close"))
    kept = current.join(closing, key, "left").withColumn("__close", F.coalesce(F.col("__close") & open_, F.lit(False)))
    if "is_active" in current.columns:
        kept = kept.withColumn("is_active", F.when(F.col("__close"), False).otherwise(F.col("is_active")))
    kept = kept.withColumn("valid_to", F.when(F.col("__close"), at).otherwise(F.col("valid_to"))).select(*current.columns)
    begins = new.filter("change_type IN ('CREATE', 'UPDATE')")
    rows = {c: F.col(c) for c in current.columns if c in incoming.columns} | {"valid_from": at, "valid_to": open_end, "version_id": F.coalesce(F.col("__version"), F.lit(0)) + 1, "is_active": F.lit(True), "is_deleted": F.lit(False), "predecessor_id": F.col("__row"), "row_id": F.lit(None)}
    if new_id:
        rows[key] = F.when(F.col("change_type") == "UPDATE", F.col(new_id)).otherwise(F.col(key))
    added = begins.select(*[rows.get(c, F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return kept.unionByName(added), new.select(key, "change_type")


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """Rows that are valid at a time: from valid_from on, before valid_to."""
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def winners(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table with `is_winner`: the first row of each key in the order."""
    return df.withColumn("is_winner", F.row_number().over(W.partitionBy(*key).orderBy(*order)) == 1)


def renumbered_losers(df: DataFrame, row: str, id_: str, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(row, old id, new id): winners keep theirs, all others get numbers after the largest id, in order of their rows.

    Losers are numbered within ranges of rows; only the ranges' counts come together.
    """
    ranked = winners(df, key, order).select(row, F.col(id_).alias("old_id"), "is_winner")
    top = df.agg(F.coalesce(F.max(id_), F.lit(0)).alias("__top"))
    losers = numbered(ranked.filter("NOT is_winner"), row).crossJoin(F.broadcast(top)).select(row, "old_id", (F.col("__top") + F.col("number")).cast("long").alias("new_id"))
    return ranked.filter("is_winner").select(row, "old_id", F.col("old_id").cast("long").alias("new_id")).unionByName(losers)


def coalesced(df: DataFrame, fallbacks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns that take the first value of several that isn't null."""
    return df.withColumns({c: F.coalesce(*of) for c, of in fallbacks.items()})
