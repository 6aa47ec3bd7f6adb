"""The address corpus: gates and filters, pages, components, entity splits, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.functions import normalize as N

# Tags of map entities that are kept beside those that begin with addr:, and which tag says what kind a place is, in this order.
KEPT_TAGS = ("name", "highway", "building", "amenity", "shop", "tourism", "office", "place", "landuse", "ref", "operator", "brand")
PLACE_TAGS = ("amenity", "shop", "tourism", "office")


def raw_norm(x: Column) -> Column:
    """Lower case without blanks at the ends; null for an empty text."""
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def json_text(x: Column) -> Column:
    """A JSON string's own text, or the `raw_address` of a JSON object; null for other JSON and for text that is none."""
    kind = F.substring(F.trim(x), 1, 1)
    own = F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"]
    return F.when(kind == '"', own).when(kind == "{", F.get_json_object(x, "$.raw_address"))


def address_components(ward: Column, district: Column, province: Column, version: Column) -> Column:
    """JSON of three levels; the district only before the reform (version 1). Nulls are kept."""
    level_2 = F.when(version == 1, district)
    return F.to_json(F.struct(province.alias("level_1"), level_2.alias("level_2"), ward.alias("level_3")), {"ignoreNullFields": "false"})


def standard_address(ward: Column, district: Column, province: Column, version: Column) -> Column:
    """Ward and province, with the district between before the reform; null where one of them is."""
    return F.when(version == 1, F.concat(ward, F.lit(", "), district, F.lit(", "), province)).otherwise(F.concat(ward, F.lit(", "), province))


def most_specific(df: DataFrame, version: int, ward_id: int | None = None, district_id: int | None = None, province_id: int | None = None) -> DataFrame:
    """Rows of the most specific unit that is given, by today's ids, or by old_ ids for version 1; deleted rows are hidden in version 2."""
    prefix = "old_" if version == 1 else ""
    for column, value in (("ward_id", ward_id), ("district_id", district_id), ("province_id", province_id)):
        if value is not None:
            df = df.filter(F.col(prefix + column) == value)
            break
    return df.filter(~F.coalesce(F.col("is_deleted"), F.lit(False))) if version == 2 else df


def any_contains(df: DataFrame, words: Mapping[str, str]) -> DataFrame:
    """Rows in which one of some columns holds its word in any case; % and _ in a word stand for anything."""
    out = F.lit(False)
    for column, word in words.items():
        out = out | F.coalesce(F.col(column).ilike(f"%{word}%"), F.lit(False))
    return df.filter(out)


def page(df: DataFrame, order: Sequence[Column], size: int, offset: int) -> DataFrame:
    """A page of the table and `total`, how many rows it has."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def recent(df: DataFrame, at: str, now: Column, window: str) -> DataFrame:
    """Rows of a window up to a given time."""
    return df.filter((F.col(at) >= now - F.expr(f"INTERVAL {window}")) & (F.col(at) <= now))


def gate(df: DataFrame, text: str, quality: str, least: float, values: Mapping[str, Sequence[object]], longer_than: int = 5) -> DataFrame:
    """Corpus rows with enough text and, where `least` is above 0, quality, and with allowed values in some columns."""
    for column, allowed in values.items():
        df = df.filter(F.col(column).isin(list(allowed)))
    df = df.filter(F.length(text) > longer_than)
    return df.filter(F.col(quality) >= least) if least > 0 else df


def filtered_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that the condition holds for, or all where there is none."""
    some = df.filter(condition)
    return df if some.isEmpty() else some


def first_non_empty(sources: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """The first source with more rows than its number; the last one in any case. No more rows are looked at than that takes."""
    for df, more_than in sources[:-1]:
        if df.limit(more_than + 1).count() > more_than:
            return df
    return sources[-1][0]


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n) of some tables."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def growth(more: Column, seconds: Column) -> Column:
    """Rows gained, for 180 seconds; null where no time has passed."""
    return F.try_divide(more * F.lit(180.0), F.nullif(seconds, F.lit(0)))


def unexpected(actual: Column, expected: Column) -> Column:
    """Distinct actual labels that aren't expected."""
    return F.array_except(actual, expected)


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row that comes first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def clean_tags(tags: Column) -> Column:
    """Tags that are kept and not blank, keys and values without white space at their ends."""
    pairs = F.transform(F.map_entries(tags), lambda e: F.struct(N.stripped(e["key"]).alias("key"), N.stripped(e["value"]).alias("value")))
    kept = F.filter(pairs, lambda e: (e["value"] != "") & (e["key"].startswith("addr:") | e["key"].isin(*KEPT_TAGS)))
    # of keys that differ in white space alone the last counts
    own = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(own)


def split_entities(df: DataFrame, id_: str, tags: str, scope: str) -> DataFrame:
    """Streets, buildings and places of a table of tagged entities: (kind, key, type_key, scope, id, name, type, n_tags).

    An entity's name is its `name`, else its `addr:street`; without one it is left out. It is a street if it has a `highway` or an `addr:street`, a building if it has a
    `building`, and a place if it has one of PLACE_TAGS, the first of which is its type: all that apply. Of streets with one name in a scope, and of buildings or places with one name
    and type, in any case and white space, the row of the least id stays.
    """
    t = F.col("__t")
    value = lambda k: F.try_element_at(t, F.lit(k))
    plain = lambda c: F.lower(N.stripped(F.regexp_replace(c, r"(?U)\s+", " ")))
    place = F.coalesce(*map(value, PLACE_TAGS))
    kind = lambda k, c, type_: F.when(c, F.struct(F.lit(k).alias("kind"), type_.alias("type")))
    none = F.lit(None).cast("string")
    kinds = F.array(kind("street", value("highway").isNotNull() | value("addr:street").isNotNull(), none), kind("building", value("building").isNotNull(), value("building")), kind("poi", place.isNotNull(), place))
    e = df.withColumn("__t", clean_tags(F.col(tags))).withColumn("__name", F.coalesce(value("name"), value("addr:street"))).filter("__name IS NOT NULL")
    e = e.select(F.col(id_).alias("id"), scope, F.col("__name").alias("name"), plain(F.col("__name")).alias("key"), F.size(t).alias("n_tags"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    e = e.select("id", scope, "name", "key", "n_tags", "k.kind", "k.type", F.coalesce(plain(F.col("k.type")), F.lit("")).alias("type_key"))
    first = F.min_by(F.struct("id", "name", "type", "n_tags"), F.struct("id", "name", "type", "n_tags")).alias("e")
    return e.groupBy("kind", "key", "type_key", scope).agg(first).select("kind", "key", "type_key", scope, "e.*")


def training_pairs(df: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new) where both are there and differ, and (new, new)."""
    pairs = F.array(F.struct(F.col(old).alias("a"), F.col(new).alias("b")), F.struct(F.col(new).alias("a"), F.col(new).alias("b")))
    return df.filter(F.col(new).isNotNull()).select(F.explode(pairs).alias("p")).select("p.*").filter("a IS NOT NULL").distinct()


def checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_failed, ok): how many rows break each rule; a null counts as broken. One pass for all rules."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in rules])
    return counts.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.n_failed") == 0).alias("ok"))


def compared(left: DataFrame, right: DataFrame, metric: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Two runs' metrics side by side: both values and their difference, null where one lacks the metric."""
    a, b = left.select(metric, F.col(value).alias(names[0])), right.select(metric, F.col(value).alias(names[1]))
    return a.join(b, metric, "full_outer").withColumn("difference", F.round(F.col(names[1]) - F.col(names[0]), 6))


def backfilled(df: DataFrame, column: str, encoder: object, text: str) -> DataFrame:
    """The table with vectors filled in where they are null: encoder is a function of a text column, such as a pandas UDF; rows with a vector aren't encoded."""
    missing = df.filter(F.col(column).isNull() & F.col(text).isNotNull())
    done = df.filter(F.col(column).isNotNull() | F.col(text).isNull())
    return done.unionByName(missing.withColumn(column, encoder(F.col(text))))
