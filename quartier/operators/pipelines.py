"""Compositions: the conversion sheet, the statistics office's sync, ground truth, and the normalization of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.functions import confidence as C
from quartier.functions import normalize as N
from quartier.functions import parse as P
from quartier.operators.matching import numbered, trigram_top1
from quartier.operators.retrieval import distinct_top_k, tfidf
from quartier.operators.search import contained

EFFECTIVE = "2025-07-01"
#: What an id of a level is offset by for each version (fixed values).
OFFSETS = {"province": 1_000, "district": 100_000, "ward": 10_000_000}
WHOLE_DISTRICT = -1


def versioned_id(code: Column, version: int, level: str) -> Column:
    return (F.lit(version * OFFSETS[level]) + code).cast("long")


def sheet_units(sheet: DataFrame) -> DataFrame:
    """(level, version, id, code, name, type_name): every unit of a conversion sheet once, with the longest of its spellings and, of these, the first by text.

    sheet: province_new, ward_name_new, ward_code_new, note, ward_name_old, ward_code_old, district_old, province_old; units are written "Name (code)"
    but for wards, whose codes stand in columns of their own. Units without a code are left out.
    """

    def unit(level: str, version: int, text: str, code: Column | None = None) -> Column:
        own = P.unit_code(F.col(text)) if code is None else code.try_cast("int")
        return F.struct(F.lit(level).alias("level"), F.lit(version).alias("version"), own.alias("code"), P.bare_name(F.col(text)).alias("full"))

    units = F.array(unit("province", 2, "province_new"), unit("ward", 2, "ward_name_new", F.col("ward_code_new")), unit("province", 1, "province_old"), unit("district", 1, "district_old"), unit("ward", 1, "ward_name_old", F.col("ward_code_old")))
    each = sheet.select(F.explode(units).alias("u")).select("u.*").filter("code IS NOT NULL AND full <> ''")
    best = each.groupBy("level", "version", "code").agg(F.min(F.struct((-F.length("full")).alias("n"), "full")).alias("b")).select("level", "version", "code", "b.full")
    kind = P.unit_type(F.col("full"))
    offset = F.create_map(*[F.lit(v) for pair in OFFSETS.items() for v in pair])
    return best.select("level", "version", (F.col("version") * F.try_element_at(offset, F.col("level")) + F.col("code")).cast("long").alias("id"), "code", N.unit_name(F.col("full"), kind).alias("name"), kind.alias("type_name"))


def sheet_mapping(sheet: DataFrame) -> DataFrame:
    """(ward_id_v1, ward_id_v2, relationship_type, mapping_total, effective_from): each old ward with its new one; a row without an old ward stands for its whole district.

    mapping_total is how many old wards went into the new one.
    """
    new, old = F.col("ward_code_new").try_cast("int"), F.col("ward_code_old").try_cast("int")
    rows = sheet.filter(new.isNotNull()).select(
        F.coalesce(versioned_id(old, 1, "ward"), F.lit(WHOLE_DISTRICT)).cast("long").alias("ward_id_v1"), versioned_id(new, 2, "ward").alias("ward_id_v2"), P.note_relation(F.col("note")).alias("relationship_type"), old.alias("old")
    )
    rows = rows.withColumn("mapping_total", F.count("old").over(W.partitionBy("ward_id_v2"))).drop("old").distinct()
    return rows.withColumn("effective_from", F.lit(EFFECTIVE).cast("date"))


def synced(masters: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, code, name, change): masters after a list of (code, name) from the statistics office.

    A row is matched by its code, else by its name's search key if one master alone has that; it then takes the new code and name (UPDATED, or SAME where
    nothing differs). What matches nothing is CREATED with ids after the largest, by code. Masters that nothing matches stay (KEPT).
    """
    inc = incoming.filter("code IS NOT NULL").groupBy("code").agg(F.min("name").alias("name"))
    by_code = inc.join(masters.select("id", "code"), "code").groupBy("code", "name").agg(F.min("id").alias("id"))
    rest = inc.join(by_code, "code", "left_anti").withColumn("key", N.search_key(F.col("name")))
    free = masters.join(by_code, "id", "left_anti").select("id", N.search_key(F.col("name")).alias("key")).filter("key <> ''")
    one = free.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    by_name = rest.join(one, "key").groupBy("id").agg(F.min(F.struct("code", "name")).alias("r")).select("r.code", "r.name", "id")
    matched = by_code.select("code", "name", "id").unionByName(by_name)
    changed = masters.join(matched.select("id", F.col("code").alias("new_code"), F.col("name").alias("new_name")), "id", "left")
    same = F.col("code").eqNullSafe(F.col("new_code")) & F.col("name").eqNullSafe(F.col("new_name"))
    kept = changed.select("id", F.coalesce("new_code", "code").alias("code"), F.coalesce("new_name", "name").alias("name"), F.when(F.col("new_code").isNull(), "KEPT").when(same, "SAME").otherwise("UPDATED").alias("change"))
    created = numbered(inc.join(matched, "code", "left_anti"), "code", name="n")
    top = F.broadcast(masters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    return kept.unionByName(created.crossJoin(top).select((F.col("top") + F.col("n")).cast("long").alias("id"), "code", "name", F.lit("CREATED").alias("change")))


def ground_truth_stats(gt: DataFrame, province: str, validated: str, quality: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of totals, the validation rate and quality's mean, least and most; and the provinces with most rows, ties by id."""
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.count_if(validated), F.count(F.lit(1))), F.lit(0.0)), 2)
    one = gt.agg(F.count(F.lit(1)).alias("total"), F.count_if(validated).alias("validated"), rate.alias("validation_rate"), F.round(F.avg(quality), 4).alias("mean_quality"), F.min(quality).alias("least_quality"), F.max(quality).alias("most_quality"))
    return one, gt.groupBy(province).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), province).limit(top)


def normalized_queue(queue: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, address, match, standard_address, score, decision): queue rows (id, address, version) with the corpus row (id, address) most like each, scored.

    The address is cleaned, its match is the corpus text of most similar trigrams, which stands for the semantic score; rows without an address, or that share no
    trigram with the corpus, are rejected.
    """
    clean = queue.withColumn("address", N.collapsed(N.spelt_out(F.col("address")))).filter("address <> ''")
    best = trigram_top1(clean.select("id", N.metric_text(F.col("address"))), corpus.select((-F.col("id") - 1).alias("id"), N.metric_text(F.col("address"))))
    best = best.select("id", (-F.col("match") - 1).alias("match"), "score").withColumnRenamed("score", "semantic")
    text = corpus.select(F.col("id").alias("match"), F.col("address").alias("standard_address"))
    found = queue.select("id", "version").join(clean.select("id", "address"), "id", "left").join(best, "id", "left").join(text, "match", "left")
    score = C.score(C.token_overlap(F.col("address"), F.col("standard_address")), F.coalesce("semantic", F.lit(0.0)), F.lit(1.0), C.temporal_weight(F.col("version")), F.lit(0.5))
    out = found.withColumn("score", F.when(F.col("match").isNotNull(), score).otherwise(0.0))
    return out.select("id", "address", "match", "standard_address", "score", C.decision(F.col("score")).alias("decision"))


#: Words of the longest unit names that tell epochs apart.
NAME_WORDS = 3


def detected_epochs(df: DataFrame, id_: str, address: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id_, pre, post, epoch, confidence) of addresses, with the unit names (name) that only one side knows: names of up to NAME_WORDS words that stand
    between white space, all looked for at once. Ids are distinct; a null address has no words."""
    names = before.select("name", F.lit(0).alias("side")).union(after.select("name", F.lit(1))).select(F.trim(F.regexp_replace(F.lower("name"), r"(?U)\s+", " ")).alias("name"), "side").filter((F.col("name") != "") & (F.size(F.split("name", " ")) <= NAME_WORDS)).distinct()
    hits = contained(df.select(id_, address), names.select("name"), tokens=True).join(names, F.col("needle") == F.col("name"))
    counted = hits.groupBy(F.col("row").alias(id_)).agg(*(F.count_if(F.col("side") == i).alias(c) for i, c in enumerate(("__before", "__after"))))
    own = df.select(id_, address).join(counted, id_, "left")
    pre, post = C.epoch_scores(F.coalesce(F.col(address), F.lit("")), *(F.coalesce(F.col(c), F.lit(0)) for c in ("__before", "__after")))
    name, confidence = C.epoch(F.col("pre"), F.col("post"))
    return own.select(id_, pre.alias("pre"), post.alias("post")).select(id_, "pre", "post", name.alias("epoch"), confidence.alias("confidence"))


def _belongs(rows: DataFrame, id_: str, child: str, parent: str, master: DataFrame) -> DataFrame:
    """(id_, __ok): whether a row's child and parent stand together in a master of (child, parent); null where the row lacks one of them."""
    pairs = master.select(child, parent).dropna().distinct().withColumn("__there", F.lit(True))
    out = rows.select(id_, child, parent).join(pairs, [child, parent], "left")
    return out.select(id_, F.when(F.col(child).isNotNull() & F.col(parent).isNotNull(), F.coalesce("__there", F.lit(False))).alias("__ok"))


def production(queue: DataFrame, corpus: DataFrame, wards: DataFrame, districts: DataFrame, before: DataFrame, after: DataFrame, features: int = 5000) -> DataFrame:
    """(id, address, match, standard_address, epoch, text, semantic, hierarchy, temporal, geo, score, decision) of a queue, step by step.

    queue: id, address, ward_id, district_id, province_id, lat, lon, version; corpus: id, address, both with ids of 0 and more. Addresses are cleaned; the epoch is that of the names (before, after: name) in
    them; a row's match is the corpus address nearest to it by the cosine of TF-IDF vectors over words, which is its semantic score; the hierarchy is held against wards (ward_id, district_id)
    and districts (district_id, province_id); coordinates give the geo weight. Rows without an address or a match are rejected with 0.
    """
    clean = queue.withColumn("address", N.collapsed(N.spelt_out(F.col("address")))).filter("address <> ''").select("id", "address")
    # the corpus's ids go below 0, so that both sides share one table of features
    texts = corpus.filter("address <> ''").select((-F.col("id") - 1).alias("id"), N.metric_text(F.col("address")).alias("text")).unionByName(clean.select("id", N.metric_text(F.col("address")).alias("text")))
    vectors = tfidf(texts, 1, features)
    best = distinct_top_k(vectors, F.col("id") >= 0, F.col("id") < 0, 1, features, 1e-6).select(F.col("query_id").alias("id"), (-F.col("id") - 1).alias("match"), F.col("score").alias("semantic"))
    checks = _belongs(queue, "id", "ward_id", "district_id", wards).withColumnRenamed("__ok", "__w").join(_belongs(queue, "id", "district_id", "province_id", districts).withColumnRenamed("__ok", "__d"), "id")
    epochs = detected_epochs(clean, "id", "address", before, after).select("id", "epoch")
    named = corpus.select(F.col("id").alias("match"), F.col("address").alias("standard_address"))
    found = queue.select("id", "version", "lat", "lon").join(clean, "id", "left").join(best, "id", "left").join(named, "match", "left").join(checks, "id").join(epochs, "id", "left")
    own = found.withColumns({"text": C.token_overlap(F.col("address"), F.col("standard_address")), "semantic": F.coalesce("semantic", F.lit(0.0)), "hierarchy": C.hierarchy_validity(F.col("__w"), F.col("__d")), "temporal": C.temporal_weight(F.col("version")), "geo": C.geo_weight(F.col("lat"), F.col("lon"))})
    own = own.withColumn("score", F.when(F.col("match").isNotNull(), C.score(*(F.col(c) for c in C.WEIGHTS), normalize=True)).otherwise(0.0))
    return own.select("id", "address", "match", "standard_address", F.coalesce("epoch", F.lit("AMBIGUOUS")).alias("epoch"), *C.WEIGHTS, "score", C.decision(F.col("score")).alias("decision"))
