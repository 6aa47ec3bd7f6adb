"""Queries of tags, spans, the conversion sheet, the statistics office's sync and strata, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.functions import normalize as N
from quartier.functions import parse as P
from quartier.operators import corpus as CO
from quartier.operators import evaluation as E
from quartier.operators import labeller as L
from quartier.operators import pipelines as PL
from quartier.operators import relational as R
from quartier.operators import repairs as RP
from quartier.operators import sampling as S
from quartier.operators import tagging as TG
from quartier.plans.addresses import A, H, NOTES, address, key, pick, rows, strip, without
from quartier.plans.queries import query
from quartier.sources import excel as XL


def fixture(t, sql: str, table: str = "customer"):
    df = t(table)
    return df.sparkSession.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}").replace("VARCHAR(99)", "STRING"), **{table: df})


NEW_WARDS = ("Phường Bến Nghé", "Phường  Sài Gòn", "Xã Tân Phú", "Đặc khu Côn Đảo", "")
SHEET = f"""SELECT c_custkey AS n, 'Thành phố ' || chr(cast(65 + c_nationkey % 6 AS INTEGER)) || ' (0' || c_nationkey % 6 || ')' AS province_new, {pick("c_custkey", NEW_WARDS)} AS ward_name_new, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE cast(c_custkey % 40 AS VARCHAR(99)) END AS ward_code_new,
{pick("c_custkey", NOTES)} AS note, {pick("c_custkey", ("Phường 1", "xã Bình Mỹ", "Thị trấn Củ Chi"))} AS ward_name_old, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(c_custkey % 120 AS VARCHAR(99)) END AS ward_code_old, 'Quận ' || c_custkey % 9 || ' (' || (c_custkey % 9 + 10) || ')' AS district_old, 'Tỉnh ' || chr(cast(65 + c_custkey % 7 AS INTEGER)) || ' (' || c_custkey % 7 || ')' AS province_old FROM customer"""


def name_of(x: str) -> str:
    return strip(f"regexp_replace({x}, '[ \\n]*\\([0-9]+\\)[ \\n]*$', '')")


def code_of(x: str) -> str:
    return f"nullif(regexp_extract({x}, '\\(0*([0-9]+)\\)', 1), '')::INTEGER"


KIND = "CASE " + " ".join(f"WHEN starts_with(full_name, '{p}') THEN '{p}'" for p in ("Thành phố", "Tỉnh", "Quận", "Phường", "Thị trấn", "Đặc khu")) + " WHEN starts_with(full_name, 'Xã') OR starts_with(full_name, 'xã') THEN 'Xã' ELSE '' END"


@query(f"""WITH s AS ({SHEET}), e AS (SELECT 'province' AS level, 2 AS version, {code_of("province_new")} AS code, {name_of("province_new")} AS full_name FROM s UNION ALL SELECT 'ward', 2, try_cast(ward_code_new AS INTEGER), {name_of("ward_name_new")} FROM s UNION ALL SELECT 'province', 1, {code_of("province_old")}, {name_of("province_old")} FROM s
UNION ALL SELECT 'district', 1, {code_of("district_old")}, {name_of("district_old")} FROM s UNION ALL SELECT 'ward', 1, try_cast(ward_code_old AS INTEGER), {name_of("ward_name_old")} FROM s),
b AS (SELECT * FROM e WHERE code IS NOT NULL AND full_name <> '' QUALIFY row_number() OVER (PARTITION BY level, version, code ORDER BY length(full_name) DESC, full_name) = 1), k AS (SELECT *, {KIND} AS type_name FROM b)
SELECT level, version, (version * CASE level WHEN 'province' THEN 1000 WHEN 'district' THEN 100000 ELSE 10000000 END + code)::BIGINT AS id, code, CASE WHEN type_name = '' THEN full_name ELSE trim(replace(full_name, type_name || ' ', '')) END AS name, type_name FROM k""")
def conversion_units(t):
    return PL.sheet_units(fixture(t, SHEET))


RELATION = f"""CASE WHEN note IS NULL OR note = '' THEN 'RETAINED' WHEN {H["special"]} THEN 'SPECIAL_ZONE' WHEN {H["whole"]} AND {H["merged"]} THEN 'MERGED_FULL' WHEN {H["part"]} AND {H["area"]} AND {H["people"]} THEN 'MERGED_PARTIAL' WHEN {H["part"]} AND {H["area"]} THEN 'MERGED_AREA' WHEN {H["part"]} AND {H["people"]} THEN 'MERGED_POPULATION' WHEN {H["part"]} THEN 'MERGED_PART'
WHEN {H["renamed"]} AND {H["retyped"]} THEN 'RENAMED_TYPE_CHANGED' WHEN {H["renamed"]} THEN 'RENAMED' WHEN {H["retyped"]} THEN 'TYPE_CHANGED' WHEN {H["kept"]} THEN 'RETAINED' WHEN {H["merged"]} THEN 'MERGED_FULL' ELSE 'OTHER' END"""


@query(f"""WITH s AS (SELECT *, trim(lower(note)) AS n FROM (SELECT * EXCLUDE (n) FROM ({SHEET}))), m AS (SELECT coalesce(10000000 + try_cast(ward_code_old AS INTEGER), -1)::BIGINT AS ward_id_v1, 20000000 + try_cast(ward_code_new AS INTEGER)::BIGINT AS ward_id_v2, {RELATION} AS relationship_type, try_cast(ward_code_old AS INTEGER) AS old FROM s WHERE try_cast(ward_code_new AS INTEGER) IS NOT NULL)
SELECT DISTINCT ward_id_v1, ward_id_v2, relationship_type, count(old) OVER (PARTITION BY ward_id_v2) AS mapping_total, DATE '2025-07-01' AS effective_from FROM m""")
def conversion_mapping(t):
    return PL.sheet_mapping(fixture(t, SHEET))


MASTERS = "SELECT s_suppkey AS id, cast(s_suppkey * 3 AS VARCHAR(99)) AS code, 'Phường ' || s_name || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE cast(s_suppkey AS VARCHAR(99)) END AS name FROM supplier"
INCOMING = "SELECT CASE WHEN s_suppkey % 4 = 0 THEN cast(s_suppkey * 3 AS VARCHAR(99)) WHEN s_suppkey % 29 = 0 THEN NULL ELSE 'N' || cast(s_suppkey AS VARCHAR(99)) END AS code, CASE WHEN s_suppkey % 4 = 2 THEN 'brand new ' || cast(s_suppkey AS VARCHAR(99)) WHEN s_suppkey % 8 = 0 THEN 'Phường ' || s_name || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE cast(s_suppkey AS VARCHAR(99)) END ELSE 'Xã ' || upper(s_name) || cast(s_suppkey AS VARCHAR(99)) END AS name FROM supplier"


@query(f"""WITH m AS ({MASTERS}), i AS (SELECT code, min(name) AS name FROM ({INCOMING}) WHERE code IS NOT NULL GROUP BY code), c AS (SELECT i.code, i.name, min(m.id) AS id FROM i JOIN m ON i.code = m.code GROUP BY ALL),
r AS (SELECT *, {key("name")} AS k FROM i WHERE code NOT IN (SELECT code FROM c)), f AS (SELECT min(id) AS id, k FROM (SELECT id, {key("name")} AS k FROM m WHERE id NOT IN (SELECT id FROM c)) WHERE k <> '' GROUP BY k HAVING count(*) = 1),
n AS (SELECT r.code, r.name, f.id FROM r JOIN f USING (k) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY r.code, r.name) = 1), x AS (SELECT * FROM c UNION ALL SELECT * FROM n)
SELECT m.id::BIGINT AS id, coalesce(x.code, m.code) AS code, coalesce(x.name, m.name) AS name, CASE WHEN x.code IS NULL THEN 'KEPT' WHEN x.code = m.code AND x.name = m.name THEN 'SAME' ELSE 'UPDATED' END AS change FROM m LEFT JOIN x USING (id)
UNION ALL SELECT (SELECT max(id) FROM m) + row_number() OVER (ORDER BY code), code, name, 'CREATED' FROM i WHERE code NOT IN (SELECT code FROM x)""")
def office_sync(t):
    return PL.synced(fixture(t, MASTERS, "supplier"), fixture(t, INCOMING, "supplier"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 3 = 0) AS validated, round(100.0 * count(*) FILTER (WHERE c_custkey % 3 = 0)::DOUBLE / count(*), 2) AS validation_rate, round(avg(c_acctbal), 4) AS mean_quality, min(c_acctbal) AS least_quality, max(c_acctbal) AS most_quality FROM customer")
def ground_truth_totals(t):
    return PL.ground_truth_stats(t("customer").withColumn("ok", F.col("c_custkey") % 3 == 0), "c_nationkey", "ok", "c_acctbal")[0]


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10")
def ground_truth_provinces(t):
    return PL.ground_truth_stats(t("customer").withColumn("ok", F.col("c_custkey") % 3 == 0), "c_nationkey", "ok", "c_acctbal")[1]


@query(f"""WITH a AS (SELECT c_custkey AS id, {address("c_custkey")} AS address, CASE WHEN c_custkey % 3 = 0 THEN upper({address("c_custkey")}) WHEN c_custkey % 3 = 1 THEN NULL ELSE 'x' END AS old_address, c_custkey % 700 AS popular, CASE WHEN c_custkey % 10 = 0 THEN 0.0005::DOUBLE WHEN c_custkey % 10 < 4 THEN 0.5 END AS degrees, c_nationkey AS ward, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS old_ward FROM customer)
SELECT id, CASE WHEN degrees < 0.0011 THEN 'D4' WHEN coalesce(ward <> old_ward, false) OR coalesce(trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) <> trim(regexp_replace(lower(old_address), '\\s+', ' ', 'g')), false) THEN 'D3' WHEN popular >= 500 OR regexp_matches(lower(address), '(ngõ|ngách|hẻm|kiệt|sn($|[^\\p{{L}}\\p{{N}}_])|lô\\s*[0-9]|đường\\s+số|hem|ngo\\s)') THEN 'D1' ELSE 'D2' END AS stratum FROM a""")
def sample_strata(t):
    k = F.col("c_custkey")
    a = t("customer").selectExpr("c_custkey", "c_nationkey AS ward", f"{address('c_custkey')} AS address")
    a = a.withColumns({"old_address": F.when(k % 3 == 0, F.upper("address")).when(k % 3 == 2, "x"), "popular": k % 700, "degrees": F.when(k % 10 == 0, 0.0005).when(k % 10 < 4, 0.5), "old_ward": F.when(k % 5 == 0, None).when(k % 7 == 0, F.col("ward") + 1).otherwise(F.col("ward"))})
    return a.select(k.alias("id"), S.stratum(S.temporal_signal([("ward", "old_ward")], "old_address", "address"), S.urban_signal("popular", "address"), F.col("degrees")).alias("stratum"))


@query("""SELECT event_id, replace('{"id": 7, "xs": [7, 12, 1.5, "7"], "sub": {"k7": ' || event_id % 9 || ', "s": "a \\" 7"}}', '', '') AS before, '{"id": 70, "xs": [70, 12, 1.5, "7"], "sub": {"k7": ' || CASE event_id % 9 WHEN 7 THEN 70 WHEN 8 THEN 80 ELSE event_id % 9 END || ', "s": "a \\" 7"}}' AS remapped FROM events""")
def json_id_remap(t):
    before = F.concat(F.lit('{"id": 7, "xs": [7, 12, 1.5, "7"], "sub": {"k7": '), F.col("event_id") % 9, F.lit(', "s": "a \\" 7"}}'))
    mapping = F.create_map(*[F.lit(x) for x in ("7", "70", "8", "80")])
    return t("events").select("event_id", before.alias("before"), TG.remapped_json(before, mapping).alias("remapped"))


@query(None)
def weak_tags(t):
    """Tested row by row against a Python version."""
    parts = F.create_map(F.lit("WDS"), "ward", F.lit("DST"), "district", F.lit("PRO"), "province", F.lit("XXX"), F.lit("Quận"))
    return rows(t).select("id", "address", TG.words(F.col("address")).alias("words"), TG.weak_tags(F.col("address"), parts).alias("tags"))


@query(None)
def span_tags(t):
    """Tested row by row against a Python version."""
    span = F.array(F.struct(F.lit(3).alias("start"), F.lit(11).alias("end"), F.lit("STR").alias("label")), F.struct(F.lit(9).alias("start"), F.lit(19).alias("end"), F.lit("WDS").alias("label")))
    return rows(t).filter("address IS NOT NULL").select("id", "address", TG.span_tags(F.col("address"), span).alias("tags"))


@query(f"WITH {A} SELECT id, CASE WHEN id % 2 = 0 THEN ward || ', ' || province ELSE ward || ', ' || district || ', ' || province END AS standard, CASE WHEN id % 2 = 0 THEN trim({without('ward', 'ward')}) END AS bare FROM a")
def standard_addresses(t):
    two = F.when(F.col("id") % 2 == 0, 2).otherwise(1)
    return rows(t).select("id", CO.standard_address(F.col("ward"), F.col("district"), F.col("province"), two).alias("standard"), F.when(F.col("id") % 2 == 0, F.trim(N.without_prefix(F.col("ward"), "ward"))).alias("bare"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS a, count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)) AS b FROM orders) SELECT 'price' AS rule, a AS n_failed, a = 0 AS ok FROM c UNION ALL SELECT 'status', b, b = 0 FROM c""")
def constraint_checks(t):
    return CO.checks(t("orders"), {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("F", "O")})


@query("""WITH a AS (SELECT o_orderpriority AS m, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS m, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.m, b.m) AS o_orderpriority, round(a.v, 4) AS oracle, round(b.v, 4) AS real, round(b.v - a.v, 4) AS difference FROM a FULL JOIN b ON a.m = b.m""")
def compared_runs(t):
    means = lambda df: df.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    o = t("orders")
    both = CO.compared(means(o.filter("o_orderstatus = 'F'")), means(o.filter("o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")), "o_orderpriority", "v", ("oracle", "real"))
    return both.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("oracle", "real", "difference")])


@query(None)
def queue_normalization(t):
    """Composition of operators that have queries of their own; its rows are tested against them."""
    a = rows(t)
    return PL.normalized_queue(a.select("id", "address", (F.col("id") % 2 + 1).alias("version")), a.filter("id % 5 = 0").select("id", F.col("other").alias("address")).filter("address IS NOT NULL"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'a b' END AS wds, CASE WHEN p_partkey % 4 = 0 THEN 'e' ELSE 'b c' END AS str, CASE WHEN p_partkey % 4 <> 0 THEN 'd' END AS pro FROM part")
def first_spans(t):
    tags = F.when(F.col("p_partkey") % 4 == 0, F.array(*map(F.lit, ("B-WDS", "I-WDS", "O", "B-WDS", "B-STR")))).otherwise(F.array(*map(F.lit, ("O", "I-STR", "I-STR", "B-PRO", "O"))))
    spans = TG.first_spans(F.array(*map(F.lit, "abcde")), E.entities(tags))
    return R.spread(t("part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("id"), spans.alias("m")).select("id", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("WDS", "STR", "PRO")])


SEGMENTS = f"""{A}, c AS (SELECT id, string_split(address, ',') AS cut FROM a WHERE address IS NOT NULL), p AS (SELECT id, cut, unnest(range(1, len(cut) + 1)) AS i FROM c),
s AS (SELECT id, i::INTEGER AS i, (coalesce(list_sum(list_transform(cut[1:i - 1], lambda x: length(x) + 1)), 0) + length(cut[i]) - length(ltrim(cut[i])))::INTEGER AS start, trim(cut[i]) AS segment FROM p WHERE trim(cut[i]) <> '')"""


@query(f"WITH {SEGMENTS} SELECT * FROM s")
def address_segments(t):
    return L.segments(rows(t), "id", "address")


def short_key(x: str) -> str:
    words = "|".join(L.ANY_UNIT.lower().split("|"))
    return f"trim(regexp_replace(lower(trim({x})), '^(?:(?:{words})\\s+|(?:tp|q|h|p|x)\\.)', ''))"


@query(f"""WITH {SEGMENTS}, g AS (SELECT 'WDS' AS level, ward AS name FROM a UNION SELECT 'DST', district FROM a UNION SELECT 'PRO', province FROM a),
gk AS (SELECT level, name, unnest(list_distinct([lower(trim(name)), {short_key("name")}])) AS k FROM g WHERE name IS NOT NULL),
sk AS (SELECT *, unnest(list_distinct([lower(segment), {short_key("segment")}])) AS k FROM s)
SELECT id, i, start, segment, name AS unit, level, bool_or(lower(segment) = lower(trim(name))) AS exact FROM sk JOIN gk USING (k) WHERE k <> '' GROUP BY ALL""")
def segment_units(t):
    a = rows(t)
    names = {"WDS": "ward", "DST": "district", "PRO": "province"}
    g = None
    for level, c in names.items():
        one = a.select(F.col(c).alias("unit"), F.lit(level).alias("level"), F.col(c).alias("name"))
        g = one if g is None else g.unionByName(one)
    return L.gazetteer_hits(L.segments(a, "id", "address"), g.filter("name IS NOT NULL").distinct())


@query(None)
def labelled_spans(t):
    """All spans of all addresses; tested against spans placed by hand and a solver of intervals in Python."""
    a = rows(t)
    streets = a.select("other").distinct().select(P.street_line(F.col("other")).alias("name")).filter("name <> ''")
    return L.labelled(a, "id", "address", "ward", "district", "province", streets)


@query(f"SELECT cast(n AS VARCHAR) AS n, province_new, nullif(ward_name_new, '') AS ward_name_new, ward_code_new, note, ward_name_old, ward_code_old, district_old, province_old FROM ({SHEET})")
def excel_sheet(t):
    """The conversion sheet as workbooks, one for each new province, and read from them."""
    sheet = fixture(t, SHEET).withColumn("file", F.col("province_new"))
    names = [c for c in sheet.columns if c != "file"]
    back = XL.sheets(XL.workbooks(sheet, "file"), names).drop("path", "row")
    return back.withColumn("ward_name_new", F.nullif(F.col("ward_name_new"), F.lit("")))


@query("""SELECT seed, o_orderkey, o_orderpriority, rank::INTEGER AS rank FROM (SELECT seed, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY seed, o_orderpriority ORDER BY md5(o_orderkey || ':' || seed), o_orderkey) AS rank FROM orders, (VALUES (1), (7), (42)) AS s(seed) WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
WHERE rank <= CASE o_orderpriority WHEN '1-URGENT' THEN 40 ELSE 15 END""")
def replicate_samples(t):
    return S.replicates(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", {"1-URGENT": 40, "5-LOW": 15}, (1, 7, 42))


@query(None)
def token_labels(t):
    """Labels of pieces of three characters of each word, for the ward and the district of each address; tested against a Python version."""
    a = rows(t).filter("address IS NOT NULL")
    spot = lambda c, label: F.when(F.instr("address", F.col(c)) > 0, F.struct((F.instr("address", F.col(c)) - 1).alias("start"), (F.instr("address", F.col(c)) - 1 + F.length(c)).alias("end"), F.lit(label).alias("label")))
    spans = F.filter(F.array(spot("ward", "WDS"), spot("district", "DST")), lambda s: s.isNotNull())
    pieces = F.flatten(F.transform(TG.placed_words(F.col("address")), lambda w: F.transform(F.sequence(w["start"], w["end"] - 1, F.lit(3)), lambda i: F.struct(i.alias("start"), F.least(i + 3, w["end"]).alias("end")))))
    tags = ["O", *(f"{p}-{label}" for label in TG.PRIORITY for p in "BI")]
    return a.select("id", TG.token_labels(F.col("address"), spans, pieces, tags, 256).alias("labels"))


@query(None)
def label_checks(t):
    """Labels of each address by patterns, repaired by its known units, and then held against those of its other spelling; tested by examples."""
    a = rows(t)
    found = lambda df, c: P.with_labels(df, c).select("id", F.filter(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("label"), F.col(k).alias("text"))) for k in ("NUM", "STR"))), lambda x: x.isNotNull()).alias(f"{c}_labels"))
    both = a.join(found(a.select("id", "address"), "address"), "id").join(found(a.select("id", "other"), "other"), "id")
    expected = RP.repaired_labels(F.col("address"), F.col("address_labels"), F.col("ward"), F.col("district"), F.col("province"))
    out = both.withColumn("expected", expected)
    return out.select("id", "expected", RP.checked_labels(F.col("address"), F.col("expected"), F.col("other_labels")).alias("check")).select("id", "expected", "check.*")


@query(None)
def production_queue(t):
    """All steps of the queue over all addresses, against the corpus of their standard forms; tested step by step against Python."""
    a = rows(t).withColumn("nation_id", F.col("nation"))
    k = F.col("id")
    queue = a.select("id", F.col("other").alias("address"), (k % 50).alias("ward_id"), F.when(k % 7 != 0, k % 25).alias("district_id"), (k % 5).alias("province_id"), F.when(k % 3 != 0, (k % 30).cast("double")).alias("lat"), (k % 200).cast("double").alias("lon"), F.when(k % 4 != 0, k % 4).alias("version"))
    wards = a.select((k % 50).alias("ward_id"), (k % 25).alias("district_id")).filter("ward_id % 9 <> 0")
    districts = t("nation").select(F.col("n_nationkey").cast("long").alias("district_id"), F.col("n_regionkey").cast("long").alias("province_id"))
    names = lambda c: a.select(F.concat(F.lower(c), F.lit(",")).alias("name")).filter("name IS NOT NULL")
    return PL.production(queue, a.select("id", "address"), wards, districts, names("ward"), names("district"))
