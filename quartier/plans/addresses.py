"""Queries of the address functions, over addresses that are made up from every customer, each with its SQL.

The input is one SQL text that both engines run: names of places in several spellings, chosen by the customer's key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.functions import confidence as C
from quartier.functions import fonts
from quartier.functions import normalize as N
from quartier.functions import parse as P
from quartier.operators import evaluation as E
from quartier.operators import matching as M
from quartier.operators import pipelines as PL
from quartier.operators import relational as R
from quartier.plans.queries import query


def pick(expr: str, values: tuple[str | None, ...]) -> str:
    """SQL that chooses one of some texts by a number."""
    cases = " ".join(f"WHEN {i} THEN " + ("cast(NULL AS VARCHAR(99))" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"(CASE {expr} % {len(values)} {cases} END)"


STREETS = ("Lê Lợi", "đường Nguyễn Huệ", "Đ. Trần Hưng Đạo", "hẻm 12  Cách Mạng Tháng Tám", "Võ Văn Tần.", "QUANG TRUNG", "Nguyễn Du")
WARDS = ("Phường Bến Nghé", "phường 12", "Xã Tân Thông Hội", "P.Đa Kao", "Thị trấn Củ Chi", "xa Tan Phu", "Phường Ỷ La", "phuong Thạch Thất", "xã VII")
DISTRICTS = ("Quận 1", "Quận Bình Thạnh", "Huyện Củ Chi", "Thành phố Thủ Đức", "Q.3", "TP. Dĩ An", "Thị xã Bến Cát", "quan Go Vap")
PROVINCES = ("Thành phố Hồ Chí Minh", "Tỉnh Bình Dương", "TP.HCM", "Thừa Thiên Huế", "tỉnh Quảng Nam", "Hà Nội", "thành phố Hải Phòng")
EXTRAS = ("", "", "Tầng 5, Tòa nhà Bitexco, ", "Phòng 302.A, chung cư Ngô Gia Tự, ", "Khu phố 3, ", "Chợ Bến Thành, ", "Bệnh viện Từ Dũ - , lầu 2, ")
TAILS = ("", ", Việt Nam", " 700000", ", 70000, Vietnam", ",  ")
NUMBERS = ("12", "12A", "45/3", "7-", "Số 9", "", "1.")


def address(k: str) -> str:
    return f"({pick(f'({k} + 3)', EXTRAS)} || {pick(k, NUMBERS)} || ' ' || {pick(f'{k} * 5', STREETS)} || ', ' || {pick(f'{k} * 7', WARDS)} || ', ' || {pick(f'{k} * 3', DISTRICTS)} || ', ' || {pick(f'({k} + 1)', PROVINCES)} || {pick(f'{k} * 2', TAILS)})"


#: id, address and a second address that differs from it in some parts; null and empty ones among both.
ROWS = f"""SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN ' ' ELSE {address("c_custkey")} END AS address,
CASE WHEN c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN {address("c_custkey")} WHEN c_custkey % 4 = 1 THEN upper({address("c_custkey")}) WHEN c_custkey % 4 = 2 THEN {address("(c_custkey + 7)")} ELSE {pick("c_custkey", STREETS)} || ', ' || {pick("c_custkey * 7", WARDS)} END AS other,
{pick("c_custkey", WARDS)} AS ward, {pick("c_custkey * 3", (*DISTRICTS, None))} AS district, {pick("(c_custkey + 1)", (*PROVINCES, None))} AS province FROM customer"""
A = f"a AS ({ROWS})"


def rows(t):
    """The same rows in Spark."""
    customer = t("customer")
    return customer.sparkSession.sql(ROWS.replace("FROM customer", "FROM {customer}").replace("cast(NULL AS VARCHAR(99))", "cast(NULL AS STRING)"), customer=R.spread(customer.select("c_custkey", "c_nationkey"), "c_custkey"))


def white(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def metric(x: str) -> str:
    plain = f"regexp_replace(translate(lower(coalesce({x}, '')), '{N.MARKED}', '{N.PLAIN}'), '\\p{{Mn}}', '', 'g')"
    return white(rf"regexp_replace({plain}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def unprefixed(x: str, prefixes: tuple[str, ...]) -> str:
    for p in prefixes:
        x = rf"regexp_replace({x}, '^{p}[.\s]+', '')"
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


def key(x: str, prefixes: tuple[str, ...] = N.KEY_PREFIXES) -> str:
    return unprefixed(f"translate({strip(f'lower({x})')}, '{N.KEY_FROM}', '{N.KEY_TO}')", prefixes)


ROMAN_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.ROMAN.items()) + " ELSE w END"


def spelt(x: str) -> str:
    for short, full in N.ABBREVIATIONS.items():
        x = f"replace({x}, '{short}', '{full}')"
    return strip(x)


@query(f"""WITH {A} SELECT id, {metric("address")} AS metric, translate(lower(address), '{N.FOLDED_FROM}', '{N.FOLDED_TO}') AS folded, {key("coalesce(ward, '')")} AS search_key,
{unprefixed(f"translate(array_to_string(list_transform(string_split({white("replace(lower(ward), 'y', 'i')")}, ' '), lambda w: {ROMAN_SQL}), ' '), '{N.KEY_FROM}', '{N.KEY_TO}')", N.MAPPING_PREFIXES)} AS mapping_key,
{white("lower(address)")} AS lowered, regexp_replace({white("lower(coalesce(address, ''))")}, '[, ]+$', '') AS comparable, {spelt("coalesce(address, '')")} AS spelt_out,
{white("nfc_normalize(coalesce(address, ''))")} AS exact, lower(nfc_normalize({strip("coalesce(address, '')")})) AS label FROM a""")
def address_normalizers(t):
    a, w = F.col("address"), F.col("ward")
    found = {"metric": N.metric_text(a), "folded": N.folded(a), "search_key": N.search_key(w), "mapping_key": N.mapping_key(w), "lowered": N.lowered(a), "comparable": N.comparable(a), "spelt_out": N.spelt_out(a), "exact": N.exact_text(a), "label": N.label_text(a)}
    return rows(t).select("id", *[c.alias(k) for k, c in found.items()])


TYPES = ("Phường", "Quận", "Tỉnh", "Thành phố Trung ương", None, "Xã", "")
NAMES = ("Phường Phường 5", "Quận 3", "Thành phố Hà Nội", " Thành phố Trung ương Hồ Chí Minh", "Thành phố Trung ương Thành phố Huế", "TP. Vinh", "Thành Phố Đà Lạt", None, "Thị trấn  Cát Bà ")


def without(x: str, level: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{p}') THEN substr({x}, {len(p) + 1})" for p in N.NAME_PREFIXES[level]) + f" ELSE {x} END"


@query(f"""WITH n AS (SELECT c_custkey AS id, {pick("c_custkey", NAMES)} AS name, {pick("c_custkey", TYPES)} AS kind FROM customer),
b AS (SELECT *, CASE WHEN trim(coalesce(kind, '')) = '' THEN trim(coalesce(name, '')) ELSE trim(replace(trim(coalesce(name, '')), trim(kind) || ' ', '')) END AS bare, trim(replace(name, coalesce(kind, '') || ' ', '')) AS tabled FROM n)
SELECT id, CASE WHEN kind = '{N.CENTRAL_CITY}' AND starts_with(bare, 'Thành phố ') THEN trim(substr(bare, 11)) ELSE bare END AS unit_name,
CASE WHEN kind = '{N.CENTRAL_CITY}' THEN regexp_replace(tabled, '^Thành phố\\s+', '') ELSE tabled END AS table_name, {without("name", "ward")} AS ward_name, {without("name", "district")} AS district_name, trim({without("name", "any")}) AS any_name,
CASE WHEN length(id::VARCHAR) >= 3 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 3, '0') END AS code FROM b""")
def unit_names(t):
    n = t("customer").selectExpr("c_custkey AS id", f"{pick('c_custkey', NAMES)} AS name".replace("VARCHAR(99)", "STRING"), f"{pick('c_custkey', TYPES)} AS kind".replace("VARCHAR(99)", "STRING"))
    name = F.col("name")
    return n.select("id", N.unit_name(name, F.col("kind")).alias("unit_name"), N.table_name(name, F.col("kind")).alias("table_name"), N.without_prefix(name, "ward").alias("ward_name"), N.without_prefix(name, "district").alias("district_name"), N.without_prefix(name).alias("any_name"), N.zero_filled(F.col("id"), 3).alias("code"))


def parts_sql(x: str) -> dict[str, str]:
    """The address parts in DuckDB, whose patterns have no look-around but fold case alike."""
    x, (ward, district, province) = f"coalesce({x}, '')", (p.replace("(?iu)", "(?i)") for p in (P.WARD, P.DISTRICT, P.PROVINCE))
    return {"street": strip(f"regexp_replace({strip(f'split_part({x}, chr(44), 1)')}, '{P.LEADING_NUMBER}', '')"), "ward": strip(f"regexp_extract({x}, '{ward}', 1)"), "district": strip(f"regexp_extract({x}, '{district}', 1)"), "province": strip(f"regexp_extract({x}, '{province}', 1)")}


@query(f"WITH {A} SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in parts_sql("address").items()) + " FROM a")
def address_parts(t):
    return rows(t).select("id", *[c.alias(k) for k, c in P.components(F.col("address")).items()])


LEVEL_ROWS = " UNION ALL ".join(f"SELECT CASE WHEN id % 5 = 0 THEN 'UNLABELED' ELSE 'D' || id % 5 END AS stratum, '{k}' AS level, {metric(parts_sql('other')[k])} AS p, {metric(parts_sql('address')[k])} AS g FROM a" for k in P.LEVELS)
COUNTS = "count(*) FILTER (WHERE g <> '' AND p = g) AS tp, count(*) FILTER (WHERE g = '' AND p <> '') AS fp, count(*) FILTER (WHERE g <> '' AND p <> g) AS fn"
RATES = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"


@query(f"WITH {A}, l AS ({LEVEL_ROWS}), c AS (SELECT stratum, level, {COUNTS} FROM l GROUP BY stratum, level) SELECT stratum, level, tp, fp, fn, {RATES} FROM c")
def component_f1_by_stratum(t):
    named = rows(t).withColumn("code", F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit("D"), F.col("id") % 5)))
    return E.component_f1_by_stratum(named, "other", "address", "code")


@query(f"WITH {A} SELECT count(*) AS n_samples, round(100.0::DOUBLE * count(*) FILTER (WHERE {white('''nfc_normalize(coalesce(other, ''))''')} = {white('''nfc_normalize(coalesce(address, ''))''')}) / count(*), 4) AS em_address_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE {white('''nfc_normalize(coalesce(other, ''))''')} = {white('''nfc_normalize(coalesce(ward, ''))''')}) / count(*), 4) AS em_ward_pct FROM a")
def exact_match(t):
    return E.exact_match(rows(t), "other", ["address", "ward"])


@query(f"WITH {A}, l AS ({LEVEL_ROWS}), c AS (SELECT level, count(*) FILTER (WHERE g <> '') AS n_gold, count(*) FILTER (WHERE g <> '' AND p = g) AS n_hit FROM l GROUP BY level) SELECT level, n_gold, n_hit, round(n_hit::DOUBLE / greatest(n_gold, 1), 4) AS accuracy FROM c")
def component_accuracy(t):
    return E.component_accuracy(rows(t), "other", "address")


@query(None)
def exact_fuzzy_proxy_f1(t):
    """SequenceMatcher has no SQL: tested against difflib."""
    a = rows(t).withColumns({"p": N.metric_text(F.col("other")), "g": N.metric_text(F.col("address"))})
    scored = M.with_ratio(a, "p", "g").withColumns({"exact": F.col("p") == F.col("g"), "model": F.element_at(F.array(F.lit("phobert"), F.lit("siamese"), F.lit("llm")), (F.col("id") % 3 + 1).cast("int")), "ms": F.when(F.col("id") % 3 < 2, F.col("id") % 50 + 5.0)})
    return E.proxy_scores(scored, "exact", "ratio", "model", "ms")


NOTES = ("Nhập toàn bộ diện tích", "nhập một phần diện tích và dân số", "Một phần diện tích", "một phần dân số", "Một phần", "Đổi tên, đổi loại hình", "Đổi tên", "đổi loại hình", "Giữ nguyên", "Nhập vào phường", "Thành lập đặc khu", None, "", "khác", "toàn bộ", "m?t ph?n di?n tích", "còn lại")


def has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


H = {k: has(v) for k, v in P.NOTE_WORDS.items()}


@query(f"""WITH a AS (SELECT c_custkey AS id, {pick("c_custkey", NOTES)} AS note FROM customer), b AS (SELECT *, trim(lower(note)) AS n FROM a)
SELECT id, CASE WHEN note IS NULL OR note = '' THEN 'RETAINED' WHEN {H["special"]} THEN 'SPECIAL_ZONE' WHEN {H["whole"]} AND {H["merged"]} THEN 'MERGED_FULL' WHEN {H["part"]} AND {H["area"]} AND {H["people"]} THEN 'MERGED_PARTIAL' WHEN {H["part"]} AND {H["area"]} THEN 'MERGED_AREA' WHEN {H["part"]} AND {H["people"]} THEN 'MERGED_POPULATION' WHEN {H["part"]} THEN 'MERGED_PART'
WHEN {H["renamed"]} AND {H["retyped"]} THEN 'RENAMED_TYPE_CHANGED' WHEN {H["renamed"]} THEN 'RENAMED' WHEN {H["retyped"]} THEN 'TYPE_CHANGED' WHEN {H["kept"]} THEN 'RETAINED' WHEN {H["merged"]} THEN 'MERGED_FULL' ELSE 'OTHER' END AS relation FROM b""")
def note_relations(t):
    note = pick("c_custkey", NOTES).replace("VARCHAR(99)", "STRING")
    return t("customer").selectExpr("c_custkey AS id", f"{note} AS note").select("id", P.note_relation(F.col("note")).alias("relation"))


UNITS = ("Phường Bến Nghé (00123)", "Xã Tân Phú (7)", "Thành phố Thủ Đức", None, "Th? tr?n Sa Pa (090)\n", "phường  5 (01) (2)", "Đặc khu Côn Đảo (900)", "Khác (x)")
SHEET = "".join(map(chr, (0x48, 0x8B, 0x20, 0x54, 0x83, 0x79)))


@query(f"""WITH a AS (SELECT c_custkey AS id, {pick("c_custkey", UNITS)} AS unit FROM customer)
SELECT id, nullif(regexp_extract(unit, '\\(0*([0-9]+)\\)', 1), '')::INTEGER AS code, {strip("regexp_replace(unit, '[ \\n]*\\([0-9]+\\)[ \\n]*$', '')")} AS name,
CASE {" ".join(f"WHEN starts_with(trim(unit), '{p}') THEN '{k}'" for p, k in P.TYPE_PREFIXES)} ELSE '' END AS kind, 'Hồ Tây' AS sheet_text, CASE WHEN id % 2 = 0 THEN 'Quảng Ngãi' ELSE 'Ba Đình' END AS healed FROM a""")
def unit_codes(t):
    a = t("customer").selectExpr("c_custkey AS id", f"{pick('c_custkey', UNITS)} AS unit".replace("VARCHAR(99)", "STRING"))
    broken = F.when(F.col("id") % 2 == 0, "Qu?ng Ng?i").otherwise("Ba ?ình")
    return a.select("id", P.unit_code(F.col("unit")).alias("code"), P.bare_name(F.col("unit")).alias("name"), P.unit_type(F.col("unit")).alias("kind"), N.decoded(F.lit(SHEET), fonts.SHEET_FONT).alias("sheet_text"), N.healed(broken, fonts.LOST_LETTERS).alias("healed"))


DECISIONS = ("Nghị quyết 1685/NQ-UBTVQH15 ngày 16/06/2025", "202/2025/QH15; 1/7/2025", "không số", "ngày 31/02/2025", None, "", "12/34")
FIGURES = ("1,234.5", "12 345", "", None, "n/a", "7")


@query(f"""WITH a AS (SELECT c_custkey AS id, {pick("c_custkey", DECISIONS)} AS d, {pick("c_custkey", FIGURES)} AS x FROM customer)
SELECT id, CASE WHEN d = '' THEN NULL ELSE coalesce(nullif(regexp_extract(d, '([0-9]+/[^\\-\\s,;]+)', 1), ''), substr(d, 1, 100)) END AS number, CASE WHEN d <> '' THEN try_strptime(regexp_extract(d, '([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})', 1), '%d/%m/%Y')::DATE END AS date,
coalesce(try_cast(regexp_replace(x, '[, ]', '', 'g') AS DOUBLE), 0) AS figure FROM a""")
def decisions(t):
    a = t("customer").selectExpr("c_custkey AS id", f"{pick('c_custkey', DECISIONS)} AS d".replace("VARCHAR(99)", "STRING"), f"{pick('c_custkey', FIGURES)} AS x".replace("VARCHAR(99)", "STRING"))
    number, date = P.decision(F.col("d"))
    return a.select("id", number.alias("number"), date.alias("date"), N.number(F.col("x")).alias("figure"))


@query(f"""WITH {A}, w AS (SELECT id, address, lower(address) AS l, list_distinct(list_filter(string_split({white(r"regexp_replace(lower(coalesce(address, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')")}, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split({white(r"regexp_replace(lower(coalesce(other, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')")}, ' '), lambda x: x <> '')) AS y,
CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 37 % 3000)::DOUBLE / 100 END AS lat, CASE WHEN id % 13 = 0 THEN 200.0::DOUBLE ELSE 100 + (id * 91 % 1500)::DOUBLE / 100 END AS lon, (id % 130)::DOUBLE / 100 - 0.1 AS sem, CASE id % 4 WHEN 0 THEN NULL WHEN 3 THEN 3 ELSE id % 4 END AS version, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS c1, CASE WHEN id % 6 = 0 THEN NULL ELSE id % 5 > 1 END AS c2 FROM a),
p AS (SELECT id, l, coalesce(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0), 0) AS text, greatest(0.0, least(1.0, sem)) AS semantic, coalesce((coalesce(c1, false)::INT + coalesce(c2, false)::INT)::DOUBLE / nullif((c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT, 0), 0.5) AS hierarchy,
CASE WHEN version IS NULL THEN 0.9 WHEN version >= 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS temporal, CASE WHEN lat IS NULL THEN 0.5 WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 0 WHEN lat BETWEEN 8 AND 24 AND lon BETWEEN 102 AND 110 THEN 1 ELSE 0.7 END::DOUBLE AS geo FROM w),
s AS (SELECT *, round(0.0::DOUBLE + 0.3::DOUBLE * text + 0.35::DOUBLE * semantic + 0.25::DOUBLE * hierarchy + 0.1::DOUBLE * temporal + 0.1::DOUBLE * geo, 4) AS score FROM p)
SELECT id, round(text, 6) AS text, hierarchy, temporal, geo, score, CASE WHEN score >= 0.9 THEN 'AUTO_ACCEPT' WHEN score >= 0.7 THEN 'AUTO_CONVERT' WHEN score >= 0.5 THEN 'SUGGEST' ELSE 'REJECT' END AS decision FROM s""")
def address_confidence(t):
    i = F.col("id")
    lat, lon = F.when(i % 11 != 0, (i * 37 % 3000).cast("double") / 100), F.when(i % 13 == 0, 200.0).otherwise(100 + (i * 91 % 1500).cast("double") / 100)
    version = F.when(i % 4 == 3, 3).when(i % 4 != 0, i % 4)
    checks = F.when(i % 3 != 0, i % 2 == 0), F.when(i % 6 != 0, i % 5 > 1)
    parts = rows(t).select("id", C.token_overlap(F.col("address"), F.col("other")).alias("text"), ((i % 130).cast("double") / 100 - 0.1).alias("semantic"), C.hierarchy_validity(*checks).alias("hierarchy"), C.temporal_weight(version).alias("temporal"), C.geo_weight(lat, lon).alias("geo"))
    scored = parts.withColumn("score", C.score(*[F.col(c) for c in C.WEIGHTS]))
    return scored.select("id", F.round("text", 6).alias("text"), "hierarchy", "temporal", "geo", "score", C.decision(F.col("score")).alias("decision"))


GRAMS = "list_distinct(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))))"
#: Names as they stand in addresses, each before a comma: of one side wards, of the other districts, where they aren't wards too.
WARD_NAMES, DISTRICT_NAMES = "regexp_replace(lower(ward), '^(phường|phuong|xã|xa|thị trấn) +', '') || ','", "regexp_replace(lower(district), '^(quận|quan|huyện|thành phố|thị xã) +', '') || ','"


@query(f"""WITH {A}, w AS (SELECT id, lower(coalesce(address, '')) AS l, list_filter(string_split({white("lower(coalesce(address, ''))")}, ' '), lambda x: x <> '') AS ws FROM a),
b AS (SELECT DISTINCT {WARD_NAMES} AS name FROM a), f AS (SELECT DISTINCT {DISTRICT_NAMES} AS name FROM a EXCEPT SELECT name FROM b),
h AS (SELECT id, l, (SELECT count(*) FROM b WHERE list_contains({GRAMS}, name)) AS n_before, (SELECT count(*) FROM f WHERE list_contains({GRAMS}, name)) AS n_after FROM w),
s AS (SELECT id, round(least(1, CASE WHEN {" OR ".join(f"contains(l, '{w}')" for w in C.BEFORE_WORDS)} THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {" OR ".join(f"regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}_]){p}')" for p in C.BEFORE_PATTERNS)} THEN 0.2::DOUBLE ELSE 0 END + 0.3::DOUBLE * n_before), 4) AS pre,
round(least(1, CASE WHEN {" OR ".join(f"contains(l, '{w}')" for w in C.AFTER_WORDS)} THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE * n_after), 4) AS post FROM h)
SELECT id, pre, post, CASE WHEN pre >= 0.6 AND pre > post THEN 'PRE_2025' WHEN post >= 0.6 AND post > pre THEN 'POST_2025' ELSE 'AMBIGUOUS' END AS epoch, greatest(pre, post) AS confidence FROM s""")
def address_epochs(t):
    a = rows(t)
    wards, districts = (a.select(F.expr(x).alias("name")) for x in (WARD_NAMES, DISTRICT_NAMES))
    return PL.detected_epochs(a.select("id", F.coalesce("address", F.lit("")).alias("address")), "id", "address", wards, districts.join(wards, "name", "left_anti"))
