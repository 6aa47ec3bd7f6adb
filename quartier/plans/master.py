"""Queries of the master-data operators, mutations and joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.functions import normalize as N
from quartier.functions import parse as P
from quartier.operators import admin as AD
from quartier.operators import corpus as CO
from quartier.operators import matching as M
from quartier.operators import mutations as MU
from quartier.operators import relational as R
from quartier.plans.addresses import A, key, pick, rows
from quartier.plans.queries import query

C = ("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_nationkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def insert_ignore(t):
    c = t("customer").select(*C)
    new = c.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return MU.insert_ignore(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS created_at, CASE WHEN c_custkey % 2 = 0 THEN 'now' ELSE 'then' END AS updated_at FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upsert_keeping_created(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    old = c.filter("c_custkey % 3 <> 0").withColumns({"created_at": F.lit("old"), "updated_at": F.lit("then")})
    new = c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2).withColumns({"created_at": F.lit("new"), "updated_at": F.lit("then")})
    return MU.upsert(old, new, ["c_custkey"], keep=["created_at"], stamp={"updated_at": F.lit("now")})


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS inserted, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS updated FROM customer WHERE c_custkey % 2 = 0")
def upsert_counts(t):
    c = t("customer").select("c_custkey")
    return MU.upsert_counts(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").union(c.filter("c_custkey % 4 = 0")), ["c_custkey"])


@query("SELECT s_suppkey, coalesce(n_name, s_name) AS s_name, CASE WHEN n_name IS NULL THEN s_acctbal ELSE s_acctbal + n_regionkey END AS s_acctbal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 1")
def update_from_join(t):
    s = t("supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    n = t("nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return MU.update_from(s, n, ["s_nationkey"], {"s_name": "s.n_name", "s_acctbal": "s_acctbal + s.n_regionkey"}).drop("s_nationkey")


@query("SELECT c_custkey, c_custkey % 5 + coalesce(n, 0) AS usage_count, coalesce(last, 'never') AS last_used_at FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderdate) AS n, 'now' AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def usage_counts(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 5).alias("usage_count"), F.lit("never").alias("last_used_at"))
    calls = t("orders").select(F.col("o_orderdate").alias("call"), F.col("o_custkey").alias("c_custkey"))
    return MU.count_usage(c, calls, "c_custkey", "usage_count", "last_used_at", F.lit("now"))


@query("SELECT c_custkey, coalesce(c_acctbal < 0 OR c_custkey % 7 = 0, false) AS is_deleted FROM customer")
def soft_delete(t):
    c = t("customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 7 == 0).alias("is_deleted"))
    return MU.soft_delete(c, F.nullif(F.col("c_acctbal"), F.lit(0.0)) < 0).select("c_custkey", "is_deleted")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY cast(ts AS DATE) DESC) AS r FROM events) WHERE r <= 2")
def retention_prune(t):
    e = t("events").select("user_id", "event_id", F.to_date("ts").alias("run"))
    return MU.retain_newest(e, "run", 2, ["user_id"]).select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 END AS extra FROM part")
def fill_columns(t):
    p = t("part").select("p_partkey", "p_size")
    v = p.filter("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") * 10).alias("p_size"))
    once = MU.fill_column(p, v, "p_partkey", "p_size")
    extra = v.withColumnRenamed("p_size", "extra")
    return MU.fill_column(MU.fill_column(once, extra, "p_partkey", "extra"), extra, "p_partkey", "extra")


@query("""WITH m AS (SELECT * FROM (SELECT n_nationkey % 5 AS level, n_nationkey AS old_id, n_nationkey * 10 + v AS new_id, v FROM nation, (VALUES (1), (2)) AS x(v) WHERE n_nationkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY level, old_id ORDER BY v DESC, new_id DESC) = 1)
SELECT c_custkey, coalesce(m.new_id, c_nationkey) AS new_id FROM customer LEFT JOIN m ON m.level = c_nationkey % 5 AND m.old_id = c_nationkey""")
def mapping_lookup_default(t):
    n = t("nation").filter("n_nationkey % 2 = 0").select((F.col("n_nationkey") % 5).alias("level"), F.col("n_nationkey").alias("old_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).withColumn("new_id", F.col("old_id") * 10 + F.col("v"))
    c = t("customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("level"), F.col("c_nationkey").alias("old_id"))
    return AD.mapped_or_same(c, AD.latest_mapping(n, "level", "old_id", "new_id", "v"), "level", "old_id", "new_id").select("c_custkey", "new_id")


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(c_nationkey::VARCHAR, 2, '0') WHEN 1 THEN c_nationkey::VARCHAR ELSE 'none' END AS code FROM customer),
h AS (SELECT c_custkey, n_nationkey, n_name, CASE WHEN lpad(n_nationkey::VARCHAR, 2, '0') = code THEN 1 ELSE 2 END AS step FROM l JOIN nation ON lpad(n_nationkey::VARCHAR, 2, '0') = code OR n_nationkey::VARCHAR = code)
SELECT c_custkey, n_nationkey, n_name FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY step, n_nationkey) = 1""")
def code_or_name_lookup(t):
    left = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, N.zero_filled(F.col("c_nationkey"), 2)).when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey").cast("string")).otherwise("none").alias("code"))
    right = t("nation").select("n_nationkey", "n_name", N.zero_filled(F.col("n_nationkey"), 2).alias("no"), F.col("n_nationkey").cast("string").alias("id_text"))
    return AD.by_code_or_name(left, right, "code", ["no", "id_text"], "c_custkey", [F.col("n_nationkey")]).select("c_custkey", "n_nationkey", "n_name")


@query("SELECT p_partkey, n_nationkey FROM part JOIN nation ON contains(lower(p_name || ' of ' || CASE p_partkey % 30 WHEN 1 THEN 'nation_1' WHEN 2 THEN 'NATION_2' ELSE p_type END), lower(n_name))")
def contains_join(t):
    p = t("part").select("p_partkey", F.concat("p_name", F.lit(" of "), F.when(F.col("p_partkey") % 30 == 1, "nation_1").when(F.col("p_partkey") % 30 == 2, "NATION_2").otherwise(F.col("p_type"))).alias("name"))
    return AD.contains_join(p, "name", t("nation").select("n_nationkey", "n_name"), "n_name", "p_partkey", "n_nationkey")


@query("""SELECT o_orderkey, coalesce(w2.s_name, w1.c_name) AS name, CASE WHEN w2.s_suppkey IS NOT NULL THEN 1 WHEN w1.c_custkey IS NOT NULL THEN 2 END AS which FROM orders LEFT JOIN supplier w2 ON w2.s_suppkey = o_custkey LEFT JOIN customer w1 ON w1.c_custkey = o_custkey AND w2.s_suppkey IS NULL""")
def exclusive_fallback(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    masters = [(t("supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey"), (t("customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey")]
    return AD.exclusive_fallback(o, masters, "unit", ["name"]).select("o_orderkey", "name", "which")


@query("""SELECT o_orderkey, coalesce(c_name, 'N/A') AS ward, coalesce(n_name, 'N/A') AS district, coalesce(r_name, 'N/A') AS province, CASE WHEN o_custkey % 9 = 0 THEN 'Whole district' ELSE coalesce(c_name, 'N/A') END AS label FROM orders
LEFT JOIN customer ON c_custkey = nullif(o_custkey, CASE WHEN o_custkey % 9 = 0 THEN o_custkey ELSE -1 END) LEFT JOIN nation ON n_nationkey = coalesce(c_nationkey, o_orderkey % 30) LEFT JOIN region ON r_regionkey = coalesce(n_regionkey, o_orderkey % 7)
WHERE c_name ILIKE '%1%' OR n_name ILIKE '%1%' OR r_name ILIKE '%e%' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500""")
def dependent_join_chain(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    whole = F.col("o_custkey") % 9 == 0
    steps = [
        (t("customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", F.when(~whole, F.col("o_custkey"))),
        (t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", F.coalesce("c_nationkey", F.col("o_orderkey") % 30)),
        (t("region").select("r_regionkey", "r_name"), "r_regionkey", F.coalesce("n_regionkey", F.col("o_orderkey") % 7)),
    ]
    wide = CO.any_contains(AD.left_chain(o, steps), {"c_name": "1", "n_name": "1", "r_name": "e"})
    top = wide.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(500)
    names = {c: F.coalesce(c, F.lit("N/A")) for c in ("c_name", "n_name", "r_name")}
    return top.select("o_orderkey", names["c_name"].alias("ward"), names["n_name"].alias("district"), names["r_name"].alias("province"), F.when(whole, "Whole district").otherwise(names["c_name"]).alias("label"))


LINEAGE = ("s", "supplier", "s_suppkey", "s_name"), ("n", "nation", "n_nationkey", "n_name"), ("r", "region", "r_regionkey", "r_name")


@query("SELECT c_custkey, " + ", ".join(f"{a}{v}.{name} AS {a}_name_v{v}" for v in (1, 2) for a, _, _, name in LINEAGE) + ", (c_acctbal < 0) IS NOT DISTINCT FROM TRUE AS is_old FROM customer " + " ".join(f"LEFT JOIN {table} {a}{v} ON {a}{v}.{id_} = (c_nationkey + {v}) % {m}" for v in (1, 2) for (a, table, id_, _), m in zip(LINEAGE, (12, 30, 6), strict=True)))
def six_way_view(t):
    df = t("customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).eqNullSafe(True).alias("is_old"))
    masters = {a: t(table).select(F.col(id_).alias("id"), F.col(name).alias("name")) for a, table, id_, name in LINEAGE}
    steps = [(masters[a].withColumnRenamed("name", f"{a}_name_v{v}"), "id", (F.col("c_nationkey") + v) % m) for v in (1, 2) for (a, *_), m in zip(LINEAGE, (12, 30, 6), strict=True)]
    return AD.left_chain(df, steps).drop("c_nationkey")


PLACES = "SELECT s_suppkey AS row_id, s_nationkey AS parent, " + pick("s_suppkey", ("Phường Bến Nghé", "Xã Tân Phú", "Thị trấn Củ Chi", "Phường Ỷ La")) + " AS name, s_suppkey % 2 + 1 AS version, s_suppkey % 3 = 0 AS is_deleted FROM supplier"


@query(f"""WITH {A}, m AS ({PLACES}), s AS (
SELECT id, row_id, version, is_deleted, 1 AS step FROM a JOIN m ON nation = parent AND lower(trim(ward)) = lower(trim(name)) UNION ALL
SELECT id, row_id, version, is_deleted, 2 FROM a JOIN m ON nation = parent AND {key("ward")} = {key("name")} UNION ALL
SELECT id, row_id, version, is_deleted, 3 FROM a JOIN m ON {key("ward")} = {key("name")})
SELECT id, row_id, step::INTEGER AS step FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, version DESC, is_deleted, row_id) = 1""")
def scoped_name_match(t):
    supplier = t("supplier").select("s_suppkey", "s_nationkey")
    m = supplier.sparkSession.sql(PLACES.replace("FROM supplier", "FROM {supplier}"), supplier=supplier)
    same, bare = (lambda c: F.lower(F.trim(c))), (lambda c: N.search_key(F.col(c)))
    steps = [(AD.scoped(F.col("nation"), same("ward")), AD.scoped(F.col("parent"), same("name"))), (AD.scoped(F.col("nation"), bare("ward")), AD.scoped(F.col("parent"), bare("name"))), (AD.scoped(bare("ward")), AD.scoped(bare("name")))]
    return AD.best_match(rows(t), m, "id", "row_id", steps, [F.desc("version"), F.col("is_deleted"), F.col("row_id")])


OLD_NAME = "CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) WHEN n_nationkey % 7 = 0 THEN 'same' ELSE n_name END"


@query(f"""WITH p AS (SELECT a.r_regionkey AS id, b.r_regionkey + 100 AS old_id FROM region a JOIN region b ON a.r_name = b.r_name),
o AS (SELECT n_nationkey + 1000 AS old_id, n_regionkey + 100 AS old_parent, {OLD_NAME} AS name FROM nation),
x AS (SELECT n_nationkey AS id, o.old_id, count(*) OVER (PARTITION BY n_nationkey) AS c1, count(*) OVER (PARTITION BY o.old_id) AS c2 FROM nation JOIN p ON n_regionkey = p.id JOIN o ON o.old_parent = p.old_id AND o.name = n_name),
e AS (SELECT id, old_id FROM x WHERE c1 = 1 AND c2 = 1),
y AS (SELECT n_nationkey AS id, o.old_id, count(*) OVER (PARTITION BY n_nationkey) AS c1, count(*) OVER (PARTITION BY o.old_id) AS c2 FROM nation JOIN p ON n_regionkey = p.id JOIN o ON o.old_parent = p.old_id AND lower(o.name) = lower(n_name) WHERE n_nationkey NOT IN (SELECT id FROM e) AND o.old_id NOT IN (SELECT old_id FROM e))
SELECT 0 AS level, id, old_id FROM p UNION ALL SELECT 1, id, old_id FROM e UNION ALL SELECT 1, id, old_id FROM y WHERE c1 = 1 AND c2 = 1""")
def top_down_match(t):
    r, n = t("region"), t("nation")
    province = r.select(F.col("r_regionkey").alias("id"), F.lit(0).alias("parent"), F.col("r_name").alias("name"))
    district = n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    old = n.select((F.col("n_nationkey") + 1000).alias("id"), (F.col("n_regionkey") + 100).alias("parent"), F.expr(OLD_NAME).alias("name"))
    return AD.top_down([(province, province.withColumn("id", F.col("id") + 100)), (district, old)], [lambda c: c, N.folded])


@query("""WITH h AS (SELECT c_custkey AS unit, c_nationkey, c_mktsegment, c_custkey % 4 + 1 AS version FROM customer WHERE c_custkey % 5 <> 0),
i AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey + 100000 END AS new_unit FROM customer WHERE c_custkey % 2 = 0),
t AS (SELECT i.*, h.version, CASE WHEN h.unit IS NULL THEN 'CREATE' WHEN h.c_nationkey = i.c_nationkey THEN 'NO_CHANGE' WHEN new_unit IS NULL THEN 'ERROR' ELSE 'UPDATE' END AS change FROM i LEFT JOIN h USING (unit))
SELECT h.unit, h.c_nationkey, h.c_mktsegment, CASE WHEN t.change = 'UPDATE' THEN '2025-07-01' ELSE '9999-12-31' END AS valid_to, h.version AS version_id FROM h LEFT JOIN t USING (unit)
UNION ALL SELECT CASE WHEN change = 'UPDATE' THEN new_unit ELSE unit END, c_nationkey, c_mktsegment, '9999-12-31', coalesce(version, 0) + 1 FROM t WHERE change IN ('CREATE', 'UPDATE')""")
def scd2_history(t):
    history, incoming = _scd(t)
    out, _ = AD.scd2(history, incoming, "unit", ["c_nationkey", "c_mktsegment"], F.lit("2025-07-01").cast("timestamp"), "new_unit")
    return out.select("unit", "c_nationkey", "c_mktsegment", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "version_id")


def _scd(t):
    c = t("customer").select(F.col("c_custkey").alias("unit"), "c_nationkey", "c_mktsegment")
    history = c.filter("unit % 5 <> 0").withColumns({"valid_from": F.lit("2020-01-01").cast("timestamp"), "valid_to": F.lit(AD.OPEN_END).cast("timestamp"), "version_id": F.col("unit") % 4 + 1})
    incoming = c.filter("unit % 2 = 0").withColumns({"c_nationkey": F.when(F.col("unit") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "new_unit": F.when(F.col("unit") % 9 != 0, F.col("unit") + 100000)})
    return history, incoming


@query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'CREATE' WHEN c_custkey % 3 <> 0 THEN 'NO_CHANGE' WHEN c_custkey % 9 = 0 THEN 'ERROR' ELSE 'UPDATE' END AS change_type, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1""")
def scd2_log(t):
    history, incoming = _scd(t)
    _, log = AD.scd2(history, incoming, "unit", ["c_nationkey", "c_mktsegment"], F.lit("2025-07-01").cast("timestamp"), "new_unit")
    return log.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT s_suppkey AS row_id, s_nationkey AS id, s_suppkey % 2 AS version, s_suppkey % 3 > 0 AS active FROM supplier), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, active DESC, row_id DESC) AS rn FROM d)
SELECT row_id, id AS old_id, id::BIGINT AS new_id FROM w WHERE rn = 1 UNION ALL SELECT row_id, id, (SELECT max(id) FROM d) + row_number() OVER (ORDER BY row_id) FROM w WHERE rn > 1""")
def winner_and_renumber(t):
    return AD.renumbered_losers(_units(t), "row_id", "id", ["id"], [F.desc("version"), F.desc("active"), F.desc("row_id")])


def _units(t):
    return t("supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("id"), (F.col("s_suppkey") % 2).alias("version"), (F.col("s_suppkey") % 3 > 0).alias("active"))


@query("""WITH m AS (SELECT s_nationkey AS old_id, max(s_suppkey) + 1000 AS new_id FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, coalesce(a.new_id, c_nationkey) AS ward_id, coalesce(b.new_id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_nationkey * 2 END) AS old_ward_id FROM customer LEFT JOIN m a ON a.old_id = c_nationkey LEFT JOIN m b ON b.old_id = CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_nationkey * 2 END""")
def downstream_remap(t):
    m = t("supplier").groupBy(F.col("s_nationkey").alias("old_id")).agg((F.max("s_suppkey") + 1000).alias("new_id"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("ward_id"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_nationkey") * 2).alias("old_ward_id"))
    return MU.remap_ids(c, m, ["ward_id", "old_ward_id"])


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS since FROM orders), m AS (SELECT o_custkey, o_orderkey FROM l QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY since DESC NULLS LAST, o_orderkey DESC) = 1)
SELECT c_custkey, o_orderkey AS mapped, CASE WHEN o_orderkey IS NULL THEN 'UNMAPPED' ELSE 'MIGRATED' END AS status FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def queue_migration(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("since"))
    latest = o.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("since", "o_orderkey")).alias("mapped"))
    return t("customer").select("c_custkey").join(latest, "c_custkey", "left").withColumn("status", F.when(F.col("mapped").isNull(), "UNMAPPED").otherwise("MIGRATED"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, lower(trim(coalesce(props, ''))) ORDER BY CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END ASC NULLS FIRST, event_id) AS rn FROM events) WHERE rn = 1")
def fingerprint_dedup_nulls_first(t):
    e = t("events").select("event_id", "event_type", "user_id", F.lower(F.trim(F.coalesce("props", F.lit("")))).alias("fingerprint"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("created"))
    # the least of a struct is the first row: a null timestamp is less than any
    return e.groupBy("event_type", "user_id", "fingerprint").agg(F.min(F.struct("created", "event_id")).alias("first")).select("first.event_id")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS old_address FROM orders WHERE o_orderstatus = 'P') ON old_address = c_name")
def text_equality_join(t):
    o = t("orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.concat(F.lit("Customer#"), N.zero_filled(F.col("o_custkey"), 9)).alias("old_address"))
    return t("customer").select("c_custkey", "c_name").join(o, F.col("old_address") == F.col("c_name"), "left").select("c_custkey", "o_orderkey")


@query(f"""WITH {A}, m AS ({PLACES}) SELECT id, row_id FROM a JOIN m ON lower(ward) = lower(name) AND contains(lower(province), lower(CASE parent % 3 WHEN 0 THEN 'Hồ Chí Minh' WHEN 1 THEN 'hà nội' ELSE 'Bình' END))""")
def name_and_parent_like(t):
    supplier = t("supplier").select("s_suppkey", "s_nationkey")
    m = supplier.sparkSession.sql(PLACES.replace("FROM supplier", "FROM {supplier}"), supplier=supplier)
    parent = F.when(F.col("parent") % 3 == 0, "hồ chí minh").when(F.col("parent") % 3 == 1, "hà nội").otherwise("bình")
    a = rows(t).select("id", F.lower("ward").alias("name"), F.lower("province").alias("province"))
    return R.agreeing_and_holding(a, m.select("row_id", F.lower("name").alias("name"), parent.alias("part")), "name", "province", "part", "id").select("id", "row_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'v2' ELSE coalesce(nullif(trim(lower(c_name)), ''), 'none') END AS raw_norm, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '{\"level_1\":\"' || c_mktsegment || '\",\"level_2\":null,\"level_3\":\"' || c_name || '\"}' END ELSE '{\"level_1\":\"' || c_mktsegment || '\",\"level_2\":\"' || c_nationkey || '\",\"level_3\":\"' || c_name || '\"}' END AS components FROM customer")
def versioned_components(t):
    c = t("customer")
    k = F.col("c_custkey")
    norm = F.when(k % 3 == 0, "v2").otherwise(F.coalesce(CO.raw_norm(F.col("c_name")), F.lit("none")))
    parts = CO.address_components(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.when(k % 2 == 0, 2).otherwise(1))
    return c.select("c_custkey", norm.alias("raw_norm"), F.when((k % 2 != 0) | (k % 3 != 0), parts).alias("components"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND NOT coalesce(c_acctbal < 0, false)")
def cascading_filter(t):
    return CO.most_specific(t("customer").withColumns({"ward_id": F.col("c_nationkey"), "district_id": F.col("c_nationkey") % 5, "is_deleted": F.col("c_acctbal") < 0}), 2, ward_id=3, district_id=1).select("c_custkey")


@query("SELECT p_partkey, count(*) OVER () AS total FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%re%' ORDER BY p_partkey DESC LIMIT 20 OFFSET 20")
def page_with_total(t):
    found = CO.any_contains(t("part").select("p_partkey", "p_name", "p_type"), {"p_name": "re", "p_type": "re"})
    return CO.page(found.select("p_partkey"), [F.desc("p_partkey")], 20, 20)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def recent_window(t):
    return CO.recent(t("events"), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), "36 hours").select("event_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars::DOUBLE / 10000 >= 0.05 AND length(text) > 5 ORDER BY n_chars DESC, doc_id LIMIT 200")
def corpus_gate(t):
    d = t("documents").withColumn("quality", F.col("n_chars").cast("double") / 10000)
    return CO.gate(d, "text", "quality", 0.05, {"lang": ["en", "fr"]}).orderBy(F.desc("n_chars"), "doc_id").limit(200).select("doc_id")


@query("SELECT doc_id FROM documents")
def filter_with_fallback(t):
    return CO.filtered_or_all(t("documents").select("doc_id", "lang"), F.col("lang") == "xx").select("doc_id")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(t):
    return CO.table_counts({n: t(n) for n in ("customer", "orders", "part")})


@query("SELECT event_type, round((last - first) * 180.0::DOUBLE / nullif(date_diff('second', a, b), 0), 4) AS growth FROM (SELECT event_type, min(event_id) AS first, max(event_id) AS last, min(ts) AS a, max(ts) AS b FROM events GROUP BY event_type)")
def growth_rate(t):
    e = t("events").groupBy("event_type").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.min("ts").alias("s"), F.max("ts").alias("e"))
    return e.select("event_type", F.round(CO.growth(F.col("b") - F.col("a"), F.timestamp_diff("SECOND", F.col("s"), F.col("e"))), 4).alias("growth"))


@query(f"""WITH {A}, o AS (SELECT id, list_filter(['province' || CASE WHEN id % 2 = 0 THEN 'x' ELSE '' END, ward, 'district'], lambda x: x IS NOT NULL) AS actual FROM a) SELECT id, len(list_filter(actual, lambda x: x NOT IN ('province', 'district', 'Phường Bến Nghé'))) AS n_unexpected FROM o""")
def unexpected_labels(t):
    actual = F.array(F.concat(F.lit("province"), F.when(F.col("id") % 2 == 0, "x").otherwise("")), F.col("ward"), F.lit("district"))
    expected = F.array(*map(F.lit, ("province", "district", "Phường Bến Nghé")))
    return rows(t).select("id", F.size(CO.unexpected(actual, expected)).alias("n_unexpected"))


@query(f"""WITH {A}, s AS (SELECT id, nation, lower(address) AS x FROM a WHERE address IS NOT NULL) SELECT nation, x, id FROM s QUALIFY row_number() OVER (PARTITION BY nation, x ORDER BY id) = 1""")
def first_seen_dedup(t):
    return CO.first_seen(rows(t).select("id", "nation", F.lower("address").alias("x")).filter("x IS NOT NULL"), ["nation", "x"], "id").select("nation", "x", "id")


OSM = """CASE event_id % 6 WHEN 0 THEN map {'addr:street': 'Lê Lợi', 'highway': 'primary', 'name': ' ', 'source': 'x'} WHEN 1 THEN map {'building': 'yes', 'name': 'Tower', 'note': 'n'} WHEN 2 THEN map {'shop': 'bakery', 'name': 'Bread'} WHEN 3 THEN map {'amenity': CASE WHEN event_id % 12 = 3 THEN 'cafe' ELSE 'Bar ' END, 'shop': 'x', 'name': CASE WHEN event_id % 9 = 0 THEN 'CAFE' ELSE ' Cafe' END} WHEN 4 THEN map {'highway': 'path'} ELSE map {'tourism': 'hotel', 'name': 'Inn', 'building': 'hotel'} END"""


@query(f"""WITH e AS (SELECT event_id AS id, event_id % 40 AS k, {OSM} AS tags FROM events), f AS (SELECT id, k, map_from_entries(list_filter(list_transform(map_entries(tags), lambda x: {{'key': trim(x.key), 'value': trim(x.value)}}), lambda x: x.value <> '' AND (starts_with(x.key, 'addr:') OR x.key IN ('name', 'highway', 'building', 'amenity', 'shop', 'tourism', 'office', 'place', 'landuse', 'ref', 'operator', 'brand')))) AS tags FROM e),
n AS (SELECT id, k, tags, coalesce(tags['name'], tags['addr:street']) AS name, len(map_keys(tags)) AS n_tags, coalesce(tags['amenity'], tags['shop'], tags['tourism'], tags['office']) AS place FROM f),
g AS (SELECT 'street' AS kind, id, k, name, NULL AS type, n_tags FROM n WHERE tags['highway'] IS NOT NULL OR tags['addr:street'] IS NOT NULL UNION ALL SELECT 'building', id, k, name, tags['building'], n_tags FROM n WHERE tags['building'] IS NOT NULL UNION ALL SELECT 'poi', id, k, name, place, n_tags FROM n WHERE place IS NOT NULL)
SELECT kind, name, k AS province, id, type, n_tags::INTEGER AS n_tags FROM g WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, lower(name), lower(coalesce(type, '')), k ORDER BY id) = 1""")
def osm_tag_split(t):
    spark_maps = {0: {"addr:street": "Lê Lợi", "highway": "primary", "name": " ", "source": "x"}, 1: {"building": "yes", "name": "Tower", "note": "n"}, 2: {"shop": "bakery", "name": "Bread"}, 4: {"highway": "path"}, 5: {"tourism": "hotel", "name": "Inn", "building": "hotel"}}
    tags = F.lit(None)
    for i, m in spark_maps.items():
        tags = F.when(F.col("event_id") % 6 == i, F.create_map(*[F.lit(v) for pair in m.items() for v in pair])).otherwise(tags)
    k = F.col("event_id")
    cafe = F.create_map(F.lit("amenity"), F.when(k % 12 == 3, "cafe").otherwise("Bar "), F.lit("shop"), F.lit("x"), F.lit("name"), F.when(k % 9 == 0, "CAFE").otherwise(" Cafe"))
    tags = F.when(k % 6 == 3, cafe).otherwise(tags)
    e = t("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 40).alias("province"), tags.alias("tags"))
    return CO.split_entities(e, "id", "tags", "province").select("kind", "name", "province", "id", "type", "n_tags")


@query(f"""WITH {A}, o AS (SELECT id, address, lower(address) AS l FROM a), m(mapping, old_name, new_name, since) AS (VALUES (1, 'Bến Nghé', 'Sài Gòn', DATE '2025-07-01'), (2, 'tân thông hội', 'Củ Chi', DATE '2025-07-02'), (3, 'Củ Chi', 'củ chi', DATE '2025-07-03'), (4, 'Sài Gòn', 'Nowhere', DATE '2025-06-01'))
SELECT id, regexp_replace(regexp_replace(address, 'tân thông hội', 'Củ Chi', 'gi'), 'Bến Nghé', 'Sài Gòn', 'gi') AS converted, (contains(l, 'bến nghé')::INTEGER + contains(l, 'tân thông hội')::INTEGER)::INTEGER AS n_applied, CASE WHEN contains(l, 'bến nghé') OR contains(l, 'tân thông hội') THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence FROM o WHERE address IS NOT NULL""")
def address_conversion(t):
    spark = t("customer").sparkSession
    m = spark.sql("SELECT mapping, old_name, new_name, cast(since AS timestamp) AS since FROM VALUES (1, 'Bến Nghé', 'Sài Gòn', DATE '2025-07-01'), (2, 'tân thông hội', 'Củ Chi', DATE '2025-07-02'), (3, 'Củ Chi', 'củ chi', DATE '2025-07-03'), (4, 'Sài Gòn', 'Nowhere', DATE '2025-06-01') AS m(mapping, old_name, new_name, since)")
    a = rows(t).filter("address IS NOT NULL").select("id", "address")
    hits = AD.contains_join(a, "address", m, "old_name", "id", "mapping", 5)
    return M.converted(a, m, "id", "address", hits).select("id", "converted", "n_applied", "confidence")


@query(None)
def postal_peel(t):
    """Tested row by row against a Python version."""
    return P.peeled(rows(t), "address", "province", "district", "ward").select("id", "street", "postal_code")


@query(None)
def address_labels(t):
    """Tested row by row against a Python version."""
    return P.with_labels(rows(t), "address").select("id", *P.LABELS, "NUM", "STR")
