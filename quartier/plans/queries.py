"""Registered queries of the address operators over the driver's tables, each with its SQL.

Region, nation and customer stand in for province, district and ward, orders for the processing queue, part names for addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.functions import normalize as N
from quartier.functions import text as X
from quartier.operators import admin as AD
from quartier.operators import geometry as G
from quartier.operators import ivf as I
from quartier.operators import matching as M
from quartier.operators import relational as R
from quartier.operators import retrieval as V
from quartier.operators import sampling as S
from quartier.sources.tables import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', ' || r_name ELSE c_name || ', ' || n_name || ', ' || r_name END AS address, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_corpus(t):
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    two = F.col("c_custkey") % 2 == 0
    return df.select("c_custkey", F.when(two, F.concat("c_name", F.lit(", "), "r_name")).otherwise(F.concat("c_name", F.lit(", "), "n_name", F.lit(", "), "r_name")).alias("address"), F.when(two, 2).otherwise(1).alias("version"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, n_chars // 100 ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def corpus_dedup_latest(t):
    df = t("documents").select("doc_id", "lang", "source", "n_chars", F.expr("n_chars div 100").alias("b"))
    return R.latest_per_key(df, ["lang", "source", "b"], [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id", "lang", "source")


@query("SELECT event_type, user_id, props, min(event_id) AS event_id FROM events GROUP BY ALL")
def raw_entity_dedup(t):
    return t("events").groupBy("event_type", "user_id", "props").agg(F.min("event_id").alias("event_id"))


@query("SELECT n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name")
def lineage_triple_count(t):
    o = t("orders").filter("o_orderstatus = 'F'").select("o_custkey")
    df = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))


@query("SELECT o_orderkey, coalesce(c_name, 'N/A') AS customer, coalesce(n_name, 'N/A') AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def lineage_left_view(t):
    c = t("customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    df = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.select("o_orderkey", F.coalesce("c_name", F.lit("N/A")).alias("customer"), F.coalesce("n_name", F.lit("N/A")).alias("nation"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_in_corpus_anti(t):
    return t("customer").join(t("orders").filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def in_corpus_semi(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def latest_mapping_per_key(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey OR n_name ILIKE '%' || r_name || '%'")
def theta_name_join(t):
    """An OR of an equality and a contained name: two equality joins, and each pair once."""
    n, r = t("nation"), t("region")
    by_key = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey")
    pairs = by_key.union(AD.contains_join(n, "n_name", r, "r_name", "n_nationkey", "r_regionkey")).distinct()
    return pairs.join(n.select("n_nationkey", "n_name"), "n_nationkey").join(r.select("r_regionkey", "r_name"), "r_regionkey").select("n_name", "r_name")


@query("SELECT coalesce(c_custkey, s_suppkey) AS key, c_nationkey, s_nationkey, CASE WHEN c_custkey IS NULL THEN 'added' WHEN s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS diff FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def key_diff(t):
    df = t("customer").select("c_custkey", "c_nationkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("c_custkey") == F.col("s_suppkey"), "full_outer").filter(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey")))
    return df.select(F.coalesce("c_custkey", "s_suppkey").alias("key"), "c_nationkey", "s_nationkey", F.when(F.col("c_custkey").isNull(), "added").when(F.col("s_suppkey").isNull(), "removed").otherwise("changed").alias("diff"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate AS f, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '9999-12-31') AS e FROM orders) WHERE f <= TIMESTAMP '1996-01-01' AND e > TIMESTAMP '1996-01-01'")
def point_in_time_version(t):
    history = R.validity(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], F.lit("9999-12-31").cast("timestamp_ntz"))
    return AD.as_of(history, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN (SELECT min(c_custkey) AS c_custkey, c_nationkey, c_custkey % 97 AS part FROM customer GROUP BY c_nationkey, c_custkey % 97 HAVING count(*) = 1) ON s_nationkey = c_nationkey AND s_suppkey % 97 = part")
def cascade_unambiguous_match(t):
    one = R.unambiguous(t("customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 97).alias("part")), ["c_nationkey", "part"])
    return t("supplier").join(one, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") % 97 == F.col("part"))).select("s_suppkey", "c_custkey")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS n_large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderstatus")
def status_summary(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), *R.conditional_counts({"n_large": F.col("o_totalprice") > 100000, "n_urgent": F.col("o_orderpriority") == "1-URGENT"}), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def having_dups(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def top_groups(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("SELECT c_mktsegment, count(*) AS n, count(o) AS n_covered, round(100.0 * count(o)::DOUBLE / count(*), 2) AS pct FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY c_mktsegment")
def coverage_percent(t):
    o = t("orders").select(F.col("o_custkey").alias("o")).distinct()
    g = t("customer").join(o, F.col("o") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("o").alias("n_covered"))
    return g.withColumn("pct", R.share(F.col("n_covered"), F.col("n")))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem")
def group_total_attach(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(W.partitionBy("l_orderkey")).alias("n_lines"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def majority_label(t):
    return R.latest_per_key(t("events").groupBy("user_id", "event_type").count(), ["user_id"], [F.desc("count"), F.col("event_type")]).select("user_id", "event_type")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(t):
    p = R.percentiles(t("events"), "event_type", "value", (0.5, 0.95, 0.99))
    return p.select("event_type", *[F.round(F.col("p")[i], 4).alias(f"p{n}") for i, n in enumerate((50, 95, 99))])


@query("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 2) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority")
def run_rollup(t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)), 2).alias("std"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT event_type, cast(cast(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, cast(ts AS DATE)), (event_type), ())")
def sync_summary(t):
    return t("events").withColumn("day", F.to_date("ts")).groupingSets([[F.col("event_type"), F.col("day")], [F.col("event_type")], []], "event_type", "day").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("day").cast("string").alias("day"), "n")


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(translate(lower(text), '{N.MARKED}', '{N.PLAIN}'), '\\p{{Mn}}', '', 'g'), 'đøłħŧ', 'dolht'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents")
def text_normalize(t):
    return t("documents").select("doc_id", X.normalized(F.col("text")).alias("norm"))


@query("WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.t, b.t)) * 2 >= len(list_distinct(list_concat(a.t, b.t)))")
def jaccard_pairs(t):
    p = t("part").select("p_partkey", "p_brand", F.split(F.lower("p_name"), " ").alias("t"))
    return M.jaccard_join(p, "p_partkey", "t", 50, ["p_brand"])


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages")
def street_parse(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 1).alias("lang"), F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 2).alias("number"))


NEAREST = "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"


@query(NEAREST)
def vector_topk(t):
    v = t("embeddings").select("vec_id", "embedding")
    return V.top_k(v, v.filter("vec_id % 20 = 0"), 5)


def _indexed(t, probes: int | None):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = I.build(v, shared_path(v.sparkSession, "ivf"), k=5)
    found = I.search(index, v.sparkSession, v.filter("id % 20 = 0"), 5, probes or len(index.centroids) if probes is not None else None)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(NEAREST)
def ivf_exact(t):
    """Every list of the index is looked into, so every row has to be in it."""
    return _indexed(t, 0)


@query(None)
def ivf_topk(t):
    """As many lists as the index has measured to be enough; a test holds its recall against exact search."""
    return _indexed(t, None)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20")
def paginate_search(t):
    return t("part").filter(F.col("p_name").ilike("%a%")).orderBy("p_name", "p_partkey").offset(20).limit(20).select("p_partkey", "p_name")


@query("SELECT o_orderkey, md5(o_orderkey || ':42') AS digest FROM orders ORDER BY digest, o_orderkey LIMIT 100")
def md5_sample(t):
    return S.md5_sample(t("orders").select("o_orderkey"), "o_orderkey", 100, 42)


@query("SELECT event_id, event_type, rank::INTEGER AS rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':7'), event_id) AS rank FROM events) WHERE rank <= CASE event_type WHEN 'click' THEN 40 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 20 ELSE 0 END")
def stratified_quota_sample(t):
    return S.stratified(t("events").select("event_id", "event_type"), "event_id", "event_type", {"click": 40, "signup": 30, "purchase": 20}, 7)


@query("SELECT c_custkey, round(0.5 * least(1.0, greatest(0.0, c_acctbal / 10000)) + 0.3 * CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END + 0.2, 4) AS score FROM customer")
def confidence_score(t):
    return t("customer").select("c_custkey", F.round(0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000)) + 0.3 * F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(0) + 0.2, 4).alias("score"))


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey * 3.0 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation),
d AS (SELECT a.k AS k, b.k AS near, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS km FROM n a JOIN n b ON a.k <> b.k)
SELECT k, near, km FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, near) AS rn FROM d) WHERE rn = 1""")
def haversine_nearest(t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.0).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon"))
    pairs = G.nearest(n, n.withColumnRenamed("k", "near"), "k", "near", 10.0, 1500.0, other=True)
    return pairs.withColumn("km", F.round("km", 4))


@query("SELECT n_nationkey AS id, n_nationkey + 1 AS other FROM nation UNION SELECT n_nationkey + 1, n_nationkey FROM nation")
def neighbours_union(t):
    e = t("nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + 1).alias("other"))
    return e.union(e.select("other", "id")).distinct()


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT c.c_custkey, c.c_acctbal, n.b IS NULL OR n.b = c.c_acctbal AS is_current FROM customer c LEFT JOIN n USING (c_custkey) UNION ALL SELECT c_custkey, b, true FROM n JOIN customer USING (c_custkey) WHERE b <> c_acctbal""")
def scd2_upsert(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    n = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("b"))
    both = c.join(n, "c_custkey", "left").withColumn("changed", F.col("b").isNotNull() & (F.col("b") != F.col("c_acctbal")))
    versions = F.when(F.col("changed"), F.array(F.struct(F.col("c_acctbal").alias("c_acctbal"), F.lit(False).alias("is_current")), F.struct(F.col("b").alias("c_acctbal"), F.lit(True).alias("is_current")))).otherwise(F.array(F.struct(F.col("c_acctbal").alias("c_acctbal"), F.lit(True).alias("is_current"))))
    return both.select("c_custkey", F.inline(versions))


@query("SELECT p_partkey, greatest(a.p_retailprice, b.p_retailprice) AS p_retailprice, coalesce(b.p_brand, a.p_brand) AS p_brand FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, p_retailprice * 1.1 AS p_retailprice, 'B' || p_size AS p_brand FROM part WHERE p_partkey % 2 = 0) b USING (p_partkey)")
def merge_greatest_coalesce(t):
    old = t("part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_retailprice", "p_brand")
    new = t("part").filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_retailprice") * 1.1).alias("p_retailprice"), F.concat(F.lit("B"), "p_size").alias("p_brand"))
    return R.merge_upsert(old, new, ["p_partkey"], {"p_retailprice": "greatest", "p_brand": "new"})


@query("SELECT s_suppkey, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS canonical FROM supplier")
def id_remap(t):
    return t("supplier").select("s_suppkey", F.min("s_suppkey").over(W.partitionBy("s_nationkey")).alias("canonical"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_object('id', event_id, 'type', event_type)::VARCHAR AS doc FROM events")
def json_build_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")), {"ignoreNullFields": "false"}).alias("doc"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part")
def training_pairs_explode(t):
    return t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))


@query("SELECT count(*) AS n_orders, count(c_custkey) AS n_customer, count(n_nationkey) AS n_nation, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def bridge_audit(t):
    df = t("orders").select("o_custkey").join(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.agg(F.count(F.lit(1)).alias("n_orders"), F.count("c_custkey").alias("n_customer"), F.count("n_nationkey").alias("n_nation"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE text <> trim(text)) AS n_untrimmed, count(*) FILTER (WHERE contains(text, '  ')) AS n_double, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang")
def doc_shape_report(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != F.trim("text")).alias("n_untrimmed"), F.count_if(F.contains("text", F.lit("  "))).alias("n_double"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))
