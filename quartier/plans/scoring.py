"""Queries of matching, evaluation, geometry and text scoring, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.functions import normalize as N
from quartier.operators import admin as AD
from quartier.operators import evaluation as E
from quartier.operators import geometry as G
from quartier.operators import matching as M
from quartier.operators import relational as R
from quartier.operators import retrieval as V
from quartier.plans.queries import query


@query("SELECT n_nationkey, 2 * 1000 + n_nationkey AS versioned, lpad(n_nationkey::VARCHAR, greatest(3, length(n_nationkey::VARCHAR))::INTEGER, '0') AS code FROM nation")
def versioned_ids(t):
    return t("nation").select("n_nationkey", (F.col("n_nationkey") + 2 * 1000).alias("versioned"), N.zero_filled(F.col("n_nationkey"), 3).alias("code"))


@query("""SELECT c_custkey, sha256('{"c_mktsegment": "' || c_mktsegment || '", "c_nationkey": "' || c_nationkey || '"}') AS checksum FROM customer""")
def row_checksum(t):
    return t("customer").select("c_custkey", AD.checksum(["c_nationkey", "c_mktsegment"]).alias("checksum"))


@query("SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)$', 1)::BIGINT AS code, regexp_replace(c_name, '#[0-9]+$', '') AS bare FROM customer")
def code_extract(t):
    return t("customer").select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)$", 1).cast("long").alias("code"), F.regexp_replace("c_name", "#[0-9]+$", "").alias("bare"))


@query("""WITH s AS (SELECT doc_id, 4 * contains(lower(text), ' the ')::INT + 2 * contains(lower(text), ' of ')::INT AS pre, 4 * contains(lower(text), ' der ')::INT + 2 * contains(lower(text), ' und ')::INT AS post FROM documents)
SELECT doc_id, pre, post, CASE WHEN pre >= 6 AND pre > post THEN 'PRE' WHEN post >= 6 AND post > pre THEN 'POST' ELSE 'AMBIGUOUS' END AS epoch FROM s""")
def epoch_detect(t):
    low = F.lower("text")
    score = lambda four, two: F.when(F.contains(low, F.lit(four)), 4).otherwise(0) + F.when(F.contains(low, F.lit(two)), 2).otherwise(0)
    df = t("documents").select("doc_id", score(" the ", " of ").alias("pre"), score(" der ", " und ").alias("post"))
    return df.withColumn("epoch", F.when((F.col("pre") >= 6) & (F.col("pre") > F.col("post")), "PRE").when((F.col("post") >= 6) & (F.col("post") > F.col("pre")), "POST").otherwise("AMBIGUOUS"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'RETAINED' WHEN contains(lower(text), 'merge') THEN 'MERGED_FULL' WHEN contains(lower(text), 'name') THEN 'RENAMED' WHEN contains(lower(text), 'type') THEN 'TYPE_CHANGED' ELSE 'OTHER' END AS relation FROM conversations")
def classify_note(t):
    low, out = F.lower("text"), F.when(F.col("text").isNull(), "RETAINED")
    for word, relation in (("merge", "MERGED_FULL"), ("name", "RENAMED"), ("type", "TYPE_CHANGED")):
        out = out.when(F.contains(low, F.lit(word)), relation)
    return t("conversations").select("conv_id", "turn", out.otherwise("OTHER").alias("relation"))


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name] ELSE [p_name || ' ' || p_type, p_name] END) AS old, p_name AS new FROM part")
def training_pairs(t):
    """(old, new) where these differ, and (new, new)."""
    old = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    both = F.array(old, F.col("p_name"))
    return t("part").select("p_partkey", F.explode(F.array_distinct(both)).alias("old"), F.col("p_name").alias("new"))


@query("""SELECT o_orderkey, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NOT NULL THEN 2 WHEN s_name IS NOT NULL THEN 1 ELSE 0 END AS version
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = o_custkey AND c_custkey IS NULL""")
def version_fallback_join(t):
    """The newer table's row, and only where there is none the older one's."""
    c = t("customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    df = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    df = df.join(t("supplier").select("s_suppkey", "s_name"), (F.col("s_suppkey") == F.col("o_custkey")) & F.col("c_custkey").isNull(), "left")
    return df.select("o_orderkey", F.coalesce("c_name", "s_name").alias("name"), F.when(F.col("c_name").isNotNull(), 2).when(F.col("s_name").isNotNull(), 1).otherwise(0).alias("version"))


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE upper(p_brand) || '!' END AS name FROM part), r AS (SELECT p_brand AS name, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY p_brand),
n AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name, min(id) AS id FROM r GROUP BY ALL)
SELECT p_partkey, coalesce(r.id, n.id) AS match, CASE WHEN r.id IS NOT NULL THEN 1 ELSE 2 END AS step FROM l LEFT JOIN r ON r.name = l.name LEFT JOIN n ON n.name = regexp_replace(lower(l.name), '[^a-z0-9]', '', 'g') WHERE coalesce(r.id, n.id) IS NOT NULL""")
def name_cascade_match(t):
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    left = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.upper("p_brand"), F.lit("!"))).alias("name"))
    right = t("part").filter("p_size > 25").select(F.col("p_partkey").alias("match"), F.col("p_brand").alias("brand"))
    return M.cascade_match(left, right, "p_partkey", "match", [(F.col("name"), F.col("brand")), (bare(F.col("name")), bare(F.col("brand")))])


@query("""WITH g AS (SELECT s_suppkey AS id, unnest(list_distinct(list_transform(range(1, length(s_name) + 2), lambda i: substr('  ' || lower(s_name) || ' ', i, 3)))) AS g FROM supplier), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id AS id, b.id AS match, round(count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS score FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY a.id, b.id)
SELECT id, match, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match) = 1""")
def trigram_best_match(t):
    names = t("supplier").select("s_suppkey", "s_name")
    return M.trigram_top1(names, names)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, doc_id AS new_id FROM d WHERE rn = 1 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT max(doc_id) FROM documents) FROM d WHERE rn > 1""")
def duplicate_id_remap(t):
    return M.remap_duplicates(t("documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


@query("""WITH m AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS a, regexp_extract(url, '://([^/?#]+)', 1) AS b, regexp_extract(url, '[0-9]+', 0) AS c FROM pages),
p AS (SELECT *, strpos(url, a) - 1 AS pa, strpos(url, b) - 1 AS pb, strpos(url, c) - 1 AS pc FROM m),
o AS (SELECT *, a <> '' AS oa, b <> '' AND NOT (a <> '' AND pa < pb + length(b) AND pb < pa + length(a)) AS ob FROM p),
q AS (SELECT *, c <> '' AND NOT (oa AND pa < pc + length(c) AND pc < pa + length(a)) AND NOT (ob AND pb < pc + length(c) AND pc < pb + length(b)) AS oc FROM o)
SELECT page_id, pa::INT AS start, (pa + length(a))::INT AS end, 'SCHEME' AS label, a AS span FROM q WHERE oa UNION ALL SELECT page_id, pb::INT, (pb + length(b))::INT, 'HOST', b FROM q WHERE ob UNION ALL SELECT page_id, pc::INT, (pc + length(c))::INT, 'NUM', c FROM q WHERE oc""")
def span_labelling(t):
    return M.span_labels(t("pages").select("page_id", "url"), "url", [("SCHEME", "^([a-z]+)://", 1), ("HOST", "://([^/?#]+)", 1), ("NUM", "[0-9]+", 0)]).drop("url")


@query(None)
def fuzzy_ratio(t):
    return t("part").select("p_partkey", F.round(M.matcher_ratio(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_brand")), 6).alias("ratio"))


LEVELS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS level, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % {k} = 0 THEN 'x' ELSE {c} END AS p, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {c} END AS g FROM part" for c, k in (("p_brand", 5), ("p_type", 3)))


@query(f"""WITH l AS ({LEVELS_SQL}), c AS (SELECT level, count(*) FILTER (WHERE p = g) AS tp, count(*) FILTER (WHERE g IS NULL AND p IS NOT NULL) AS fp, count(*) FILTER (WHERE p IS DISTINCT FROM g AND g IS NOT NULL) AS fn FROM l GROUP BY level)
SELECT level, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 4) AS f1 FROM c""")
def component_f1(t):
    key = F.col("p_partkey")
    pair = lambda c, k: (F.when(key % 7 == 0, None).when(key % k == 0, "x").otherwise(F.col(c)), F.when(key % 11 == 0, None).otherwise(F.col(c)))
    return E.component_metrics(t("part"), {"p_brand": pair("p_brand", 5), "p_type": pair("p_type", 3)})


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS relevant, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
o AS (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS first, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE relevant) AS n FROM r GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS top1, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr,
round(avg(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) END), 4) AS ndcg_k FROM o""")
def retrieval_metrics(t):
    v = t("embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = V.all_top_k(v, 5).withColumnRenamed("id", "vec_id")
    label = t("embeddings").select("vec_id", "label")
    judged = top.join(label, "vec_id").join(label.toDF("query_id", "wanted"), "query_id")
    return E.ranking_metrics(judged.select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant")), 5)


@query("SELECT coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE lang END), ''), 'UNLABELED') AS stratum, count(*) AS n, round(100.0 * count(*) FILTER (WHERE n_chars > 500)::DOUBLE / count(*), 2) AS pct FROM documents GROUP BY stratum")
def stratum_metrics(t):
    code = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("lang"))
    g = t("documents").groupBy(F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit("UNLABELED")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 500).alias("hit"))
    return g.select("stratum", "n", R.share(F.col("hit"), F.col("n")).alias("pct"))


#: Corners of the test polygons around their middle, as (lat, lon).
CORNERS = ((-2.0, -2.0), (-2.0, 2.5), (2.5, 2.5), (0.25, 0.0), (2.5, -2.0))
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1]))


@query(f"""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 1000)::DOUBLE / 50 AS lat, (c_custkey * 91 % 1000)::DOUBLE / 50 AS lon FROM customer), m AS (SELECT r_regionkey, 3 + 3.5::DOUBLE * r_regionkey AS mid FROM region),
e AS (SELECT r_regionkey, mid + a::DOUBLE AS a, mid + b::DOUBLE AS b, mid + c::DOUBLE AS c, mid + d::DOUBLE AS d FROM m, (VALUES {_EDGES}) v(a, b, c, d))
SELECT c_custkey, r_regionkey FROM p, e WHERE (a > lat) <> (c > lat) AND lon < (d - b) * (lat - a) / (c - a) + b GROUP BY ALL HAVING count(*) % 2 = 1""")
def point_in_polygon(t):
    at = lambda k: ((F.col("c_custkey") * k) % 1000).cast("double") / 50
    mid = 3 + 3.5 * F.col("r_regionkey")
    ring = F.array(*[F.struct((mid + a).alias("lat"), (mid + b).alias("lon")) for a, b in CORNERS])
    points = t("customer").select("c_custkey", at(37).alias("lat"), at(91).alias("lon"))
    return G.points_in_polygons(points, t("region").select("r_regionkey", ring.alias("ring")), 1.0).select("c_custkey", "r_regionkey")


@query("""WITH w AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS w FROM part),
t AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END)) AS term FROM w) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term ORDER BY sum(c) DESC, term LIMIT 5000), r AS (SELECT id, term, c * (ln((1 + (SELECT count(*) FROM part))::DOUBLE / (1 + df)) + 1) AS w FROM t JOIN f USING (term)),
z AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r), s AS (SELECT q.id AS query_id, z.id AS id, round(sum(q.w * z.w), 6) AS score FROM z q JOIN z USING (term) WHERE q.id % 20 = 0 AND q.id <> z.id GROUP BY q.id, z.id)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 5""")
def tfidf_topk(t):
    return V.tfidf_top_k(V.tfidf(t("part").select("p_partkey", "p_name")), F.col("id") % 20 == 0, 5)
