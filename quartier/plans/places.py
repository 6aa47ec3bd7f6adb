"""Queries of geometry, retrieval, sampling and tagging, each with its SQL where there is one.

Points, polygons and tags are made up from keys by the same arithmetic in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.operators import evaluation as E
from quartier.operators import geometry as G
from quartier.operators import matching as M
from quartier.operators import relational as R
from quartier.operators import retrieval as V
from quartier.operators import sampling as S
from quartier.plans.queries import query

POINTS = "SELECT c_custkey AS point, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE (c_custkey * 37 % 2000)::DOUBLE / 100 + 0.003 END AS lat, (c_custkey * 91 % 2000)::DOUBLE / 100 + 0.004 AS lon, c_nationkey % 16 AS unit FROM customer"
#: Sixteen squares of 4.99 by 4.99 degrees with narrow gaps between, as segments with their lower corner.
UNITS = "SELECT n_nationkey AS unit, 5.0::DOUBLE * (n_nationkey // 4) AS y, 5.0::DOUBLE * (n_nationkey % 4) AS x FROM nation WHERE n_nationkey < 16"
SEGMENTS = "SELECT unit, y + 4.99::DOUBLE * a AS y1, x + 4.99::DOUBLE * b AS x1, y + 4.99::DOUBLE * c AS y2, x + 4.99::DOUBLE * d AS x2 FROM u, (VALUES (0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0)) AS s(a, b, c, d)"
DISTANCE = "SELECT point, unit, min(sqrt(pow(lat - y1 - t * (y2 - y1), 2) + pow(lon - x1 - t * (x2 - x1), 2))) AS d FROM (SELECT p.point, s.*, lat, lon, greatest(0.0, least(1.0, ((lat - y1) * (y2 - y1) + (lon - x1) * (x2 - x1)) / (pow(y2 - y1, 2) + pow(x2 - x1, 2)))) AS t FROM p, s WHERE lat IS NOT NULL) GROUP BY point, unit"
BASE = f"p AS ({POINTS}), u AS ({UNITS}), s AS ({SEGMENTS}), d AS ({DISTANCE}), i AS (SELECT point, u.unit AS found FROM p JOIN u ON lat > y AND lat < y + 4.99 AND lon > x AND lon < x + 4.99)"


def points(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("point"), F.when(k % 41 != 0, (k * 37 % 2000).cast("double") / 100 + 0.003).alias("lat"), ((k * 91 % 2000).cast("double") / 100 + 0.004).alias("lon"), (F.col("c_nationkey") % 16).alias("unit"))


def units(t):
    n = t("nation").filter("n_nationkey < 16").select(F.col("n_nationkey").alias("unit"), (F.floor(F.col("n_nationkey") / 4) * 5.0).alias("y"), ((F.col("n_nationkey") % 4) * 5.0).alias("x"))
    vertex = lambda a, b: F.struct((F.col("y") + 4.99 * a).alias("lat"), (F.col("x") + 4.99 * b).alias("lon"))
    return n.select("unit", F.array(vertex(0, 0), vertex(0, 1), vertex(1, 1), vertex(1, 0)).alias("ring"))


def located(t):
    return points(t).filter("lat IS NOT NULL").select("point", "lat", "lon")


@query(f"WITH {BASE} SELECT point, round(min(d), 6) AS degrees FROM d WHERE d <= 0.3 GROUP BY point")
def boundary_distance(t):
    return G.boundary_distances(located(t), units(t), "point", 1.0, 0.3).withColumn("degrees", F.round("degrees", 6))


@query(f"""WITH {BASE}, n AS (SELECT d.point, d.unit, CASE WHEN i.found IS NOT NULL THEN 0.0 ELSE d END AS w FROM d LEFT JOIN i ON i.point = d.point AND i.found = d.unit), b AS (SELECT n.point, n.unit, CASE WHEN w <= 0.0005 THEN 0.0005 WHEN w <= 0.0035 THEN 0.0035 ELSE 0.02 END::DOUBLE AS buffer, pow(lat - y - 2.495, 2) + pow(lon - x - 2.495, 2) AS far FROM n JOIN p USING (point) JOIN u ON u.unit = n.unit WHERE w <= 0.02)
SELECT point, unit, buffer FROM b QUALIFY row_number() OVER (PARTITION BY point ORDER BY buffer, round(far, 9), unit) = 1""")
def adaptive_buffer(t):
    return G.adaptive_buffer(located(t), units(t), "point", "unit", 1.0, (0.0005, 0.0035, 0.02))


EDGES = "e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 16 AS b FROM nation WHERE n_nationkey < 16), h AS (SELECT a AS id, b AS other FROM e UNION SELECT b, a FROM e)"
KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


def edges(t):
    return t("nation").filter("n_nationkey < 16").select(F.col("n_nationkey").alias("from_id"), ((F.col("n_nationkey") + 1) % 16).alias("to_id"))


def centroids(t):
    return units(t).select("unit", G.vertex_mean(F.col("ring")).alias("c")).select("unit", "c.*")


@query(f"""WITH {BASE}, {EDGES}, c AS (SELECT unit, y + 2.495::DOUBLE AS lat, x + 2.495::DOUBLE AS lon FROM u), k AS (SELECT p.point, c.unit, round({KM.format(a="p", b="c")}, 6) AS km FROM p JOIN h ON h.id = p.unit JOIN c ON c.unit = h.other)
SELECT point, unit, km FROM k WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, unit) = 1""")
def nearest_neighbour_unit(t):
    return G.nearest_neighbour(points(t).filter("lat IS NOT NULL"), centroids(t), edges(t), "point", 400.0)


@query(f"""WITH p AS (SELECT c_custkey AS point, (c_custkey * 37 % 1200)::DOUBLE / 10 - 60 AS lat, (c_custkey * 91 % 3400)::DOUBLE / 10 - 170 AS lon FROM customer), q AS (SELECT s_suppkey AS place, (s_suppkey * 53 % 1200)::DOUBLE / 10 - 60 AS lat, (s_suppkey * 71 % 3400)::DOUBLE / 10 - 170 AS lon FROM supplier),
k AS (SELECT point, place, {KM.format(a="p", b="q")} AS km FROM p, q) SELECT point, place, round(km, 4) AS km FROM k WHERE km <= 800 QUALIFY row_number() OVER (PARTITION BY point ORDER BY round(km, 9), place) = 1""")
def nearest_place(t):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = t("customer").select(k.alias("point"), ((k * 37 % 1200).cast("double") / 10 - 60).alias("lat"), ((k * 91 % 3400).cast("double") / 10 - 170).alias("lon"))
    q = t("supplier").select(s.alias("place"), ((s * 53 % 1200).cast("double") / 10 - 60).alias("lat"), ((s * 71 % 3400).cast("double") / 10 - 170).alias("lon"))
    return G.nearest(p, q, "point", "place", 5.0, 800.0).withColumn("km", F.round("km", 4))


MISMATCH = f"""WITH {BASE}, {EDGES}, c AS (SELECT unit, y + 2.495::DOUBLE AS lat, x + 2.495::DOUBLE AS lon FROM u), f AS (SELECT point, min(found) AS found FROM i GROUP BY point),
r AS (SELECT p.*, found, CASE WHEN lat IS NULL THEN 'bad' WHEN found IS NULL THEN 'undetected' WHEN found = unit THEN 'matched' ELSE 'mismatched' END AS status FROM p LEFT JOIN f USING (point)),
n AS (SELECT d.point, d.unit, CASE WHEN i.found IS NOT NULL THEN 0.0 ELSE d END AS w FROM d LEFT JOIN i ON i.point = d.point AND i.found = d.unit), b AS (SELECT n.point, n.unit, CASE WHEN w <= 0.0005 THEN 1 WHEN w <= 0.0015 THEN 2 ELSE 3 END AS buffer, pow(lat - y - 2.495, 2) + pow(lon - x - 2.495, 2) AS far FROM n JOIN p USING (point) JOIN u ON u.unit = n.unit WHERE w <= 0.005),
bb AS (SELECT point, unit AS by_buffer FROM b QUALIFY row_number() OVER (PARTITION BY point ORDER BY buffer, round(far, 9), unit) = 1),
k AS (SELECT p.point, c.unit, round({KM.format(a="p", b="c")}, 6) AS km FROM p JOIN h ON h.id = p.unit JOIN c ON c.unit = h.other WHERE p.lat IS NOT NULL), kk AS (SELECT point, unit AS by_neighbour FROM k WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, unit) = 1),
m AS (SELECT r.point, r.unit, found, status, CASE WHEN status IN ('undetected', 'mismatched') THEN coalesce(by_buffer, by_neighbour) END AS corrected FROM r LEFT JOIN bb USING (point) LEFT JOIN kk USING (point))"""


def mismatch(t):
    return G.spatial_mismatch(points(t), units(t), centroids(t), edges(t), "point", 1.0, km=400.0)


@query(f"{MISMATCH} SELECT point, unit, found, status, corrected FROM m")
def spatial_mismatch(t):
    return mismatch(t)


@query(f"""{MISMATCH}, z AS (SELECT count(*) AS n_points, count(*) FILTER (WHERE status = 'bad') AS n_bad, count(*) FILTER (WHERE status = 'matched') AS n_matched, count(*) FILTER (WHERE status = 'mismatched') AS n_mismatched, count(*) FILTER (WHERE status = 'undetected') AS n_undetected, count(corrected) AS n_corrected, count(*) FILTER (WHERE status IN ('undetected', 'mismatched') AND corrected IS NULL) AS n_uncorrectable FROM m)
SELECT *, round(n_matched::DOUBLE / (n_points - n_bad), 4) AS accuracy, round(n_corrected::DOUBLE / (n_mismatched + n_undetected), 4) AS correction_rate FROM z""")
def mismatch_summary(t):
    return G.mismatch_summary(mismatch(t))


@query("""WITH g AS (SELECT n_nationkey AS unit, n_nationkey * 1.5::DOUBLE AS y, 100 + n_nationkey % 10 AS x FROM nation) SELECT unit, 2 AS n_rings, round((y + y + (y + 1) + y) / 4, 6) AS lat, round((x + (x + 1) + (x + 1) + x) / 4, 6) AS lon, unit % 3 = 0 AS centre_inside FROM g""")
def geojson_rings(t):
    """Triangles closed by their first vertex, in either order of coordinates, with a hole around the middle in two of three."""
    y, x = F.col("n_nationkey") * 1.5, 100 + F.col("n_nationkey") % 10
    swap = F.col("n_nationkey") % 2 == 0

    def vertex(dy: float, dx: float):
        return F.when(swap, F.concat(F.lit("["), y + dy, F.lit(","), x + dx, F.lit("]"))).otherwise(F.concat(F.lit("["), x + dx, F.lit(","), y + dy, F.lit("]")))

    def ring(*of):
        return F.concat(F.lit("["), F.concat_ws(",", *[vertex(*v) for v in of]), F.lit("]"))

    hole = F.when(F.col("n_nationkey") % 3 == 0, ring((0.05, 0.9), (0.06, 0.9), (0.06, 0.91), (0.05, 0.9))).otherwise(ring((0.2, 0.6), (0.2, 0.8), (0.4, 0.7), (0.2, 0.6)))
    g = t("nation").select(F.col("n_nationkey").alias("unit"), y.alias("y"), x.alias("x"), G.rings(F.concat(F.lit('{"type":"Polygon","coordinates":['), ring((0, 0), (0, 1), (1, 1), (0, 0)), F.lit(","), hole, F.lit("]}"))).alias("rings"))
    centre = G.vertex_mean(F.get("rings", F.lit(0)))
    return g.select("unit", F.size("rings").alias("n_rings"), F.round(centre["lat"], 6).alias("lat"), F.round(centre["lon"], 6).alias("lon"), G.inside_rings(F.col("y") + 0.25, F.col("x") + 0.7, F.col("rings")).alias("centre_inside"))


@query(None)
def concave_hulls(t):
    """Tested: all points inside, no edge crosses another, the share kept."""
    return G.concave_hulls(points(t), "unit", 0.8)


@query(None)
def mismatch_with_hulls(t):
    """The corrections with the step of hulls between; tested on a few points."""
    return G.spatial_mismatch(points(t), units(t), centroids(t), edges(t), "point", 1.0, km=400.0, hull_share=0.9)


@query("""WITH k AS (SELECT c_custkey AS point, (c_custkey * 37 % 2000)::DOUBLE / 100 + 0.003 AS lat, (c_custkey * 91 % 2000)::DOUBLE / 100 + 0.004 AS lon FROM customer), u AS (SELECT n_nationkey AS unit, n_nationkey % 5 * 4 AS y, n_nationkey // 5 * 4 AS x FROM nation)
SELECT point, unit FROM k JOIN u ON (lat > y AND lat < y + 2 AND lon > x AND lon < x + 2 AND NOT (lat > y + 0.5 AND lat < y + 1 AND lon > x + 0.5 AND lon < x + 1.5)) OR (lat > y + 2.5 AND lat < y + 3.5 AND lon > x + 2.5 AND lon < x + 3.75) OR (unit = 7 AND lat > 0 AND lat < 20 AND lon > 18 AND lon < 19)""")
def points_in_multipolygons(t):
    """MultiPolygons of two parts, the first with a hole; one unit has a third part that is large."""
    y, x = F.col("n_nationkey") % 5 * 4, F.floor(F.col("n_nationkey") / 5) * 4

    def box(y0, x0, y1, x1):
        corner = lambda b, a: F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]"))
        return F.concat(F.lit("["), F.concat_ws(",", corner(y0, x0), corner(y0, x1), corner(y1, x1), corner(y1, x0), corner(y0, x0)), F.lit("]"))

    parts = [F.concat(F.lit("["), box(y, x, y + 2, x + 2), F.lit(","), box(y + 0.5, x + 0.5, y + 1.0, x + 1.5), F.lit("]")), F.concat(F.lit("["), box(y + 2.5, x + 2.5, y + 3.5, x + 3.75), F.lit("]"))]
    parts.append(F.when(F.col("n_nationkey") == 7, F.concat(F.lit("["), box(F.lit(0), F.lit(18), F.lit(20), F.lit(19)), F.lit("]"))))
    json = F.concat(F.lit('{"type": "MultiPolygon", "coordinates": ['), F.concat_ws(",", *parts), F.lit("]}"))
    return G.points_in_polygons(located_all(t), t("nation").select(F.col("n_nationkey").alias("unit"), G.rings(json).alias("rings")), 0.5).select("point", "unit")


def located_all(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("point"), ((k * 37 % 2000).cast("double") / 100 + 0.003).alias("lat"), ((k * 91 % 2000).cast("double") / 100 + 0.004).alias("lon"))


@query(None)
def convex_hulls(t):
    """Tested against a brute-force hull."""
    return G.convex_hulls(points(t), "unit")


TOKENS = 4


LATE = f"""t AS (SELECT query_id, vec_id, i, max(list_cosine_similarity(q[i * 8 + 1:i * 8 + 8], e[j * 8 + 1:j * 8 + 8])) AS m FROM pairs, range(0, {TOKENS}) AS a(i), range(0, {TOKENS}) AS b(j) GROUP BY ALL),
late AS (SELECT query_id, vec_id, round(sum(m), 6) AS late FROM t GROUP BY ALL)"""


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (SELECT x.vec_id AS query_id, x.e AS q, v.vec_id, v.e FROM v x JOIN v ON x.vec_id <> v.vec_id WHERE x.vec_id % 20 = 0), {LATE}
SELECT query_id, vec_id, late AS score FROM late QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late DESC, vec_id) <= 3""")
def maxsim_topk(t):
    v = t("embeddings").select("vec_id", F.slice("embedding", 1, TOKENS * 8).alias("embedding"))
    return V.block_top_k(v, v.filter("vec_id % 20 = 0"), 3, tokens=TOKENS).select("query_id", F.col("id").alias("vec_id"), "score")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT x.vec_id AS query_id, v.vec_id, x.e AS q, v.e, round(list_cosine_similarity(x.e, v.e), 6) AS score FROM v x JOIN v ON x.vec_id <> v.vec_id WHERE x.vec_id % 20 = 0),
pairs AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50), {LATE},
c AS (SELECT query_id, vec_id, late, row_number() OVER (PARTITION BY query_id ORDER BY late DESC, vec_id)::INTEGER AS rank FROM late QUALIFY rank <= 3) SELECT query_id, vec_id, late, rank, rank = 1 AND late < 3.2 AS needs_model FROM c""")
def cascade_topk(t):
    """The 50 nearest by cosine, of which late interaction keeps three."""
    v = t("embeddings").select("vec_id", "embedding")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.slice(F.transform("embedding", lambda x: x.cast("double")), i * 8 + 1, 8))
    top = V.top_k(v, v.filter("vec_id % 20 = 0"), 50).select("query_id", F.col("vec_id").alias("id"), "score")
    d = v.select(F.col("vec_id").alias("id"), tokens.alias("d"))
    both = top.join(d, "id").join(d.toDF("query_id", "q"), "query_id")
    rescored = both.withColumn("late", F.round(V.max_similarity(F.col("q"), F.col("d")), 6))
    return V.cascade(rescored, {"late": 3}, 3.2).select("query_id", F.col("id").alias("vec_id"), "late", "rank", "needs_model")


WORDS = r"list_filter(string_split(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, list_distinct({WORDS.format(x="p_type")}) AS w FROM part WHERE p_partkey % 20 = 0), d AS (SELECT p_partkey AS id, {WORDS.format(x="p_name || ' ' || p_type")} AS w FROM part),
s AS (SELECT query_id, id, round(len(list_filter(d.w, lambda x: list_contains(q.w, x)))::DOUBLE / len(d.w), 6) AS score FROM q JOIN d ON len(list_intersect(q.w, d.w)) = len(q.w) WHERE len(q.w) > 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def fulltext_rank(t):
    p = t("part")
    docs = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    return V.fulltext_rank(docs, p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("text")), 5)


QUOTA = "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 40 = 0 THEN 'D1' WHEN event_type = 'view' THEN 'D2' WHEN event_type = 'purchase' THEN 'D3' ELSE 'D4' END AS stratum, md5(event_id || ':11') AS m FROM events"


@query(f"""WITH e AS ({QUOTA}), p AS (SELECT event_id, stratum, m FROM e QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY m, event_id) <= CASE stratum WHEN 'D1' THEN 80 WHEN 'D2' THEN 40 WHEN 'D3' THEN 60 ELSE 20 END),
f AS (SELECT event_id, 'D2' AS stratum, m FROM e WHERE event_id NOT IN (SELECT event_id FROM p) ORDER BY m, event_id LIMIT 200 - (SELECT count(*) FROM p)) SELECT event_id, stratum FROM p UNION ALL SELECT event_id, stratum FROM f""")
def quota_sample_backfill(t):
    e = t("events").select("event_id", F.when((F.col("event_type") == "click") & (F.col("user_id") % 40 == 0), "D1").when(F.col("event_type") == "view", "D2").when(F.col("event_type") == "purchase", "D3").otherwise("D4").alias("stratum"))
    return S.quota_sample(e, "event_id", "stratum", 200, (("D1", 0.4), ("D2", 0.2), ("D3", 0.3), ("D4", 0.1)), 11, "D2")


@query(None)
def random_sample_fast(t):
    """A random sample: its size and that its rows are rows of the table are tested."""
    return S.escalating_sample(t("orders").select("o_orderkey"), 100, 42)


TAGS = ("B-WDS", "I-WDS", "O", "B-PRO", "I-PRO", "I-WDS", "O", "B-STR", "B-STR", "O", "I-NUM")


@query(f"""WITH x AS (SELECT p_partkey, i, (list_value({", ".join(f"'{x}'" for x in TAGS)}))[1 + (p_partkey * 3 + i) % {len(TAGS)}] AS g, (list_value({", ".join(f"'{x}'" for x in TAGS)}))[1 + (p_partkey * 3 + i + CASE WHEN p_partkey % 4 = 0 AND i % 3 = 0 THEN 1 ELSE 0 END) % {len(TAGS)}] AS p FROM part, range(0, 12) AS r(i)),
l AS (SELECT p_partkey, i, 'g' AS s, g AS t FROM x UNION ALL SELECT p_partkey, i, 'p', p FROM x), k AS (SELECT *, substr(t, 3) AS label, lag(CASE WHEN t = 'O' THEN '' ELSE substr(t, 3) END) OVER w AS before FROM l WINDOW w AS (PARTITION BY p_partkey, s ORDER BY i)),
b AS (SELECT *, t <> 'O' AND (starts_with(t, 'B-') OR before IS NULL OR before <> label) AS starts FROM k), n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY p_partkey, s ORDER BY i) AS e FROM b WHERE t <> 'O'),
e AS (SELECT s, p_partkey, min(i) AS a, max(i) AS z, min(label) AS label FROM n GROUP BY s, p_partkey, e), h AS (SELECT count(*) AS hit FROM e a JOIN e b ON a.s = 'g' AND b.s = 'p' AND a.p_partkey = b.p_partkey AND a.a = b.a AND a.z = b.z AND a.label = b.label), c AS (SELECT count(*) FILTER (WHERE s = 'g') AS gold, count(*) FILTER (WHERE s = 'p') AS pred FROM e)
SELECT (SELECT count(*) FROM x) AS n_tokens, round((SELECT count(*) FILTER (WHERE g = p) FROM x)::DOUBLE / (SELECT count(*) FROM x), 6) AS token_accuracy, round(hit::DOUBLE / pred, 6) AS precision, round(hit::DOUBLE / gold, 6) AS recall, round(2 * hit::DOUBLE / (pred + gold), 6) AS f1 FROM h, c""")
def entity_f1(t):
    k, tags = F.col("p_partkey"), F.array(*map(F.lit, TAGS))
    gold = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(tags, (1 + (k * 3 + i) % len(TAGS)).cast("int")))
    pred = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(tags, (1 + (k * 3 + i + F.when((k % 4 == 0) & (i % 3 == 0), 1).otherwise(0)) % len(TAGS)).cast("int")))
    return E.tagging_scores(R.spread(t("part").select("p_partkey"), "p_partkey").select(gold.alias("gold"), pred.alias("pred")), "gold", "pred")


@query("""WITH a AS (SELECT p_partkey, p_name || ', ' || p_name || ' ' || p_brand AS text FROM part) SELECT p_partkey, 0 AS start, length(split_part(text, ',', 1)) AS "end", 'A' AS label FROM a UNION ALL SELECT p_partkey, instr(text, ', ') + 1, instr(text, ', ') + 1 + length(split_part(text, ',', 1)), 'B' FROM a UNION ALL SELECT a.p_partkey, length(text) - length(p_brand), length(text), 'C' FROM a JOIN part USING (p_partkey)""")
def free_occurrences(t):
    """The same name twice: each takes the first place that is still free; what doesn't stand in the text has none."""
    p = t("part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_name", F.lit(" "), "p_brand").alias("text"), "p_name", "p_brand")
    items = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).alias("text")) for label, c in (("A", "p_name"), ("B", "p_name"), ("D", "p_name"), ("C", "p_brand"))])
    return p.select("p_partkey", F.inline(M.free_occurrences(F.col("text"), items))).select("p_partkey", "start", "end", "label")


@query(None)
def best_candidates(t):
    """SequenceMatcher has no SQL: tested against difflib."""
    p = t("part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    c = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array("p_type", F.concat("p_brand", F.lit(" "), F.substring("p_name", 3, 30)))).alias("candidate"))
    return M.best_candidate(q, c)
