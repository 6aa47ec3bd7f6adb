"""What a query costs grows no faster than its input: each test fails, by its time or its plan, on the code before."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quartier.operators import evaluation as E
from quartier.operators import geometry as G
from quartier.operators import labeller as L
from quartier.operators import matching as M
from quartier.operators import relational as R
from quartier.operators import retrieval as V
from quartier.operators import tagging as TG
from quartier.plans import scoring  # its queries are registered  # noqa: F401
from quartier.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_are_not_broadcast(spark):
    """segments look like a small table, but are as many as the table's texts."""
    texts = spark.createDataFrame([(1, "Phường 1, Quận 3"), (1, "Phường 1, Quận 3"), (2, "quận 3 ,, x"), (3, None)], "id int, address string")
    units = spark.createDataFrame([("Quận 3", "DST", "Quận 3"), ("Phường 1", "WDS", "Phường 1"), ("3", "DST", "3")], "unit string, level string, name string")
    hits = L.gazetteer_hits(L.segments(texts, "id", "address"), units)
    assert "Broadcast" not in plan(hits)
    got = sorted((r.id, r.i, r.start, r.unit, r.exact) for r in hits.collect())
    assert got == [(1, 1, 0, "Phường 1", True), (1, 2, 10, "3", False), (1, 2, 10, "Quận 3", True), (2, 1, 0, "3", False), (2, 1, 0, "Quận 3", True)]


def python_entities(tags):
    out, start = [], None
    for i, t in enumerate([*tags, None]):
        own, before = ((x[2:] if x not in (None, "O") else "") for x in (t, tags[i - 1] if i else None))
        starts = t not in (None, "O") and (t.startswith("B-") or i == 0 or own != before)
        if start is not None and (starts or own == ""):
            out.append((start, i, tags[start][2:]))
            start = None
        start = i if starts else start
    return out


def test_entities_of_long_arrays(spark):
    """spans of a long array in one pass."""
    kinds = ["B-WDS", "I-WDS", "O", "B-PRO", "I-PRO", "I-WDS", "O", "B-STR", "B-STR", None, "I-NUM"]
    rows = [[kinds[(i * i + n * i // 3) % 11] for i in range(400)] for n in range(4)] + [[], ["I-A"], ["O"], ["B-A", "I-A", "I-B"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    at = time.time()
    got = {r.i: [tuple(x) for x in r.e] for r in df.select("i", E.entities(F.col("t")).alias("e")).collect()}
    assert time.time() - at < 30
    assert got == {i: python_entities(r) for i, r in enumerate(rows)}
    assert spark.sql("SELECT cast(NULL AS array<string>) AS t").select(E.entities(F.col("t")).alias("e")).first().e == []


def test_jaccard_join_of_copies(spark):
    """copies of a set are one class, which is compared once."""
    df = spark.range(3000).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), i)).alias("t")).union(spark.sql("SELECT 5000L, array('w0', 'w1', 'w1') UNION ALL SELECT 5001L, array('w1', 'w0') UNION ALL SELECT 5002L, array('w1', 'w0', 'z') UNION ALL SELECT 5003L, array('z', 'y')"))
    at = time.time()
    got = M.jaccard_join(df, "id", "t", 50).groupBy((F.col("a") >= 5000).alias("other")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("a") >= 5000, F.struct("a", "b"))).alias("p")).collect()
    assert time.time() - at < 40
    assert {r.other: r.n for r in got} == {False: 3000 * 2999 // 2, True: 3}
    assert {tuple(x) for r in got for x in r.p} == {(5000, 5001), (5000, 5002), (5001, 5002)}


def test_equal_addresses_are_labelled_once(spark):
    """spans are worked out on distinct texts with their names, of which nulls are some."""
    text = "12 Lê Lợi, Phường Bến Nghé, Quận 1, Thành phố Hồ Chí Minh"
    rows = [(i, text, "Phường Bến Nghé" if i % 2 else None, "Quận 1", "Thành phố Hồ Chí Minh") for i in range(40)] + [(90, None, "x", "y", "z"), (91, " ", "x", "y", "z")]
    df = spark.createDataFrame(rows, "id int, a string, w string, d string, p string")
    found = L.labelled(df, "id", "a", "w", "d", "p")
    assert "HashAggregate(keys=[__t" in plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add((r.start, r.end, r.label, r.span))
    assert set(got) == set(range(40)) and all(got[i] == got[i % 2] for i in range(40))
    assert {(k, text[s:e]) for s, e, k, _ in got[1]} >= {("WDS", "Phường Bến Nghé"), ("DST", "Quận 1"), ("PRO", "Thành phố Hồ Chí Minh"), ("STR", "Lê Lợi"), ("NUM", "12")}


def test_weak_tags_of_long_texts(spark):
    """words are split once, not again for each place and label."""
    text = " ".join(f"Từ{i}" for i in range(1500)) + " Quận Ba"
    df = spark.range(40).select(F.lit(text).alias("t"), F.create_map(F.lit("DST"), F.lit("quận ba"), F.lit("STR"), F.lit("từ7 TỪ8 từ9"), F.lit("PRO"), F.lit("nowhere")).alias("c"))
    at = time.time()
    got = [r.x for r in df.select(TG.weak_tags(F.col("t"), F.col("c")).alias("x")).collect()]
    assert time.time() - at < 30
    want = ["O"] * 1502
    want[7:10], want[1500:] = ["B-STR", "I-STR", "I-STR"], ["B-DST", "I-DST"]
    assert got == [want] * 40


def test_first_spans_of_many_labels(spark):
    """spans are found once, not again for each label."""
    n = 240
    df = spark.range(8).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.when(i % 2 == 0, "B-L").otherwise("I-L"), F.floor(i / 2) % 60)).alias("t"))
    at = time.time()
    got = [r.m for r in df.select(TG.first_spans(F.transform("t", lambda t, i: i.cast("string")), E.entities(F.col("t"))).alias("m")).collect()]
    assert time.time() - at < 30
    assert got == [{f"L{i}": f"{2 * i} {2 * i + 1}" for i in range(60)}] * 8


def test_token_labels_of_long_texts(spark):
    """F16: a token's word is looked for once."""
    words = 150
    text = " ".join(["abcdefghi"] * words)
    span = F.array(F.struct(F.lit(10).alias("start"), F.lit(29).alias("end"), F.lit("WDS").alias("label")))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(6), F.lit(3)), lambda i: F.struct((w * 10 + i).alias("start"), (w * 10 + i + 3).alias("end")))))
    df = spark.range(20).select(F.lit(text).alias("t"), pieces.alias("k"))
    at = time.time()
    got = [r.x for r in df.select(TG.token_labels(F.col("t"), span, F.col("k"), ["O", "B-WDS", "I-WDS"]).alias("x")).collect()]
    assert time.time() - at < 30
    assert got == [[x for w in range(words) for x in ({1: 1, 2: 2}.get(w, 0), -100, -100)]] * 20


def test_fulltext_rank_of_copies(spark):
    """queries of equal words are asked once, and of equal documents the first k take part."""
    docs = spark.range(40_000).select("id", F.lit("blue ring large").alias("text"))
    queries = spark.range(0, 40_000, 4).select(F.col("id").alias("query_id"), F.lit("Large, ring").alias("text"))
    at = time.time()
    got = V.fulltext_rank(docs, queries, 3).groupBy("id", "score", "rank").count().orderBy("rank").collect()
    assert time.time() - at < 30
    assert [tuple(r) for r in got] == [(i, 0.666667, i + 1, 10_000) for i in range(3)]


def test_sparse_top_k_of_copies(spark):
    """Equal vectors cost once, and each query still has its k others by id."""
    rows = [(i, [0, 1], [1.0, 2.0]) for i in range(5)] + [(9, [1], [3.0]), (10, [5], [1.0])]
    v = spark.createDataFrame(rows, "id long, at array<int>, v array<double>")
    got = V.tfidf_top_k(v, F.col("id") % 2 == 0, 2, 10).collect()
    assert "[at" in plan(V.tfidf_top_k(v, F.col("id") % 2 == 0, 2, 10))
    want = V.block_top_k(v, v.filter("id % 2 = 0"), 2, 10, 1e-6).collect()
    key = lambda found: sorted((r.query_id, r.id, r.score, r.rank) for r in found)
    assert key(got) == key(want) and {(r.query_id, r.id) for r in got} == {(0, 1), (0, 2), (2, 0), (2, 1), (4, 0), (4, 1)}


def test_few_names_with_many_rows_are_dealt(spark):
    """rows of one name and parent go to many tasks, and what texts hold is judged once for each distinct one."""
    a = spark.range(400).select("id", F.lit("x").alias("name"), F.when(F.col("id") % 4 == 0, "tp bình dương").when(F.col("id") % 4 == 1, None).otherwise("hà nội").alias("province"))
    m = spark.createDataFrame([(i, "x", "bình" if i % 2 else "nội") for i in range(10)] + [(99, None, "nội"), (98, "x", None)], "row_id int, name string, part string")
    found = R.agreeing_and_holding(a, m, "name", "province", "part", "id")
    assert "__deal" in plan(found)
    got = {(r.id, r.row_id) for r in found.collect()}
    assert got == {(i, j) for i in range(400) for j in range(10) if (j % 2 and i % 4 == 0) or (not j % 2 and i % 4 in (2, 3))} and found.count() == len(got)


def test_nearest_among_dense_places(spark):
    """the radius grows in rounds, and no round's choice differs from that of all places."""
    spot = lambda n, k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) / 10).cast("double")
    places = spark.range(20_000).select(F.col("id").alias("q"), spot(97, 1).alias("lat"), spot(211, 2).alias("lon")).union(spark.sql("SELECT 50000L, 60.0D, 179.9D"))
    points = spark.range(20_000).select(F.col("id").alias("p"), (spot(97, 3) + 0.03).alias("lat"), spot(211, 4).alias("lon")).union(spark.sql("SELECT 70000L, 60.0D, -179.9D UNION ALL SELECT 70001L, -80.0D, 0.0D UNION ALL SELECT 70002L, NULL, 0.0D"))
    at = time.time()
    got = {r.p: (r.q, r.km) for r in G.nearest(points, places, "p", "q", 5.0, 800.0).collect()}
    assert time.time() - at < 60
    assert len(got) == 20_001 and got[70000][0] == 50000
    known = {}
    for r in places.collect():
        known[(r.lat, r.lon)] = min(r.q, known.get((r.lat, r.lon), r.q))
    some = points.filter("p % 500 = 0 AND p < 20000").collect()
    for r in some:
        far = lambda lat, lon: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(lat - r.lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(r.lat)) * math.sin(math.radians(lon - r.lon) / 2) ** 2))  # noqa: E731, B023
        km, q = min((round(far(*s), 9), q) for s, q in known.items())
        assert got[r.p] == (q, pytest.approx(km, abs=1e-6))
    own = G.nearest(places.limit(300), places.limit(300).withColumnRenamed("q", "o"), "q", "o", 5.0, 800.0, other=True).collect()
    assert len(own) == 300 and all(r.q != r.o for r in own)


def test_ratio_of_equal_pairs_once(spark):
    """pairs of texts are told apart first, nulls included."""
    df = spark.createDataFrame([(i, "abcd" if i % 2 else None, "abce") for i in range(50)], "i int, a string, b string")
    found = M.with_ratio(df, "a", "b")
    assert "HashAggregate(keys=[a" in plan(found)
    assert {r.i: r.ratio for r in found.collect()} == {i: 0.75 if i % 2 else 0.0 for i in range(50)}


def test_what_a_search_holds_is_bounded():
    """passes hold as many candidates however many queries there are, and dense vectors keep no places."""
    for n, k in ((1, 50), (30_000, 50), (1_000_000, 5), (3, 10_000_000)):
        passes = V.passes_of(n, k)
        assert -(-n // passes) * k <= max(V.CANDIDATES // 4, k) * 1.01
    assert V._Vectors(np.arange(3), np.full(3, 2), np.ones(6)).row is None


def test_trigram_top1_of_copies(spark):
    """copies of a name are looked up once, and each finds the least other id."""
    names = spark.range(6000).select("id", F.concat(F.lit("Supplier#00000000"), F.col("id") % 3).alias("n"))
    at = time.time()
    got = M.trigram_top1(names, names).groupBy(F.col("match"), "score").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).collect()
    assert time.time() - at < 45
    assert {(r.match, r.score, r.n) for r in got} == {(m, 1.0, 1999) for m in range(3)} | {(m, 1.0, 1) for m in range(3, 6)}


def best_by_trigrams(left, right):
    """(match, score) of each left (id, version, name), by comparing all names."""
    grams = lambda x: {f"  {x.lower()} "[i : i + 3] for i in range(len(x) + 1)}
    own, want = [(j, w, grams(m)) for j, w, m in right], {}
    for i, v, n in left:
        g = grams(n)
        scored = [(-round(len(g & h) / len(g | h), 6), j) for j, w, h in own if w == v and j != i and g & h]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    return want


def test_trigram_top1_of_different_names(spark):
    """F1 of round 4: names that differ in a digit only share most of their trigrams with all others, and meet by several of the rare ones at once."""
    names = spark.range(6000).select("id", F.format_string("Supplier#%06d", "id").alias("n"))
    at = time.time()
    got = {r.id: (r.match, r.score) for r in M.trigram_top1(names, names).collect()}
    assert time.time() - at < 60
    rows = [(i, 0, f"Supplier#{i:06d}") for i in range(6000)]
    assert len(got) == 6000 and {i: got[i] for i in range(0, 6000, 97)} == best_by_trigrams(rows[::97], rows)


@pytest.mark.parametrize("together", (1, 2, 3))
def test_trigram_top1_by_several_trigrams(spark, monkeypatch, together):
    """F1 of round 4: names that meet by several trigrams at once are those that single ones find, short ones included."""
    r = random.Random(31)
    base = ["".join(r.choices("abcdeđ ", k=r.randint(1, 16))) for _ in range(50)]
    vary = lambda x: "".join(c if r.random() > 0.15 else r.choice("abcxyz") for c in x)
    left = [(i, i % 2, vary(r.choice(base))) for i in range(150)] + [(500, 1, ""), (501, 0, "日本")]
    right = [(1000 + i, i % 2, vary(x)) for i, x in enumerate(base * 3)] + [(7, 1, left[7][2]), (2000, 0, base[0]), (2001, 0, base[0]), (2001, 0, base[1])]
    for name, value in (("PAIRS", -1), ("PAIRS_EACH", 0), ("ENTRY", 0), ("TOGETHER", together)):
        monkeypatch.setattr(M, name, value)
    schema = "id int, v int, n string"
    got = M.trigram_top1(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), (0.8, 0.5, 0.25, 0.0)).collect()
    want = best_by_trigrams(left, right)
    assert {x.id: (x.match, x.score) for x in got} == want and len(got) == len(want)


def test_retrieval_metrics_of_all_rows(spark, sf_dir):
    """F2 of round 4: every row is a query."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert QUERIES["retrieval_metrics"](spark, sf_dir).first().n_queries == embeddings.count()


def nearest_of_all(rows, k):
    """(id, score) of the k best rows of other ids for each id, by comparing all rows."""
    v = np.array([x for _, x in rows])
    n = np.linalg.norm(v, axis=1)
    v = v / np.where(n > 0, n, 1)[:, None]
    score, want = np.round(v @ v.T, 6) + 0.0, {}
    for at, (i, _) in enumerate(rows):
        want.setdefault(i, []).extend((-score[at, b], j) for b, (j, _) in enumerate(rows) if j != i)
    return {i: [(j, -s) for s, j in sorted(x)[:k]] for i, x in want.items()}


def odd_vectors():
    """Vectors of which many are equal, some zero, and some of one id."""
    r = random.Random(17)
    rows = [(i, [float(r.choice((-1, 0, 0, 1, 2))) for _ in range(3)]) for i in range(160)]
    rows += [(200 + i, [r.gauss(0, 1) for _ in range(3)]) for i in range(90)]
    return [*rows, (5, [0.5, -3.0, 1.0]), (210, rows[210][1]), (7, rows[8][1]), (400, [0.0] * 3)]


def test_all_top_k(spark, monkeypatch):
    """F2 of round 4: all rows against all, parts by parts, finds what comparing all rows finds, and neither side is broadcast."""
    assert V.parts_of(612_000, 12) == 19 and V.parts_of(500, 12) == 1
    rows = odd_vectors()
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for part in (1 << 16, 37):
        monkeypatch.setattr(V, "PART", part)
        df = V.all_top_k(v, 4)
        assert "Broadcast" not in plan(df)
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == nearest_of_all(rows, 4)
    assert V.all_top_k(v.limit(0), 4).count() == 0 and V.all_top_k(v.filter("id = 5").limit(1), 4).count() == 0


def test_parts_meet_in_blocks(monkeypatch):
    """F2 of round 4: blocks of products, of a part in itself and of two parts, keep the same best rows, whichever way they are looked at."""
    monkeypatch.setattr(V, "NEAR", 9)
    r = np.random.default_rng(5)
    v = np.round(r.standard_normal((70, 4)), 1)
    table = pa.table({"c": np.arange(70), "id": np.arange(70), "v": list(v), "asked": np.arange(70) % 3 > 0})
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.round(unit @ unit.T, 6) + 0.0

    def best(queries, rows):
        return {(c, j, score[c, j]) for c in queries if c % 3 for j in sorted(rows, key=lambda j: (-score[c, j], j))[:5]}

    found = lambda *t: {(c, i, s) for c, i, s in zip(*(x.to_pylist() for x in V._near(*t, k=5).columns), strict=True)}
    assert found(table) == best(range(70), range(70))
    assert found(table.slice(0, 25), table.slice(25)) == best(range(25), range(25, 70)) | best(range(25, 70), range(25))
    assert found(table.slice(0, 3), table.slice(3)) == best(range(3), range(3, 70)) | best(range(3, 70), range(3))
