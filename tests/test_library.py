"""Operators on small hand-made tables: nulls, ties, empty tables, and cases that the registered queries' tables don't have."""

import math
import random
from datetime import datetime
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quartier.functions import fonts
from quartier.functions import normalize as N
from quartier.functions import parse as P
from quartier.functions import text as X
from quartier.operators import admin as AD
from quartier.operators import corpus as CO
from quartier.operators import evaluation as E
from quartier.operators import geometry as G
from quartier.operators import matching as M
from quartier.operators import mutations as MU
from quartier.operators import pipelines as PL
from quartier.operators import relational as R
from quartier.operators import ivf as IVF
from quartier.operators import retrieval as V
from quartier.operators import sampling as S
from quartier.operators import tagging as TG
from quartier.plans import addresses as A
from quartier.plans import labels, master, places  # these register their queries  # noqa: F401
from quartier.plans.queries import QUERIES
from quartier.sources import tables as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row.x


STRINGS = ["Nguyễn Huệ", "Đường  LÊ LỢI, P.5", "Thị trấn Ea Súp", unicodedata.normalize("NFD", "Phường Đống Đa"), "ý Yên xã VII", "", "  ", "tp. Hồ Chí Minh", "x–y_z 12", "Ærø"]


def test_normalizers_against_python(spark):
    def metric(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s.lower().strip()) if unicodedata.category(c) != "Mn")
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()

    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    c = F.col("s")
    for r in df.select("s", N.metric_text(c).alias("metric"), N.exact_text(c).alias("exact"), N.label_text(c).alias("label"), N.comparable(c).alias("comparable")).collect():
        assert r.metric == metric(r.s)
        assert r.exact == re.sub(r"\s+", " ", unicodedata.normalize("NFC", r.s.strip()))
        assert r.label == unicodedata.normalize("NFC", r.s.strip()).lower()
        assert r.comparable == " ".join(r.s.lower().split()).rstrip(", ")
    nulls = spark.createDataFrame([(None,)], "s string").select(N.metric_text(c), N.exact_text(c), N.search_key(c), N.mapping_key(c), N.comparable(c), N.spelt_out(c)).first()
    assert list(nulls) == [""] * 6


@pytest.mark.parametrize(
    ("raw", "search", "mapping"),
    [("Nguyễn Huệ", "nguyenhue", "nguienhue"), ("Thành phố Hồ Chí Minh", "hochiminh", "hochiminh"), ("Phường Ỷ La", "ila", "ila"), ("xã VII", "vii", "7"), ("Ý Yên", "iyen", "iien"), ("Tỉnh Quận Xã Lý", "xali"[2:], "li"), ("TP. Đà Lạt", "dalat", "tpdalat"), ("Thị xã Ba Đồn", "badon", "badon")],
)
def test_keys(spark, raw, search, mapping):
    assert one(spark, N.search_key(F.col("s")), s=raw) == search
    assert one(spark, N.mapping_key(F.col("s")), s=raw) == mapping


def test_small_text_functions(spark):
    x = F.col("s")
    assert one(spark, N.spelt_out(x), s="12 Lê Lợi, P.5, Q.1, TP.HCM") == "12 Lê Lợi, Phường 5, Quận 1, Thành phố HCM"
    assert one(spark, N.folded(x), s="Đường Ý Yên") == "duong y yen"
    assert one(spark, N.zero_filled(x, 3), s="12345") == "12345" and one(spark, N.zero_filled(x, 3), s="7") == "007"
    assert one(spark, N.with_street_prefix(x, {"đ.": "Đường ", "Đường d.": "never"}), s="Đ.Lê Lợi") == "Đường Lê Lợi"
    assert one(spark, N.joined(x, F.lit(""), F.lit(None).cast("string"), F.lit("b")), s="a") == "a, b"
    assert one(spark, N.decoded(x, fonts.TCVN3), s="Th¸i B×nh") == "Thái Bình"
    assert one(spark, N.decoded(x, fonts.SHEET_FONT), s="\x93ng日") == "ồng?"
    assert [tuple(spark.range(1).select(*P.number_and_street(F.lit(s))).first()) for s in ("Số 12/3 Lê Lợi", "Lê Lợi", ", x", "12A")] == [("12/3", "Lê Lợi"), ("Lê", "Lợi"), (None, ", x"), ("12A", None)]
    same = [("PRO", "Tỉnh Quảng Nam", "quang nam", True), ("WDS", "P. Bến Nghé", "Phường Bến Nghé", True), ("WDS", "Xã", "xã", True), ("DST", "Quận 1", "Quận 2", False), ("STR", "a", "a", False), ("WDS", "Phường A", "Quận A", False)]
    got = spark.createDataFrame([s[:3] for s in same], "l string, a string, b string").select(N.same_unit(F.col("l"), F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [s[3] for s in same]


def test_search_text(spark):
    got = [r.x for r in spark.createDataFrame([("Nguyễn Huệ, Đường  Đống-Đa!",), ("Ångström Łódź",), (None,)], "s string").select(X.normalized(F.col("s")).alias("x")).collect()]
    assert got == ["nguyen hue duong dong da", "angstrom lodz", None]


def test_raw_json(spark):
    values = ['"a \\" b"', '{"raw_address": "x", "y": 1}', "[1]", "plain", None, "12", '{"y": 1}']
    got = spark.createDataFrame([(v,) for v in values], "v string").select(CO.json_text(F.col("v")).alias("x"), CO.raw_norm(F.lit("  ")).alias("e")).collect()
    assert [r.x for r in got] == ['a " b', "x", None, None, None, None, None] and got[0].e is None


def test_address_labels_against_python(spark, sf_dir):
    """The same steps with Python's own regular expressions, for every row."""
    patterns = {k: re.compile(p.replace("(?iu)", ""), re.IGNORECASE) for k, p in P.LABELS.items()}
    t = lambda n: T.table(spark, sf_dir, n)
    source = {r.id: r.address for r in A.rows(t).collect()}
    seen = set()
    for r in QUERIES["address_labels"](spark, sf_dir).collect():
        rest, want = (source[r.id] or "").strip(), {}
        for label, p in patterns.items():
            m = p.search(rest)
            value = m.group(1).strip(" -/.,") if m else ""
            want[label] = value or None
            if value:
                rest = (rest[: m.start()] + rest[m.end() :]).strip(" ,")
        rest = re.sub(r"\s*,\s*,+", ", ", re.sub(r"\s{2,}", " ", rest))
        m = re.match(r"^\s*([0-9]+[A-Za-z]?(?:/[0-9]+[A-Za-z]?)*)", rest)
        want["NUM"] = m.group(1) if m else None
        head = rest.split(",")[0].strip()
        if m and head.startswith(m.group(1)):
            head = head[len(m.group(1)) :].strip(" -/")
        want["STR"] = head or None
        assert {k: r[k] for k in want} == want
        seen |= {k for k, v in want.items() if v}
    assert seen == {*P.LABELS, "NUM", "STR"}


def test_postal_peel(spark):
    rows = [
        ("1 Lê Lợi, Phường 5, Quận 1, Tỉnh X, Việt Nam", "X", "1", "5", "1 Lê Lợi", None),
        ("1 Lê Lợi, Bến Nghé, Quận 1, Hồ Chí Minh 700000", "Thành phố Hồ Chí Minh", "Quận 1", "Phường Bến Nghé", "1 Lê Lợi", "700000"),
        ("a, b, c, d, 70000, vietnam", "D", "C", "B", "a", "70000"),
        ("số 5 Lê Lợi Phường 1", "X", "Y", "Z", "số 5 Lê Lợi Phường 1", None),
        ("a, b, c", None, None, None, "a, b, c", None),
        ("a, Phường 1", "X", "Y", "Z", "a", None),
        (None, "X", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "id int, address string, p string, d string, w string")
    got = {r.id: (r.street, r.postal_code) for r in P.peeled(df, "address", "p", "d", "w").collect()}
    assert got == {i: r[4:] for i, r in enumerate(rows)}


def test_mutations_with_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z"), (None, "m")], "k int, v string")
    assert sorted(map(str, MU.insert_ignore(old, new, ["k"], [F.col("v")]).collect())) == sorted(map(str, [*old.collect(), *new.filter("v IN ('y', 'm')").collect()]))
    assert MU.insert_ignore(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert [tuple(r) for r in MU.upsert(old.filter("k IS NOT NULL"), new.filter("v IN ('x', 'y')"), ["k"]).orderBy("k").collect()] == [(1, "a"), (2, "x"), (3, "y")]
    assert tuple(MU.upsert_counts(old, new.filter("k IS NOT NULL"), ["k"]).first()) == (1, 1)
    filled = MU.fill_column(old, spark.createDataFrame([(1, 5)], "k int, w int"), "k", "w")
    assert sorted((str(r.k), r.w) for r in filled.collect()) == [("1", 5), ("2", None), ("None", None)]
    runs = spark.createDataFrame([(9,), (7,), (9,), (8,), (None,)], "run int")
    assert sorted(r.run for r in MU.retain_newest(runs, "run", 2).collect()) == [8, 9, 9]
    calls = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, None)], "call int, k int")
    used = MU.count_usage(old.selectExpr("k", "cast(NULL AS long) AS n", "cast(NULL AS string) AS at"), calls, "k", "n", "at", F.lit("now")).collect()
    assert {r.k: (r.n, r.at) for r in used} == {1: (2, "now"), 2: (0, None), None: (0, None)}


def test_checksum_is_that_of_sorted_json(spark):
    import hashlib
    import json

    rows = [('quote " and \\ and Đ', None), ("", "x"), ("line\nbreak", "tab\t")]
    got = spark.createDataFrame(rows, "b string, a string").select(AD.checksum(["b", "a"]).alias("c")).collect()
    assert [r.c for r in got] == [hashlib.sha256(json.dumps({"b": str(b), "a": str(a)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for b, a in rows]


def test_scd2_history_then_as_of(spark):
    start = F.lit("2020-01-01").cast("timestamp")
    history = spark.createDataFrame([(1, "a", 1), (2, "b", 4)], "id int, name string, version_id int").withColumns({"valid_from": start, "valid_to": F.lit(AD.OPEN_END).cast("timestamp")})
    incoming = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (4, None)], "id int, name string")
    at = F.lit("2025-07-01").cast("timestamp")
    out, log = AD.scd2(history, incoming, "id", ["name"], at)
    assert {r.id: r.change_type for r in log.collect()} == {1: "NO_CHANGE", 2: "UPDATE", 3: "CREATE", 4: "CREATE"}
    assert sorted((r.id, str(r.name), r.version_id) for r in AD.as_of(out, F.lit("2024-01-01").cast("timestamp")).collect()) == [(1, "a", 1), (2, "b", 4)]
    assert sorted((r.id, str(r.name), r.version_id) for r in AD.as_of(out, at).collect()) == [(1, "a", 1), (2, "B", 5), (3, "c", 1), (4, "None", 1)]


def test_best_match_by_step_then_order(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, None, "a"), (4, 20, None), (5, 99, "zzz")], "id int, parent int, name string")
    right = spark.createDataFrame([(7, 10, "a", 1), (8, 10, "a", 2), (9, 30, "b", 1), (6, 30, "b", 1)], "row int, up int, name string, version int")
    steps = [(AD.scoped(F.col("parent"), F.col("name")), AD.scoped(F.col("up"), F.col("name"))), (F.col("name"), F.col("name"))]
    got = {r.id: (r.row, r.step) for r in AD.best_match(left, right, "id", "row", steps, [F.desc("version"), F.col("row")]).collect()}
    assert got == {1: (8, 1), 2: (6, 2), 3: (8, 2)}


def test_percentiles_against_interpolation(spark):
    r = random.Random(4)
    rows = [("a", float(r.randrange(50))) for _ in range(501)] + [("b", 3.5)] * 10 + [("c", r.gauss(0, 1e6)) for _ in range(77)] + [("d", None), ("e", 1.0), ("e", 2.0)]
    got = {x.k: x.p for x in R.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    want = {x.k: x.p for x in spark.createDataFrame(rows, "k string, v double").filter("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.5, 0.95, 1.0)))).alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_percentiles_with_an_outlier_and_infinities(spark):
    """One outlier leaves few values to order, and infinite ones are values."""
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(20_000)] + [("a", 1e12), ("b", float("inf")), ("b", 1.0), ("b", float("-inf")), ("b", float("inf")), ("c", 2.0)]
    got = {x.k: x.p for x in R.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(4), "k", "v", (0.5, 0.99, 1.0)).collect()}
    v = sorted(x for k, x in rows if k == "a")
    at = lambda p: v[int((len(v) - 1) * p)] + (v[min(int((len(v) - 1) * p) + 1, len(v) - 1)] - v[int((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1)
    assert got["a"] == pytest.approx([at(0.5), at(0.99), 1e12])
    assert got["b"] == [float("inf")] * 3 and got["c"] == [2.0] * 3


def test_numbers_of_hashed_keys(spark):
    """Keys far apart are numbered as close ones are."""
    keys = [(hash((i, 7)) % 2**61,) for i in range(3000)]
    got = {x.k: x.number for x in M.numbered(spark.createDataFrame(keys, "k long").repartition(7), "k").collect()}
    assert got == {k: i for i, (k,) in enumerate(sorted(keys), 1)}
    assert M.numbered(spark.createDataFrame([], "k long"), "k").collect() == []


def test_entities_of_several_kinds(spark):
    """All kinds that apply, names from streets, keys without case and white space, types of places in their order."""
    rows = [(5, {"building": "yes", "amenity": "cafe", "name": "Cafe  Sữa"}), (3, {"amenity": "Cafe", "name": "cafe sữa"}), (4, {"shop": "x", "name": "CAFE SỮA "}), (6, {"addr:street": " Lê Lợi "}), (7, {"highway": "primary", "name": "lê lợi"}), (8, {"highway": "path"}), (9, {"place": "hamlet", "name": "Ấp"}), (10, {"office": "o", "tourism": "t", "name": "N", "": "y"}), (11, None), (12, {"building": " ", "name": "Y"})]
    got = CO.split_entities(spark.createDataFrame([(i, 1, t) for i, t in rows], "id int, p int, tags map<string,string>"), "id", "tags", "p").collect()
    assert sorted((x.kind, x.id, x.name, x.type) for x in got if x.kind != "street") == [("building", 5, "Cafe  Sữa", "yes"), ("poi", 3, "cafe sữa", "Cafe"), ("poi", 4, "CAFE SỮA", "x"), ("poi", 10, "N", "t")]
    assert [(x.id, x.name, x.type) for x in got if x.kind == "street"] == [(6, "Lê Lợi", None)]


def test_history_of_deleted_rows_and_predecessors(spark):
    schema = "row_id long, predecessor_id long, id int, name string, valid_from timestamp, valid_to timestamp, version_id int, is_active boolean, is_deleted boolean"
    day = lambda d: datetime(2020, 1, d)
    end = datetime(9999, 12, 31)
    current = spark.createDataFrame([(11, None, 1, "a", day(1), end, 3, True, False), (12, None, 2, "b", day(1), end, 1, True, True), (13, None, 3, "c", day(1), end, 1, True, False)], schema)
    out, log = AD.scd2(current, spark.createDataFrame([(1, "A"), (2, "b"), (3, "c")], "id int, name string"), "id", ["name"], F.lit("2020-02-01").cast("timestamp"))
    assert {x.id: x.change_type for x in log.collect()} == {1: "UPDATE", 2: "CREATE", 3: "NO_CHANGE"}
    rows = {(x.id, x.version_id, x.name): (x.row_id, x.predecessor_id, x.is_active, x.is_deleted, x.valid_to == end) for x in out.collect()}
    assert rows[1, 3, "a"] == (11, None, False, False, False) and rows[1, 4, "A"] == (None, 11, True, False, True)
    assert rows[3, 1, "c"] == (13, None, True, False, True) and len(rows) == 4 or (2, 1, "b") in rows


def test_vectors_that_are_zero_null_or_not_numbers(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in V.top_k(v, v.filter("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(6, 1.0), (1, 0.707107), (2, 0.0), (3, 0.0), (4, -1.0)]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, float("nan")], [1.0, 2.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.x for r in zero.select(V.cosine("a", "b").alias("x")).collect()] == [0.0, 0.0, 0.0]
    assert V.top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_top_k_of_rows_with_equal_ids(spark):
    """Rows that share an id are rows of their own, also where whole blocks repeat."""
    rows = [(i, [float(i), 1.0]) for i in range(5)] * 2
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = V.top_k(v, v.filter("vec_id = 0").limit(1), 20).collect()
    assert sorted(r.vec_id for r in got) == sorted([1, 2, 3, 4] * 2)


def test_inverted_file_index(spark, tmp_path):
    """All rows are in the index, all lists give the exact result, and fewer lists the wanted recall; skewed, zero and broken vectors included."""
    r = random.Random(9)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in (centres[0] if i % 3 == 0 else r.choice(centres))]) for i in range(1500)]
    rows += [(2000, [0.0] * 12), (2001, [float("nan")] + [1.0] * 11), (2002, rows[0][1]), (2003, rows[0][1])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    index = IVF.build(v, str(tmp_path / "i"), k=5)
    assert index.rows(spark).count() == len(rows) and 1 <= index.probes < len(index.centroids) and index.recall >= 0.95
    queries = v.filter("id % 20 = 0")
    exact = {(x.query_id, x.id, x.score, x.rank) for x in V.block_top_k(v, queries, 5).collect()}
    assert {(x.query_id, x.id, x.score, x.rank) for x in IVF.search(index, spark, queries, 5, len(index.centroids)).collect()} == exact
    found = {tuple(x) for x in IVF.search(IVF.load(spark, str(tmp_path / "i")), spark, queries, 5).select("query_id", "id", "score", "rank").collect()}
    assert len(found) == len(exact) and len({x[:2] for x in found} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    # more than a list holds: exact search takes over
    many = IVF.search(index, spark, v.filter("id = 20"), 1400, 1).collect()
    assert len(many) == 1400 and {x.id for x in many} == {x.id for x in V.block_top_k(v, v.filter("id = 20"), 1400).collect()}


def test_top_k_over_many_blocks(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = {(x.query_id, x.rank): (x.vec_id, x.score) for x in V.top_k(v, v.filter("vec_id % 20 = 0"), 7).collect()}
    monkeypatch.setattr(V, "BLOCK", 9)
    monkeypatch.setattr(V, "QUERY_NUMBERS", 7)
    monkeypatch.setattr(V, "CANDIDATES", 10)
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in V.top_k(v, v.filter("vec_id % 20 = 0"), 7).collect()} == whole


def test_jaccard_join_against_all_pairs(spark):
    r = random.Random(2)
    sets = [(i, r.choice("xy"), [r.choice("abcdefghijkl") for _ in range(r.randint(0, 6))]) for i in range(80)]
    df = spark.createDataFrame(sets, "id int, g string, t array<string>")
    for percent in (50, 70, 100):
        want = {(i, j) for i, g, a in sets for j, h, b in sets if i < j and g == h and a and b and 100 * len({*a} & {*b}) >= percent * len({*a} | {*b})}
        assert {(x.a, x.b) for x in M.jaccard_join(df, "id", "t", percent, ["g"]).collect()} == want


def test_span_lies_where_the_pattern_matched(spark):
    df = spark.createDataFrame([("ab 12 ab",), ("ab",), ("x",), (None,)], "t string")
    got = [(r.t, r.start, r.end, r.label) for r in M.span_labels(df, "t", [("END", "ab$", 0), ("ANY", "ab", 0), ("NUM", r"(?<= )(\d+)", 1)]).collect()]
    assert sorted(got) == [("ab", 0, 2, "END"), ("ab 12 ab", 0, 2, "ANY"), ("ab 12 ab", 3, 5, "NUM"), ("ab 12 ab", 6, 8, "END")]


def test_fuzzy_scores_and_candidates(spark, sf_dir):
    t = lambda n: T.table(spark, sf_dir, n)
    pairs = [(r.id, r.p, r.g) for r in A.rows(t).select("id", N.metric_text(F.col("other")).alias("p"), N.metric_text(F.col("address")).alias("g")).collect()]
    by = {m: [x for x in pairs if x[0] % 3 == i] for i, m in enumerate(("phobert", "siamese", "llm"))}
    for r in QUERIES["exact_fuzzy_proxy_f1"](spark, sf_dir).collect():
        own = by[r.model]
        exact = sum(p == g for _, p, g in own) / len(own)
        fuzzy = sum(SequenceMatcher(None, p, g).ratio() >= E.FUZZY for _, p, g in own) / len(own)
        assert r.exact_rate == pytest.approx(exact, abs=1e-4) and r.fuzzy_rate == pytest.approx(fuzzy, abs=1e-4) and r.f1_proxy == pytest.approx(2 * exact * fuzzy / (exact + fuzzy), abs=1e-4)
        assert (r.throughput == 0 and r.cost_per_million == E.DEFAULT_COST["llm"]) if r.model == "llm" else r.cost_per_million == pytest.approx(E.HOURLY_COST[r.model] / r.throughput * 1e6 / 3600, rel=1e-3)
    parts = {r.p_partkey: r for r in t("part").collect()}
    for r in QUERIES["best_candidates"](spark, sf_dir).collect():
        p = parts[r.query_id]
        ratios = {c: SequenceMatcher(None, p.p_name, c).ratio() for c in (p.p_type, f"{p.p_brand} {p.p_name[2:]}")}
        assert (r.best, r.ratio) == (p.p_name, 0.0) if r.query_id % 2 else r.ratio == pytest.approx(max(ratios.values()), abs=1e-6) and ratios[r.best] == max(ratios.values())


def test_hulls(spark):
    r = random.Random(9)
    rows = [(u, r.randrange(20) / 2, r.randrange(20) / 2) for u in range(5) for _ in range(60)] + [(7, 1.0, 1.0), (7, 2.0, 2.0), (7, 3.0, 3.0), (None, 1.0, 2.0), (8, None, 1.0)]
    got = {x.u: [(p.lat, p.lon) for p in x.ring] for x in G.convex_hulls(spark.createDataFrame(rows, "u int, lat double, lon double").repartition(6), "u").collect()}
    assert got.keys() == set(range(5))
    for u, ring in got.items():
        own = {(y, x) for v, y, x in rows if v == u}
        cross = lambda a, b, c: (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])
        edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
        assert set(ring) <= own and all(cross(a, b, p) >= 0 for a, b in edges for p in own) and all(cross(a, b, c) > 0 for (a, b), (_, c) in zip(edges, edges[1:] + edges[:1], strict=True))


def test_samples(spark):
    df = spark.createDataFrame([(i, "D1" if i < 5 else "D2") for i in range(300)], "id int, s string")
    got = S.quota_sample(df, "id", "s", 50, (("D1", 0.4), ("D2", 0.2), ("D4", 0.4)), 3, "D9").collect()
    assert len(got) == 50 and len({r.id for r in got}) == 50 and sum(r.s == "D1" for r in got) == 5 and sum(r.s == "D2" for r in got) == 10 and sum(r.s == "D9" for r in got) == 35
    assert S.quota_sample(df.limit(20), "id", "s", 50, (("D1", 0.4), ("D2", 0.6)), 3, "D9").count() == 20
    assert S.quotas(10, (("a", 0.25), ("b", 0.25), ("c", 0.5))) == {"a": 2, "b": 2, "c": 6}
    few = {r.id for r in S.escalating_sample(df, 40, 1).collect()}
    assert len(few) == 40 and few == {r.id for r in S.escalating_sample(df, 40, 1).collect()}
    assert S.escalating_sample(df, 500, 1).count() == 300


def test_corpus_helpers(spark):
    a, b, c = (spark.range(n) for n in (5, 60, 10))
    assert CO.first_non_empty([(a, 100), (b, 50), (c, 0)]).count() == 60 and CO.first_non_empty([(a, 100), (b, 100), (c, 0)]).count() == 10
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), (None, "c"), ("d", None)], "o string, n string")
    assert sorted(tuple(r) for r in CO.training_pairs(pairs, "o", "n").collect()) == [("a", "b"), ("b", "b"), ("c", "c")]
    ok = {r.rule: (r.n_failed, r.ok) for r in CO.checks(spark.createDataFrame([(1, 0.5), (2, None), (3, 1.5)], "id int, q double"), {"range": F.col("q").between(0, 1), "id": F.col("id") > 0}).collect()}
    assert ok == {"range": (2, False), "id": (0, True)}
    two = CO.compared(spark.createDataFrame([("em", 0.5), ("x", 1.0)], "m string, v double"), spark.createDataFrame([("em", 0.75)], "m string, v double"), "m", "v", ("oracle", "real"))
    assert {r.m: (r.oracle, r.real, r.difference) for r in two.collect()} == {"em": (0.5, 0.75, 0.25), "x": (1.0, None, None)}
    v = spark.createDataFrame([("a", None), ("b", [1.0]), (None, None)], "t string, v array<double>")
    assert sorted(str(r.v) for r in CO.backfilled(v, "v", lambda t: F.array(F.length(t).cast("double") + 5), "t").collect()) == ["None", "[1.0]", "[6.0]"]


def test_csv_encodings(spark, tmp_path):
    text = "id,name\n1,Hà Nội\n2,Đà Lạt\n"
    for name, encoding, want in (("u8", "utf-8", "Hà Nội"), ("sig", "utf-8-sig", "Hà Nội"), ("u16", "utf-16", "Hà Nội"), ("cp", "windows-1252", "H\x85 x€y"), ("l1", "latin-1", "Hà\x81")):
        body = text if want == "Hà Nội" else f"id,name\n1,{want}\n2,x\n" if encoding == "latin-1" else "id,name\n1,café €\n2,x\n"
        (tmp_path / name).write_bytes(body.encode(encoding))
        got = {r.id: r.name for r in T.csv_with_encodings(spark, str(tmp_path / name), "id int, name string").collect()}
        assert got[1] == ("café €" if name == "cp" else want) and len(got) == 2
    assert [T.encoding_of(spark, str(tmp_path / n)) for n in ("u8", "sig", "u16", "cp", "l1")] == ["UTF-8", "UTF-8", "UTF-16", "windows-1252", "ISO-8859-1"]
    (tmp_path / "font").write_bytes(b"a,b\nT\x83y H\x8b,1\n")
    assert T.font_csv(spark, str(tmp_path / "font"), ["name"]).first().name == "Tây Hồ"


def test_other_sources(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id": 1, "p": 7}\nnot json\n{"id": 2, "p": 8}\n')
    assert [r.id for r in T.json_lines(spark, str(tmp_path / "j.jsonl"), "id int, p int", F.col("p") == 8).collect()] == [2]
    (tmp_path / "x.xml").write_text("<a><NewDataSet><TABLE><MA>01</MA><TEN>Hà Nội</TEN></TABLE><TABLE><MA>02</MA></TABLE></NewDataSet></a>")
    assert sorted((r.MA, r.TEN) for r in T.xml_rows(spark, str(tmp_path / "x.xml"), "MA string, TEN string").collect()) == [("01", "Hà Nội"), ("02", None)]
    (tmp_path / "q.csv").write_text('id,raw,parts,processing_status\n1,"a, b","{""x"": 1}",DONE\n2,c,{bad,\n3,d,,\n')
    got = {r.id: (r.raw, r.parts, r.processing_status) for r in T.queue_csv(spark, str(tmp_path / "q.csv"), "id int, raw string, parts string, processing_status string", ["parts"]).collect()}
    assert got == {1: ("a, b", '{"x": 1}', "DONE"), 2: ("c", None, "PENDING"), 3: ("d", None, "PENDING")}
    df = spark.createDataFrame([(1, "Phường Phường 5", "Phường"), (2, "Quận 3", None)], "id int, name string, type string")
    assert sorted(r.name for r in T.seeded(df, str(tmp_path / "seed"), "name", "type").collect()) == ["5", "Quận 3"]
    tasks = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "id int, raw string")
    assert [tuple(r) for r in T.new_tasks(tasks, spark.createDataFrame([("b",)], "raw string"), "raw").collect()] == [(1, "a")]
    assert T.labelled(df, "name", None).columns == ["id", "raw_address", "standard_address"] and T.distinct_values(df, "type").count() == 1


def test_tagging_scores(spark):
    rows = [(["B-A", "I-A", "O"], ["B-A", "I-A", "O"]), (["B-A", "I-B", "B-B"], ["B-A", "I-A", "I-B"]), (["O"], ["B-A"]), ([], [])]
    r = E.tagging_scores(spark.createDataFrame(rows, "g array<string>, p array<string>"), "g", "p").first()
    # gold: A[0,2) A[0,1) B[1,2) B[2,3); predicted: A[0,2) A[0,2) B[2,3) A[0,1)
    assert (r.n_tokens, r.token_accuracy, r.precision, r.recall) == (7, round(4 / 7, 6), 0.5, 0.5)


def test_strict_component_counts(spark):
    rows = spark.createDataFrame([("x", "y"), ("x", "x"), ("x", None), (None, "y"), ("", "")], "p string, g string")
    assert tuple(E.component_f1(rows, [], "p", "g").first())[:3] == (1, 1, 2)
    assert tuple(E.component_f1(rows, [], "p", "g", strict=True).first())[:3] == (1, 2, 2)
    assert math.isclose(E.component_f1(rows, [], "p", "g").first().f1, 0.4)


def test_tags_against_python(spark, sf_dir):
    t = lambda n: T.table(spark, sf_dir, n)
    source = {r.id: r for r in A.rows(t).collect()}
    used = set()
    for r in QUERIES["weak_tags"](spark, sf_dir).collect():
        own = (r.address or "").split()
        want = ["O"] * len(own)
        for label, part in (("WDS", source[r.id].ward), ("DST", source[r.id].district), ("PRO", source[r.id].province)):
            c = (part or "").lower().split()
            at = next((i for i in range(len(own) - len(c) + 1) if c and [x.lower() for x in own[i : i + len(c)]] == c), None)
            if at is not None:
                want[at : at + len(c)] = [f"B-{label}"] + [f"I-{label}"] * (len(c) - 1)
        assert (r.words, r.tags) == (own, want)
        used |= set(want)
    assert {"B-PRO", "I-PRO"} <= used
    one = spark.createDataFrame([("12 Lê lợi P. 5 lê LỢI", {"STR": "Lê Lợi", "WDS": "P. 5", "NUM": "12", "PRO": "none", "DST": None})], "t string, c map<string,string>")
    assert one.select(TG.weak_tags(F.col("t"), F.col("c")).alias("x")).first().x == ["B-NUM", "B-STR", "I-STR", "B-WDS", "I-WDS", "O", "O"]
    for r in QUERIES["span_tags"](spark, sf_dir).collect():
        want, begun = [], set()
        for m in re.finditer(r"\S+", r.address):
            hit = next(((a, b, x) for a, b, x in ((3, 11, "STR"), (9, 19, "WDS")) if a < m.end() and m.start() < b), None)
            first = hit and (hit[0] >= m.start() or not r.address[hit[0] : m.start()].strip())
            want.append("O" if hit is None else ("B-" if first else "I-") + hit[2])
            begun.add(hit)
        assert r.tags == want


def test_entities_of_other_models(spark):
    e = [("B-STREET", "Lê"), ("I-STREET", "Lợi"), ("O", "x"), ("WARD", " Bến@@ Nghé "), (None, "y"), ("PRO", ""), ("NUM", "1")]
    df = spark.createDataFrame([(e,), ([],)], "e array<struct<label:string,word:string>>")
    assert [r.m for r in df.select(TG.merged_entities(F.col("e")).alias("m")).collect()] == [{"STR": "Lê Lợi", "WDS": "BếnNghé", "NUM": "1"}, {}]


def test_queue_normalization(spark, sf_dir):
    t = lambda n: T.table(spark, sf_dir, n)
    corpus = {r.id: r.other for r in A.rows(t).filter("id % 5 = 0").collect() if r.other is not None}
    rows = QUERIES["queue_normalization"](spark, sf_dir).collect()
    assert len(rows) == t("customer").count()
    grams = lambda s: {f"  {s.lower()} "[i : i + 3] for i in range(len(s) + 1)}
    plain = {r.id: r.m for r in A.rows(t).select("id", N.metric_text(N.collapsed(N.spelt_out(F.col("address")))).alias("m")).collect()}
    texts = dict(spark.createDataFrame(list(corpus.items()), "id long, t string").select("id", N.metric_text(F.col("t"))).collect())
    for r in rows:
        if not plain[r.id]:
            assert r.match is None and (r.score, r.decision) == (0.0, "REJECT")
            continue
        like = {i: round(len(grams(plain[r.id]) & grams(x)) / len(grams(plain[r.id]) | grams(x)), 6) for i, x in texts.items()}
        assert like[r.match] == max(like.values()) and r.standard_address == corpus[r.match]


def test_trigram_top1_in_rounds(spark):
    """The rounds find what one comparison of all names finds."""
    r = random.Random(12)
    base = ["".join(r.choices("abcdeđ ", k=r.randint(1, 14))) for _ in range(60)]
    vary = lambda x: "".join(c if r.random() > 0.15 else r.choice("abcxyz") for c in x)
    left = [(i, i % 2, vary(r.choice(base))) for i in range(120)] + [(500, 0, None), (501, None, "abc"), (502, 1, ""), (503, 0, "日本")]
    right = [(1000 + i, i % 2, vary(x)) for i, x in enumerate(base * 2)] + [(7, 1, left[7][2]), (2000, 0, base[0]), (2001, 0, base[0])]
    grams = lambda x: {f"  {x.lower()} "[i : i + 3] for i in range(len(x) + 1)}
    want = {}
    for i, v, n in left:
        scored = [(-round(len(grams(n) & grams(m)) / len(grams(n) | grams(m)), 6), j) for j, w, m in right if n is not None and v is not None and w == v and j != i and grams(n) & grams(m)]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    schema = "id int, v int, n string"
    for bounds in (M.BOUNDS, (0.9, 0.0), (0.0,)):
        got = M.trigram_top1(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), bounds).collect()
        assert {x.id: (x.match, x.score) for x in got} == want and len(got) == len(want)


def test_replicates_and_their_interval(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "k int, s string").repartition(5)
    got = S.replicates(df, "k", "s", {"a": 9, "b": 4, "z": 3}, (3, 5))
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    rows = got.collect()
    for seed in (3, 5):
        for name, n in (("a", 9), ("b", 4)):
            want = [x.k for x in S.md5_sample(df.filter(F.col("s") == name), "k", n, seed).collect()]
            assert [x.k for x in sorted((x for x in rows if x.seed == seed and x.s == name), key=lambda x: x.rank)] == want
    assert len(rows) == 26
    runs = spark.createDataFrame([(i, 0.5 + i / 100, 0.6 + i / 100 + (i % 3) / 50) for i in range(30)] + [(99, None, 1.0)], "seed int, a double, b double")
    one = S.paired_interval(runs, "seed", "a", "b").first()
    assert one.n == 30 and one.difference == pytest.approx(0.12) and 0.105 < one.low < 0.12 < one.high < 0.135
    assert tuple(S.paired_interval(runs.limit(0), "seed", "a", "b").first()) == (0, None, None, None)


def test_token_labels(spark):
    """Two segmentations of one text: words, and pieces of any length, with special and empty tokens, against Python."""
    r = random.Random(8)
    tags = ["O", "B-WDS", "I-WDS", "B-DST", "B-STR", "I-STR"]
    rows = []
    for i in range(60):
        text = "".join(r.choice("abđ  ,") for _ in range(r.randint(0, 25)))
        spans = [(s, s + r.randint(0, 8), r.choice(["WDS", "DST", "STR", "XXX", None])) for s in (r.randint(0, 24) for _ in range(r.randint(0, 3)))]
        if len({s for s, *_ in spans}) < len(spans):
            spans = spans[:1]
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, r.randint(0, 12))))
        tokens = [(None, None), *zip(cuts, cuts[1:], strict=False), (0, 0)]
        rows.append((i, text, spans, tokens))
    df = spark.createDataFrame([*rows, (99, None, [], [(0, 1)])], "i int, t string, s array<struct<start:int,end:int,label:string>>, k array<struct<start:int,end:int>>")
    got = {x.i: x.x for x in df.select("i", TG.token_labels(F.col("t"), F.col("s"), F.col("k"), tags, 11).alias("x")).collect()}
    for i, text, spans, tokens in rows:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        own = ["O"] * len(words)
        for s, e, label in sorted((x for x in spans if x[2]), key=lambda x: x[0]):
            first = True
            for k, (a, b) in enumerate(words):
                if f"B-{label}" in tags and b > s and a < e:
                    own[k], first = f"{'B' if first else 'I'}-{label}", False
        used, want = set(), []
        for s, e in tokens:
            k = None if s is None or e <= s else next((k for k, (a, b) in enumerate(words) if a <= s < b), None)
            want.append(-100 if k is None or k in used else tags.index(own[k]) if own[k] in tags else 0)
            used.add(k)
        assert got[i] == want[:11], (text, spans, tokens)
    assert got[99] == [-100]


def test_production_step_by_step(spark):
    """Each step of the queue against Python."""
    corpus = [(0, "12 Lê Lợi, Phường Bến Nghé, Quận 1"), (1, "45 Nguyễn Huệ, Phường Đa Kao, Quận 1"), (2, "7 Quang Trung, Xã Bình Mỹ, Huyện Củ Chi"), (3, None)]
    queue = [(0, "12 le loi, ben nghe", 1, 10, 100, 10.0, 106.0, 2), (1, "nguyễn huệ đa kao", 1, 11, 100, 50.0, 10.0, 1), (2, " ", 1, 10, 100, None, None, None), (3, None, None, None, None, 1.0, 2.0, 1), (4, "Xã Bình Mỹ, Huyện Củ Chi", None, 10, 101, 200.0, 1.0, None), (5, "日本", 1, None, 100, 9.0, 105.0, 3)]
    q = spark.createDataFrame(queue, "id long, address string, ward_id long, district_id long, province_id long, lat double, lon double, version int")
    c = spark.createDataFrame(corpus, "id long, address string")
    wards, districts = spark.createDataFrame([(1, 10), (1, 10), (2, 11)], "ward_id long, district_id long"), spark.createDataFrame([(10, 100), (11, 101)], "district_id long, province_id long")
    old, new = spark.createDataFrame([("bình mỹ,",), ("bình mỹ,",)], "name string"), spark.createDataFrame([("đa kao",)], "name string")
    got = {r.id: r for r in PL.production(q, c, wards, districts, old, new).collect()}
    assert {i: r.match for i, r in got.items()} == {0: 0, 1: 1, 2: None, 3: None, 4: 2, 5: None}
    assert {i: r.hierarchy for i, r in got.items()} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.5, 4: 0.0, 5: 0.5}
    assert {i: r.geo for i, r in got.items()} == {0: 1.0, 1: 0.7, 2: 0.5, 3: 0.7, 4: 0.0, 5: 1.0}
    assert {i: r.temporal for i, r in got.items()} == {0: 1.0, 1: 0.8, 2: 0.9, 3: 0.8, 4: 0.9, 5: 1.0}
    assert {i: r.epoch for i, r in got.items()} == {0: "AMBIGUOUS", 1: "AMBIGUOUS", 2: "AMBIGUOUS", 3: "AMBIGUOUS", 4: "PRE_2025", 5: "AMBIGUOUS"}
    # semantic scores from vectors of words by hand
    plain = lambda x: re.findall(r"\S+", x) if x else []
    texts = {r.i: plain(r.x) for r in q.select(F.col("id").alias("i"), N.metric_text(N.collapsed(N.spelt_out(F.col("address")))).alias("x")).collect()} | {-1 - i: plain(x) for i, x in ((r.i, r.x) for r in c.select(F.col("id").alias("i"), N.metric_text(F.col("address")).alias("x")).collect())}
    texts = {i: w for i, w in texts.items() if w}
    df = {w: sum(w in set(x) for x in texts.values()) for x in texts.values() for w in x}
    vector = lambda x: {w: x.count(w) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w in x}
    for i, r in got.items():
        if r.match is not None:
            a, b = vector(texts[i]), vector(texts[-1 - r.match])
            dot = sum(a[w] * b.get(w, 0) for w in a)
            assert r.semantic == pytest.approx(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), abs=2e-6)
            total = 0.3 * r.text + 0.35 * r.semantic + 0.25 * r.hierarchy + 0.1 * r.temporal + 0.1 * r.geo
            assert r.score == pytest.approx(total / 1.1, abs=1e-4)
        else:
            assert (r.score, r.decision, r.semantic) == (0.0, "REJECT", 0.0)


def test_cloned_and_seeded_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "Quận 1", "Quận"), (2, "Huyện Củ Chi", "Huyện"), (3, None, "Xã"), (4, "Bình Mỹ", None)], "id int, name string, type string")
    assert sorted(map(str, T.cloned(df, str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))
    seeded = T.seeded(df, str(tmp_path / "s"), "name", "type")
    assert seeded.schema == df.schema and {r.id: r.name for r in seeded.collect()} == {r.id: r.x for r in df.select("id", N.unit_name(F.col("name"), F.col("type")).alias("x")).collect()}
    assert {r.id: r.name for r in seeded.collect()}[2] == "Củ Chi" and {r.id: r.name for r in seeded.collect()}[4] == "Bình Mỹ"
    # written again, the newest rows alone are there
    assert T.seeded(df.limit(1), str(tmp_path / "s"), "name", "type").count() == 1
