"""Spans of addresses: examples placed by hand, and the fold of candidates against a solver in Python."""

import random

from pyspark.sql import functions as F

from quartier.operators import labeller as L

ROWS = [
    (1, "12 Lê Lợi, Phường Bến Nghé, Quận 1, Thành phố Hồ Chí Minh", "Phường Bến Nghé", "Quận 1", "Thành phố Hồ Chí Minh"),
    (2, "12A Nguyễn Huệ, Bến Nghé, Q1", "Phường Bến Nghé", "Quận 1", None),
    (3, "45/3 đường Trần Phú tp hcm", None, None, None),
    (4, "Số 9 Lê Lợi Phường 5 Hà Nội", None, None, None),
    (5, "H4VR+86C, Châu Pha, Tân Thành, Bà Rịa - Vũng Tàu, Việt Nam", None, None, None),
    (6, "Xã Năm Căn, Thị trấn Năm Căn, Huyện Năm Căn, Cà Mau", None, None, None),
    (7, "7 tổ 3, ấp 2, Xã Bình Mỹ, Huyện Củ Chi, Hồ Chí Minh", None, None, None),
    (8, None, "x", "y", "z"),
    (9, "  ", "x", "y", "z"),
    (10, "12 ÂU CƠ, Phú Nhuận", "Phường Phú Nhuận", "Quận Tân Bình", "Tỉnh Kiên Giang"),
    (11, "QL 1A, Xã An Phú, Đà Nẵng 550000", "Xã An Phú", None, "Thành phố Đà Nẵng"),
    (12, "5 lô 7, Phường 3 + (phường 3), Quận 3", "Phường 3", "", None),
    (13, "8 trường tiểu học Lê Lợi, Phường 9", None, None, None),
]
#: id: spans as (text, label, stage); those of rule b stand behind the text.
WANT = {
    1: [("12", "NUM", "h"), ("Lê Lợi", "STR", "g"), ("Phường Bến Nghé", "WDS", "a"), ("Quận 1", "DST", "a"), ("Thành phố Hồ Chí Minh", "PRO", "a")],
    2: [("12A", "NUM", "h"), ("Nguyễn Huệ", "STR", "g"), ("Bến Nghé", "WDS", "a"), ("1", "DST", "b")],
    3: [("45/3", "NUM", "h"), ("đường Trần Phú", "STR", "h"), ("tp hcm", "PRO", "c")],
    4: [("Số 9", "NUM", "h"), ("Lê Lợi", "STR", "g"), ("Phường 5", "WDS", "c"), ("Hà Nội", "PRO", "c")],
    5: [("Châu Pha", "WDS", "e"), ("Tân Thành", "DST", "e"), ("Bà Rịa - Vũng Tàu", "PRO", "e")],
    6: [("Xã Năm Căn", "WDS", "d"), ("Thị trấn Năm Căn", "WDS", "f"), ("Huyện Năm Căn", "DST", "d"), ("Cà Mau", "PRO", "d")],
    7: [("7", "NUM", "h"), ("Xã Bình Mỹ", "WDS", "d"), ("Huyện Củ Chi", "DST", "d"), ("Hồ Chí Minh", "PRO", "d")],
    10: [("12", "NUM", "h"), ("ÂU CƠ", "STR", "g"), ("Phú Nhuận", "WDS", "a"), ("Tân Bình", "DST", "b"), ("Kiên Giang", "PRO", "b")],
    11: [("QL 1A", "STR", "h"), ("Xã An Phú", "WDS", "a"), ("Đà Nẵng", "PRO", "a")],
    12: [("5", "NUM", "h"), ("lô 7", "NHB", "h"), ("phường 3", "WDS", "a"), ("Quận 3", "DST", "d")],
    13: [("8", "NUM", "h"), ("Phường 9", "WDS", "d")],
}


def test_labelled(spark):
    df = spark.createDataFrame(ROWS, "id int, a string, w string, d string, p string")
    streets = spark.createDataFrame([("lê lợi",), ("Âu Cơ",), (None,)], "name string")
    found = L.labelled(df, "id", "a", "w", "d", "p", streets).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.start, r.end)):
        got.setdefault(r.id, []).append((r.span, r.label, r.stage))
    assert got == WANT
    text = {i: a for i, a, *_ in ROWS}
    assert all(r.implied == (r.stage == "b") for r in found)
    assert all(text[r.id][r.start : r.end] == r.span for r in found if not r.implied)
    assert next(r for r in found if r.id == 2 and r.label == "WDS").labels == ["WDS", "PRO"]
    assert {r.score for r in found if r.stage == "g"} == {0.92, 0.8}


def solved(candidates):
    """What stays of candidates (stage, label, start, end, rule), by hand."""
    units, spans = {"WDS", "DST", "PRO"}, []
    for stage, label, start, end, rule in candidates:
        labels = [x for s in spans for x in s[2]]
        if rule != L.ALWAYS and label in labels:
            continue
        if rule == L.AFTER_DISTRICT and "DST" not in labels:
            continue
        if rule == L.AFTER_WARD and not any("WDS" in s[2] and s[3] < stage for s in spans):
            continue
        if rule == L.BARE and any(s[2][0] in units and s[3] < stage for s in spans):
            continue
        hit = next((s for s in spans if s[0] < end and start < s[1]), None)
        new = [start, end, [label], stage]
        if hit is None:
            spans.append(new)
            continue
        own, pair = hit[2][0], {hit[2][0], label} <= {"DST", "PRO"}
        if hit[:2] == [start, end]:
            if label in hit[2] or (own in units and label not in units):
                continue
            if pair:
                spans.append(new)
                continue
            rank = [L.PRIORITY.get(x, 10) for x in (own, label)]
            if rank[1] > rank[0]:
                hit[2] = [label]
            elif rank[1] == rank[0]:
                hit[2].append(label)
        elif pair:
            spans.append(new)
        elif (own in units) == (label in units) and end - start > hit[1] - hit[0]:
            spans.remove(hit)
            spans.append(new)
    return [tuple(map(str, s)) for s in spans]


def test_fold_of_candidates(spark):
    r = random.Random(6)
    rules = [L.ALWAYS, L.ALWAYS, L.MISSING, L.AFTER_DISTRICT, L.AFTER_WARD, L.BARE]
    cases = []
    for _ in range(300):
        own = []
        for stage in sorted(r.choices("abcdefgh", k=r.randint(0, 9))):
            start = r.randint(0, 12)
            own.append((stage, r.choice([*L.PRIORITY, *L.UNIT_WORDS, *L.UNIT_WORDS]), start, start + r.randint(0, 5), r.choice(rules)))
        cases.append(own)
    df = spark.createDataFrame([(i, [(s, l, a, b, "x", 0.5, rule) for s, l, a, b, rule in c]) for i, c in enumerate(cases)], f"i int, c {L.CANDIDATES}")
    got = {x.i: [(str(s.start), str(s.end), str(list(s.labels)), s.stage) for s in x.spans] for x in df.select("i", L.resolved(F.col("c")).alias("spans")).collect()}
    assert got == {i: solved([x for x in c if x[3] > x[2]]) for i, c in enumerate(cases)}


def test_places_of_matches(spark):
    df = spark.createDataFrame([("an an ban an", "an"), ("Ấp ẤP ấp.", "ấp"), ("a.b a+b a.b", "a.b"), ("", "x"), (None, "x")], "t string, w string")
    got = [[(m.start, m.span) for m in x.m] if x.m is not None else None for x in df.select(L.matches(F.col("t"), L.whole_words(F.col("w"))).alias("m")).collect()]
    assert got == [[(0, "an"), (3, "an"), (10, "an")], [(0, "Ấp"), (3, "ẤP"), (6, "ấp")], [(0, "a.b"), (8, "a.b")], [], None]
