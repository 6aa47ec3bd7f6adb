"""Repaired and checked labels, by examples."""

from pyspark.sql import functions as F

from quartier.operators import repairs as RP

ROWS = [
    # address, expected, ward, district, province, repaired
    ("12 Lê Lợi, Phường Bến Nghé, Quận 1, Hồ Chí Minh", [("WDS", "Bến Nghé"), ("STR", "Lê Lợi"), ("str", "lê lợi"), ("NUM", " ")], "Bến Nghé", "1", "Thành phố Hồ Chí Minh", [("STR", "Lê Lợi"), ("WDS", "Phường Bến Nghé"), ("DST", "Quận 1"), ("PRO", "Hồ Chí Minh")]),
    ("5 A, Xã Tân Phú, Huyện Củ Chi", [("WDS", "tân phú"), ("DST", "Hóc Môn"), ("PRO", "Long An")], None, " ", None, [("WDS", "Xã Tân Phú"), ("DST", "Huyện Củ Chi"), ("PRO", "Long An")]),
    ("Phường 5, Quận 3", [("WDS", "Phường 12"), ("DST", "q3")], None, None, "Tỉnh Kiên Giang", [("WDS", "Phường 12"), ("DST", "Quận 3"), ("PRO", "Tỉnh Kiên Giang")]),
    (None, None, None, "Quận 1", None, [("DST", "Quận 1")]),
    ("", [(None, "x"), ("POI", None)], None, None, None, []),
]


def test_repaired_labels(spark):
    df = spark.createDataFrame([(i, *x[:5]) for i, x in enumerate(ROWS)], f"i int, a string, e {RP.ITEMS}, w string, d string, p string")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", RP.repaired_labels(*map(F.col, "aewdp")).alias("x")).collect()}
    assert got == {i: x[5] for i, x in enumerate(ROWS)}


def test_checked_labels(spark):
    rows = [
        ("Phường Bến Nghé, Quận 1", [("WDS", "Phường Bến Nghé"), ("DST", "Quận 1")], [("WDS", "bến nghé"), ("dst", "QUẬN 1")], (True, [], [], [])),
        ("Phường Bến Nghé, Quận 1", [("WDS", "Bến Nghé")], [("WDS", "Phường Bến Nghé"), ("STR", "x")], (False, [], [("STR", "x")], ["missing:DST", "untyped:WDS:Bến Nghé"])),
        ("TP. Hồ Chí Minh", [("STR", "a"), ("STR", "b")], [("STR", "a")], (False, [("STR", "b")], [], ["missing:PRO"])),
        (None, None, None, (True, [], [], [])),
    ]
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(rows)], f"i int, a string, e {RP.ITEMS}, b {RP.ITEMS}")
    for r in df.select("i", RP.checked_labels(F.col("a"), F.col("e"), F.col("b")).alias("x")).collect():
        assert (r.x.passed, [tuple(y) for y in r.x.missing], [tuple(y) for y in r.x.unexpected], r.x.errors) == rows[r.i][3], rows[r.i][0]
