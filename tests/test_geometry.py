"""Hulls, polygons with holes and parts, and the 180th meridian, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.operators import geometry as G


def crossings(lat, lon, ring):
    n = 0
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return n


def on_edge(lat, lon, ring):
    return any(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-9 and min(x1, x2) - 1e-9 <= lon <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= lat <= max(y1, y2) + 1e-9 for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True))


def area(ring):
    return abs(sum(y1 * x2 - y2 * x1 for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def simple(ring):
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    return not any(cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0 for i, (a, b) in enumerate(edges) for c, d in edges[:i])


def shapes():
    r = random.Random(3)
    ell = [(y, x) for y, x in ((r.uniform(0, 10), r.uniform(0, 10)) for _ in range(900)) if y < 4 or x < 4]
    ring = [(float(np.sin(a)) * d, float(np.cos(a)) * d) for a, d in ((r.uniform(0, 4.5), r.uniform(3, 5)) for _ in range(500))]
    return {1: ell, 2: ring, 3: [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(300)], 4: [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], 5: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], 6: [(1.0, 1.0)] * 9, 7: [(0.0, 0.0), (5.0, 1.0)], 8: [(float(y), float(x)) for y in range(6) for x in range(6)]}


@pytest.mark.parametrize("grid, share", [(64, 0.5), (3, 0.5), (64, 0.95), (1, 0.6)])
def test_concave_hulls(spark, monkeypatch, grid, share):
    monkeypatch.setattr(G, "GRID", grid)
    rows = [(u, y, x) for u, ps in shapes().items() for y, x in ps] + [(1, None, 2.0), (None, 0.0, 1.0)]
    random.Random(1).shuffle(rows)
    got = {r.u: r for r in G.concave_hulls(spark.createDataFrame(rows, "u int, lat double, lon double").repartition(5), "u", share).collect()}
    assert set(got) == {1, 2, 3, 4, 8}
    for u, r in got.items():
        ring, points = [(p.lat, p.lon) for p in r.ring], shapes()[u]
        assert r.n_vertices == len(ring) == len(set(ring)) and r.n_points == len(points) and set(ring) <= set(points)
        assert simple(ring) and all(crossings(y, x, ring) % 2 or on_edge(y, x, ring) for y, x in points)
        convex = G._hull([(x, y) for y, x in points])
        assert r.share == pytest.approx(area(ring) / area([(y, x) for x, y in convex])) and share - 1e-9 <= r.share <= 1 + 1e-9
    assert got[4].share == pytest.approx(1) and got[8].share == pytest.approx(1)
    if grid == 64 and share == 0.5:
        assert got[1].share < 0.85 and got[2].share < 0.8


SQUARE = lambda y, x, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]


def test_rings_of_geometries(spark):
    rows = [(1, str({"type": "MultiPolygon", "coordinates": [[SQUARE(0, 0, 4), SQUARE(1, 1, 2)], [SQUARE(10, 10, 1)]]}).replace("'", '"')), (2, str({"type": "Polygon", "coordinates": [SQUARE(0, 100, 4)]}).replace("'", '"')), (3, '{"type": "Point", "coordinates": [1, 2]}'), (4, "no json"), (5, None)]
    df = spark.createDataFrame(rows, "u int, j string").withColumn("rings", G.rings(F.col("j")))
    assert {r.u: None if r.rings is None else [len(x) for x in r.rings] for r in df.collect()} == {1: [5, 5, 5], 2: [5], 3: None, 4: None, 5: None}
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 10.5, 10.5), (4, 1.0, 101.0), (5, 50.0, 50.0)], "p int, lat double, lon double")
    for cell in (0.01, 1.0, 500.0):
        got = G.points_in_polygons(points, df.select("u", "rings"), cell).select("p", "u").collect()
        assert sorted(tuple(x) for x in got) == [(1, 1), (3, 1), (4, 2)]
    assert G.points_in_polygons(points, df.select("u", "rings").limit(0), 1.0).collect() == []
    near = {(r.p, r.u): round(r.degrees, 6) for r in G.near_polygons(points, df.select("u", "rings"), 1.0, 1.5).collect()}
    assert near == {(1, 1): 0.0, (2, 1): 1.0, (3, 1): 0.0, (4, 2): 0.0}


def test_polygons_of_all_sizes_meet_few_cells(spark):
    """A polygon has as few rows whatever its size, and results are those of all pairs."""
    r = random.Random(4)
    boxes = [(i, *c) for i, c in enumerate([(-80.0, -170.0, 160.0)] + [(r.uniform(-60, 50), r.uniform(-150, 140), r.choice([0.01, 0.3, 5.0, 30.0])) for _ in range(60)])]
    polygons = spark.createDataFrame([(i, [(y, x), (y, x + n), (y + n, x + n), (y + n, x)]) for i, y, x, n in boxes], "u int, ring array<struct<lat:double,lon:double>>")
    assert max(r["count"] for r in G._cells(G._with_rings(polygons), 0.01, 0.0).groupBy("u").count().collect()) <= (G.SPAN + 1) ** 2
    points = [(k, r.uniform(-60, 60), r.uniform(-150, 150)) for k in range(300)]
    got = G.points_in_polygons(spark.createDataFrame(points, "p int, lat double, lon double"), polygons, 0.01).select("p", "u").collect()
    assert {tuple(x) for x in got} == {(k, i) for k, a, b in points for i, y, x, n in boxes if y < a < y + n and x < b < x + n}


def test_nearest_behind_the_meridian(spark):
    p = spark.createDataFrame([(1, 0.0, 179.95), (2, 0.0, -179.95), (3, 89.9, 10.0), (4, 10.0, 20.0)], "p int, lat double, lon double")
    q = spark.createDataFrame([(7, 0.0, -179.99), (8, 0.01, 179.9), (9, 89.95, -170.0)], "q int, lat double, lon double")
    got = {r.p: (r.q, round(r.km, 1)) for r in G.nearest(p, q, "p", "q", 1.0, 30.0).collect()}
    assert got == {1: (8, 5.7), 2: (7, 4.4), 3: (9, 16.7)}


def test_mismatch_with_hulls(spark):
    """A point outside its unit's polygon, and outside every buffer, comes back to its unit if that unit's matched points surround it."""
    u = [(1, [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]]), (2, [[(0.0, 20.0), (0.0, 30.0), (10.0, 30.0), (10.0, 20.0)]])]
    polygons = spark.createDataFrame(u, "unit int, rings array<array<struct<lat:double,lon:double>>>")
    rows = [(i, 1, y, x) for i, (y, x) in enumerate([(1.0, 1.0), (1.0, 9.0), (9.0, 9.0), (9.0, 1.0)])] + [(10, 1, 5.0, 5.0), (11, 2, 5.0, 15.0), (12, 1, 5.0, 25.0), (13, 1, None, 1.0), (14, 1, 50.0, 50.0)]
    points = spark.createDataFrame(rows, "point int, unit int, lat double, lon double")
    centroids = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 25.0)], "unit int, lat double, lon double")
    none = spark.createDataFrame([], "from_id int, to_id int")
    got = {r.point: (r.found, r.status, r.corrected) for r in G.spatial_mismatch(points, polygons, centroids, none, "point", 1.0, hull_share=0.9).collect() if r.point > 9}
    assert got == {10: (None, "undetected", 1), 11: (None, "undetected", None), 12: (2, "mismatched", 2), 13: (None, "bad", None), 14: (None, "undetected", None)}
