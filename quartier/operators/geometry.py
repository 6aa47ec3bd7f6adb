"""Points and polygons. A ring is an array of (lat, lon); coordinates and buffers are in degrees, distances between places in kilometres."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.operators.relational import latest_per_key
from quartier.operators.retrieval import haversine_km
from quartier.sources.tables import shared_path

#: Widths, in degrees, by which a polygon is widened, one after the other, until it holds a point.
BUFFERS = (0.0005, 0.0015, 0.005)
NEIGHBOUR_KM = 2.0
GEOJSON = "struct<type:string,coordinates:array<array<array<double>>>>"
MULTI = "struct<coordinates:array<array<array<array<double>>>>>"
#: Grid cells that a polygon's box spans at most in each direction, at the level of the grid that it is filed under.
SPAN = 4


def _following(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a ray from the point crosses the edges of the ring, whose last vertex joins its first, an odd number of times."""

    def crosses(a: Column, b: Column) -> Column:
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(F.zip_with(ring, _following(ring), crosses), lambda c: c)) % 2 == 1


def inside_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a point is inside an odd number of rings: inside the outer one and outside its holes, or inside one of several parts."""
    return F.size(F.filter(rings, lambda r: inside(lat, lon, r))) % 2 == 1


def boundary_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Degrees from a point to the nearest edge of a ring."""

    def squared(a: Column, b: Column) -> Column:
        dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
        along = F.coalesce(F.try_divide((lat - a["lat"]) * dy + (lon - a["lon"]) * dx, dy * dy + dx * dx), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.pow(lat - a["lat"] - t * dy, 2) + F.pow(lon - a["lon"] - t * dx, 2)

    return F.sqrt(F.array_min(F.zip_with(ring, _following(ring), squared)))


def rings_distance(lat: Column, lon: Column, rings: Column) -> Column:
    """Degrees from a point to the nearest edge of some rings."""
    return F.array_min(F.transform(rings, lambda r: boundary_distance(lat, lon, r)))


def vertex_mean(ring: Column) -> Column:
    """Mean of a ring's vertices as they are listed, so that a closing vertex counts twice."""
    mean = lambda d: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[d]) / F.size(ring)
    return F.when(F.size(ring) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def rings(geojson: Column) -> Column:
    """Rings of a GeoJSON polygon, or of all parts of a MultiPolygon, holes among them; null for other geometries and for text that is none.

    Vertices are (lon, lat); pairs that can only be (lat, lon), as their second number is beyond 90, are turned round.
    """

    def vertex(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        turned = F.abs(y) > 90
        return F.struct(F.when(turned, x).otherwise(y).alias("lat"), F.when(turned, y).otherwise(x).alias("lon"))

    kind = F.get_json_object(geojson, "$.type")
    flat = F.when(kind == "MultiPolygon", F.flatten(F.from_json(geojson, MULTI)["coordinates"])).when(kind == "Polygon", F.from_json(geojson, GEOJSON)["coordinates"])
    return F.transform(flat, lambda r: F.transform(r, vertex))


def _with_rings(polygons: DataFrame) -> DataFrame:
    """Polygons with `rings`, be it their column or their one `ring`."""
    out = polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))
    return out.drop("ring").filter(F.size(F.flatten("rings")) > 0)


def _cells(df: DataFrame, cell: float, margin: float) -> DataFrame:
    """A row for each grid cell that the box of some rings, widened by a margin, covers.

    The grid has levels, each twice as wide as the one before; a polygon is filed under the first on which its box spans no more than SPAN cells each way. So a large
    one has as few rows as a small one, and the cells that small ones lie close together in are narrow.
    """
    box = df
    for d in ("lat", "lon"):
        values = F.transform(F.flatten("rings"), lambda p: p[d])  # noqa: B023
        box = box.withColumn(f"__{d}0", F.array_min(values) - margin).withColumn(f"__{d}1", F.array_max(values) + margin)
    widest = F.greatest(F.col("__lat1") - F.col("__lat0"), F.col("__lon1") - F.col("__lon0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(widest, F.lit(1e-12)) / (SPAN * cell)))).cast("int")
    box = box.withColumn("__level", level).withColumn("__width", F.pow(F.lit(2.0), "__level") * cell)
    span = lambda d: F.sequence(F.floor(F.col(f"__{d}0") / F.col("__width")), F.floor(F.col(f"__{d}1") / F.col("__width")))
    both = F.flatten(F.transform(span("lat"), lambda x: F.transform(span("lon"), lambda y: F.struct("__level", x.alias("x"), y.alias("y")))))
    return box.withColumn("__cell", F.explode(both)).drop("__lat0", "__lat1", "__lon0", "__lon1", "__level", "__width")


def _met(points: DataFrame, polygons: DataFrame, cell: float, margin: float) -> DataFrame:
    """Points with the polygons whose widened box may hold them: they meet in the cells of those levels, at most some thirty, that polygons are filed under."""
    filed = _cells(_with_rings(polygons), cell, margin)
    levels = sorted(r[0] for r in filed.select("__cell.__level").distinct().collect())
    at = lambda c, n: F.floor(F.col(c) / (cell * 2.0**n))
    own = F.array(*(F.struct(F.lit(n).alias("__level"), at("lat", n).alias("x"), at("lon", n).alias("y")) for n in levels)) if levels else F.array().cast(filed.schema["__cell"].dataType.simpleString().join(("array<", ">")))
    return points.withColumn("__cell", F.explode(own)).join(filed, "__cell").drop("__cell")


def _of_each(body: Callable[[Column, Column, Column], Column]) -> Column:
    """body(lat, lon, rings) of joined rows. Columns that only a nested lambda names may be overlooked when a filter is pushed below a join, so they are bound outside of it."""
    return F.get(F.transform(F.array(F.struct("lat", "lon", "rings")), lambda x: body(x["lat"], x["lon"], x["rings"])), F.lit(0))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points (.., lat, lon) with the polygons (.., ring, or rings with holes and parts) they lie in; they meet by grid cells, the narrowest of a width, then by ray casting."""
    return _met(points, polygons, cell, 0.0).filter(_of_each(inside_rings)).drop("rings")


def near_polygons(points: DataFrame, polygons: DataFrame, cell: float, buffer: float) -> DataFrame:
    """Points with the polygons (`rings`) that hold them or whose boundary is within the buffer, and `degrees`, the distance, 0 inside."""
    d = _of_each(lambda lat, lon, rings: F.when(inside_rings(lat, lon, rings), 0.0).otherwise(rings_distance(lat, lon, rings)))
    return _met(points, polygons, cell, buffer).withColumn("degrees", d).filter(F.col("degrees") <= buffer)


def adaptive_buffer(points: DataFrame, polygons: DataFrame, point: str, unit: str, cell: float, buffers: Sequence[float] = BUFFERS) -> DataFrame:
    """(point, unit, buffer): the polygon that holds a point in the smallest buffer in which any does, of several the one whose centroid is nearest."""
    lat, lon = F.col("lat"), F.col("lon")
    near = near_polygons(points, polygons, cell, max(buffers)).withColumn("c", vertex_mean(F.flatten("rings")))
    width = F.coalesce(*[F.when(F.col("degrees") <= b, F.lit(b)) for b in sorted(buffers)])
    near = near.select(point, unit, width.alias("buffer"), (F.pow(lat - F.col("c.lat"), 2) + F.pow(lon - F.col("c.lon"), 2)).alias("far"))
    return latest_per_key(near, [point], [F.col("buffer"), F.col("far"), F.col(unit)]).select(point, unit, "buffer")


def boundary_distances(points: DataFrame, polygons: DataFrame, point: str, cell: float, most: float) -> DataFrame:
    """(point, degrees): distance to the nearest boundary, of points that are within `most` of one."""
    far = _met(points, polygons, cell, most).select(point, _of_each(rings_distance).alias("degrees"))
    return far.filter(F.col("degrees") <= most).groupBy(point).agg(F.min("degrees").alias("degrees"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other) in both directions, each once, from edges (from_id, to_id)."""
    return edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).union(edges.select("to_id", "from_id")).filter("id IS NOT NULL AND other IS NOT NULL").distinct()


def nearest_neighbour(points: DataFrame, centroids: DataFrame, edges: DataFrame, point: str, km: float = NEIGHBOUR_KM) -> DataFrame:
    """(point, unit, km): of the units one edge away from a point's own, the one whose centroid is nearest, within a radius. points: .., unit, lat, lon; centroids: unit, lat, lon."""
    near = neighbours(edges)
    c = centroids.select(F.col("unit").alias("other"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    far = points.join(near, F.col("unit") == F.col("id")).join(c, "other").withColumn("km", F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")), 6))
    return latest_per_key(far.filter(F.col("km") <= km), [point], [F.col("km"), F.col("other")]).select(point, F.col("other").alias("unit"), "km")


#: Places that a point may meet in the first round of the search for the nearest.
MEETS = 64


def nearest(points: DataFrame, places: DataFrame, point: str, place: str, cell: float, km: float, other: bool = False) -> DataFrame:
    """(point, place, km): the nearest place within a radius, or, with `other`, the nearest that has another id.

    Points on one spot are looked up once, and of places on one spot the first by id takes part (with `other` the first two, as one may be the point's own). The radius grows in rounds, from one in which a
    point meets some MEETS places where they stand densest, up to the whole; a spot that has found its places is done, as others lie farther off. So work follows the points, however many places the radius holds.
    """
    spark, keep = points.sparkSession, 2 if other else 1

    def written(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    there = "lat IS NOT NULL AND lon IS NOT NULL"
    spots = written(points.filter(there).select("lat", "lon").distinct().withColumn("__spot", F.monotonically_increasing_id()), "spots")
    known = places.filter(there).select(place, F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).distinct()
    known = written(known.withColumn("__n", F.row_number().over(W.partitionBy("__lat", "__lon").orderBy(place))).filter(F.col("__n") <= keep).drop("__n"), "places")
    crowd = known.groupBy(F.floor(F.col("__lat") / cell), F.floor(F.col("__lon") / cell)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0
    radii = [km]
    while crowd * (2 * radii[0] / 111.19 / cell) ** 2 > MEETS:
        radii.insert(0, radii[0] / 4)
    open_, found = spots, None
    for radius in radii:
        w = W.partitionBy("__spot").orderBy(F.round("km", 9), place)
        best = _within(open_, known, min(cell, radius / 111.19) if radius < km else cell, radius).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep)
        if radius < km:
            # a place right at the radius may have an equal one behind it
            best = written(best.drop("lat", "lon"), "nearest")
            done = best.filter((F.col("__n") == keep) & (F.col("km") < radius - 1e-6)).select("__spot")
            best, open_ = best.join(done, "__spot", "left_semi"), open_.join(done, "__spot", "left_anti")
        best = best.select("__spot", place, "km")
        found = best if found is None else found.unionByName(best)
    each = points.select(point, "lat", "lon").join(spots.hint("merge"), ["lat", "lon"]).select(point, "__spot").join(found.hint("merge"), "__spot")
    each = each.filter(F.col(point) != F.col(place)) if other else each
    return latest_per_key(each, [point], [F.round("km", 9), F.col(place)]).select(point, place, "km")


def _within(points: DataFrame, places: DataFrame, cell: float, km: float) -> DataFrame:
    """Points (.., lat, lon) with the places (.., __lat, __lon) within a radius and their distance `km`. They meet by grid cells; cells are narrower in longitude than they look, so the
    search is widened by latitude, and it goes on behind the 180th meridian."""
    degrees = km / 111.19
    reach = F.abs(F.col("lat")) + degrees
    wide = F.when(reach >= 89.999999, 180.0).otherwise(F.least(F.lit(180.0), degrees / F.cos(F.radians(reach))))
    at = lambda c: F.floor(c / cell)

    def columns(turn: float) -> Column:
        low, high = F.greatest(F.col("lon") - wide + turn, F.lit(-180.0)), F.least(F.col("lon") + wide + turn, F.lit(180.0))
        return F.when(low <= high, F.sequence(at(low), at(F.greatest(low, high)))).otherwise(F.array().cast("array<bigint>"))

    lons = F.array_distinct(F.concat(*(columns(turn) for turn in (0.0, -360.0, 360.0))))
    cells = F.flatten(F.transform(F.sequence(at(F.col("lat") - degrees), at(F.col("lat") + degrees)), lambda x: F.transform(lons, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    spread_ = points.withColumn("__cell", F.explode(cells))
    p = places.withColumn("__cell", F.struct(at(F.col("__lat")).alias("x"), at(F.col("__lon")).alias("y")))
    return spread_.join(p.hint("shuffle_hash"), "__cell").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))).filter(F.col("km") <= km)


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Vertices of the convex hull by Andrew's monotone chain, from the least one against the clock in (lon, lat)."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hulls(points: DataFrame, unit: str) -> DataFrame:
    """(unit, n_vertices, ring) of the points (.., unit, lat, lon) of each unit that has at least three vertices.

    Each task reduces its own points to hulls first, and only their vertices are shuffled, so a unit with very many points costs no more than others.
    """
    kind = points.schema[unit].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for u, own in batch.groupby("unit", dropna=True):
                held[u] = _hull([*held.get(u, ()), *zip(own["lon"], own["lat"], strict=True)])
        rows = [(u, x, y) for u, h in held.items() for x, y in h]
        yield pd.DataFrame(rows, columns=["unit", "lon", "lat"])

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        h = _hull(list(zip(own["lon"], own["lat"], strict=True)))
        return pd.DataFrame([(own["unit"].iloc[0], len(h), [{"lat": y, "lon": x} for x, y in h])] if len(h) > 2 else [], columns=["unit", "n_vertices", "ring"])

    some = points.select(F.col(unit).alias("unit"), F.col("lon").cast("double"), F.col("lat").cast("double")).dropna()
    few = some.mapInPandas(partial, f"unit {kind}, lon double, lat double")
    return few.groupBy("unit").applyInPandas(whole, f"unit {kind}, n_vertices int, ring array<struct<lat:double,lon:double>>").withColumnRenamed("unit", unit)


#: Cells, each way, of the grid over a unit's box of which the points are first reduced to hulls.
GRID = 64


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the area of triangles, positive against the clock."""
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def _cuts(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether the line from a to b crosses one of those from c to d inside both."""
    return bool(((_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0)).any())


def dug_hull(cells: list[list[tuple[float, float]]], share: float) -> list[tuple[float, float]]:
    """Vertices of a hull of all points in some convex cells (vertices of each, in order), whose area is no less than a share of the convex hull's.

    From the longest on, each edge is drawn in to the point nearest to it, of those that lie beside it, as long as no cell and no other edge is cut and the share is kept; the two
    new edges follow. Between an edge and the nearest point beside it there is no other, so all points stay inside.
    """
    ring = _hull([p for c in cells for p in c])
    if len(ring) < 3:
        return ring
    points = np.array(sorted({p for c in cells for p in c}))
    ends = [(np.array(c), np.roll(np.array(c), -1, axis=0)) for c in cells if len(c) > 1]
    starts, stops = (np.concatenate([e[i] for e in ends]) if ends else np.zeros((0, 2)) for i in (0, 1))
    solid = [e for e in ends if len(e[0]) > 2]
    area = _area(np.array(ring))
    least = share * area
    following = {p: ring[(i + 1) % len(ring)] for i, p in enumerate(ring)}
    length = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    heap = [(-length(a, b), a, b) for a, b in following.items()]
    heapify(heap)
    while heap:
        _, a, b = heappop(heap)
        if following.get(a) != b:
            continue
        u, v = np.array(a), np.array(b)
        along = ((points - u) @ (v - u)) / max(float((v - u) @ (v - u)), 1e-300)
        height = _cross(u, v, points)
        # points on the edge itself, but for rounding, come first and cost no area
        height[np.abs(height) < 1e-12 * max(float((v - u) @ (v - u)), 1e-12)] = 0.0
        beside = np.flatnonzero((along > 0) & (along < 1) & (height >= 0))
        if not len(beside):
            continue
        p = tuple(points[beside[np.lexsort((along[beside], height[beside]))[0]]].tolist())
        gone = float(height[beside].min()) / 2
        if p in following or area - gone < least:
            continue
        w, tail, head = np.array(p), np.array(list(following)), np.array(list(following.values()))
        middles = np.array([(u + w) / 2, (v + w) / 2])
        if any(_cuts(x, w, tail, head) or _cuts(x, w, starts, stops) for x in (u, v)) or any((_cross(s, e, m) > 0).all() for s, e in solid for m in middles):
            continue
        following[a], following[p], area = p, b, area - gone
        for x, y in ((a, p), (p, b)):
            heappush(heap, (-length(x, y), x, y))
    out = [ring[0]]
    while following[out[-1]] != ring[0]:
        out.append(following[out[-1]])
    return out


def concave_hulls(points: DataFrame, unit: str, share: float = 0.95) -> DataFrame:
    """(unit, n_points, n_vertices, share, ring) of the points (.., unit, lat, lon) of each unit that has three at least, not all in a line: a hull as small as `dug_hull` makes it.

    A unit's box is cut into GRID by GRID cells, and each task, then each cell, is reduced to its convex hull, so what comes together for a unit is bounded by the grid.
    """
    kind = points.schema[unit].dataType.simpleString()
    some = points.select(F.col(unit).alias("unit"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).dropna()
    box = some.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}{i}") for c in ("lon", "lat") for i, f in enumerate((F.min, F.max))))
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")) * GRID), F.lit(GRID - 1)), F.lit(0))
    dealt = some.join(box.filter("n >= 3"), "unit").select("unit", "n", (place("lon") * GRID + place("lat")).cast("int").alias("cell"), "lon", "lat")
    keys = ["unit", "n", "cell"]

    def reduced(own: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, x, y) for key, cell in own.groupby(keys, dropna=False) for x, y in _hull(list(zip(cell["lon"], cell["lat"], strict=True)))]
        return pd.DataFrame(rows, columns=[*keys, "lon", "lat"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield reduced(batch)

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        cells = [_hull(list(zip(c["lon"], c["lat"], strict=True))) for _, c in own.groupby("cell")]
        ring, n = dug_hull(cells, share), int(own["n"].iloc[0])
        full = _hull([p for c in cells for p in c])
        rows = [(own["unit"].iloc[0], n, len(ring), _area(np.array(ring)) / _area(np.array(full)), [{"lat": y, "lon": x} for x, y in ring])] if len(ring) > 2 else []
        return pd.DataFrame(rows, columns=["unit", "n_points", "n_vertices", "share", "ring"])

    row = f"unit {kind}, n bigint, cell int, lon double, lat double"
    once = dealt.mapInPandas(partial, row).groupBy(*keys).applyInPandas(reduced, row)
    return once.groupBy("unit").applyInPandas(whole, f"unit {kind}, n_points bigint, n_vertices int, share double, ring array<struct<lat:double,lon:double>>").withColumnRenamed("unit", unit)


def spatial_mismatch(points: DataFrame, polygons: DataFrame, centroids: DataFrame, edges: DataFrame, point: str, cell: float, buffers: Sequence[float] = BUFFERS, km: float = NEIGHBOUR_KM, hull_share: float | None = None) -> DataFrame:
    """(point, unit, found, status, corrected): where points lie against the unit that they are filed under.

    found is the polygon a point lies in, by least id; status is bad (no coordinates), matched, mismatched or undetected. What doesn't match is corrected by the
    polygon that holds it in a buffer; else, with `hull_share`, to its own unit, if the concave hull of that unit's matched points holds it; else by the nearest
    neighbouring unit's centroid, else not (corrected is null).
    """
    good = points.filter("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    own = polygons.withColumnRenamed("unit", "found")
    hit = points_in_polygons(good.select(point, "lat", "lon"), own, cell).groupBy(point).agg(F.min("found").alias("found"))
    seen = points.join(hit, point, "left").join(good.select(point, F.lit(True).alias("__good")), point, "left")
    status = F.when(F.col("__good").isNull(), "bad").when(F.col("found").isNull(), "undetected").when(F.col("found").eqNullSafe(F.col("unit")), "matched").otherwise("mismatched")
    seen = seen.withColumn("status", status)
    # a point found in another polygon is corrected to that one, whose buffer of any width holds it
    open_ = seen.filter("status IN ('undetected', 'mismatched')").select(point, "unit", "lat", "lon")
    buffered = adaptive_buffer(open_.select(point, "lat", "lon"), own.withColumnRenamed("found", "by_buffer"), point, "by_buffer", cell, buffers).drop("buffer")
    injected = nearest_neighbour(open_, centroids, edges, point, km).select(point, F.col("unit").alias("by_neighbour"))
    steps = [buffered]
    if hull_share is not None:
        hulls = concave_hulls(seen.filter("status = 'matched'").select("unit", "lat", "lon"), "unit", hull_share).select(F.col("unit").alias("by_hull"), "ring")
        steps.append(points_in_polygons(open_, hulls, cell).filter("unit = by_hull").select(point, "by_hull"))
    out = seen
    for step in (*steps, injected):
        out = out.join(step, point, "left")
    return out.select(point, "unit", "found", "status", F.coalesce(*(step.columns[1] for step in (*steps, injected))).alias("corrected"))


def mismatch_summary(report: DataFrame) -> DataFrame:
    """One row: counts by status, what was corrected and what wasn't, accuracy among points with coordinates and correction rate among those that don't match."""
    wrong = F.col("status").isin("mismatched", "undetected")
    n = report.agg(F.count(F.lit(1)).alias("n_points"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("bad", "matched", "mismatched", "undetected")], F.count_if(wrong & F.col("corrected").isNotNull()).alias("n_corrected"), F.count_if(wrong & F.col("corrected").isNull()).alias("n_uncorrectable"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return n.withColumns({"accuracy": rate(F.col("n_matched"), F.col("n_points") - F.col("n_bad")), "correction_rate": rate(F.col("n_corrected"), F.col("n_mismatched") + F.col("n_undetected"))})
