"""Point-to-area operators: boxes, nearest centres, polygons.

Points are looked up by place: equal coordinates are one lookup, and the result is joined back to all rows that have
them, so ids may repeat or be null. Null and non-finite coordinates belong to no area. Short area lists (checked by
count) become one array constant that is scanned per point, so points are never shuffled. Longer lists go through a
grid with the same results: areas and places meet on equal cell numbers, never as all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.session import materialize, one_row, small_table

SHORT_LIST = 256


def short_rows(df: DataFrame, columns: list[str], limit: int) -> list | None:
    """The rows of a dimension with at most ``limit`` rows, else None; reads ``limit + 1`` rows at most."""
    rows = df.select(*columns).limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _as_array(rows: list, columns: list[str]) -> Column:
    """Rows as one array constant of structs."""
    return F.array(*[F.struct(*[F.lit(row[c]).alias(c) for c in columns]) for row in rows])


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _with_box_cells(boxes: DataFrame, size: float) -> DataFrame:
    """One row per grid cell a box touches."""
    return boxes.withColumn(
        "_cy", F.explode(F.sequence(_cell(F.col("lat_min"), size), _cell(F.col("lat_max"), size)))
    ).withColumn("_cx", F.explode(F.sequence(_cell(F.col("lon_min"), size), _cell(F.col("lon_max"), size))))


def _with_point_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("_cy", _cell(F.col("lat"), size)).withColumn("_cx", _cell(F.col("lon"), size))


def _placed() -> Column:
    """Both coordinates are known and finite."""
    return (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))


def _spots(points: DataFrame) -> DataFrame:
    """Each pair of coordinates once."""
    return points.select("lat", "lon").filter(_placed()).distinct()


def _with_found(points: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return points.join(found.select("lat", "lon", name), ["lat", "lon"], "left").select(*points.columns, name)


def box_lookup(points: DataFrame, boxes: DataFrame, cell: float = 0.5, short_limit: int = SHORT_LIST) -> DataFrame:
    """``box_county`` of each point: the box with the lowest ``ord`` that holds it, bounds included; else null."""
    def holds(b) -> Column:
        return F.col("lat").between(b["lat_min"], b["lat_max"]) & F.col("lon").between(b["lon_min"], b["lon_max"])

    columns = ["ord", "county", "lat_min", "lat_max", "lon_min", "lon_max"]
    rows = short_rows(boxes, columns, short_limit)
    if rows:
        return points.withColumn("box_county", F.array_min(F.filter(_as_array(rows, columns), holds))["county"])
    met = _with_point_cell(_spots(points), cell).join(_with_box_cells(boxes.select(*columns), cell), ["_cy", "_cx"])
    found = met.filter(holds({c: F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")})).groupBy("lat", "lon").agg(
        F.min(F.struct("ord", "county"))["county"].alias("box_county")
    )
    return _with_found(points, found, "box_county")


def nearest_center(points: DataFrame, centers: DataFrame, cell: float = 0.25, short_limit: int = SHORT_LIST) -> DataFrame:
    """``near_county`` of each point: smallest squared degree distance, lowest ``ord`` on ties."""
    def squared(c) -> Column:
        return (F.col("lat") - c["lat"]) * (F.col("lat") - c["lat"]) + (F.col("lon") - c["lon"]) * (F.col("lon") - c["lon"])

    columns = ["ord", "county", "lat", "lon"]
    placed = centers.filter(_placed())
    rows = short_rows(placed, columns, short_limit)
    if rows:
        best = F.array_min(F.transform(_as_array(rows, columns), lambda c: F.struct(
            squared(c).alias("d"), c["ord"].alias("ord"), c["county"].alias("county")
        )))
        return points.withColumn("near_county", F.when(_placed(), best["county"]))
    return _with_found(points, _nearest_by_grid(_spots(points), placed, cell), "near_county")


def _nearest_by_grid(spots: DataFrame, centers: DataFrame, cell: float) -> DataFrame:
    """Nearest centre of each place by a descent through coarser to finer cells, each 4 x 4 of the next.

    A cell knows the bounds of the centres in it, so the distance of its nearest centre lies between two values. On
    each level a place keeps the cells that can still win, and only those are opened: a far-off place meets few cells,
    never all centres.
    """
    leaf = materialize(
        centers.groupBy("lat", "lon").agg(F.min(F.struct("ord", "county")).alias("first"))
        .select(F.col("lat").alias("clat"), F.col("lon").alias("clon"), "first",
                _cell(F.col("lat"), cell).alias("_cy"), _cell(F.col("lon"), cell).alias("_cx")), "centers",
    )
    reach = one_row(leaf.agg(F.max(F.greatest(F.abs("clat"), F.abs("clon"))).alias("reach")))["reach"]
    level, width = 0, cell
    while reach is not None and width <= reach:  # at the top only the cells -1 and 0 are used
        level, width = level + 1, width * 4

    def up(axis: str, levels: int) -> Column:
        return F.shiftright(axis, 2 * levels)

    corners = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    kept = spots.withColumn("_py", F.explode(corners)).withColumn("_px", F.explode(corners))
    place = Window.partitionBy("lat", "lon")
    for k in range(level, -1, -1):
        boxes = leaf.groupBy(up("_cy", k).alias("_cy"), up("_cx", k).alias("_cx")).agg(
            F.min("clat").alias("y0"), F.max("clat").alias("y1"), F.min("clon").alias("x0"), F.max("clon").alias("x1")
        ).withColumn("_py", up("_cy", 1)).withColumn("_px", up("_cx", 1))
        met = kept.join(boxes, ["_py", "_px"])
        near = [F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0)) for v, lo, hi in (("lat", "y0", "y1"), ("lon", "x0", "x1"))]
        far = [F.greatest(F.abs(F.col(lo) - F.col(v)), F.abs(F.col(v) - F.col(hi))) for v, lo, hi in (("lat", "y0", "y1"), ("lon", "x0", "x1"))]
        bound = F.min(far[0] * far[0] + far[1] * far[1]).over(place)
        # the small margin keeps cells whose bounds differ by rounding only
        open_cells = met.withColumn("_near", near[0] * near[0] + near[1] * near[1]).withColumn("_bound", bound)
        kept = open_cells.filter(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).select(
            "lat", "lon", F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
    dlat, dlon = F.col("lat") - F.col("clat"), F.col("lon") - F.col("clon")
    hits = kept.withColumnsRenamed({"_py": "_cy", "_px": "_cx"}).join(leaf, ["_cy", "_cx"])
    best = F.min(F.struct((dlat * dlat + dlon * dlon).alias("d"), F.col("first.ord").alias("ord"), F.col("first.county").alias("county")))
    return hits.groupBy("lat", "lon").agg(best["county"].alias("near_county"))


def locate(points: DataFrame, boxes: DataFrame, centers: DataFrame) -> DataFrame:
    """Place of each point: its box, else the nearest centre."""
    found = nearest_center(box_lookup(points, boxes), centers)
    return found.withColumn("county", F.coalesce("box_county", "near_county"))


# --- polygons ---------------------------------------------------------------

POLYGON_TYPE = "array<array<array<double>>>"
MULTI_TYPE = "array<array<array<array<double>>>>"


def polygon_rings(features: DataFrame) -> DataFrame:
    """``rings`` from GeoJSON-style ``type`` and ``coordinates`` text: all rings of all parts."""
    return features.withColumn(
        "rings",
        F.when(F.col("type") == "Polygon", F.from_json("coordinates", POLYGON_TYPE))
        .otherwise(F.flatten(F.from_json("coordinates", MULTI_TYPE))),
    )


def _edges(ring: Column) -> Column:
    """Each vertex with the one before it, the first with the last."""
    before = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.size(ring) - 1))
    return F.zip_with(ring, before, lambda p, q: F.struct(
        p[0].alias("xi"), p[1].alias("yi"), q[0].alias("xj"), q[1].alias("yj")
    ))


def _crossed(edge: Column, lon: Column, lat: Column) -> Column:
    at = F.try_divide((edge["xj"] - edge["xi"]) * (lat - edge["yi"]), edge["yj"] - edge["yi"]) + edge["xi"]
    return ((edge["yi"] > lat) != (edge["yj"] > lat)) & (lon < at)


def polygon_lookup(points: DataFrame, polygons: DataFrame, tracked: list[str] | None = None, cell: float = 0.5) -> DataFrame:
    """First polygon (lowest ``ord``) with any ring around the point, by ray casting.

    Polygons enter the grid by bounding box, and a cell takes only the edges that
    reach its band of latitudes: no other edge can be crossed there. Only places in
    a shared cell and inside the box are tested. ``status`` is ``in-range`` for tracked names.
    """
    flat = F.flatten("rings")
    shapes = polygons.select(
        "ord", "name", F.transform("rings", _edges).alias("_ring_edges"),
        F.array_min(F.transform(flat, lambda p: p[1])).alias("lat_min"),
        F.array_max(F.transform(flat, lambda p: p[1])).alias("lat_max"),
        F.array_min(F.transform(flat, lambda p: p[0])).alias("lon_min"),
        F.array_max(F.transform(flat, lambda p: p[0])).alias("lon_max"),
    )
    low, high = (F.col("_cy") - 1e-6) * cell, (F.col("_cy") + 1 + 1e-6) * cell
    cells = _with_box_cells(shapes, cell).withColumn("_ring_edges", F.transform("_ring_edges", lambda edges: F.filter(
        edges, lambda e: (F.greatest(e["yi"], e["yj"]) >= low) & (F.least(e["yi"], e["yj"]) <= high)
    )))
    met = _with_point_cell(_spots(points), cell).join(cells, ["_cy", "_cx"])
    inside = F.exists("_ring_edges", lambda edges: F.size(
        F.filter(edges, lambda e: _crossed(e, F.col("lon"), F.col("lat")))
    ) % 2 == 1)
    found = (
        met.filter(F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
                   & F.col("lon").between(F.col("lon_min"), F.col("lon_max")))
        .filter(inside).groupBy("lat", "lon").agg(F.min(F.struct("ord", "name"))["name"].alias("area"))
    )
    out = _with_found(points, found, "area")
    known = F.col("area").isNotNull() if tracked is None else F.coalesce(F.col("area").isin(tracked), F.lit(False))
    return out.withColumn("status", F.when(known, F.lit("in-range")).otherwise(F.lit("out-of-range"))).withColumn(
        "county", F.when(known, F.col("area"))
    )


def ring_center(polygons: DataFrame) -> DataFrame:
    """Mean vertex of the first ring; a repeated closing vertex counts twice."""
    ring = F.col("rings")[0]

    def mean(i: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[i]) / F.size(ring)

    return polygons.select("name", mean(1).alias("lat"), mean(0).alias("lon"))


def fixed_boxes(spark) -> DataFrame:
    return small_table(
        spark, C.COUNTY_BOXES, "ord int, county string, lat_min double, lat_max double, lon_min double, lon_max double"
    )


def fixed_centers(spark) -> DataFrame:
    rows = [(i, county, fips, lat, lon) for i, (county, fips, lat, lon) in enumerate(C.COUNTY_META)]
    return small_table(spark, rows, "ord int, county string, fips string, lat double, lon double")
