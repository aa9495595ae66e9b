"""Point lookups and graph operators against brute force."""

import math
import random

import pytest

from panelwatch import constants as C
from panelwatch.operators import geo, graph

POINTS = "id long, lat double, lon double"


def random_points(n=400, seed=5):
    rng = random.Random(seed)
    points = [(i, round(rng.uniform(34.4, 38.6), 2), round(rng.uniform(-122, -117.4), 2)) for i in range(n)]
    # bounds, an overlap of three boxes, a far point
    return points + [(n, 34.79, -119.95), (n + 1, 37.0, -120.2), (n + 2, 80.0, 179.0), (n + 3, -60.0, -179.0)]


def brute_box(lat, lon):
    for _, county, a, b, c, d in C.COUNTY_BOXES:
        if a <= lat <= b and c <= lon <= d:
            return county
    return None


def brute_near(lat, lon, centers):
    return min((((lat - y) ** 2 + (lon - x) ** 2), o, name) for o, name, y, x in centers)[2]


@pytest.mark.parametrize("limit", [geo.SHORT_LIST, 0])
def test_first_box_wins(spark, limit):
    points = random_points()
    df = geo.box_lookup(spark.createDataFrame(points, POINTS), geo.fixed_boxes(spark), short_limit=limit)
    got = {r.id: r.box_county for r in df.collect()}
    assert got == {i: brute_box(lat, lon) for i, lat, lon in points}


@pytest.mark.parametrize("limit", [geo.SHORT_LIST, 0])
def test_nearest_center(spark, limit):
    points = random_points()
    centers = [(i, county, lat, lon) for i, (county, _, lat, lon) in enumerate(C.COUNTY_META)]
    df = geo.nearest_center(spark.createDataFrame(points, POINTS), geo.fixed_centers(spark), short_limit=limit)
    got = {r.id: r.near_county for r in df.collect()}
    assert got == {i: brute_near(lat, lon, centers) for i, lat, lon in points}


@pytest.mark.parametrize("limit", [geo.SHORT_LIST, 0])
def test_nearest_center_ties_take_the_first(spark, limit):
    centers = spark.createDataFrame([(1, "b", 1.0, 0.0), (0, "a", -1.0, 0.0)], "ord int, county string, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0)], POINTS)
    got = {r.id: r.near_county for r in geo.nearest_center(points, centers, short_limit=limit).collect()}
    assert got == {1: "a", 2: "b"}


@pytest.mark.parametrize("limit", [geo.SHORT_LIST, 0])
def test_null_and_repeated_points(spark, limit):
    points = spark.createDataFrame(
        [(1, 36.7, -119.8), (1, 35.3, -119.0), (2, None, -119.8), (None, 36.7, -119.8), (3, float("nan"), 1.0), (3, 36.7, None)], POINTS)
    found = geo.nearest_center(geo.box_lookup(points, geo.fixed_boxes(spark), short_limit=limit), geo.fixed_centers(spark), short_limit=limit)
    assert found.columns == ["id", "lat", "lon", "box_county", "near_county"]
    centers = [(i, county, lat, lon) for i, (county, _, lat, lon) in enumerate(C.COUNTY_META)]
    known = [(i, brute_box(y, x), brute_near(y, x, centers)) for i, y, x in ((1, 36.7, -119.8), (1, 35.3, -119.0), (None, 36.7, -119.8))]
    got = [(r.id, r.box_county, r.near_county) for r in found.collect()]
    assert sorted(got, key=str) == sorted(known + [(2, None, None), (3, None, None), (3, None, None)], key=str)


def test_nearest_of_many_centers_from_far_off(spark):
    rng = random.Random(11)
    centers = [(i, f"c{i}", round(rng.uniform(-60, 60), 1), round(rng.gauss(20, 15), 1)) for i in range(600)]
    points = [(i, round(rng.uniform(-90, 90), 1), round(rng.uniform(-180, 180), 1)) for i in range(150)] + [(150, 5000.0, -9000.0)]
    df = geo.nearest_center(spark.createDataFrame(points, POINTS), spark.createDataFrame(centers, "ord int, county string, lat double, lon double"))
    assert {r.id: r.near_county for r in df.collect()} == {i: brute_near(y, x, centers) for i, y, x in points}


def test_no_centers_or_boxes(spark):
    points = spark.createDataFrame([(1, 36.7, -119.8)], POINTS)
    found = geo.locate(points, geo.fixed_boxes(spark).limit(0), geo.fixed_centers(spark).limit(0))
    assert [tuple(r) for r in found.collect()] == [(1, 36.7, -119.8, None, None, None)]


def inside(px, py, ring):
    odd, j = False, len(ring) - 1
    for i, (xi, yi) in enumerate(ring):
        xj, yj = ring[j]
        if (yi > py) != (yj > py) and px < (xj - xi) * (py - yi) / (yj - yi) + xi:
            odd = not odd
        j = i
    return odd


def test_polygons_with_holes_parts_and_order(spark):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    part = [(6.0, 6.0), (8.0, 6.0), (7.0, 9.0), (6.0, 6.0)]

    def text(rings):
        return str([[list(p) for p in ring] for ring in rings])

    shapes = spark.createDataFrame([
        (1, "late", "Polygon", text([[(-1.0, -1.0), (9.0, -1.0), (9.0, 9.0), (-1.0, 9.0), (-1.0, -1.0)]])),
        (0, "holed", "MultiPolygon", "[" + text([outer, hole]) + "," + text([part]) + "]"),
    ], "ord int, name string, type string, coordinates string")
    rng = random.Random(1)
    points = [(i, rng.uniform(-2, 10), rng.uniform(-2, 10)) for i in range(300)] + [(300, 1.5, 1.5), (301, 0.0, 0.0)]
    got = {r.id: (r.area, r.status, r.county) for r in geo.polygon_lookup(
        spark.createDataFrame(points, POINTS), geo.polygon_rings(shapes), ["holed"]).collect()}
    for i, lat, lon in points:
        if any(inside(lon, lat, ring) for ring in (outer, hole, part)):
            want = ("holed", "in-range", "holed")
        elif inside(lon, lat, [(-1.0, -1.0), (9.0, -1.0), (9.0, 9.0), (-1.0, 9.0), (-1.0, -1.0)]):
            want = ("late", "out-of-range", None)
        else:
            want = (None, "out-of-range", None)
        assert got[i] == want
    assert got[300][0] == "holed"  # a hole counts as inside
    center = {r.name: (r.lat, r.lon) for r in geo.ring_center(geo.polygon_rings(shapes)).collect()}
    assert center["holed"] == pytest.approx((8 / 5, 8 / 5))


def test_adjacency_of_the_fixed_graph(spark):
    edges = spark.createDataFrame(C.COUNTY_EDGES, "src string, dst string")
    degree = {r.node: r.degree for r in graph.degrees(edges).collect()}
    assert degree == {"Fresno": 5, "Kern": 3, "Kings": 4, "Madera": 3, "Merced": 5, "San Joaquin": 3, "Stanislaus": 3, "Tulare": 4}
    weights = {(r.src, r.dst): r.w for r in graph.normalized_adjacency(edges).collect()}
    assert len(weights) == 30
    for (a, b), w in weights.items():
        assert w == pytest.approx(1 / math.sqrt(degree[a] * degree[b])) and weights[(b, a)] == pytest.approx(w)


def test_neighbor_features_are_a_matrix_product(spark):
    edges = spark.createDataFrame(C.COUNTY_EDGES, "src string, dst string")
    weights = graph.normalized_adjacency(edges)
    values = {(row[0], t): float(i + t) for i, row in enumerate(C.COUNTY_META) for t in (1, 2)}
    panel = spark.createDataFrame([(c, t, v) for (c, t), v in values.items()], "county string, t int, x double")
    got = {(r.county, r.t): r.nb_x for r in graph.neighbor_features(weights, panel, ["x"]).collect()}
    matrix = {(r.src, r.dst): r.w for r in weights.collect()}
    for (c, t), v in got.items():
        assert v == pytest.approx(sum(w * values[(d, t)] for (s, d), w in matrix.items() if s == c))


def test_isolated_node_keeps_its_loop(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {(r.src, r.dst): r.w for r in graph.normalized_adjacency(edges, nodes).collect()}
    assert got[("c", "c")] == 1.0 and len(got) == 5


def test_fixed_edges_match_places():
    names = {row[0] for row in C.COUNTY_META}
    assert {n for edge in C.COUNTY_EDGES for n in edge} == names and len(C.COUNTY_EDGES) == 11
