"""More registered queries: golden cells, files there and back, indexes, trees, sets with flags, neighbourhoods. Their SQL is written by hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spherix import storage
from spherix.functions import cells as C
from spherix.functions import geometry as G
from spherix.functions import udtf
from spherix.operators import coverage as V
from spherix.operators import maps as M
from spherix.operators import regions as Q
from spherix.operators import render as P
from spherix.plans import catalog as K
from spherix.plans.catalog import CUSTOMERS, EVENTS, QUERIES, SKY, SQL, SUPPLIERS, add, all_cells, cells_sql, count_sql, hashed, layered, r9, sky_counts, source
from spherix.sources import raw, sky, tables, text
from spherix.streaming import counts


def values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) AS t({columns})"


def golden(name: str, cells: list[tuple[int, int, bool]], depth: int, want: list[int]) -> None:
    """A coverage's cells at one depth against a list that is right."""
    add(name, lambda s, d: M.flatten(M.to_ranges(V.to_df(s, cells)), depth).select("ipix").distinct(), values([(f"CAST({h} AS BIGINT)",) for h in want], "ipix"))


#: Cells that published examples of the grid give for these regions.
_LMC = (13.158329, -72.80028, 5.64323)
golden("golden_cone", V.cover(V.Cone(*_LMC), 3, 2), 3, [514, 515, 520, 521, 522, 705, 708, 709])
golden("golden_cone_centres", V.cover(V.Cone(*_LMC), 4, mode="centres"), 4, [2058, 2059, 2080, 2081, 2082, 2083, 2088])
golden("golden_cone_inside", V.cover(V.Cone(*_LMC), 4, mode="inside"), 4, [2081, 2082])
_TRIANGLE = [(0.0, 0.0), (0.0, math.degrees(0.5)), (math.degrees(0.25), math.degrees(0.25))]
golden("golden_polygon", V.cover(V.Polygon(_TRIANGLE), 3), 3, [304, 305, 306, 307, 308, 310, 313, 316])
_CAP = [(65.11781779000003, 85.012424), (89.70533626000001, 87.06130188), (60.23667431000001, 85.609882)]
golden("golden_polygon_cap", V.cover(V.Polygon(_CAP), 6), 6, [4062, 4063, 4084, 4085])
_ZONE = "4,1055,0 4,1075,0 4,1076,0 4,1077,0 4,1078,0 4,1079,1 4,1084,0 4,1085,0 4,1087,0 4,1096,0 4,1097,0 4,1098,0 4,1099,1 4,1100,0 4,1102,0 4,1103,0 3,280,1 4,1124,1 4,1125,0 4,1126,1 4,1127,1 4,1128,1 4,1129,1 4,1130,0 4,1131,1 3,283,1 4,1136,0 4,1138,0 4,1139,0 4,1144,1 4,1145,0 4,1146,0 4,1147,0 4,1216,0 4,1217,0 4,1219,0 4,1220,1 4,1221,0 4,1222,0 4,1223,0 4,1228,0 4,1232,0"
add("golden_zone", lambda s, d: V.to_df(s, V.cover(V.Zone(0.0, -10.0, 20.0, 10.0), 4)), values([(f"CAST({o} AS INT)", f"CAST({h} AS BIGINT)", "true" if f == "1" else "false") for o, h, f in (x.split(",") for x in _ZONE.split())], "order_, ipix, is_full"))
add("cone_table_function", lambda s, d: (udtf.register(s), s.sql("SELECT order_, ipix, is_full FROM hpx_cone(3, 13.158329, -72.80028, 5.64323)").select("ipix"))[1], SQL["golden_cone"])
add("polygon_table_function", lambda s, d: (udtf.register(s), M.flatten(M.to_ranges(s.sql(f"SELECT * FROM hpx_polygon(3, array({', '.join(f'{x}D' for p in _TRIANGLE for x in p)}))")), 3).select("ipix").distinct())[1], SQL["golden_polygon"])
add("external_edge_golden", lambda s, d: _edges(s), values([(c, f"CAST({h} AS BIGINT)") for c, own in {10: [85, 87, 93, 95, 117, 138, 139, 142, 143, 154, 176, 178, 184, 186, 415, 437, 439, 445, 447], 11: [63, 95, 117, 119, 125, 127, 143, 154, 155, 158, 159, 165, 167, 173, 175, 239, 250, 251, 254, 255]}.items() for h in own], "ipix, outer_"))


def _edges(s) -> DataFrame:
    n = 4 * (1 << 2) + 4
    near = C.apply(all_cells(s, 1).where("ipix IN (10, 11)"), C.external_edge(1, 2))
    return near.select(F.col("ipix").cast("int").alias("ipix"), F.explode(F.array_compact(F.array(*[f"x{k}" for k in range(n)]))).alias("outer_"))


SQL["zone_cover"] = SQL["cover_file"] = SQL["cover_csv"] = SQL["golden_zone"]
SQL["cone_cover_centres"] = values([(f"CAST({o} AS INT)", f"CAST({h} AS BIGINT)", "true") for o, h in ((4, 2058), (4, 2059), (3, 520), (4, 2088))], "order_, ipix, is_full")
SQL["cone_cover_inside"] = values([("CAST(4 AS INT)", f"CAST({h} AS BIGINT)", "true") for h in (2081, 2082)], "order_, ipix, is_full")
SQL["cone_cover"] = values([("CAST(3 AS INT)", f"CAST({h} AS BIGINT)", "false") for h in (514, 515, 520, 521, 522, 705, 708, 709)], "order_, ipix, is_full")

# Regions that cover, wherever they lie: what a region holds is found through its cells


def covered(name: str, shape, predicate: str, sql: str, depth: int = 5) -> None:
    """Positions in a region through the cells of its coverage and the exact predicate, against a predicate of its own."""
    cells = V.cover(shape, depth)

    def query(s, d):
        keyed = M.with_hash(source(s, d, SKY), 29, out="hash29")
        return M.within(keyed, V.ranges(cells), predicate).select("id", "lon", "lat")

    add(name, query, f"SELECT id, lon, lat FROM {SKY} AS t WHERE {sql}")


_X, _Y, _Z = "cos(radians(lat)) * cos(radians(lon))", "cos(radians(lat)) * sin(radians(lon))", "sin(radians(lat))"


def sides(vertices: list[tuple[float, float]]) -> str:
    """A convex polygon, anticlockwise as seen from outside, as half spaces of its edges' great circles."""
    tests = []
    for v, w in zip(vertices, vertices[1:] + vertices[:1]):
        n = M._cross(M._xyz(*v), M._xyz(*w))
        tests.append(f"({n[0]!r} * {_X} + {n[1]!r} * {_Y} + {n[2]!r} * {_Z}) > 0.0")
    return "(" + " AND ".join(tests) + ")"


_MERIDIAN = [(350.0, -10.0), (10.0, -12.0), (14.0, 11.0), (352.0, 9.0)]
_SOUTH = [(270.0, -60.0), (180.0, -65.0), (90.0, -62.0), (0.0, -58.0)]
_NORTH = [(0.0, 58.0), (90.0, 62.0), (180.0, 65.0), (270.0, 60.0)]
_BOX = V.corners(0.0, 12.0, 12.0, 5.0, 30.0)
for _name, _polygon in {"meridian": _MERIDIAN, "south_pole": _SOUTH, "north_pole": _NORTH}.items():
    covered(f"polygon_over_{_name}", V.Polygon(_polygon), M.in_polygon(_polygon), sides(_polygon))
covered("box_over_meridian", V.box(0.0, 12.0, 12.0, 5.0, 30.0), M.in_polygon(_BOX), sides(_BOX if "%" not in str(_BOX) and M._angle(M._xyz(*_BOX[0]), M._xyz(0, 12)) < 1 and sum(a * b for a, b in zip(M._cross(M._xyz(*_BOX[0]), M._xyz(*_BOX[1])), M._xyz(0.0, 12.0))) > 0 else _BOX[::-1]))
covered("polygon_complement", V.Polygon(_MERIDIAN, complement=True), M.in_polygon(_MERIDIAN, "complement"), f"NOT {sides(_MERIDIAN)}", 4)
covered("polygon_control_out", V.Polygon(_MERIDIAN, inside=("out", 0.0, 0.0)), M.in_polygon(_MERIDIAN, ("out", 0.0, 0.0)), f"NOT {sides(_MERIDIAN)}", 4)
_ELLIPSE = (100.0, -40.0, 15.0, 5.0, 30.0)
_U = f"(cos(radians(lat)) * sin(radians(lon - 100.0)))"
_W = f"({_Z} * cos(radians(-40.0)) - cos(radians(lat)) * sin(radians(-40.0)) * cos(radians(lon - 100.0)))"
_ESQL = f"({_Z} * sin(radians(-40.0)) + cos(radians(lat)) * cos(radians(-40.0)) * cos(radians(lon - 100.0)) > 0.0 AND pow(({_U} * 0.5 + {_W} * (sqrt(3.0) / 2.0)) / sin(radians(15.0)), 2) + pow(({_U} * (sqrt(3.0) / 2.0) - {_W} * 0.5) / sin(radians(5.0)), 2) <= 1.0)"
covered("ellipse_through_cells", V.ellipse(*_ELLIPSE), M.in_ellipse(*_ELLIPSE), _ESQL)
covered("ring_through_cells", V.Cone(*_LMC[:2], 25.0, 12.0), f"({M.haversine('13.158329', '-72.80028', 'lon', 'lat')} BETWEEN 12.0 AND 25.0)", "degrees(acos(least(1.0, sin(radians(lat)) * sin(radians(-72.80028)) + cos(radians(lat)) * cos(radians(-72.80028)) * cos(radians(lon - 13.158329))))) BETWEEN 12.0 AND 25.0")
covered("zone_through_cells", V.Zone(350.0, -10.0, 20.0, 30.0), M.in_zone(350.0, -10.0, 20.0, 30.0), "(lat >= -10.0 AND lat < 30.0 AND (lon >= 350.0 OR lon < 20.0))")
covered("region_box", Q.shape(Q.parse("Box ICRS 0 12 12 5 30")), Q.predicate("Box ICRS 0 12 12 5 30"), SQL["box_over_meridian"].split(" WHERE ", 1)[1])


def stored_sky(s, d) -> DataFrame:
    """The sky in the order of cells, as a table whose row groups hold ranges of hash29."""
    return M.store(source(s, d, SKY), storage.scratch(s, "sky"))


add("within_stored", lambda s, d: M.within(stored_sky(s, d), V.ranges(K.CONE), K._EXACT).select("id", "lon", "lat"), SQL["within_cone"])
add("zone_exclusive", lambda s, d: source(s, d, SKY).where(F.expr(C.doubles(M.in_zone_exclusive(350.0, -10.0, 20.0, 30.0)))).select("id", "lon", "lat"), f"SELECT id, lon, lat FROM {SKY} AS t WHERE lat > -10.0 AND lat < 30.0 AND NOT (lon BETWEEN 20.0 AND 350.0)")
_LINES = "(SELECT id, lon, lat, least(lat, 5.0) - 8.0 AS lat_down, lat + 12.0 AS lat_up, lon AS lon_left, CASE WHEN lon + 80.0 >= 360.0 THEN lon - 280.0 ELSE lon + 80.0 END AS lon_right FROM "
add(
    "zone_crossed",
    lambda s, d: source(s, d, CUSTOMERS).selectExpr("id", *map(C.doubles, ("lon", "lat", "least(lat, 5.0) - 8.0 AS lat_down", "lat + 12.0 AS lat_up", "lon AS lon_left", "CASE WHEN lon + 80.0 >= 360.0 THEN lon - 280.0 ELSE lon + 80.0 END AS lon_right"))).selectExpr("id", C.doubles(f"{M.crossed_vertically(30.0, 0.0, 70.0, 9.0)} AS vertically"), C.doubles(f"{M.crossed_horizontally(30.0, 0.0, 70.0, 9.0)} AS horizontally")),
    f"SELECT id, (lat_down < 0.0 AND lat_up >= 9.0 AND lon BETWEEN 30.0 AND 69.9999999) AS vertically, (lat >= 0.0 AND lat < 9.0 AND CASE WHEN lon_left <= lon_right THEN lon_left < 30.0 AND lon_right >= 70.0 ELSE lon_left < 30.0 OR lon_right >= 70.0 END) AS horizontally FROM {_LINES}{CUSTOMERS} AS t) AS q",
)
add(
    "polygon_parallels",
    lambda s, d: s.createDataFrame([(float(lat), round(x, 7)) for lat in (0.0, 5.0, -8.0) for x in M.crosses_parallel([(20.0, -10.0), (60.0, -10.0), (60.0, 10.0), (20.0, 10.0)], lat)], "lat DOUBLE, lon DOUBLE"),
    values([(lat, lon) for lat in (0.0, 5.0, -8.0) for lon in (20.0, 60.0)], "lat, lon").replace("(0.0,", "(CAST(0 AS DOUBLE),").replace("SELECT *", "SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon"),
)
add(
    "polygon_arcs",
    lambda s, d: s.createDataFrame([(round(x, 7), round(y, 7) + 0.0) for x, y in M.crosses_arc([(20.0, -10.0), (60.0, -10.0), (60.0, 10.0), (20.0, 10.0)], (0.0, 0.0), (40.0, 0.0))], "lon DOUBLE, lat DOUBLE"),
    "SELECT CAST(20 AS DOUBLE) AS lon, CAST(0 AS DOUBLE) AS lat",
)
add("ellipse_near_cone", lambda s, d: source(s, d, CUSTOMERS).where(F.expr(C.doubles(M.ellipse_overlaps_cone(100.0, -40.0, 15.0, 5.0, 30.0, "2.0")))).select("id"), f"SELECT id FROM {CUSTOMERS} AS t WHERE {_ESQL.replace('radians(15.0)', 'radians(17.0)').replace('radians(5.0)', 'radians(7.0)')}")
add("enclosing_cones", lambda s, d: s.createDataFrame([(k, round(r, 6)) for k, r in (("two", M.enclosing_cone([(0.0, 0.0), (10.0, 0.0)])[2]), ("square", M.enclosing_cone([(0.0, 90.0), (0.0, 80.0), (180.0, 80.0), (90.0, 80.0)])[2]), ("mean", M.bounding_cone([(0.0, 0.0), (10.0, 0.0)])[2]))], "kind STRING, radius DOUBLE"), "SELECT * FROM (VALUES ('two', CAST(5 AS DOUBLE)), ('square', CAST(10 AS DOUBLE)), ('mean', CAST(5 AS DOUBLE))) AS t(kind, radius)")

# Codes of cells

layered_uniq = [{"uniq": C.uniq("5", "ipix")}, *C.from_uniq("uniq", "order_", "cell")]
add("from_uniq", lambda s, d: C.apply(all_cells(s, 5), layered_uniq).select("uniq", "order_", "cell"), f"SELECT ipix + 16384 AS uniq, 5 AS order_, ipix AS cell FROM {cells_sql(5)} AS c")
add("from_uniq_ivoa", lambda s, d: C.apply(all_cells(s, 5), [{"u": C.uniq_ivoa("5", "ipix")}, *C.from_uniq_ivoa("u", "order_", "cell")]).select("u", "order_", "cell"), f"SELECT ipix + 4096 AS u, 5 AS order_, ipix AS cell FROM {cells_sql(5)} AS c")
_DEEP = 3458764513820540927
add("from_uniq_deep", lambda s, d: C.apply(s.range(3).selectExpr(f"{_DEEP}L - id AS ipix"), [{"u": C.uniq_ivoa("29", "ipix")}, *C.from_uniq_ivoa("u", "order_", "cell")]).select("u", "order_", "cell"), f"SELECT {_DEEP} - range + 1152921504606846976 AS u, 29 AS order_, {_DEEP} - range AS cell FROM range(3)")
add("siblings", lambda s, d: all_cells(s, 3).selectExpr("ipix", *[f"{e} AS {n}_" for n, e in C.siblings(3).items()]), f"SELECT ipix, min(ipix) OVER w AS first_, max(ipix) OVER w AS last_ FROM {cells_sql(3)} AS c WINDOW w AS (PARTITION BY ipix // 4)")
add("siblings_of_base_cells", lambda s, d: all_cells(s, 0).selectExpr("ipix", *[f"{e} AS {n}_" for n, e in C.siblings(0).items()]), f"SELECT ipix, min(ipix) OVER () AS first_, max(ipix) OVER () AS last_ FROM {cells_sql(0)} AS c")
add("axis_masks", lambda s, d: s.createDataFrame([(k, *C.masks(k).values()) for k in range(30)], "depth INT, x_mask BIGINT, y_mask BIGINT, xy_mask BIGINT"), "SELECT range AS depth, ((CAST(1 AS BIGINT) << (2 * range)) - 1) // 3 AS x_mask, 2 * (((CAST(1 AS BIGINT) << (2 * range)) - 1) // 3) AS y_mask, (CAST(1 AS BIGINT) << (2 * range)) - 1 AS xy_mask FROM range(30)")
add("valid_depth_nside", lambda s, d: s.range(-3, 70).selectExpr("id", f"{C.is_depth('id')} AS is_depth", f"{C.is_nside('id')} AS is_nside", "CASE WHEN id BETWEEN 0 AND 29 THEN 1L << CAST(2 * id AS INT) END AS square"), "SELECT range AS id, range >= 0 AND range < 30 AS is_depth, range IN (1, 2, 4, 8, 16, 32, 64) AS is_nside, CASE WHEN range BETWEEN 0 AND 29 THEN CAST(pow(4, range) AS BIGINT) END AS square FROM range(-3, 70)")
add("depth_of_cells", lambda s, d: s.range(30).selectExpr("id AS depth", "12L << CAST(2 * id AS INT) AS n").selectExpr("n", f"CAST({G.depth_of_nside('CAST(sqrt(CAST(n DIV 12 AS DOUBLE)) AS BIGINT)')} AS BIGINT) AS depth"), "SELECT CAST(12 AS BIGINT) << (2 * range) AS n, range AS depth FROM range(30)")
add("zuniq_overlap", lambda s, d: all_cells(s, 2).selectExpr("ipix", f"{C.overlap(C.zuniq('2', 'ipix'), C.zuniq('1', '17L'))} AS under", f"{C.overlap(C.zuniq('2', 'ipix'), C.zuniq('4', '1000L'))} AS over"), f"SELECT ipix, ipix // 4 = 17 AS under, ipix = 1000 // 16 AS over FROM {cells_sql(2)} AS c")
add("best_depth_units", lambda s, d: s.range(1).selectExpr(*[f"CAST({G.best_depth(C.doubles(G.unit('1.0', u)))} AS INT) AS {u}_" for u in ("deg", "arcmin", "arcsec", "rad")]), "SELECT 5 AS deg_, 11 AS arcmin_, 17 AS arcsec_, 0 AS rad_")
add("region_of_latitude", lambda s, d: source(s, d, CUSTOMERS).selectExpr("id", f"{G.is_equatorial('lat')} AS equatorial"), f"SELECT id, abs(sin(radians(lat))) <= 2.0 / 3.0 AS equatorial FROM {CUSTOMERS} AS t")


def from_axes(lon: str, lat: str, pole: tuple[float, float], node: float) -> tuple[str, str]:
    """Galactic longitude and latitude by the pole's position and the longitude of the celestial pole, spherical trigonometry."""
    a, b = pole
    sin_b = f"(sin(radians({lat})) * sin(radians({b!r})) + cos(radians({lat})) * cos(radians({b!r})) * cos(radians({lon} - {a!r})))"
    l = f"({node!r} - degrees(atan2(cos(radians({lat})) * sin(radians({lon} - {a!r})), sin(radians({lat})) * cos(radians({b!r})) - cos(radians({lat})) * sin(radians({b!r})) * cos(radians({lon} - {a!r})))))"
    return f"({l} - 360.0 * floor({l} / 360.0))", f"degrees(asin({sin_b}))"


for _frame, _pole, _node in (("fk4", (192.25, 27.4), 123.0), ("fk5", (192.85948, 27.12825), 122.93192)):
    _l, _b = from_axes("lon", "lat", _pole, _node)
    add(f"galactic_{_frame}", lambda s, d, f=_frame: C.apply(source(s, d, CUSTOMERS), G.rotated(G.galactic(f), "lon", "lat", "l", "b")).selectExpr("id", "round(l, 6) AS l", "round(b, 6) AS b"), f"SELECT id, round({_l}, 6) AS l, round({_b}, 6) AS b FROM {CUSTOMERS} AS t")
_HAV = "degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(20.0)) + cos(radians(lat)) * cos(radians(20.0)) * cos(radians(lon - 40.0))))))"
add("local_frame_distance", lambda s, d: C.apply(source(s, d, CUSTOMERS), [*G.rotated(G.local_frame(40.0, 20.0), "lon", "lat", "u", "v"), {"far": "degrees(acos(least(1.0, greatest(-1.0, cos(radians(u)) * cos(radians(v))))))"}]).selectExpr("id", "round(far, 5) AS far"), f"SELECT id, round({_HAV}, 5) AS far FROM {CUSTOMERS} AS t")
add("forced_sin", lambda s, d: C.apply(source(s, d, CUSTOMERS), G.forced_sin(40.0, 20.0)).selectExpr("id", "round(distance, 5) AS distance", C.doubles("round(degrees(asin(least(1.0, sqrt(x * x + y * y)))), 3) AS plane")), f"SELECT id, round({_HAV}, 5) AS distance, round(CASE WHEN {_HAV} <= 90.0 THEN {_HAV} ELSE 180.0 - {_HAV} END, 3) AS plane FROM {CUSTOMERS} AS t WHERE true")
add("proj_float", lambda s, d: C.apply(source(s, d, CUSTOMERS), G.project_float("lon", "lat", "fx", "fy")).selectExpr("id", "round(CAST(fx AS DOUBLE), 3) AS fx", "round(CAST(fy AS DOUBLE), 3) AS fy"))
_E = G.ellipse_of_axes(3.0, 1.0, 30.0)
add("plane_ellipse", lambda s, d: s.range(-40, 41).selectExpr(*map(C.doubles, ("id", "id / 10.0 AS x", "id * id / 400.0 - 1.0 AS y"))).selectExpr("id", C.doubles(f"{G.mahalanobis(_E)} <= 1.0 AS inside"), C.doubles(f"round({G.mahalanobis(_E)}, 6) AS square")), "SELECT id, square <= 1.0 AS inside, round(square, 6) AS square FROM (SELECT id, pow((x * sin(pi() / 6.0) + y * cos(pi() / 6.0)) / 3.0, 2) + pow(x * cos(pi() / 6.0) - y * sin(pi() / 6.0), 2) AS square FROM (SELECT range AS id, range / 10.0 AS x, range * range / 400.0 - 1.0 AS y FROM range(-40, 41)) AS p) AS q")
add("ellipse_border", lambda s, d: C.apply(s.range(32).selectExpr("id AS k"), [*G.ellipse_path(_E, 32), {"square": G.mahalanobis(_E)}]).selectExpr("k", "round(square, 6) AS square"), "SELECT range AS k, CAST(1 AS DOUBLE) AS square FROM range(32)")

# Neighbourhoods: rings by the graph of neighbours, away from the corners where cells have seven


def _graph(depth: int, rings: int) -> str:
    """CTEs n (a, b), all pairs of neighbours, and g1, g2 .., all within that many steps."""
    pairs = " UNION ALL ".join(f"SELECT ipix AS a, n_{x.lower()} AS b FROM h WHERE n_{x.lower()} IS NOT NULL" for x in C.DIRECTIONS)
    out = f"h AS MATERIALIZED ({C.to_sql(cells_sql(depth), C.neighbours(depth), '*')}), n AS MATERIALIZED ({pairs}), g0 AS (SELECT ipix AS a, ipix AS b FROM h)"
    for k in range(1, rings + 1):
        out += f", g{k} AS MATERIALIZED (SELECT a, b FROM g{k - 1} UNION SELECT g.a, n.b FROM g{k - 1} AS g JOIN n ON g.b = n.a)"
    return out


def _inner(depth: int, k: int) -> str:
    """Cells whose k rings stay inside their base cell."""
    n = 1 << depth
    own = C.to_sql(cells_sql(depth), C.decode(depth, "ipix"), "ipix, _x, _y")
    return f"(SELECT ipix FROM ({own}) AS o WHERE _x BETWEEN {k} AND {n - 1 - k} AND _y BETWEEN {k} AND {n - 1 - k})"


def _rings(s, depth: int, layers, n: int, k: int) -> DataFrame:
    size = 1 << depth
    inner = C.apply(all_cells(s, depth), [*C.decode(depth, "ipix", "f", "x", "y")]).where(f"x BETWEEN {k} AND {size - 1 - k} AND y BETWEEN {k} AND {size - 1 - k}").select("ipix")
    return C.apply(inner, layers).select("ipix", F.explode(F.array_compact(F.array(*[f"k{i}" for i in range(n)]))).alias("near")).distinct()


add("kth_ring", lambda s, d: _rings(s, 4, C.kth_neighbours(4, 3), 24, 3), f"WITH {_graph(4, 3)} SELECT a AS ipix, b AS near FROM (SELECT * FROM g3 EXCEPT SELECT * FROM g2) AS q WHERE a IN {_inner(4, 3)}")
add("kth_neighbourhood", lambda s, d: _rings(s, 4, C.kth_neighbourhood(4, 2), 25, 2), f"WITH {_graph(4, 2)} SELECT a AS ipix, b AS near FROM g2 WHERE a IN {_inner(4, 2)}")
add(
    "external_edge_cells",
    lambda s, d: C.apply(all_cells(s, 2), C.external_edge(2, 2)).select("ipix", F.explode(F.array_compact(F.array(*[f"x{k}" for k in range(20)]))).alias("outer_")).distinct(),
    f"WITH {_graph(4, 1)} SELECT DISTINCT a // 16 AS ipix, b AS outer_ FROM n WHERE a // 16 <> b // 16",
)
add("internal_edge_sorted", lambda s, d: all_cells(s, 2).select("ipix", F.posexplode(F.array(*[F.expr(e) for e in C.internal_edge_sorted(2, 2)])).alias("k", "inner_")), f"WITH {_graph(4, 1)}, e AS (SELECT DISTINCT a AS inner_ FROM n WHERE a // 16 <> b // 16) SELECT inner_ // 16 AS ipix, CAST(row_number() OVER (PARTITION BY inner_ // 16 ORDER BY inner_) - 1 AS INT) AS k, inner_ FROM e")

# Maps


def _with_nulls(s, d):
    return M.to_dense(sky_counts(s, d, 5), 5, -1)


add("dense_null_value", _with_nulls, f"SELECT a.ipix, coalesce(c.value, -1) AS value FROM {cells_sql(5)} AS a LEFT JOIN {count_sql(5)} AS c ON a.ipix = c.ipix")
add("sparse_null_value", lambda s, d: M.to_sparse(_with_nulls(s, d), -1), f"SELECT * FROM {count_sql(5)} AS c")
add("representation", lambda s, d: M.representation_sizes(sky_counts(s, d, 6), 6), f"SELECT CAST(393216 AS BIGINT) AS implicit_bytes, count(*) * 12 AS explicit_bytes, CASE WHEN count(*) * 12 < 393216 THEN 'explicit' ELSE 'implicit' END AS best FROM {count_sql(6)} AS c")
add("colour_scale", lambda s, d: M.colour_scale(sky_counts(s, d, 5)).select("least", "greatest", F.coalesce(F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ","), F.lit("many")).alias("values_")), f"SELECT CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS greatest, CASE WHEN count(DISTINCT value) <= 25 THEN array_to_string(list_sort(list(DISTINCT value)), ',') ELSE 'many' END AS values_ FROM {count_sql(5)} AS c WHERE value <> 0")


def tree_sql(leaves: str, depth: int, n: int, rule: str) -> str:
    """Bottom-up merge of complete groups of n; rule is SQL over s, lo, hi, z: sum, extremes and zeros of a group."""
    ctes, parts = [f"m{depth} AS MATERIALIZED ({leaves})"], []
    for k in range(depth, 0, -1):
        ctes.append(f"g{k} AS MATERIALIZED (SELECT p, CASE WHEN c = {n} THEN {rule} END AS m FROM (SELECT ipix // {n} AS p, count(*) AS c, sum(value) AS s, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE value = 0) AS z FROM m{k} GROUP BY 1) AS q)")
        ctes.append(f"m{k - 1} AS MATERIALIZED (SELECT p AS ipix, m AS value FROM g{k} WHERE m IS NOT NULL)")
        parts.append(f"SELECT {k} AS order_, ipix, value FROM m{k} JOIN g{k} ON ipix // {n} = p WHERE m IS NULL")
    return f"WITH {', '.join(ctes)} SELECT order_, ipix, CAST(value AS DOUBLE) AS value FROM ({' UNION ALL '.join([*parts, 'SELECT 0 AS order_, ipix, value FROM m0'])}) AS t"


_LEAVES = f"SELECT a.ipix, CAST(coalesce(c.value, 0) AS BIGINT) AS value FROM {cells_sql(4)} AS a LEFT JOIN {count_sql(4)} AS c ON a.ipix = c.ipix"
_AS_DOUBLE = ("order_", "ipix", "CAST(value AS DOUBLE) AS value")
add("tree_sum_until", lambda s, d: M.build_tree(M.dense(sky_counts(s, d, 4), 4), 4, M.sum_until_merger(40)).selectExpr(*_AS_DOUBLE), tree_sql(_LEAVES, 4, 4, "CASE WHEN s <= 40 THEN s END"))
add("tree_empty_siblings", lambda s, d: M.build_tree(M.dense(sky_counts(s, d, 4), 4), 4, M.empty_siblings_merger(60, 1)).selectExpr(*_AS_DOUBLE), tree_sql(_LEAVES, 4, 4, "CASE WHEN s <= 60 AND z <= 1 THEN s END"))
add("tree_tolerance", lambda s, d: M.build_tree(M.dense(sky_counts(s, d, 4), 4).select("ipix", F.col("value").cast("double").alias("value")), 4, M.tolerance_merger(0.5)).selectExpr(*_AS_DOUBLE), tree_sql(_LEAVES.replace("CAST(coalesce(c.value, 0) AS BIGINT)", "CAST(coalesce(c.value, 0) AS DOUBLE)"), 4, 4, "CASE WHEN hi - lo <= 0.5e0 * abs(s / 4) THEN s / 4 END"))
add("tree_equal", lambda s, d: M.multi_order_map(M.dense(sky_counts(s, d, 4), 4), 4, M.equal_merger()).selectExpr(*_AS_DOUBLE), tree_sql(_LEAVES, 4, 4, "CASE WHEN lo = hi THEN lo END"))
add("tree_of_three", lambda s, d: M.build_tree(s.range(729).selectExpr("id AS ipix", "id * id % 7 AS value"), 6, M.sum_until_merger(11), 3).selectExpr(*_AS_DOUBLE), tree_sql("SELECT range AS ipix, range * range % 7 AS value FROM range(729)", 6, 3, "CASE WHEN s <= 11 THEN s END"))
add("stream_mom", lambda s, d: counts.mom_once(s, f"{d}/events.parquet", 4, EVENTS, M.threshold_merger(40)), K._MOM3)

# Indexes


def _index(s, d) -> DataFrame:
    return M.cumulative_index(sky_counts(s, d, 6), 6)


_STARTS = f"(SELECT ipix, CAST(sum(value) OVER (ORDER BY ipix) - value AS BIGINT) AS row_start, CAST(sum(value) OVER (ORDER BY ipix) AS BIGINT) AS row_end FROM {count_sql(6)} AS c)"
add("index_cell", lambda s, d: M.index_cell_count(_index(s, d), 6, 4, 1000), f"SELECT count(*) AS n FROM {hashed(4)} AS h WHERE ipix = 1000")
add("index_range_rows", lambda s, d: M.index_rows(_index(s, d), 6, 3, 100, 130), f"SELECT min(row_start) AS row_start, max(row_end) AS row_end FROM {_STARTS} AS i WHERE ipix // 64 BETWEEN 100 AND 129")
add("index_get", lambda s, d: M.index_get(_index(s, d), s.range(0, 49152, 500).select(F.col("id").alias("ipix"))), f"SELECT range AS ipix, (SELECT min(row_start) FROM {_STARTS} AS i WHERE i.ipix >= range) AS row_start FROM range(0, 49152, 500)")
add("sample_rows", lambda s, d: M.sample_rows(M.sampled_index(source(s, d, SKY), 100), 100, 1 << 58, 3 << 58), f"SELECT CAST(coalesce(max(n) FILTER (WHERE hash29 < {1 << 58}), 0) * 100 AS BIGINT) AS row_start, CAST(min(n) FILTER (WHERE hash29 >= {3 << 58}) * 100 AS BIGINT) AS row_end FROM (SELECT sample_no AS n, hash29 FROM ({SQL['sampled_index']}) AS i) AS q")


def _files(s, write, read) -> DataFrame:
    path = storage.scratch(s, "files")
    write(path)
    return read(path)


def _total(df: DataFrame) -> int:
    return df.agg(F.max("row_end")).first()[0]


def _held_index(s, d) -> tuple[DataFrame, int]:
    index = storage.held(_index(s, d))
    return index, _total(index)


for _implicit in (True, False):
    add(f"index_file_{'implicit' if _implicit else 'explicit'}", lambda s, d, i=_implicit: (lambda x: _files(s, lambda p: raw.write_index(x[0], p, 6, x[1], i, "u64" if i else "u32", {"name": "sky.csv", "lon": "lon", "lat": "lat"}), lambda p: raw.read_index(s, p)))(_held_index(s, d)), SQL["cumul_index"])
for _explicit in (True, False):
    add(f"samples_file_{'explicit' if _explicit else 'implicit'}", lambda s, d, e=_explicit: _files(s, lambda p: raw.write_samples(M.sampled_index(source(s, d, SKY), 100), p, 100, e), lambda p: raw.read_samples(s, p)), SQL["sampled_index"])
add("index_csv", lambda s, d: _files(s, lambda p: raw.index_csv(_index(s, d), p), lambda p: s.read.csv(p, header=True, schema="hash BIGINT, starting_byte BIGINT")), f"SELECT ipix AS hash, row_start AS starting_byte FROM {_STARTS} AS i")
add("bmoc_raw", lambda s, d: _files(s, lambda p: raw.write_bmoc(V.to_df(s, V.cover(V.Zone(0.0, -10.0, 20.0, 10.0), 4)), p, 4), lambda p: raw.read_bmoc(s, p)), SQL["golden_zone"])
add("bmoc_raw_deep", lambda s, d: _files(s, lambda p: raw.write_bmoc(M.with_hash(source(s, d, SUPPLIERS), 29).select(F.lit(29).alias("order_"), "ipix", (F.col("ipix") % 2 == 0).alias("is_full")).distinct(), p, 29), lambda p: raw.read_bmoc(s, p)), f"SELECT DISTINCT 29 AS order_, ipix, ipix % 2 = 0 AS is_full FROM {hashed(29, SUPPLIERS)} AS h")
add("mom_raw", lambda s, d: _files(s, lambda p: raw.write_mom(K.chi2_mom(s, d), p, 4, "u32"), lambda p: raw.read_mom(s, p, "long")), SQL["mom_file"])
add("moc_text", lambda s, d: raw.uncompressed(raw.from_text(raw.to_text(raw.compressed(V.to_df(s, V.cover(V.Polygon(_CAP), 6)).withColumn("id", F.lit(1)), 6)))).select("ipix"), SQL["golden_polygon_cap"])

# Text


def _sky_file(s, d) -> str:
    path = storage.scratch(s, "text")
    source(s, d, CUSTOMERS).select(F.concat_ws(",", "id", "lon", "lat").alias("value")).write.text(path)
    return path


_DIGITS = {"lon": 2, "lat": 3}
add("csv_hash_paste", lambda s, d: text.hash_file(s, _sky_file(s, d), 6, paste=True, **_DIGITS).selectExpr("CAST(split(line, ',')[0] AS BIGINT) AS id", "CAST(split(line, ',')[3] AS BIGINT) AS ipix"), f"SELECT id, ipix FROM {hashed(6, CUSTOMERS)} AS h")
add("csv_count_map", lambda s, d: text.count_file(s, _sky_file(s, d), 5, **_DIGITS), f"SELECT * FROM {count_sql(5, CUSTOMERS)} AS c")


def _sorted_file(s, d) -> str:
    out = storage.scratch(s, "sorted")
    text.sort_file(s, _sky_file(s, d), out, **_DIGITS)
    return out


add("csv_sorted_breaks", lambda s, d: text.order_breaks(s, _sky_file(s, d), **_DIGITS).selectExpr("breaks > 0 AS unsorted"), "SELECT true AS unsorted")
add("csv_index", lambda s, d: text.index_file(s, _sorted_file(s, d), 5, **_DIGITS), f"SELECT ipix, CAST(sum(value) OVER (ORDER BY ipix) - value AS BIGINT) AS row_start, CAST(sum(value) OVER (ORDER BY ipix) AS BIGINT) AS row_end FROM {count_sql(5, CUSTOMERS)} AS c")
add("csv_projected", lambda s, d: C.apply(text.read_projected(s, _sky_file(s, d), 2, 3).selectExpr("CAST(split(line, ',')[0] AS BIGINT) AS id", "x", "y"), []).selectExpr("id", "round(x, 3) AS x", "round(y, 3) AS y"), f"SELECT id, round(lon, 3) AS x, round(lat, 3) AS y FROM {CUSTOMERS} AS t")


def _cell_file(s, d) -> DataFrame:
    path = storage.scratch(s, "cells")
    text.cell_file(s, 3, path)
    return text.hash_file(s, path, 3, paste=True, lon=2, lat=3).selectExpr("CAST(split(line, ',')[0] AS BIGINT) AS ipix", "CAST(split(line, ',')[4] AS BIGINT) AS again")


add("csv_cells", _cell_file, f"SELECT ipix, ipix AS again FROM {cells_sql(3)} AS c")
add("cell_list", lambda s, d: tables.read_cells(s, _files(s, lambda p: all_cells(s, 2).selectExpr("concat('2,', ipix) AS value").write.text(p), lambda p: p), order=1, ipix=2).groupBy("order_").agg(F.count("*").alias("n"), F.sum("ipix").alias("total")), "SELECT 2 AS order_, CAST(192 AS BIGINT) AS n, CAST(18336 AS BIGINT) AS total")
add("position_list", lambda s, d: sky.read_positions(s, _files(s, lambda p: source(s, d, CUSTOMERS).select(F.concat_ws("\t", "lon", "lat").alias("value")).write.text(p), lambda p: p)).agg(F.count("lon").alias("n"), F.round(F.sum("lon"), 3).alias("lon"), F.round(F.sum("lat"), 3).alias("lat")), f"SELECT count(*) AS n, round(sum(lon), 3) AS lon, round(sum(lat), 3) AS lat FROM {CUSTOMERS} AS t")

# Sets with flags: cells of one depth, each with a flag of its own, so that the rule by cell is plain


def _flagged(s, d, src, by: int) -> DataFrame:
    return M.with_hash(source(s, d, src), 4).select(F.lit(4).alias("order_"), "ipix", (F.col("ipix") % by != 0).alias("is_full")).distinct()


_FA, _FB = (f"(SELECT DISTINCT ipix, ipix % {n} <> 0 AS f FROM {hashed(4, x)} AS h)" for x, n in ((CUSTOMERS, 3), (SUPPLIERS, 2)))
_BOTH = f"(SELECT c.ipix, CASE WHEN a.f THEN 2 WHEN a.f IS NULL THEN 0 ELSE 1 END AS l, CASE WHEN b.f THEN 2 WHEN b.f IS NULL THEN 0 ELSE 1 END AS r FROM {cells_sql(4)} AS c LEFT JOIN {_FA} AS a ON c.ipix = a.ipix LEFT JOIN {_FB} AS b ON c.ipix = b.ipix)"
_BY_CELL = {
    "and": "SELECT ipix, least(l, r) = 2 AS is_full FROM both_ WHERE least(l, r) > 0",
    "or": "SELECT ipix, greatest(l, r) = 2 AS is_full FROM both_ WHERE greatest(l, r) > 0",
    "xor": "SELECT ipix, l + r = 2 AND l * r = 0 AS is_full FROM both_ WHERE l + r BETWEEN 1 AND 3",
    "minus": "SELECT ipix, l = 2 AND r = 0 AS is_full FROM both_ WHERE l > 0 AND l + r < 4",
    "not": "SELECT ipix, l = 0 AS is_full FROM both_ WHERE l < 2",
}
for _op, _sql in _BY_CELL.items():
    add(f"moc_{_op}_flags", lambda s, d, op=_op: M.flatten(M.combine(M.to_ranges(_flagged(s, d, CUSTOMERS, 3)), None if op == "not" else M.to_ranges(_flagged(s, d, SUPPLIERS, 2)), op), 4), f"WITH both_ AS {_BOTH} {_sql}")
_RUNS = "SELECT min(ipix) << 50 AS lo, (max(ipix) + 1) << 50 AS hi, f AS is_full FROM (SELECT ipix, f, ipix - row_number() OVER (PARTITION BY f ORDER BY ipix) AS g FROM {}) AS q GROUP BY g, f"
add("moc_flagged_ranges", lambda s, d: M.union_ranges(M.to_ranges(_flagged(s, d, CUSTOMERS, 3))), _RUNS.format(f"{_FA} AS a"))
add("moc_ranges", lambda s, d: M.union_ranges(K.moc(s, d, SUPPLIERS)).select("lo", "hi"), f"SELECT lo, hi FROM ({_RUNS.format(f'(SELECT ipix, true AS f FROM {K._B} AS b) AS a')}) AS r")
add("moc_ranges_over_base_cells", lambda s, d: M.union_ranges(M.to_ranges(s.sql("SELECT 0 AS order_, id AS ipix, true AS is_full FROM range(3, 7) UNION ALL SELECT 1, 28, true UNION ALL SELECT 1, 30, true"))), f"SELECT CAST({3 << 58} AS BIGINT) AS lo, CAST({29 << 56} AS BIGINT) AS hi, true AS is_full UNION ALL SELECT {30 << 56}, {31 << 56}, true")
add("moc_equal", lambda s, d: M.equal_covers(_flagged(s, d, CUSTOMERS, 3), M.to_cells(M.union_ranges(M.to_ranges(_flagged(s, d, CUSTOMERS, 3))))), "SELECT true AS equal")
add("moc_not_equal", lambda s, d: M.equal_covers(_flagged(s, d, CUSTOMERS, 3), _flagged(s, d, SUPPLIERS, 2)), f"SELECT count(*) = 0 AS equal FROM ((SELECT * FROM {_FA} AS a EXCEPT SELECT * FROM {_FB} AS b) UNION ALL (SELECT * FROM {_FB} AS b EXCEPT SELECT * FROM {_FA} AS a)) AS q")
add("moc_minus_cells", lambda s, d: M.minus_cells(_flagged(s, d, CUSTOMERS, 3), _flagged(s, d, SUPPLIERS, 2)), f"SELECT ipix FROM {_FA} AS a EXCEPT SELECT ipix FROM {_FB} AS b")
add("moc_packed", lambda s, d: M.moc_of(M.with_hash(source(s, d, SKY), 3).select("ipix"), 3).select(F.explode(F.expr("sequence(shiftleft(ipix, 2 * (3 - order_)), shiftleft(ipix + 1, 2 * (3 - order_)) - 1)")).alias("ipix")), f"SELECT DISTINCT ipix FROM {hashed(3)} AS h")
add("moc_degrade", lambda s, d: M.degrade_cover(_flagged(s, d, SUPPLIERS, 2), 2).select("ipix", "is_full"), f"SELECT DISTINCT ipix // 16 AS ipix, false AS is_full FROM {_FB} AS b")
add("moc_all_sky", lambda s, d: M.to_ranges(V.all_sky(s)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo")).alias("size")), f"SELECT CAST(0 AS BIGINT) AS lo, CAST({12 << 58} AS BIGINT) AS hi, CAST({12 << 58} AS BIGINT) AS size")
add("order_breaks_of_rows", lambda s, d: M.order_breaks(s.range(0, 1000, 1, 4).selectExpr("id * 7 % 100 AS k"), "k"), "SELECT count(*) FILTER (WHERE p > k) AS breaks FROM (SELECT k, lag(k) OVER (ORDER BY range) AS p FROM (SELECT range, range * 7 % 100 AS k FROM range(1000)) AS r) AS q")
add(
    "haversine_pairs",
    lambda s, d: _customers_and_suppliers(s, d).select("left_id", F.col("id").alias("right_id"), F.round(F.expr(C.doubles(M.haversine("a_lon", "a_lat", "lon", "lat"))), 6).alias("distance")),
    f"SELECT a.id AS left_id, b.id AS right_id, round(degrees(acos(least(1.0, greatest(-1.0, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)))))), 6) AS distance FROM {CUSTOMERS} AS a JOIN (SELECT c_custkey, c_nationkey FROM customer) AS c ON a.id = c.c_custkey JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) AS n ON c.c_nationkey = n.s_nationkey JOIN {SUPPLIERS} AS b ON b.id = n.k",
)


def _customers_and_suppliers(s, d) -> DataFrame:
    """Each customer beside the first supplier of the nation."""
    first = s.read.parquet(f"{d}/supplier.parquet").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    nation = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    left = source(s, d, CUSTOMERS).select(F.col("id").alias("left_id"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    return left.join(nation, F.col("left_id") == F.col("c_custkey")).join(first, F.col("c_nationkey") == F.col("s_nationkey")).join(source(s, d, SUPPLIERS), F.col("k") == F.col("id"))


# Images

for _p in ("arc", "feye", "stg", "tan", "zea"):
    add(
        f"pixels_{_p}",
        lambda s, d, p=_p: P.pixels(s, 41, 41, p, 40.0, 20.0, 30.0).where("px = 20 AND py BETWEEN 10 AND 30").selectExpr("py", "round(lon, 4) AS lon", "round(lat, 4) AS lat"),
        # up the middle column the sky goes along the meridian: distance from the middle is the angle's
        f"SELECT range AS py, CAST(40 AS DOUBLE) AS lon, round(20.0 + sign(20 - range) * degrees({ {'arc': '(abs(r) * radians(30.0))', 'feye': '(abs(r) * radians(30.0))', 'stg': '(2.0 * atan(abs(r) * tan(radians(15.0))))', 'tan': 'atan(abs(r) * tan(radians(30.0)))', 'zea': '(2.0 * asin(abs(r) * sin(radians(15.0))))'}[_p]}), 4) AS lat FROM (SELECT range, (20 - range) * 2 / 41.0 AS r FROM range(10, 31)) AS q",
    )
for _p, _lat in (("cyp", "degrees(2.0 * atan(y))"), ("par", "degrees(3.0 * asin(y / 2.0))")):
    add(f"pixels_{_p}", lambda s, d, p=_p: P.pixels(s, 41, 41, p, 40.0).where("px = 20").selectExpr("py", "round(lon, 6) AS lon", "round(lat, 6) AS lat"), f"SELECT range AS py, CAST(40 AS DOUBLE) AS lon, round({_lat}, 6) AS lat FROM (SELECT range, 1.0 - (2 * range + 1) / 41.0 AS y FROM range(41)) AS q")
for _t, _f in (("log", "ln(v + 0.01)"), ("sqrt", "sqrt(v)"), ("pow2", "(v * v)"), ("asinh", "asinh(v)")):
    add(f"colours_{_t}", lambda s, d, t=_t: P.scaled_value(s.range(41).selectExpr("id", "CAST(id AS DOUBLE) AS value"), 2.0, 30.0, t).select("id", "colour"), f"SELECT id, CAST(floor(255.0 * ({_f} - {_f.replace('v', 'lo')}) / ({_f.replace('v', 'hi')} - {_f.replace('v', 'lo')}) + 0.5) AS INT) AS colour FROM (SELECT range AS id, CAST(greatest(2, least(30, range)) AS DOUBLE) AS v, CAST(2 AS DOUBLE) AS lo, CAST(30 AS DOUBLE) AS hi FROM range(41)) AS q")
