"""The registered queries: for each a DataFrame program and, where SQL can express it, SQL that gives the same rows.

The test sky is derived from the tables by integer arithmetic. SQL of the cell functions is written from the
same layers as the DataFrame's; maps, joins, sets and merges have SQL of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix import storage
from spherix.functions import cells as C
from spherix.functions import geometry as G
from spherix.functions import ring as R
from spherix.operators import coverage as V
from spherix.operators import maps as M
from spherix.operators import regions as Q
from spherix.operators import render as P
from spherix.sources import sky, tables
from spherix.streaming import counts

SKY = """(SELECT l_orderkey * 8 + l_linenumber AS id,
 CAST((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 360000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
 CAST((l_partkey * 15485863 + l_suppkey * 32452843 + l_orderkey * 13) % 180001 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM lineitem)"""
CUSTOMERS = """(SELECT c_custkey AS id, CAST((c_custkey * 104729) % 360000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
 CAST((c_custkey * 15485863) % 180001 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM customer)"""
SUPPLIERS = """(SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 360000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
 CAST((s_suppkey * 32452843) % 180001 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM supplier)"""
EVENTS = """(SELECT event_id AS id, CAST((event_id * 7919 + user_id * 31) % 360000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
 CAST((event_id * 15485863) % 180001 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM events)"""
_TABLE = {SKY: "lineitem", CUSTOMERS: "customer", SUPPLIERS: "supplier", EVENTS: "events"}


def source(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = _TABLE[sql]
    return spark.sql(f"SELECT * FROM {sql.replace(f'FROM {name}', 'FROM {t}')}", t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cells_sql(depth: int) -> str:
    return f"(SELECT CAST(range AS BIGINT) AS ipix FROM range({C.n_hash(depth)}))"


def all_cells(spark: SparkSession, depth: int) -> DataFrame:
    return spark.range(C.n_hash(depth)).select(F.col("id").alias("ipix"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = C.doubles(sql)


def layered(name: str, src, layers: C.Layers, out: list[str]) -> None:
    """A query of one set of layers over a table or over all cells of a depth; doubles are given to 9 decimals."""
    if isinstance(src, int):
        add(name, lambda s, d: C.apply(all_cells(s, src), layers).selectExpr(*map(C.doubles, out)), C.to_sql(cells_sql(src), layers, out))
    else:
        add(name, lambda s, d: C.apply(source(s, d, src), layers).selectExpr(*map(C.doubles, out)), C.to_sql(src, layers, out))


def r9(*names: str) -> list[str]:
    return [f"round({n}, 9) AS {n}" for n in names]


for _d in (3, 9, 14, 29):
    layered(f"hash_d{_d}", SKY, C.cell_hash(_d), ["id", "ipix"])
layered("hash_dxdy", SKY, [*C.locate(9, "lon", "lat"), *C.encode(9, "_face", "_x", "_y", "ipix"), {"dx": "_fx", "dy": "_fy"}], ["id", "ipix", "round(dx, 6) AS dx", "round(dy, 6) AS dy"])
layered("proj_xy", SKY, C.project("lon", "lat"), ["id", *r9("x", "y")])
layered("unproj_lonlat", SKY, [*C.project("lon", "lat", "px", "py"), *C.unproject("px", "py", "ulon", "ulat")], ["id", "round(ulon, 7) AS ulon", "round(ulat, 7) AS ulat"])
layered("cell_center", 5, C.position(5), ["ipix", *r9("lon", "lat")])
layered("cell_position", 4, C.position(4, dx=0.25, dy=0.75), ["ipix", *r9("lon", "lat")])
layered("cell_vertices", 4, C.vertices(4), ["ipix", *r9(*[f"{d.lower()}_{c}" for d in C.CARDINALS for c in ("lon", "lat")])])
layered("uniq_codes", 5, [{"uniq": C.uniq("5", "ipix"), "uniq_ivoa": C.uniq_ivoa("5", "ipix"), "zuniq": C.zuniq("5", "ipix")}], ["ipix", "uniq", "uniq_ivoa", "zuniq"])
layered("parent_children", 5, [{"parent": C.parent("ipix"), "ancestor": C.parent("ipix", 3), "first": C.first_child("ipix"), "end_": C.end_child("ipix"), "sibling": "ipix & -4"}], ["ipix", "parent", "ancestor", "first", "end_", "sibling"])
layered("decode_cell", 5, [*C.decode(5, "ipix"), {"base": "_face", "i": "_x", "j": "_y"}], ["ipix", "base", "i", "j"])
layered("to_ring", 5, C.to_ring(5), ["ipix", "ring"])
layered("from_ring", 5, C.from_ring(5, "ipix", "nested"), ["ipix", "nested"])
layered("neighbours", 4, C.neighbours(4), ["ipix", *[f"n_{d.lower()}" for d in C.DIRECTIONS]])
layered("bilinear", SKY, C.bilinear(6), ["id", "b0", "b1", "b2", "b3", "round(w0, 6) AS w0", "round(w1, 6) AS w1", "round(w2, 6) AS w2", "round(w3, 6) AS w3"])
layered("internal_edge", 3, [{f"e{k}": e for k, e in enumerate(C.internal_edge(3, 2))}], ["ipix", *[f"e{k}" for k in range(12)]])
_RING2 = [(x, y) for x in range(-2, 3) for y in range(-2, 3) if max(abs(x), abs(y)) == 2]
layered("kth_neighbours", 3, [*C.decode(3, "ipix"), *C.side_by_side(*[C.step_to(3, str(x), str(y), f"k{i}") for i, (x, y) in enumerate(_RING2)])], ["ipix", *[f"k{i}" for i in range(16)]])
_OUTER = [(x, y) for x in range(-1, 3) for y in range(-1, 3) if x in (-1, 2) or y in (-1, 2)]
layered("external_edge", 3, [{"first": C.first_child("ipix")}, *C.decode(4, "first"), *C.side_by_side(*[C.step_to(4, str(x), str(y), f"x{i}") for i, (x, y) in enumerate(_OUTER)])], ["ipix", *[f"x{i}" for i in range(12)]])
add("layer_table", lambda s, d: s.range(30).selectExpr("CAST(id AS INT) AS depth", "1L << CAST(id AS INT) AS nside", "12L << CAST(2 * id AS INT) AS ncells"), "SELECT CAST(range AS INT) AS depth, CAST(1 AS BIGINT) << range AS nside, CAST(12 AS BIGINT) << (2 * range) AS ncells FROM range(30)")

layered("eq_to_gal", CUSTOMERS, G.rotated(G.GALACTIC, "lon", "lat", "gal_lon", "gal_lat"), ["id", "round(gal_lon, 7) AS gal_lon", "round(gal_lat, 7) AS gal_lat"])
layered("gal_to_eq", CUSTOMERS, G.rotated(G.GALACTIC, "lon", "lat", "eq_lon", "eq_lat", back=True), ["id", "round(eq_lon, 7) AS eq_lon", "round(eq_lat, 7) AS eq_lat"])


def hashed(depth: int, src: str = SKY) -> str:
    return f"({C.to_sql(src, C.cell_hash(depth), ['id', 'lon', 'lat', 'ipix'])})"


def count_sql(depth: int, src: str = SKY) -> str:
    return f"(SELECT ipix, count(*) AS value FROM {hashed(depth, src)} AS h WHERE ipix IS NOT NULL GROUP BY ipix)"


def sky_counts(s, d, depth, src=SKY):
    return M.count_map(source(s, d, src), depth)


_NORM = f"{float(C.n_hash(6))!r} / (4.0 * pi())"
add("count_map", lambda s, d: sky_counts(s, d, 6), f"SELECT * FROM {count_sql(6)} AS c")
add("dens_map", lambda s, d: M.density(sky_counts(s, d, 6), 6).select("ipix", F.round("value", 6).alias("value")), f"SELECT ipix, round(value * {_NORM}, 6) AS value FROM {count_sql(6)} AS c")
add("count_map_dense", lambda s, d: M.dense(sky_counts(s, d, 5), 5), f"SELECT a.ipix, CAST(coalesce(value, 0) AS BIGINT) AS value FROM {cells_sql(5)} a LEFT JOIN {count_sql(5)} c ON a.ipix = c.ipix")
add("degrade_sum", lambda s, d: M.degrade(sky_counts(s, d, 7), 3), f"SELECT ipix >> 6 AS ipix, CAST(sum(value) AS BIGINT) AS value FROM {count_sql(7)} AS c GROUP BY 1")
add("map_add", lambda s, d: M.add(sky_counts(s, d, 5), sky_counts(s, d, 5, EVENTS)), f"SELECT ipix, CAST(sum(value) AS BIGINT) AS value FROM (SELECT * FROM {count_sql(5)} AS a UNION ALL SELECT * FROM {count_sql(5, EVENTS)} AS b) AS u GROUP BY ipix")
add("map_lookup", lambda s, d: M.with_hash(source(s, d, CUSTOMERS), 5).join(sky_counts(s, d, 5), "ipix", "left").select("id", F.coalesce("value", F.lit(0)).alias("value")), f"SELECT h.id, coalesce(c.value, 0) AS value FROM {hashed(5, CUSTOMERS)} h LEFT JOIN {count_sql(5)} c ON h.ipix = c.ipix")
add("rollup_depths", lambda s, d: M.rollup(sky_counts(s, d, 4), 4), " UNION ALL ".join(f"SELECT {k} AS order_, ipix >> {2 * (4 - k)} AS ipix, CAST(sum(value) AS BIGINT) AS value FROM {count_sql(4)} AS c GROUP BY 1, 2" for k in range(5)))
add("cumul_index", lambda s, d: M.cumulative_index(sky_counts(s, d, 6), 6), f"SELECT ipix, CAST(sum(value) OVER (ORDER BY ipix) - value AS BIGINT) AS row_start, CAST(sum(value) OVER (ORDER BY ipix) AS BIGINT) AS row_end FROM {count_sql(6)} AS c")
add("index_range_count", lambda s, d: M.cumulative_index(sky_counts(s, d, 6), 6).where("ipix BETWEEN 1000 AND 1999").agg((F.max("row_end") - F.min("row_start")).alias("n")), f"SELECT CAST(sum(value) AS BIGINT) AS n FROM {count_sql(6)} AS c WHERE ipix BETWEEN 1000 AND 1999")
add("sort_hash29", lambda s, d: M.sort_by_cell(source(s, d, SKY)).select("id", "hash29"), C.to_sql(SKY, C.cell_hash(29, out="hash29"), ["id", "hash29"]))
add("map_statistics", lambda s, d: sky_counts(s, d, 6).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("value").alias("n_distinct")), f"SELECT min(value) AS least, max(value) AS most, count(DISTINCT value) AS n_distinct FROM {count_sql(6)} AS c")


def filtered(name: str, predicate: str) -> None:
    add(name, lambda s, d: source(s, d, SKY).where(F.expr(C.doubles(predicate))).select("id", "lon", "lat"), f"SELECT id, lon, lat FROM {SKY} AS t WHERE {predicate}")


TRIANGLE = [(20.0, -10.0), (60.0, -5.0), (45.0, 35.0)]
filtered("zone_filter", M.in_zone(350.0, -10.0, 20.0, 30.0))
filtered("cone_filter", f"{M.haversine('40.0', '20.0', 'lon', 'lat')} <= 12.5")
filtered("ellipse_filter", M.in_ellipse(100.0, -40.0, 15.0, 5.0, 30.0))
filtered("polygon_filter", M.in_polygon(TRIANGLE))

CONE = V.cover(V.Cone(40.0, 20.0, 12.5), 6)
_EXACT = f"{M.haversine('40.0', '20.0', 'lon', 'lat')} <= 12.5"
add("within_cone", lambda s, d: M.within(M.with_hash(source(s, d, SKY), 29, out="hash29"), V.ranges(CONE), _EXACT).select("id", "lon", "lat"), f"SELECT id, lon, lat FROM {SKY} AS t WHERE {_EXACT}")
_RANGES = ", ".join(f"({x << 2 * (29 - o)}, {(x + 1) << 2 * (29 - o)}, {f})" for o, x, f in CONE)
add(
    "bmoc_test_coo",
    lambda s, d: M.test_positions(source(s, d, SKY), V.to_df(s, CONE), 6).groupBy("status").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN f THEN 'IN' WHEN f IS NOT NULL THEN 'UNKNOWN' ELSE 'OUT' END AS status, count(*) AS n FROM ({C.to_sql(SKY, C.cell_hash(29, out='h'), ['id', 'h'])}) p LEFT JOIN (VALUES {_RANGES}) AS r(lo, hi, f) ON p.h >= r.lo AND p.h < r.hi GROUP BY 1",
)
for _name, _cells in {
    "cone_cover": V.cover(V.Cone(13.158329, -72.80028, 5.64323), 3, 2),
    "ring_cover": V.cover(V.Cone(13.158329, -72.80028, 10.0, 5.64323), 4),
    "cone_cover_centres": V.cover(V.Cone(13.158329, -72.80028, 5.64323), 4, mode="centres"),
    "cone_cover_inside": V.cover(V.Cone(13.158329, -72.80028, 5.64323), 4, mode="inside"),
    "zone_cover": V.cover(V.Zone(0.0, -10.0, 20.0, 10.0), 4, 3),
    "polygon_cover": V.cover(V.Polygon(TRIANGLE), 4, 3),
    "ellipse_cover": V.cover(V.ellipse(100.0, -40.0, 15.0, 5.0, 30.0), 4, 3),
    "box_cover": V.cover(V.box(100.0, -40.0, 10.0, 4.0, 30.0), 4, 3),
}.items():
    add(_name, lambda s, d, c=_cells: V.to_df(s, c))


def moc(s, d, src, depth=4):
    return M.to_ranges(M.with_hash(source(s, d, src), depth).select(F.lit(depth).alias("order_"), "ipix", F.lit(True).alias("is_full")).distinct())


_A, _B = (f"(SELECT DISTINCT ipix FROM {hashed(4, x)} AS h)" for x in (CUSTOMERS, SUPPLIERS))
_SETS = {"and": f"SELECT ipix FROM {_A} AS a INTERSECT SELECT ipix FROM {_B} AS b", "or": f"SELECT ipix FROM {_A} AS a UNION SELECT ipix FROM {_B} AS b", "minus": f"SELECT ipix FROM {_A} AS a EXCEPT SELECT ipix FROM {_B} AS b", "not": f"SELECT ipix FROM {cells_sql(4)} AS c EXCEPT SELECT ipix FROM {_A} AS a"}
_SETS["xor"] = f"(SELECT ipix FROM {_A} AS a UNION SELECT ipix FROM {_B} AS b) EXCEPT (SELECT ipix FROM {_A} AS a INTERSECT SELECT ipix FROM {_B} AS b)"
for _op, _sql in _SETS.items():
    add(f"moc_{_op}", lambda s, d, op=_op: M.flatten(M.combine(moc(s, d, CUSTOMERS), None if op == "not" else moc(s, d, SUPPLIERS), op), 4), f"SELECT ipix, true AS is_full FROM ({_sql}) AS q")
_NEAR = " UNION ".join(["SELECT ipix FROM n", *[f"SELECT n_{x.lower()} FROM n WHERE n_{x.lower()} IS NOT NULL" for x in C.DIRECTIONS]])
add("moc_expand", lambda s, d: M.expand(M.with_hash(source(s, d, SUPPLIERS), 4).select("ipix").distinct(), 4), f"WITH n AS ({C.to_sql(_B, C.neighbours(4), '*')}) {_NEAR}")
add("moc_border", lambda s, d: M.external_border(M.with_hash(source(s, d, SUPPLIERS), 4).select("ipix").distinct(), 4), f"WITH n AS ({C.to_sql(_B, C.neighbours(4), '*')}) SELECT ipix FROM ({_NEAR}) AS q EXCEPT SELECT ipix FROM n")


def merge_sql(depth: int, rule: str, kind: str = "BIGINT") -> str:
    """Unrolled bottom-up merge; rule is SQL over v0 .. v3, NULL where four siblings stay."""
    ctes, parts = [f"m{depth} AS MATERIALIZED (SELECT ipix, CAST(value AS {kind}) AS value FROM {count_sql(depth)} AS c)"], []
    for k in range(depth, 0, -1):
        four = ", ".join(f"max(CASE WHEN (ipix & 3) = {j} THEN value END) AS v{j}" for j in range(4))
        ctes.append(f"g{k} AS MATERIALIZED (SELECT p, CASE WHEN n = 4 THEN {rule} END AS m FROM (SELECT ipix >> 2 AS p, count(*) AS n, {four} FROM m{k} GROUP BY 1) AS q)")
        ctes.append(f"m{k - 1} AS MATERIALIZED (SELECT p AS ipix, CAST(m AS {kind}) AS value FROM g{k} WHERE m IS NOT NULL)")
        parts.append(f"SELECT {k} AS order_, ipix, value FROM m{k} JOIN g{k} ON ipix >> 2 = p WHERE m IS NULL")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join([*parts, 'SELECT 0 AS order_, ipix, value FROM m0'])}"


_SUM = "(v0 + v1 + v2 + v3)"
_CHI2 = f"CASE WHEN (CASE WHEN least(v0, v1, v2, v3) <= 0 THEN CAST({_SUM} AS DOUBLE) ELSE {_SUM} - 16.0 / (1.0 / v0 + 1.0 / v1 + 1.0 / v2 + 1.0 / v3) END) < {M.CHI2_3DOF} THEN {_SUM} END"
add("mom_chi2_count", lambda s, d: M.multi_order_map(sky_counts(s, d, 4), 4, M.chi2_count_merger()), merge_sql(4, _CHI2))
add("mom_threshold", lambda s, d: M.multi_order_map(sky_counts(s, d, 5), 5, M.threshold_merger(40)), merge_sql(5, f"CASE WHEN {_SUM} < 40 THEN {_SUM} END"))
_MOM = merge_sql(4, _CHI2)
_IN = "(p.ipix >> (2 * (4 - m.order_))) = m.ipix"
add("mom_lookup", lambda s, d: M.lookup(M.with_hash(source(s, d, CUSTOMERS), 4), M.multi_order_map(sky_counts(s, d, 4), 4, M.chi2_count_merger()), 4).select("id", "order_", "value"), f"SELECT p.id, m.order_, m.value FROM {hashed(4, CUSTOMERS)} p JOIN ({_MOM}) m ON {_IN}")
_MOM2 = merge_sql(4, f"CASE WHEN {_SUM} < 40 THEN {_SUM} END")
add(
    "mom_mult",
    lambda s, d: M.multiply(M.multi_order_map(sky_counts(s, d, 4), 4, M.chi2_count_merger()), M.multi_order_map(sky_counts(s, d, 4), 4, M.threshold_merger(40)), 4, 0.5).select("order_", "ipix", F.round("value", 6).alias("value")),
    f"SELECT greatest(a.order_, b.order_) AS order_, CASE WHEN a.order_ >= b.order_ THEN a.ipix ELSE b.ipix END AS ipix, round(a.value * b.value * 0.5, 6) AS value FROM ({_MOM}) a JOIN ({_MOM2}) b ON CASE WHEN a.order_ >= b.order_ THEN (a.ipix >> (2 * (a.order_ - b.order_))) = b.ipix ELSE (b.ipix >> (2 * (b.order_ - a.order_))) = a.ipix END",
)
_XD = M.haversine("a.lon", "a.lat", "b.lon", "b.lat")
add("xmatch", lambda s, d: M.cross_match(source(s, d, CUSTOMERS), source(s, d, SUPPLIERS), 3.0, 3).select("left_id", "right_id", F.round("distance", 9).alias("distance")), f"SELECT a.id AS left_id, b.id AS right_id, round({_XD}, 9) AS distance FROM {CUSTOMERS} a JOIN {SUPPLIERS} b ON {_XD} <= 3.0")
add("sql_hpx_hash", lambda s, d: (sky.register_sql(s), source(s, d, CUSTOMERS).selectExpr("id", "hpx_hash(9, lon, lat) AS ipix", "hpx_nside(9) AS nside"))[1], f"SELECT id, ipix, 512 AS nside FROM {hashed(9, CUSTOMERS)} AS h")
add("stream_count_map", lambda s, d: counts.run_once(s, f"{d}/events.parquet", 5, EVENTS), f"SELECT * FROM {count_sql(5, EVENTS)} AS c")
add("fits_skymap", lambda s, d: sky.round_trip(s, sky_counts(s, d, 5), 5), f"SELECT * FROM {count_sql(5)} AS c")


# Geometry, RING cells of any nside, regions in text, refinements, images and files


def numbered(name: str, depth: int, points: int, layers: C.Layers, out: list[str]) -> None:
    """A query of layers over each cell of a depth with numbers k below points."""
    cells_k = f"(SELECT ipix, CAST(k AS BIGINT) AS k FROM {cells_sql(depth)} AS c, (SELECT range AS k FROM range({points})) AS n)"
    add(name, lambda s, d: C.apply(all_cells(s, depth).select("ipix", F.explode(F.expr(f"sequence(0L, {points - 1}L)")).alias("k")), layers).selectExpr(*map(C.doubles, out)), C.to_sql(cells_k, layers, out))


def ringed(name: str, nside: int, layers: C.Layers, out: list[str]) -> None:
    add(name, lambda s, d: C.apply(s.range(R.n_hash(nside)).select(F.col("id").alias("ring")), layers).selectExpr(*map(C.doubles, out)), C.to_sql(f"(SELECT CAST(range AS BIGINT) AS ring FROM range({R.n_hash(nside)}))", layers, out))


layered("ring_hash_any", SKY, R.cell_hash(100), ["id", "ring"])
ringed("ring_center_any", 12, R.position(12), ["ring", *r9("lon", "lat")])
ringed("ring_position_any", 12, R.position(12, dx=0.25, dy=0.75), ["ring", *r9("lon", "lat")])
ringed("ring_plane_any", 12, R.plane(12), ["ring", *r9("px", "py")])
ringed("ring_vertices_any", 12, R.vertices(12), ["ring", *r9(*[f"{d}_{c}" for d in "senw" for c in ("lon", "lat")])])
numbered("cell_side_path", 3, 5, G.side_path(3, "E", "N", 4), ["ipix", "k", *r9("lon", "lat")])
numbered("cell_edge_path", 3, 12, G.edge_path(3, 3), ["ipix", "k", *r9("lon", "lat")])
numbered("cell_edge_path_clockwise", 3, 12, G.edge_path(3, 3, clockwise=True), ["ipix", "k", *r9("lon", "lat")])
numbered("cell_grid", 3, 16, G.grid(3, 3), ["ipix", "k", *r9("lon", "lat")])
layered("projected_vertices", 4, G.projected_vertices(4), ["ipix", *r9(*[f"{d}_{c}" for d in "senw" for c in ("x", "y")])])
layered("cell_radius", 4, G.cell_radius(4), ["ipix", "round(radius, 6) AS radius"])
layered("internal_corners", 4, [{f"c_{d.lower()}": e for d, e in G.internal_corners("ipix", 3).items()}], ["ipix", "c_s", "c_e", "c_n", "c_w"])
layered("internal_side", 4, [{f"e{k}": e for k, e in enumerate(G.internal_side("ipix", 2, "NE"))}], ["ipix", "e0", "e1", "e2", "e3"])
layered("proj_base_cell", SKY, [*C.project("lon", "lat", "px", "py"), *G.base_cell("px", "py")], ["id", "base"])
layered("sin_projection", CUSTOMERS, G.sin_project(40.0, 20.0), ["id", *r9("x", "y")])
layered("sin_round_trip", CUSTOMERS, [*G.sin_project(40.0, 20.0), *G.sin_unproject(40.0, 20.0, lon="slon", lat="slat")], ["id", "round(slon, 6) AS slon", "round(slat, 6) AS slat"])
layered("best_depth", CUSTOMERS, [{"depth": G.best_depth("(90.0 / (id * id + 1))")}], ["id", "CAST(depth AS INT) AS depth"])
layered("depth_of_nside", 3, [{"depth": G.depth_of_nside("(ipix + 1)")}], ["ipix", "CAST(depth AS INT) AS depth"])
add("cell_sizes", lambda s, d: s.range(30).selectExpr("id AS depth", C.doubles(f"round({G.cell_size('id')}, 12) AS size")), f"SELECT range AS depth, round({G.cell_size('range')}, 12) AS size FROM range(30)")

REGION = "Intersection ICRS (Circle 40 20 14 Not (Union (PositionInterval 35 15 42 22 Polygon 44 18 50 18 47 26)))"
DIFFERENCE = "Difference ICRS (Circle SPHER2 100 -40 12 Ellipse 104 -40 15 5 30)"
for _name, _text in {"region_filter": REGION, "region_difference": DIFFERENCE}.items():
    filtered(_name, Q.predicate(_text))
add("region_cover", lambda s, d: V.to_df(s, Q.cover(REGION, 6)))
add("within_region", lambda s, d: M.within(M.with_hash(source(s, d, SKY), 29, out="hash29"), V.ranges(Q.cover(REGION, 6)), Q.predicate(REGION)).select("id", "lon", "lat"), f"SELECT id, lon, lat FROM {SKY} AS t WHERE {Q.predicate(REGION)}")
_POLYGONS = {"a": TRIANGLE, "b": [(30.0, -20.0), (80.0, -20.0), (80.0, 15.0), (30.0, 10.0)], "c": [(200.0, 10.0), (230.0, 10.0), (215.0, 50.0)]}
add(
    "polygons_of_positions",
    lambda s, d: source(s, d, CUSTOMERS).select("id", F.explode(F.array_compact(F.array(*[F.expr(f"CASE WHEN {C.doubles(M.in_polygon(p))} THEN '{n}' END") for n, p in _POLYGONS.items()]))).alias("polygon")),
    " UNION ALL ".join(f"SELECT id, '{n}' AS polygon FROM {CUSTOMERS} AS t WHERE {M.in_polygon(p)}" for n, p in _POLYGONS.items()),
)


def chi2_mom(s, d):
    return M.multi_order_map(sky_counts(s, d, 4), 4, M.chi2_count_merger())


def threshold_mom(s, d):
    return M.multi_order_map(sky_counts(s, d, 4, EVENTS), 4, M.threshold_merger(40))


_EVENT_COUNTS = count_sql(4, EVENTS)
_MOM3 = _MOM2.replace(count_sql(4), _EVENT_COUNTS)
#: Both maps cut to the deepest cells, where a full join is plain; the refinement is compared cut likewise.
_CUT = lambda m: f"(SELECT (m.ipix << (2 * (4 - m.order_))) + k AS cell, m.value, m.order_ FROM ({m}) AS m, (SELECT range AS k FROM range(256)) AS n WHERE k < (1 << (2 * (4 - m.order_))))"
add(
    "mom_refine",
    lambda s, d: M.refine(storage.held(chi2_mom(s, d)), storage.held(threshold_mom(s, d)), 4).select(F.explode(F.expr("sequence(shiftleft(ipix, 2 * (4 - order_)), shiftleft(ipix + 1, 2 * (4 - order_)) - 1)")).alias("ipix"), "l", "l_order", "r", "r_order"),
    f"SELECT CAST(coalesce(a.cell, b.cell) AS BIGINT) AS ipix, a.value AS l, CAST(a.order_ AS INT) AS l_order, b.value AS r, CAST(b.order_ AS INT) AS r_order FROM {_CUT(_MOM)} AS a FULL JOIN {_CUT(_MOM3)} AS b ON a.cell = b.cell",
)
_HOLDS = "CASE WHEN c.order_ >= m.order_ THEN (c.ipix >> (2 * (c.order_ - m.order_))) = m.ipix ELSE (m.ipix >> (2 * (m.order_ - c.order_))) = c.ipix END"
add(
    "mom_overlapping",
    lambda s, d: M.overlapping(M.with_hash(source(s, d, SUPPLIERS), 3).select(F.lit(3).alias("order_"), "ipix").distinct(), chi2_mom(s, d), 4),
    f"SELECT c.order_, c.ipix, CAST(m.order_ AS INT) AS m_order, m.ipix AS m_ipix, m.value FROM (SELECT DISTINCT 3 AS order_, ipix FROM {hashed(3, SUPPLIERS)} AS h) AS c JOIN ({_MOM}) AS m ON {_HOLDS}",
)
add("mom_densities", lambda s, d: M.densities(chi2_mom(s, d)).select("order_", "ipix", F.round("value", 6).alias("value")), f"SELECT CAST(order_ AS INT) AS order_, ipix, round(value * CAST((CAST(12 AS BIGINT) << (2 * order_)) AS DOUBLE) / (4.0 * pi()), 6) AS value FROM ({_MOM}) AS m")


def density_mom_sql(depth: int) -> str:
    """merge_sql's form with the rule of chi2_density_merger, whose cell area depends on the depth."""
    counts_ = count_sql(depth)
    norm = f"{float(C.n_hash(depth))!r} / (4.0 * pi())"
    ctes, parts = [f"m{depth} AS MATERIALIZED (SELECT ipix, value * {norm} AS value FROM {counts_} AS c)"], []
    for k in range(depth, 0, -1):
        one = f"({float(C.n_hash(k) // 4)!r} / pi())"
        four = ", ".join(f"max(CASE WHEN (ipix & 3) = {j} THEN value END) AS v{j}" for j in range(4))
        inverse = " + ".join(f"1.0 / greatest(v{j}, {one})" for j in range(4))
        rule = f"CASE WHEN n = 4 AND (v0 + v1 + v2 + v3 - 16.0 / ({inverse})) / {one} < {M.CHI2_3DOF} THEN (v0 + v1 + v2 + v3) / 4.0 END"
        ctes.append(f"g{k} AS MATERIALIZED (SELECT p, {rule} AS m FROM (SELECT ipix >> 2 AS p, count(*) AS n, {four} FROM m{k} GROUP BY 1) AS q)")
        ctes.append(f"m{k - 1} AS MATERIALIZED (SELECT p AS ipix, m AS value FROM g{k} WHERE m IS NOT NULL)")
        parts.append(f"SELECT {k} AS order_, ipix, round(value, 6) AS value FROM m{k} JOIN g{k} ON ipix >> 2 = p WHERE m IS NULL")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join([*parts, 'SELECT 0 AS order_, ipix, round(value, 6) AS value FROM m0'])}"


add("mom_chi2_density", lambda s, d: M.multi_order_map(M.density(sky_counts(s, d, 4), 4), 4, M.chi2_density_merger()).select("order_", "ipix", F.round("value", 6).alias("value")), density_mom_sql(4))
_H29 = C.to_sql(SKY, C.cell_hash(29, out="hash29"), ["hash29"])
add("sampled_index", lambda s, d: M.sampled_index(source(s, d, SKY), 100), f"SELECT CAST(n // 100 AS BIGINT) AS sample_no, hash29 FROM (SELECT hash29, row_number() OVER (ORDER BY hash29) - 1 AS n FROM ({_H29}) AS h WHERE hash29 IS NOT NULL) AS q WHERE n % 100 = 0")
add("order_breaks", lambda s, d: M.order_breaks(M.sort_by_cell(source(s, d, SKY)), "hash29"), "SELECT 0 AS breaks")
add("moc_cells", lambda s, d: M.flatten(M.to_ranges(M.to_cells(M.union_ranges(moc(s, d, CUSTOMERS)))), 4).select("ipix"), f"SELECT DISTINCT ipix FROM {_A} AS a")
add("moc_pack_size", lambda s, d: M.deep_size(M.to_cells(M.union_ranges(moc(s, d, CUSTOMERS))), 4).select("deep_size"), f"SELECT count(*) AS deep_size FROM {_A} AS a")
add("cover_degrade", lambda s, d: M.degrade_cover(M.with_hash(source(s, d, SUPPLIERS), 4).select(F.lit(4).alias("order_"), "ipix", F.lit(True).alias("is_full")).distinct(), 2), f"SELECT DISTINCT 2 AS order_, ipix >> 4 AS ipix, false AS is_full FROM {_B} AS b")
for _p in ("mol", "car"):
    _pix = C.to_sql("(SELECT CAST(range % 64 AS BIGINT) AS px, CAST(range // 64 AS BIGINT) AS py FROM range(2048))", [*P.pixel_layers(64, 32, _p), *C.cell_hash(4)], ["px", "py", "ipix"])
    add(f"skymap_pixels_{_p}", lambda s, d, p=_p: P.image(P.pixels(s, 64, 32, p), sky_counts(s, d, 4), 4), f"SELECT px, py, value FROM ({_pix}) AS p LEFT JOIN {count_sql(4)} AS c ON p.ipix = c.ipix")
add("mom_pixels", lambda s, d: P.image(P.pixels(s, 64, 32, "car"), chi2_mom(s, d), 4, multi_order=True), f"SELECT px, py, m.value FROM ({_pix}) AS p LEFT JOIN ({_MOM}) AS m ON (p.ipix >> (2 * (4 - m.order_))) = m.ipix")
add("mom_file", lambda s, d: tables.round_trip(chi2_mom(s, d), lambda m, p: tables.write_mom(m, p, 4), lambda p: tables.read_mom(s, p, "long")), f"SELECT CAST(order_ AS INT) AS order_, ipix, value FROM ({_MOM}) AS m")
_ZONE_CELLS = V.cover(V.Zone(0.0, -10.0, 20.0, 10.0), 4)
for _name, _write, _read in (("cover_file", tables.write_cover, tables.read_cover), ("cover_csv", tables.write_cover_csv, tables.read_cover_csv)):
    add(_name, lambda s, d, w=_write, r=_read: tables.round_trip(V.to_df(s, _ZONE_CELLS), lambda c, p: w(c, p, 4), lambda p: r(s, p)))
add("fits_implicit", lambda s, d: sky.round_trip(s, sky_counts(s, d, 5), 5, implicit=True), SQL["count_map_dense"])
