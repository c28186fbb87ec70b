"""Geometry around cells as layers of SQL expressions: paths and grids in cells, depths for radii, frames, projections."""

from __future__ import annotations

import math

from spherix.functions import cells
from spherix.functions.cells import Layers, big

#: By depth, the least distance (radians) between an edge of a cell and the one opposite.
OPPOSITE_EDGES = (
    8.410686705679302e-1, 3.7723631722170065e-1, 1.8203364957037313e-1, 8.91145416330163e-2, 4.3989734509169175e-2,
    2.1817362566054977e-2, 1.0854009694242892e-2, 5.409888140793663e-3, 2.6995833266547898e-3, 1.3481074874673246e-3,
    6.735240905806414e-4, 3.365953703015157e-4, 1.682452196838741e-4, 8.410609042173736e-5, 4.204784317861652e-5,
    2.1022283297961136e-5, 1.0510625670060442e-5, 5.255150320257332e-6, 2.6275239729465538e-6, 1.3137458638808036e-6,
    6.568678535571394e-7, 3.284323270983175e-7, 1.642156595517884e-7, 8.21076709163242e-8, 4.105378528139296e-8,
    2.0526876713226626e-8, 1.0263433216329513e-8, 5.131714858175969e-9, 2.5658567623093986e-9, 1.2829280665188905e-9,
)
#: Rows of the rotation from equatorial (ICRS) to galactic coordinates.
GALACTIC = ((-0.0548755604162154, -0.8734370902348850, -0.4838350155487132), (0.4941094278755837, -0.4448296299600112, 0.7469822444972189), (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669))


def best_depth(radius: str) -> str:
    """Deepest depth at which a cone of the radius (degrees) meets at most a cell and its neighbours; 0 where there is none."""
    return f"CASE WHEN {radius} IS NOT NULL THEN greatest(0, {' + '.join(f'CAST(radians({radius}) < {d!r} AS INT)' for d in OPPOSITE_EDGES)} - 1) END"


def best_starting_depth(radius: float) -> int | None:
    """best_depth of a number; None where not even depth 0 will do."""
    n = sum(math.radians(radius) < d for d in OPPOSITE_EDGES)
    return n - 1 if n else None


def depth_of_nside(nside: str) -> str:
    """NULL for what isn't a power of two."""
    return f"CASE WHEN {nside} > 0 AND ({nside} & ({nside} - 1)) = 0 THEN CAST(bit_count({nside} - 1) AS INT) END"


def cell_size(depth: str) -> str:
    """Side of a square of a cell's area, in degrees."""
    return f"degrees(sqrt(4.0 * pi() / CAST(({big('12')} << CAST(2 * {depth} AS INT)) AS DOUBLE)))"


def base_cell(x: str, y: str, out: str = "base") -> Layers:
    """Base cell of a point of the projection plane; beyond a cap's edges, the cell of its column."""
    return [
        {"_bx": f"CASE WHEN {x} < 0 THEN {x} + 8.0 ELSE {x} END"},
        {"_ba": big(f"floor((_bx + {y} + 1.0) / 2.0)"), "_bb": big(f"floor(({y} - _bx + 1.0) / 2.0)"), "_bq": big("floor(_bx / 2.0)")},
        {out: "CASE WHEN _ba + _bb >= 1 THEN (CASE WHEN _ba + _bb > 1 THEN _bq ELSE _ba - 1 END) & 3 WHEN _ba + _bb = 0 THEN 4 + (_ba & 3) ELSE 8 + ((CASE WHEN _ba + _bb < -1 THEN _bq ELSE _ba END) & 3) END"},
    ]


def position_at(depth: int, h: str, dx: str, dy: str, lon: str = "lon", lat: str = "lat") -> Layers:
    """Position at (dx, dy), expressions from 0 to 1, in a cell; a border point of a cap stays on the cell's side."""
    return [
        *cells.decode(depth, h),
        {"_dx": dx, "_dy": dy},
        *cells.plane_of(depth, "_face", "_x + _dx", "_y + _dy", "_px", "_py"),
        {"_gc": "2.0 * (_face & 3) + 1.0", "_gs": "2.0 - abs(_py)", "_eqr": "abs(_py) <= 1.0"},
        {"_gl": "CASE WHEN _eqr THEN _px WHEN _gs < 1e-13 THEN _gc ELSE _gc + least(greatest((_px - _gc) / _gs, -1.0), 1.0) END"},
        {
            lon: "45.0 * (CASE WHEN _gl < 0 THEN _gl + 8.0 WHEN _gl >= 8.0 THEN _gl - 8.0 ELSE _gl END)",
            lat: "CASE WHEN _eqr THEN degrees(asin(least(greatest(_py / 1.5, -1.0), 1.0))) WHEN _py > 0 THEN degrees(2.0 * acos(_gs / sqrt(6.0)) - pi() / 2.0) ELSE -degrees(2.0 * acos(_gs / sqrt(6.0)) - pi() / 2.0) END",
        },
    ]


def side_path(depth: int, start: str, end: str, segments: int, h: str = "ipix", k: str = "k") -> Layers:
    """The k-th of the points that cut a side from corner start to corner end in segments."""
    (x0, y0), (x1, y1) = cells.CARDINALS[start], cells.CARDINALS[end]
    return position_at(depth, h, f"{float(x0)!r} + {float(x1 - x0)!r} * {k} / {float(segments)!r}", f"{float(y0)!r} + {float(y1 - y0)!r} * {k} / {float(segments)!r}")


def edge_path(depth: int, segments: int, clockwise: bool = False, h: str = "ipix", k: str = "k") -> Layers:
    """The k-th of 4 * segments points around a cell, from the south corner by the east, or by the west if clockwise."""
    t = f"(({k} % {segments}) / {float(segments)!r})"
    side = lambda a: f"CASE WHEN {k} < {segments} THEN {a[0]} WHEN {k} < {2 * segments} THEN {a[1]} WHEN {k} < {3 * segments} THEN {a[2]} ELSE {a[3]} END"
    first, second = side((t, "1.0", f"1.0 - {t}", "0.0")), side(("0.0", t, "1.0", f"1.0 - {t}"))
    return position_at(depth, h, *((second, first) if clockwise else (first, second)))


def grid(depth: int, segments: int, h: str = "ipix", k: str = "k") -> Layers:
    """The k-th of (segments + 1)^2 points of a regular grid over a cell."""
    n = segments + 1
    return position_at(depth, h, f"({k} % {n}) / {float(segments)!r}", f"(({k} - {k} % {n}) / {float(n)!r}) / {float(segments)!r}")


def projected_vertices(depth: int, h: str = "ipix") -> Layers:
    """Columns s_x, s_y .. w_y in the projection plane."""
    own = {f"{d.lower()}_{c}": e for d, (x, y) in cells.CARDINALS.items() for layer in cells.plane_of(depth, "_face", f"_x + {x}", f"_y + {y}", "x", "y") for c, e in layer.items()}
    return [*cells.decode(depth, h), own]


def cell_radius(depth: int, h: str = "ipix", out: str = "radius") -> Layers:
    """Greatest distance (degrees) from a cell's centre to its corners."""
    far = [f"(1.0 - (sin(radians(_clat)) * sin(radians({d.lower()}_lat)) + cos(radians(_clat)) * cos(radians({d.lower()}_lat)) * cos(radians({d.lower()}_lon - _clon)))) / 2.0" for d in cells.CARDINALS]
    return [*cells.vertices(depth, h), *cells.position(depth, h, lon="_clon", lat="_clat"), {out: f"degrees(2.0 * asin(sqrt(greatest({', '.join(far)}))))"}]


def internal_corners(h: str, delta: int) -> dict[str, str]:
    n = 1 << delta
    return {d: f"({cells.first_child(h, delta)} | {cells.morton((n - 1) * x, (n - 1) * y)})" for d, (x, y) in cells.CARDINALS.items()}


def internal_side(h: str, delta: int, direction: str) -> list[str]:
    """Cells at depth + delta inside one side (SE, SW, NE or NW), from its southern end."""
    n = 1 << delta
    at = {"SE": lambda k: (k, 0), "SW": lambda k: (0, k), "NE": lambda k: (n - 1, k), "NW": lambda k: (k, n - 1)}[direction]
    return [f"({cells.first_child(h, delta)} | {cells.morton(*at(k))})" for k in range(n)]


# Vectors, frames and projections


def xyz(lon: str = "lon", lat: str = "lat", names: tuple[str, str, str] = ("_x0", "_x1", "_x2")) -> Layers:
    return [dict(zip(names, (f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))")))]


def rotated(matrix, lon: str, lat: str, to_lon: str, to_lat: str, back: bool = False) -> Layers:
    """Position in the frame of matrix's rows, or from it back."""
    rows = list(zip(*matrix)) if back else matrix
    return [
        *xyz(lon, lat),
        {f"_g{k}": " + ".join(f"({m!r}) * _x{j}" for j, m in enumerate(row)) for k, row in enumerate(rows)},
        {"_gl": "degrees(atan2(_g1, _g0))"},
        {to_lon: "CASE WHEN _gl < 0 THEN _gl + 360.0 ELSE _gl END", to_lat: "degrees(asin(least(greatest(_g2, -1.0), 1.0)))"},
    ]


def sin_project(lon0: float, lat0: float, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> Layers:
    """Orthographic plane around a centre, east and north; NULL on the far half."""
    return [
        {"_sd": f"radians({lon} - ({lon0!r}))", "_sl": f"radians({lat})", "_s0": f"radians({lat0!r})"},
        {"_sf": "sin(_sl) * sin(_s0) + cos(_sl) * cos(_s0) * cos(_sd) > 0.0"},
        {x: "CASE WHEN _sf THEN cos(_sl) * sin(_sd) END", y: "CASE WHEN _sf THEN sin(_sl) * cos(_s0) - cos(_sl) * sin(_s0) * cos(_sd) END"},
    ]


def sin_unproject(lon0: float, lat0: float, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> Layers:
    """Position of a point of the orthographic plane; NULL outside the unit circle."""
    return [
        {"_s2": f"{x} * {x} + {y} * {y}", "_s0": f"radians({lat0!r})"},
        {"_sz": "CASE WHEN _s2 <= 1.0 THEN sqrt(1.0 - _s2) END"},
        {"_sl": f"degrees(atan2({x}, _sz * cos(_s0) - {y} * sin(_s0))) + ({lon0!r})", lat: f"degrees(asin(least(greatest(_sz * sin(_s0) + {y} * cos(_s0), -1.0), 1.0)))"},
        {lon: "_sl - 360.0 * floor(_sl / 360.0)"},
    ]


# Frames by Euler angles, the frame around a position, regions of the plane


def matrix_z(angle: float) -> list[list[float]]:
    """Rotation around the third axis by degrees."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


def matrix_y(angle: float) -> list[list[float]]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [[c, 0.0, s], [0.0, 1.0, 0.0], [-s, 0.0, c]]


def matrix_x(angle: float) -> list[list[float]]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [[1.0, 0.0, 0.0], [0.0, c, -s], [0.0, s, c]]


def product(a, b) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def transposed(a) -> list[list[float]]:
    return [list(row) for row in zip(*a)]


def euler_zyz(z1: float, y2: float, z3: float) -> list[list[float]]:
    return product(matrix_z(z1), product(matrix_y(y2), matrix_z(z3)))


#: Longitude of the galactic north pole, its distance from the pole and the position of the centre, in degrees, of two equatorial frames.
GALACTIC_ANGLES = {"fk4": (192.25, 62.6, 57.0), "fk5": (192.85948, 62.87175, 57.06808)}


def galactic(frame: str) -> list[list[float]]:
    """Rows of the rotation from an equatorial frame, fk4 (B1950) or fk5 (J2000), to galactic coordinates."""
    return transposed(euler_zyz(*GALACTIC_ANGLES[frame]))


def local_frame(lon: float, lat: float) -> list[list[float]]:
    """Rows of the rotation into the frame in which a position, in degrees, is (1, 0, 0)."""
    return transposed(product(matrix_z(lon), matrix_y(-lat)))


def is_equatorial(lat: str) -> str:
    """Whether a latitude in degrees is in the equatorial region, its border with it."""
    return f"abs(radians({lat})) <= {cells.TRANSITION!r}"


def is_projected_equatorial(y: str) -> str:
    return f"abs({y}) <= 1.0"


def unit(expr: str, name: str) -> str:
    """An angle in deg, arcmin, arcsec or rad as degrees."""
    return {"deg": f"({expr})", "arcmin": f"(({expr}) / 60.0)", "arcsec": f"(({expr}) / 3600.0)", "rad": f"degrees({expr})"}[name]


# Ellipses of the plane: (sxx, syy, sxy), the covariance whose unit distance is the border


def ellipse_of_axes(a: float, b: float, pa: float) -> tuple[float, float, float]:
    """Half axes and the position angle (degrees) of the first from the y axis towards x."""
    s, c = math.sin(math.radians(pa)), math.cos(math.radians(pa))
    return a * a * s * s + b * b * c * c, a * a * c * c + b * b * s * s, (a * a - b * b) * s * c


def ellipse_of_correlation(sx: float, sy: float, rho: float) -> tuple[float, float, float]:
    return sx * sx, sy * sy, rho * sx * sy


def axes_of_ellipse(sxx: float, syy: float, sxy: float) -> tuple[float, float, float]:
    """(a, b, pa) of a covariance."""
    mean, half = (sxx + syy) / 2, math.hypot((sxx - syy) / 2, sxy)
    return math.sqrt(mean + half), math.sqrt(max(mean - half, 0.0)), math.degrees(0.5 * math.atan2(2 * sxy, syy - sxx)) % 180.0


def mahalanobis(ellipse: tuple[float, float, float], x: str = "x", y: str = "y") -> str:
    """Squared distance of a point from the centre in units of the ellipse: 1 on the border."""
    sxx, syy, sxy = ellipse
    det = sxx * syy - sxy * sxy
    return f"(({x}) * ({x}) * {syy / det!r} - 2.0 * ({x}) * ({y}) * {sxy / det!r} + ({y}) * ({y}) * {sxx / det!r})"


def ellipses_overlap(one: tuple[float, float, float], two: tuple[float, float, float], x: str = "x", y: str = "y") -> str:
    """Whether an ellipse around (x, y) may overlap one around the origin: their covariances add up, a test without false refusals."""
    return f"(sqrt({mahalanobis(tuple((math.sqrt(p) + math.sqrt(q)) ** 2 if k < 2 else p + q for k, (p, q) in enumerate(zip(one, two))), x, y)}) <= 1.0)" if one[2] == two[2] == 0 else f"({x} * {x} + {y} * {y} <= {(axes_of_ellipse(*one)[0] + axes_of_ellipse(*two)[0]) ** 2!r})"


def ellipse_path(ellipse: tuple[float, float, float], points: int, k: str = "k") -> Layers:
    """(x, y): the k-th of points on the border, by equal angles of the circle that it is stretched from."""
    a, b, pa = axes_of_ellipse(*ellipse)
    s, c = math.sin(math.radians(pa)), math.cos(math.radians(pa))
    return [{"_et": f"2.0 * pi() * {k} / {float(points)!r}"}, {"_eu": f"{a!r} * cos(_et)", "_ev": f"{b!r} * sin(_et)"}, {"x": f"_eu * {s!r} + _ev * {c!r}", "y": f"_eu * {c!r} - _ev * {s!r}"}]


def forced_sin(lon0: float, lat0: float, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y", distance: str = "distance") -> Layers:
    """Orthographic plane of all sky, the far half too, with the angular distance in degrees."""
    return [
        {"_sd": f"radians({lon} - ({lon0!r}))", "_sl": f"radians({lat})", "_s0": f"radians({lat0!r})"},
        {x: "cos(_sl) * sin(_sd)", y: "sin(_sl) * cos(_s0) - cos(_sl) * sin(_s0) * cos(_sd)", distance: "degrees(2.0 * asin(least(1.0, sqrt(pow(sin((_sl - _s0) / 2.0), 2) + cos(_sl) * cos(_s0) * pow(sin(_sd / 2.0), 2)))))"},
    ]


# Single precision


def project_float(lon: str, lat: str, x: str = "x", y: str = "y") -> Layers:
    """cells.project with every step in FLOAT."""
    f = lambda e: f"CAST({e} AS FLOAT)"
    return [
        {"_fl": f(f"radians({f(lat)})"), "_fa": f(f"abs({f(lon)}) / CAST(45 AS FLOAT)")},
        {"_fs": f(f"{f('sqrt(6.0)')} * {f('cos(abs(_fl) / 2.0 + pi() / 4.0)')}"), "_fc": f("2.0 * least(floor(_fa / 2.0), 3.0) + 1.0")},
        {
            x: f(f"(CASE WHEN {lon} < 0 THEN -1.0 ELSE 1.0 END) * (CASE WHEN abs(_fl) <= {cells.TRANSITION!r} THEN _fa ELSE _fc + (_fa - _fc) * _fs END)"),
            y: f(f"CASE WHEN abs(_fl) <= {cells.TRANSITION!r} THEN 1.5 * sin(_fl) WHEN _fl > 0 THEN 2.0 - _fs ELSE _fs - 2.0 END"),
        },
    ]


def largest_radius(depth: int) -> float:
    """An upper bound, in degrees, of the distance from any cell's centre of a depth to its corners: that of the cells at the poles and transition, by a margin."""
    return math.degrees(1.2 * math.sqrt(math.pi / 3) / (1 << depth))
