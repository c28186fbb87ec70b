"""RING cells for any nside, not only powers of two, as layers of SQL expressions (see cells)."""

from __future__ import annotations

from spherix.functions import cells
from spherix.functions.cells import Layers, big

MOST_NSIDE = 1 << 29


def checked(nside: int) -> int:
    if not 1 <= nside <= MOST_NSIDE:
        raise ValueError(f"nside {nside} isn't in [1, {MOST_NSIDE}]")
    return nside


def n_hash(nside: int) -> int:
    return 12 * checked(nside) ** 2


def n_rings(nside: int) -> int:
    """Rings of equal latitude."""
    return 4 * checked(nside) - 1


def first_cells(nside: int) -> dict[str, int]:
    """First cells of the equatorial region, of the rings where it meets the caps, and of the south cap."""
    n = checked(nside)
    return {"north_transition": 2 * n * (n - 1), "equatorial": 2 * n * (n + 1), "south_transition": n_hash(n) - 2 * n * (n + 1), "south_cap": n_hash(n) - 2 * n * (n - 1)}


def quotient(a: str, b: str) -> str:
    """Whole part of a / b for a >= 0: the multiple of b below a is divided, which a double can't get wrong."""
    return big(f"floor(CAST(({a}) - ({a}) % ({b}) AS DOUBLE) / CAST({b} AS DOUBLE) + 0.5)")


def cell_hash(nside: int, lon: str = "lon", lat: str = "lat", out: str = "ring") -> Layers:
    """RING cell of a position; NULL where a coordinate is NULL, not finite, or the latitude beyond a pole."""
    n = checked(nside)
    good = f"{lat} BETWEEN -90.0 AND 90.0 AND {lon} BETWEEN -1e9 AND 1e9"
    return [
        {"_rl": f"CASE WHEN {good} THEN radians({lat}) END", "_rt": f"CASE WHEN {good} THEN ({lon} - 360.0 * floor({lon} / 360.0)) / 90.0 END"},
        {"_r4": "CASE WHEN _rt >= 4.0 THEN 0.0 ELSE _rt END", "_req": f"abs(_rl) <= {cells.TRANSITION!r}"},
        {"_rq": "floor(_r4)", "_rs": f"{n}.0 * sqrt(6.0) * cos(abs(_rl) / 2.0 + pi() / 4.0)", "_ra": f"{n}.0 * (0.5 + _r4)", "_rb": f"{n}.0 * 0.75 * sin(_rl)"},
        {
            "_rp": big("CASE WHEN _req THEN floor(_ra - _rb) ELSE floor((_r4 - _rq) * _rs) END"),
            "_rm": big("CASE WHEN _req THEN floor(_ra + _rb) ELSE floor((1.0 - (_r4 - _rq)) * _rs) END"),
        },
        {"_rr": f"CASE WHEN _req THEN {n + 1} + _rp - _rm ELSE least(_rp + _rm + 1, {n}) END"},
        {"_ri": f"CASE WHEN _req THEN ((_rp + _rm - {n} + 1 + (1 - (_rr & 1))) >> 1) % {4 * n} ELSE least({big('floor(_r4 * _rr)')}, 4 * _rr - 1) END"},
        {out: f"CASE WHEN _rl IS NULL THEN NULL WHEN _req THEN {2 * n * (n - 1)} + (_rr - 1) * {4 * n} + (_ri + {4 * n}) % {4 * n} WHEN _rl > 0 THEN 2 * _rr * (_rr - 1) + _ri ELSE {n_hash(n)} - 2 * _rr * (_rr + 1) + _ri END"},
    ]


def plane(nside: int, r: str = "ring", x: str = "px", y: str = "py") -> Layers:
    """Centre of a cell in the projection plane, x in [0, 8)."""
    n, total = checked(nside), n_hash(nside)
    cap = 2 * n * (n + 1)
    return [
        {"_ps": f"{total - 1} - ({r})"},
        {"_pp": f"CASE WHEN ({r}) < {cap} THEN 0 WHEN ({r}) < {total - cap} THEN 1 ELSE 2 END", "_po": f"CASE WHEN ({r}) < {cap} THEN ({r}) WHEN ({r}) < {total - cap} THEN 0 ELSE _ps END"},
        *cells.root("1 + 2 * _po", "_prt"),
        {"_pi": "(1 + _prt) >> 1"},
        # in the south cap, places are counted from the last cell
        {"_pk": f"CASE WHEN _pp = 1 THEN (({r}) - {cap}) % {4 * n} ELSE _po - 2 * _pi * (_pi - 1) END", "_pn": f"CASE WHEN _pp = 1 THEN {n} ELSE _pi END", "_pj": f"CASE WHEN _pp = 0 THEN _pi WHEN _pp = 2 THEN {4 * n} - _pi ELSE {n + 1} + {quotient(f'CASE WHEN _pp = 1 THEN ({r}) - {cap} ELSE 0 END', str(4 * n))} END"},
        {"_pt": "CASE WHEN _pp = 2 THEN 4 * _pn - 1 - _pk ELSE _pk END"},
        {"_pq": quotient("_pt", "_pn")},
        {
            x: f"CASE WHEN _pp = 1 THEN (2.0 * _pt + ((_pj + {n} + 1) & 1)) / {n}.0 ELSE 2.0 * _pq + 1.0 + (2.0 * (_pt - _pq * _pn) + 1.0 - _pn) / {n}.0 END",
            y: f"({2 * n} - _pj) / {n}.0",
        },
    ]


def position(nside: int, r: str = "ring", dx: float = 0.5, dy: float = 0.5, lon: str = "lon", lat: str = "lat") -> Layers:
    """Position at (dx, dy) in a cell, its centre by default; lon in [0, 360)."""
    px, py = f"_qx + {(dx - dy) / nside!r}", f"_qy + {(dx + dy - 1) / nside!r}"
    return [*plane(nside, r, "_qx", "_qy"), {"_qpx": px, "_qpy": py}, {"_qw": "CASE WHEN _qpx < 0 THEN _qpx + 8.0 WHEN _qpx >= 8.0 THEN _qpx - 8.0 ELSE _qpx END"}, *cells.unproject("_qw", "_qpy", lon, lat)]


def vertices(nside: int, r: str = "ring") -> Layers:
    """Columns s_lon, s_lat .. w_lat: the corners, those of a cap's cells on the cap's own meridians."""
    step = 1.0 / nside
    layers = plane(nside, r, "_vx", "_vy")
    for d, (x, y) in {"s": (0.0, -step), "e": (step, 0.0), "n": (0.0, step), "w": (-step, 0.0)}.items():
        layers += [
            {f"_vx{d}": f"_vx + {x!r}", f"_vy{d}": f"_vy + {y!r}"},
            {f"_vs{d}": f"2.0 - abs(_vy{d})", f"_vc{d}": "2.0 * floor(_vx / 2.0) + 1.0"},
            {f"_vl{d}": f"CASE WHEN abs(_vy{d}) <= 1.0 THEN _vx{d} WHEN _vs{d} < 1e-13 THEN _vc{d} ELSE _vc{d} + least(greatest((_vx{d} - _vc{d}) / _vs{d}, -1.0), 1.0) END"},
            {
                f"{d}_lon": f"45.0 * (CASE WHEN _vl{d} < 0 THEN _vl{d} + 8.0 WHEN _vl{d} >= 8.0 THEN _vl{d} - 8.0 ELSE _vl{d} END)",
                f"{d}_lat": f"CASE WHEN abs(_vy{d}) <= 1.0 THEN degrees(asin(least(greatest(_vy{d} / 1.5, -1.0), 1.0))) WHEN _vy{d} > 0 THEN degrees(2.0 * acos(_vs{d} / sqrt(6.0)) - pi() / 2.0) ELSE -degrees(2.0 * acos(_vs{d} / sqrt(6.0)) - pi() / 2.0) END",
            },
        ]
    return layers
