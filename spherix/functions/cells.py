"""Cells of the hierarchical equal-area grid, NESTED and RING, as layers of SQL expressions.

An operator is a list of layers, each a dict of new columns over the columns before; a name with a leading
underscore is a scratch column. `apply` adds them to a DataFrame, where Catalyst folds them into one
projection, and `to_sql` writes the same layers as nested SELECTs. Angles are in degrees. x grows to the
north-east and y to the north-west of a base cell.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layers = list[dict[str, str]]

MAX_DEPTH = 29
TRANSITION = math.asin(2 / 3)
#: The compass points as steps (x, y).
DIRECTIONS = {"S": (-1, -1), "SE": (0, -1), "E": (1, -1), "SW": (-1, 0), "NE": (1, 0), "W": (-1, 1), "NW": (0, 1), "N": (1, 1)}
CARDINALS = {"S": (0, 0), "E": (1, 0), "N": (1, 1), "W": (0, 1)}


#: Names and numbers that an expression may come to when columns are replaced by what they stand for.
MOST_INLINED = 400
_NUMBER = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")
_WORD = re.compile(r"[A-Za-z_]\w*|\d+")


def doubles(e: str) -> str:
    """Fractions as doubles: with an exponent, which both dialects take so."""
    return _NUMBER.sub(r"\1e0", e)


def apply(df: DataFrame, layers: Layers) -> DataFrame:
    """df with the layers' columns, less the scratch ones.

    The optimizer folds projections by copying expressions, which for bit tricks grows as a power of the
    layers. A layer that would come out too large is added by a generator of one row, which stays inside the
    stage's generated code but isn't folded.
    """
    size: dict[str, int] = {}
    given = set(df.columns)
    scratch = [n for layer in layers for n in layer if n.startswith("_")]
    # a column of the user's that is called like a scratch one steps aside, unless the layers read it
    kept = {c: f"{c}__{len(given)}" for c in df.columns if c in scratch}
    if kept:
        out = apply(df.withColumnsRenamed(kept), layers)
        return out.withColumnsRenamed({new: c for c, new in kept.items()})
    for layer in layers:
        own = {n: sum(size.get(w, 1) for w in _WORD.findall(e)) for n, e in layer.items()}
        # a scratch column may be used anew; it then replaces the one before
        rest = [f"`{c}`" for c in df.columns if c not in layer] if any(n in size or n in given for n in layer) else ["*"]
        if max(own.values()) > MOST_INLINED:
            own = {}
            df = df.select(*rest, F.inline(F.array(F.struct(*[F.expr(doubles(e)).alias(n) for n, e in layer.items()]))))
        else:
            df = df.selectExpr(*rest, *[f"{doubles(e)} AS {n}" for n, e in layer.items()])
        for n in layer:
            size[n] = own.get(n, 1)
    return df.drop(*scratch)


def to_sql(source: str, layers: Layers, out: list[str] | str) -> str:
    """SELECT out over the layers over source, a table or a query in parentheses."""
    known: set[str] = set()
    for layer in layers:
        anew = f" EXCLUDE ({', '.join(n for n in layer if n in known)})" if known & set(layer) else ""
        source = f"(SELECT *{anew}, {', '.join(f'{doubles(e)} AS {n}' for n, e in layer.items())} FROM {source} AS t)"
        known |= set(layer)
    return f"SELECT {out if isinstance(out, str) else ', '.join(out)} FROM {source} AS t"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def nside(depth: int) -> int:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth {depth} isn't in [0, {MAX_DEPTH}]")
    return 1 << depth


def n_hash(depth: int) -> int:
    return 12 * nside(depth) ** 2


def spread(c: str, out: str) -> Layers:
    """Bits of c on the even places, in five doubling steps."""
    layers, own = [], c
    for k, (by, mask) in enumerate(((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))):
        name = out if by == 1 else f"_sp{k}_{out.strip('_')}"
        layers.append({name: f"(({own}) | (({own}) << {by})) & {mask}"})
        own = name
    return layers


def compact(c: str, out: str) -> Layers:
    layers, own = [{f"_cp_{out.strip('_')}": f"({c}) & {0x5555555555555555}"}], f"_cp_{out.strip('_')}"
    for k, (by, mask) in enumerate(((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))):
        name = out if by == 16 else f"_cp{k}_{out.strip('_')}"
        layers.append({name: f"(({own}) | (({own}) >> {by})) & {mask}"})
        own = name
    return layers


def side_by_side(*many: Layers) -> Layers:
    """Layers that don't depend on each other, merged level by level."""
    return [{k: v for own in many if i < len(own) for k, v in own[i].items()} for i in range(max(map(len, many)))]


def encode(depth: int, face: str, x: str, y: str, out: str) -> Layers:
    tag = out.strip("_")
    return [*side_by_side(spread(x, f"_ex_{tag}"), spread(y, f"_ey_{tag}")), {out: f"(({face}) << {2 * depth}) | _ex_{tag} | (_ey_{tag} << 1)"}]


def decode(depth: int, h: str, face: str = "_face", x: str = "_x", y: str = "_y") -> Layers:
    low = f"(({h}) & {(1 << 2 * depth) - 1})"
    return side_by_side([{face: f"({h}) >> {2 * depth}"}], compact(low, x), compact(f"({low} >> 1)", y))


def project(lon: str, lat: str, x: str = "x", y: str = "y") -> Layers:
    """Projection plane, x in [-8, 8] with the sign of lon, y in [-2, 2]."""
    return [
        {"_pl": f"radians({lat})", "_pa": f"abs({lon}) / 45.0"},
        {"_ps": "sqrt(6.0) * cos(abs(_pl) / 2.0 + pi() / 4.0)", "_pc": "2.0 * least(floor(_pa / 2.0), 3.0) + 1.0"},
        {
            x: f"(CASE WHEN {lon} < 0 THEN -1.0 ELSE 1.0 END) * (CASE WHEN abs(_pl) <= {TRANSITION!r} THEN _pa ELSE _pc + (_pa - _pc) * _ps END)",
            y: f"CASE WHEN abs(_pl) <= {TRANSITION!r} THEN 1.5 * sin(_pl) WHEN _pl > 0 THEN 2.0 - _ps ELSE _ps - 2.0 END",
        },
    ]


def unproject(x: str, y: str, lon: str = "lon", lat: str = "lat") -> Layers:
    tag = lon.strip("_")
    s, c, a = f"_us_{tag}", f"_uc_{tag}", f"_ua_{tag}"
    return [
        {s: f"2.0 - abs({y})", a: f"abs({x})", c: f"2.0 * floor(abs({x}) / 2.0) + 1.0"},
        {
            lon: f"(CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END) * (CASE WHEN abs({y}) <= 1.0 THEN {a} * 45.0 WHEN {s} < 1e-13 THEN {c} * 45.0 ELSE ({c} + least(greatest(({a} - {c}) / {s}, -1.0), 1.0)) * 45.0 END)",
            lat: f"CASE WHEN abs({y}) <= 1.0 THEN degrees(asin(least(greatest({y} / 1.5, -1.0), 1.0))) WHEN {y} > 0 THEN degrees(2.0 * acos({s} / sqrt(6.0)) - pi() / 2.0) ELSE -degrees(2.0 * acos({s} / sqrt(6.0)) - pi() / 2.0) END",
        },
    ]


def locate(depth: int, lon: str, lat: str) -> Layers:
    """_face, _x, _y of a position and the places _fx, _fy in the cell, in [0, 1). South and south-east, south-west edges belong to a cell."""
    n = nside(depth)
    return [
        {"_lat": f"radians({lat})", "_t": f"({lon} - 360.0 * floor({lon} / 360.0)) / 90.0"},
        {"_t4": "CASE WHEN _t >= 4.0 THEN 0.0 ELSE _t END", "_eq": f"abs(_lat) <= {TRANSITION!r}"},
        {"_q": "floor(_t4)", "_s": f"{n}.0 * sqrt(6.0) * cos(abs(_lat) / 2.0 + pi() / 4.0)", "_a": f"{n}.0 * (0.5 + _t4)", "_b": f"{n}.0 * 0.75 * sin(_lat)"},
        {"_u": f"CASE WHEN _eq THEN _a + _b WHEN _lat > 0 THEN {n}.0 - (1.0 - (_t4 - _q)) * _s ELSE (_t4 - _q) * _s END", "_v": f"CASE WHEN _eq THEN {5 * n}.0 - (_a - _b) WHEN _lat > 0 THEN {n}.0 - (_t4 - _q) * _s ELSE (1.0 - (_t4 - _q)) * _s END"},
        {c: big(f"CASE WHEN _eq THEN floor({v}) ELSE least(greatest(floor({v}), 0.0), {n - 1}.0) END") for c, v in (("_iu", "_u"), ("_iv", "_v"))},
        {"_fu": f"_iu >> {depth}", "_fv": f"4 - (_iv >> {depth})", "_qi": big("_q"), "_x": f"_iu & {n - 1}", "_y": f"_iv & {n - 1}", "_fx": "_u - _iu", "_fy": "_v - _iv"},
        {"_face": "CASE WHEN _eq THEN (CASE WHEN _fu = _fv THEN (_fu & 3) + 4 WHEN _fv < _fu THEN _fv & 3 ELSE (_fu & 3) + 8 END) WHEN _lat > 0 THEN _qi ELSE _qi + 8 END"},
    ]


def cell_hash(depth: int, lon: str = "lon", lat: str = "lat", out: str = "ipix") -> Layers:
    """Cell number of a position; NULL where a coordinate is NULL, not finite, or the latitude beyond a pole."""
    good = f"{lat} BETWEEN -90.0 AND 90.0 AND {lon} BETWEEN -1e9 AND 1e9"
    return [{"_glon": f"CASE WHEN {good} THEN {lon} END", "_glat": f"CASE WHEN {good} THEN {lat} END"}, *locate(depth, "_glon", "_glat"), *encode(depth, "_face", "_x", "_y", out)]


def plane_of(depth: int, face: str, x: str, y: str, px: str, py: str) -> Layers:
    """Projection-plane place of (x, y), in cells and parts of cells, of a base cell."""
    n = f"{nside(depth)}.0"
    return [{px: f"2.0 * ({face} & 3) + (CASE WHEN ({face} >> 2) = 1 THEN 0.0 ELSE 1.0 END) + (({x}) - ({y})) / {n}", py: f"(({x}) + ({y})) / {n} - ({face} >> 2)"}]


def position(depth: int, h: str = "ipix", dx: float = 0.5, dy: float = 0.5, lon: str = "lon", lat: str = "lat") -> Layers:
    """Position at (dx, dy) in a cell, its centre by default; lon in [0, 360)."""
    return [*decode(depth, h), *plane_of(depth, "_face", f"_x + {dx!r}", f"_y + {dy!r}", "_px", "_py"), {"_pxw": "CASE WHEN _px < 0 THEN _px + 8.0 ELSE _px END"}, *unproject("_pxw", "_py", lon, lat)]


def vertex(depth: int, h: str, direction: str, lon: str, lat: str) -> Layers:
    """A corner of a cell; corners are just inside the border, so that none leaves its base cell's meridians."""
    cx, cy = CARDINALS[direction]
    d = direction.lower()
    cap = f"CASE WHEN abs(_py{d}) > 1.0 AND (_face{d} >> 2) <> 1 THEN 2.0 * (_face{d} & 3) + 1.0 ELSE _px{d} END"
    return [
        *decode(depth, h, f"_face{d}", f"_x{d}", f"_y{d}"),
        *plane_of(depth, f"_face{d}", f"_x{d} + {cx}", f"_y{d} + {cy}", f"_px{d}", f"_py{d}"),
        {f"_s{d}": f"2.0 - abs(_py{d})", f"_c{d}": cap},
        {
            f"_lo{d}": f"CASE WHEN abs(_py{d}) <= 1.0 THEN _px{d} WHEN _s{d} < 1e-13 THEN _c{d} ELSE _c{d} + (_px{d} - _c{d}) / _s{d} END",
            lat: f"CASE WHEN abs(_py{d}) <= 1.0 THEN degrees(asin(_py{d} / 1.5)) WHEN _py{d} > 0 THEN degrees(2.0 * acos(_s{d} / sqrt(6.0)) - pi() / 2.0) ELSE -degrees(2.0 * acos(_s{d} / sqrt(6.0)) - pi() / 2.0) END",
        },
        {lon: f"45.0 * (CASE WHEN _lo{d} < 0 THEN _lo{d} + 8.0 WHEN _lo{d} >= 8.0 THEN _lo{d} - 8.0 ELSE _lo{d} END)"},
    ]


def vertices(depth: int, h: str = "ipix") -> Layers:
    return side_by_side(*[vertex(depth, h, d, f"{d.lower()}_lon", f"{d.lower()}_lat") for d in CARDINALS])


# Codes of cells


def uniq(depth: str, h: str) -> str:
    """A sentinel bit above the number: 16 * 4**depth + cell."""
    return f"(({big('16')} << (2 * ({depth}))) | ({h}))"


def uniq_ivoa(depth: str, h: str) -> str:
    return f"(({big('4')} << (2 * ({depth}))) + ({h}))"


def zuniq(depth: str, h: str) -> str:
    """A sentinel bit below the number, so that cells of all depths sort along the curve."""
    return f"((2 * ({h}) + 1) << (2 * ({MAX_DEPTH} - ({depth}))))"


def from_zuniq(z: str = "zuniq", depth: str = "order_", h: str = "ipix") -> Layers:
    return [{"_tz": f"bit_count((({z}) & (-({z}))) - 1)"}, {depth: f"{MAX_DEPTH} - (CAST(_tz AS INT) >> 1)", h: f"({z}) >> (CAST(_tz AS INT) + 1)"}]


def from_uniq(u: str = "uniq", depth: str = "order_", h: str = "ipix") -> Layers:
    """Order and cell of a uniq: its sentinel bit is the highest, found by its logarithm and put right by a step."""
    return _from_sentinel(u, 4, depth, h)


def from_uniq_ivoa(u: str = "uniq_ivoa", depth: str = "order_", h: str = "ipix") -> Layers:
    return _from_sentinel(u, 2, depth, h)


def _from_sentinel(u: str, shift: int, depth: str, h: str) -> Layers:
    bits = big(f"floor(ln(CAST({u} AS DOUBLE)) / ln(2.0) / 2.0 + 1e-9)")
    return [
        {"_ub": bits},
        {"_uc": f"CASE WHEN ({u}) >> CAST(2 * _ub AS INT) >= 4 THEN _ub + 1 WHEN ({u}) >> CAST(2 * _ub AS INT) = 0 THEN _ub - 1 ELSE _ub END"},
        {depth: f"CAST(_uc - {shift // 2} AS INT)", h: f"({u}) - ({big(str(1 << shift))} << CAST(2 * (_uc - {shift // 2}) AS INT))"},
    ]


def siblings(depth: int, h: str = "ipix") -> dict[str, str]:
    """First and last cell with the same parent; the base cells are siblings."""
    return {"first": f"({h}) - ({h}) % 4", "last": f"({h}) - ({h}) % 4 + 3"} if depth else {"first": big("0"), "last": big("11")}


def masks(depth: int) -> dict[str, int]:
    """Bits of the x axis, of the y axis and of both in a cell's number."""
    x = sum(1 << 2 * k for k in range(depth))
    return {"x_mask": x, "y_mask": x << 1, "xy_mask": x | x << 1}


def overlap(z1: str, z2: str) -> str:
    """Whether the cells of two ZUNIQ codes overlap: half-open ranges of depth 29 meet."""
    half = lambda z: f"(({z}) & (-({z})))"
    return f"(({z1}) - {half(z1)} < ({z2}) + {half(z2)} AND ({z2}) - {half(z2)} < ({z1}) + {half(z1)})"


def is_depth(d: str) -> str:
    return f"({d}) BETWEEN 0 AND {MAX_DEPTH}"


def is_nside(n: str) -> str:
    return f"(({n}) > 0 AND ({n}) <= {1 << MAX_DEPTH} AND (({n}) & (({n}) - 1)) = 0)"


def parent(h: str, delta: int = 1) -> str:
    return f"(({h}) >> {2 * delta})"


def first_child(h: str, delta: int = 1) -> str:
    return f"(({h}) << {2 * delta})"


def end_child(h: str, delta: int = 1) -> str:
    return f"((({h}) + 1) << {2 * delta})"


def root(e: str, out: str) -> Layers:
    """Integer square root, put right by a step either way, as a double can't hold all of 60 bits."""
    return [{f"_r_{out.strip('_')}": big(f"floor(sqrt(CAST({e} AS DOUBLE)))")}, {out: f"CASE WHEN _r_{out.strip('_')} * _r_{out.strip('_')} > ({e}) THEN _r_{out.strip('_')} - 1 WHEN (_r_{out.strip('_')} + 1) * (_r_{out.strip('_')} + 1) <= ({e}) THEN _r_{out.strip('_')} + 1 ELSE _r_{out.strip('_')} END"}]


def to_ring(depth: int, h: str = "ipix", out: str = "ring") -> Layers:
    n = nside(depth)
    return [
        *decode(depth, h),
        {"_jr": f"((_face >> 2) + 2) * {big(str(n))} - _x - _y - 1", "_lead": "2 * (_face & 3) + (CASE WHEN (_face >> 2) = 1 THEN 0 ELSE 1 END)"},
        {"_nr": f"CASE WHEN _jr < {n} THEN _jr WHEN _jr > {3 * n} THEN {4 * n} - _jr ELSE {n} END", "_shift": f"CASE WHEN _jr BETWEEN {n} AND {3 * n} THEN (_jr - {n}) & 1 ELSE 0 END"},
        {"_jp0": "(_lead * _nr + _x - _y + 1 + _shift) >> 1"},
        {"_jp": "CASE WHEN _jp0 > 4 * _nr THEN _jp0 - 4 * _nr WHEN _jp0 < 1 THEN _jp0 + 4 * _nr ELSE _jp0 END"},
        {out: f"CASE WHEN _jr < {n} THEN 2 * _jr * (_jr - 1) WHEN _jr > {3 * n} THEN {12 * n * n} - 2 * _nr * (_nr + 1) ELSE {2 * n * (n - 1)} + (_jr - {n}) * {4 * n} END + _jp - 1"},
    ]


def from_ring(depth: int, r: str = "ring", out: str = "ipix") -> Layers:
    n = nside(depth)
    cap, total = 2 * n * (n - 1), 12 * n * n
    return [
        {"_south": f"{total - 1} - ({r})"},
        {"_part": f"CASE WHEN ({r}) < {cap} THEN 0 WHEN ({r}) < {total - cap} THEN 1 ELSE 2 END", "_off": f"CASE WHEN ({r}) < {cap} THEN ({r}) WHEN ({r}) < {total - cap} THEN 0 ELSE _south END"},
        *root("1 + 2 * _off", "_rt"),
        {"_i": "(1 + _rt) >> 1"},
        {"_kr": f"CASE WHEN _part = 1 THEN {n} ELSE _i END", "_ring": f"CASE WHEN _part = 0 THEN _i WHEN _part = 1 THEN ((({r}) - {cap}) >> {depth + 2}) + {n} ELSE {4 * n} - _i END"},
        {"_phi": f"CASE WHEN _part = 0 THEN ({r}) + 1 - 2 * _i * (_i - 1) WHEN _part = 1 THEN ((({r}) - {cap}) & {4 * n - 1}) + 1 ELSE 4 * _i + 1 - (_south + 1 - 2 * _i * (_i - 1)) END", "_sh": f"CASE WHEN _part = 1 THEN (_ring - {n}) & 1 ELSE 0 END"},
        {
            "_up": f"_ring - {n} + 1",
            "_dn": f"{2 * n + 1} - _ring + {n}",
            "_q4": big("floor(CAST(_phi - 1 AS DOUBLE) / CAST(_kr AS DOUBLE))"),
        },
        {"_q": "CASE WHEN _q4 * _kr > _phi - 1 THEN _q4 - 1 WHEN (_q4 + 1) * _kr <= _phi - 1 THEN _q4 + 1 ELSE _q4 END", "_fm": f"(_phi - ((_up) >> 1) + {n} - 1) >> {depth}", "_fp": f"(_phi - (({2 * n} + 2 - _up) >> 1) + {n} - 1) >> {depth}"},
        {"_face": "CASE WHEN _part = 0 THEN _q WHEN _part = 2 THEN 8 + _q WHEN _fp = _fm THEN (_fp & 3) + 4 WHEN _fp < _fm THEN _fp & 3 ELSE (_fm & 3) + 8 END"},
        {"_irt": f"_ring - ((_face >> 2) + 2) * {n} + 1", "_lead": "2 * (_face & 3) + (CASE WHEN (_face >> 2) = 1 THEN 0 ELSE 1 END)"},
        {"_ipt0": "2 * _phi - _lead * _kr - _sh - 1"},
        {"_ipt": f"CASE WHEN _ipt0 >= {2 * n} THEN _ipt0 - {8 * n} ELSE _ipt0 END"},
        {"_x": "(_ipt - _irt) >> 1", "_y": "(-(_ipt + _irt)) >> 1"},
        *encode(depth, "_face", "_x", "_y", out),
    ]


# Neighbours


def step_to(depth: int, dx: str, dy: str, out: str) -> Layers:
    """Cell at (_x + dx, _y + dy) of _face, over the border of the base cell if need be; NULL where three base cells meet."""
    n, t = nside(depth), out.strip("_")
    x, y, f, k = f"_nx_{t}", f"_ny_{t}", f"_nf_{t}", f"_nk_{t}"
    east = f"CASE WHEN {x} < 0 THEN -1 WHEN {x} >= {n} THEN 1 ELSE 0 END"
    west = f"CASE WHEN {y} < 0 THEN -1 WHEN {y} >= {n} THEN 1 ELSE 0 END"
    wrap = lambda c: f"{c} & {n - 1}"
    over = lambda c: f"({2 * n - 1} - {c})"  # noqa: E731  # mirrored beyond a polar edge
    return [
        {x: f"_x + ({dx})", y: f"_y + ({dy})", k: "_face & 3"},
        {f"_sx_{t}": east, f"_sy_{t}": west, f"_fr_{t}": "_face >> 2"},
        {
            f: f"CASE WHEN _sx_{t} = 0 AND _sy_{t} = 0 THEN _face "
            f"WHEN _fr_{t} = 1 THEN (CASE WHEN _sx_{t} = 1 AND _sy_{t} = 0 THEN {k} WHEN _sx_{t} = 0 AND _sy_{t} = 1 THEN ({k} + 3) & 3 WHEN _sx_{t} = -1 AND _sy_{t} = 0 THEN 8 + (({k} + 3) & 3) WHEN _sx_{t} = 0 AND _sy_{t} = -1 THEN 8 + {k} WHEN _sx_{t} = 1 AND _sy_{t} = -1 THEN 4 + (({k} + 1) & 3) WHEN _sx_{t} = -1 AND _sy_{t} = 1 THEN 4 + (({k} + 3) & 3) END) "
            f"WHEN _fr_{t} = 0 THEN (CASE WHEN _sx_{t} = 1 AND _sy_{t} = 0 THEN ({k} + 1) & 3 WHEN _sx_{t} = 0 AND _sy_{t} = 1 THEN ({k} + 3) & 3 WHEN _sx_{t} = -1 AND _sy_{t} = 0 THEN 4 + {k} WHEN _sx_{t} = 0 AND _sy_{t} = -1 THEN 4 + (({k} + 1) & 3) WHEN _sx_{t} = 1 AND _sy_{t} = 1 THEN ({k} + 2) & 3 WHEN _sx_{t} = -1 AND _sy_{t} = -1 THEN 8 + {k} END) "
            f"ELSE (CASE WHEN _sx_{t} = 1 AND _sy_{t} = 0 THEN 4 + (({k} + 1) & 3) WHEN _sx_{t} = 0 AND _sy_{t} = 1 THEN 4 + {k} WHEN _sx_{t} = 0 AND _sy_{t} = -1 THEN 8 + (({k} + 1) & 3) WHEN _sx_{t} = -1 AND _sy_{t} = 0 THEN 8 + (({k} + 3) & 3) WHEN _sx_{t} = 1 AND _sy_{t} = 1 THEN {k} WHEN _sx_{t} = -1 AND _sy_{t} = -1 THEN 8 + (({k} + 2) & 3) END) END",
            f"_gx_{t}": f"CASE WHEN _fr_{t} = 0 AND _sx_{t} = 1 AND _sy_{t} = 1 THEN {over(x)} WHEN _fr_{t} = 0 AND _sx_{t} = 1 AND _sy_{t} = 0 THEN {y} WHEN _fr_{t} = 0 AND _sx_{t} = 0 AND _sy_{t} = 1 THEN {over(y)} WHEN _fr_{t} = 2 AND _sx_{t} = -1 AND _sy_{t} = -1 THEN -1 - {x} WHEN _fr_{t} = 2 AND _sx_{t} = 0 AND _sy_{t} = -1 THEN -1 - {y} WHEN _fr_{t} = 2 AND _sx_{t} = -1 AND _sy_{t} = 0 THEN {y} ELSE {wrap(x)} END",
            f"_gy_{t}": f"CASE WHEN _fr_{t} = 0 AND _sx_{t} = 1 AND _sy_{t} = 1 THEN {over(y)} WHEN _fr_{t} = 0 AND _sx_{t} = 1 AND _sy_{t} = 0 THEN {over(x)} WHEN _fr_{t} = 0 AND _sx_{t} = 0 AND _sy_{t} = 1 THEN {x} WHEN _fr_{t} = 2 AND _sx_{t} = -1 AND _sy_{t} = -1 THEN -1 - {y} WHEN _fr_{t} = 2 AND _sx_{t} = 0 AND _sy_{t} = -1 THEN {x} WHEN _fr_{t} = 2 AND _sx_{t} = -1 AND _sy_{t} = 0 THEN -1 - {x} ELSE {wrap(y)} END",
        },
        *encode(depth, f, f"_gx_{t}", f"_gy_{t}", out),
    ]


def neighbours(depth: int, h: str = "ipix") -> Layers:
    """Columns n_s .. n_n, one a compass point."""
    return [*decode(depth, h), *side_by_side(*[step_to(depth, str(x), str(y), f"n_{d.lower()}") for d, (x, y) in DIRECTIONS.items()])]


def offsets(depth: int, steps: list[tuple[int, int]], h: str = "ipix", prefix: str = "k") -> Layers:
    """Columns k0, k1 ..: the cells that many steps away; NULL where there is none. A step is at most a base cell long."""
    if any(max(abs(x), abs(y)) > nside(depth) for x, y in steps):
        raise ValueError(f"a step is longer than a base cell of depth {depth}")
    return [*decode(depth, h), *side_by_side(*[step_to(depth, str(x), str(y), f"{prefix}{i}") for i, (x, y) in enumerate(steps)])]


def ring_steps(k: int) -> list[tuple[int, int]]:
    """Steps to the k-th ring around a cell, anticlockwise from the south."""
    if not k:
        return [(0, 0)]
    side = range(-k, k)
    return [*[(x, -k) for x in side], *[(k, y) for y in side], *[(-x, k) for x in side], *[(-k, -y) for y in side]]


def kth_neighbours(depth: int, k: int, h: str = "ipix") -> Layers:
    """Columns k0 .. of the 8 k cells of the k-th ring, k at most nside."""
    return offsets(depth, ring_steps(k), h)


def kth_neighbourhood(depth: int, k: int, h: str = "ipix") -> Layers:
    """Columns k0 .. of the cell and its rings 1 to k."""
    return offsets(depth, [s for j in range(k + 1) for s in ring_steps(j)], h)


def external_edge(depth: int, delta: int, h: str = "ipix") -> Layers:
    """Columns x0 .. of the cells at depth + delta that surround a cell, anticlockwise from the southern corner."""
    n = 1 << delta
    steps = [*[(x, -1) for x in range(-1, n)], *[(n, y) for y in range(-1, n)], *[(x, n) for x in range(n, -1, -1)], *[(-1, y) for y in range(n, -1, -1)]]
    return [{"_first": first_child(h, delta)}, *offsets(depth + delta, steps, "_first", "x")]


def internal_edge_sorted(depth: int, delta: int, h: str = "ipix") -> list[str]:
    """internal_edge in ascending order: literal places in one block of children sort as they are."""
    n, base = 1 << delta, first_child(h, delta)
    return [f"({base} | {m})" for m in sorted(morton(x, y) for x in range(n) for y in range(n) if x in (0, n - 1) or y in (0, n - 1))]


def internal_edge(depth: int, delta: int, h: str = "ipix") -> list[str]:
    """Numbers at depth + delta of the cells inside the border, anticlockwise from the south: literal places, so four integers a step."""
    n, base = 1 << delta, first_child(h, delta)
    ring = [(k, 0) for k in range(n)] + [(n - 1, k) for k in range(1, n)] + [(k, n - 1) for k in range(n - 2, -1, -1)] + [(0, k) for k in range(n - 2, 0, -1)]
    return [f"({base} | {morton(x, y)})" for x, y in (ring if n > 1 else [(0, 0)])]


def morton(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(30))


def bilinear(depth: int, lon: str = "lon", lat: str = "lat") -> Layers:
    """Cells b0 to b3 around a position and weights w0 to w3; a missing corner cell shares its weight between its two neighbours."""
    return [
        *locate(depth, lon, lat),
        {"_ex": "CASE WHEN _fx >= 0.5 THEN 1 ELSE -1 END", "_ey": "CASE WHEN _fy >= 0.5 THEN 1 ELSE -1 END"},
        {"_wx": "abs(_fx - 0.5)", "_wy": "abs(_fy - 0.5)"},
        *side_by_side(encode(depth, "_face", "_x", "_y", "b0"), step_to(depth, "_ex", "0", "b1"), step_to(depth, "0", "_ey", "b2"), step_to(depth, "_ex", "_ey", "b3")),
        {"w0": "(1.0 - _wx) * (1.0 - _wy)", "w1": "_wx * (1.0 - _wy) + (CASE WHEN b3 IS NULL THEN 0.5 * _wx * _wy ELSE 0.0 END)", "w2": "(1.0 - _wx) * _wy + (CASE WHEN b3 IS NULL THEN 0.5 * _wx * _wy ELSE 0.0 END)", "w3": "CASE WHEN b3 IS NULL THEN 0.0 ELSE _wx * _wy END"},
    ]
