"""A text language of regions: parsed into a tree, which gives a coverage or an exact SQL predicate.

AllSky | Circle F lon lat r | Ellipse F lon lat a b pa | Box F lon lat a b [pa] | Polygon F lon lat lon lat lon lat ..
| PositionInterval F lon_min lat_min lon_max lat_max | Not [F] (R) | Union [F] (R R ..) | Intersection [F] (R R ..)
| Difference [F] (R R), all in degrees. F is a frame, ICRS or none; a flavour SPHER2 and a unit deg may follow.
Difference is symmetric, and a part without a frame has its parent's. a and b of a Box are half sides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from spherix.operators import coverage, maps
from spherix.operators.coverage import ranges_of_flags

#: Names of shapes with the counts of numbers they take (None: any even count from 6), and of set operations.
SHAPES = {"allsky": (0,), "circle": (3,), "ellipse": (5,), "box": (4, 5), "polygon": None, "positioninterval": (4,)}
SETS = {"not": "not", "union": "or", "intersection": "and", "difference": "xor"}
FRAMES = {"icrs", "unknownframe"}
_TOKEN = re.compile(r"[()]|[^\s()]+")


@dataclass
class Region:
    kind: str
    numbers: list[float] = field(default_factory=list)
    parts: list["Region"] = field(default_factory=list)


def parse(text: str) -> Region:
    """The tree of one region; a ValueError tells what is wrong and where."""
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
    region, at = _region(tokens, 0)
    if at < len(tokens):
        raise ValueError(f"'{tokens[at][0]}' at {tokens[at][1]} follows a whole region")
    return region


def _region(tokens, at: int) -> tuple[Region, int]:
    if at >= len(tokens):
        raise ValueError("a region is missing at the end")
    word, where = tokens[at]
    kind = word.lower()
    if kind not in SHAPES and kind not in SETS:
        raise ValueError(f"'{word}' at {where} isn't a region")
    at += 1
    while at < len(tokens) and tokens[at][0] not in "()" and tokens[at][0].lower() not in {*SHAPES, *SETS} and not _number(tokens[at][0]):
        if tokens[at][0].lower() not in {*FRAMES, "spher2", "unit", "deg"}:
            raise ValueError(f"'{tokens[at][0]}' at {tokens[at][1]} isn't supported: the frame is ICRS, the flavour SPHER2, the unit deg")
        at += 1
    if kind in SETS:
        return _set(kind, tokens, at)
    numbers = []
    while at < len(tokens) and _number(tokens[at][0]):
        numbers.append(float(tokens[at][0]))
        at += 1
    if at < len(tokens) and tokens[at][0].lower() == "unit":
        if at + 1 >= len(tokens) or tokens[at + 1][0].lower() != "deg":
            raise ValueError(f"the unit at {tokens[at][1]} isn't deg")
        at += 2
    return _checked(kind, numbers, where), at


def _set(kind: str, tokens, at: int) -> tuple[Region, int]:
    if at >= len(tokens) or tokens[at][0] != "(":
        raise ValueError(f"{kind} without '('")
    parts, at = [], at + 1
    while at < len(tokens) and tokens[at][0] != ")":
        part, at = _region(tokens, at)
        parts.append(part)
    if at >= len(tokens):
        raise ValueError(f"{kind} without ')'")
    if not parts or kind == "not" and len(parts) != 1 or kind == "difference" and len(parts) != 2:
        raise ValueError(f"{kind} of {len(parts)} regions")
    return Region(kind, parts=parts), at + 1


def _number(word: str) -> bool:
    return re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", word) is not None


def _checked(kind: str, n: list[float], where: int) -> Region:
    sizes = SHAPES[kind]
    if (len(n) < 6 or len(n) % 2) if sizes is None else len(n) not in sizes:
        raise ValueError(f"{kind} at {where} has {len(n)} numbers")
    pairs = list(zip(n[::2], n[1::2])) if kind in ("polygon", "positioninterval") else [tuple(n[:2])] if n else []
    if any(not 0 <= lon <= 360 or not -90 <= lat <= 90 for lon, lat in pairs):
        raise ValueError(f"{kind} at {where}: longitude isn't in [0, 360] or latitude not in [-90, 90]")
    if kind == "circle" and not 0 < n[2] < 180:
        raise ValueError(f"circle at {where}: the radius isn't in ]0, 180[")
    if kind in ("ellipse", "box") and not 0 < n[3] <= n[2] < 90:
        raise ValueError(f"{kind} at {where}: axes aren't 0 < b <= a < 90")
    if kind in ("ellipse", "box") and len(n) == 5 and not 0 <= n[4] < 180:
        raise ValueError(f"{kind} at {where}: position angle isn't in [0, 180[")
    return Region(kind, n)


def shape(region: Region):
    n = region.numbers
    if region.kind == "circle":
        return coverage.Cone(*n)
    if region.kind == "ellipse":
        return coverage.ellipse(*n)
    if region.kind == "box":
        return coverage.box(*n, *([] if len(n) == 5 else [0.0]))
    if region.kind == "positioninterval":
        return coverage.Zone(*n)
    return coverage.Polygon(list(zip(n[::2], n[1::2])))


def cover(region: Region | str, depth: int, delta: int = 0) -> list[tuple[int, int, bool]]:
    """(order, ipix, is_full) of a region, in z-order: shapes are covered, sets combined by flags."""
    if isinstance(region, str):
        region = parse(region)
    if region.kind == "allsky":
        return [(0, h, True) for h in range(12)]
    if region.kind in SHAPES:
        return coverage.cover(shape(region), depth, delta)
    parts = [cover(p, depth, delta) for p in region.parts]
    if region.kind == "not":
        return combine(parts[0], [], "not")
    return reduce(lambda a, b: combine(a, b, SETS[region.kind]), parts)


def combine(left: list[tuple[int, int, bool]], right: list[tuple[int, int, bool]], op: str) -> list[tuple[int, int, bool]]:
    """Set operation of two coverages on the driver, by the rules of maps.combine."""
    edges: dict[int, list[int]] = {}
    for side, cells_ in enumerate((left, right)):
        for d, h, full in cells_:
            by = 2 * (29 - d)
            edges.setdefault(h << by, [0, 0])[side] += 1 + full
            edges.setdefault((h + 1) << by, [0, 0])[side] -= 1 + full
    if op == "not":
        edges.setdefault(0, [0, 0])
        edges.setdefault(12 << 58, [0, 0])
    at, state, found = sorted(edges), [0, 0], []
    for lo, hi in zip(at, at[1:]):
        state = [s + e for s, e in zip(state, edges[lo])]
        flag = maps.RULES[op].get(tuple(state))
        if flag is not None:
            found.append((lo, hi, flag))
    return ranges_of_flags(found)


def predicate(region: Region | str) -> str:
    """Exact SQL over lon and lat; polygons as maps.in_polygon takes them, and a box as the polygon of its corners."""
    if isinstance(region, str):
        region = parse(region)
    n = region.numbers
    if region.kind == "allsky":
        return "(lon IS NOT NULL AND lat IS NOT NULL)"
    if region.kind == "circle":
        return f"({maps.haversine(repr(n[0]), repr(n[1]), 'lon', 'lat')} <= {n[2]!r})"
    if region.kind == "ellipse":
        return maps.in_ellipse(*n)
    if region.kind == "positioninterval":
        return maps.in_zone(*n)
    if region.kind == "polygon":
        return maps.in_polygon(list(zip(n[::2], n[1::2])))
    if region.kind == "box":
        return maps.in_polygon(coverage.corners(*n, *([] if len(n) == 5 else [0.0])))
    parts = [predicate(p) for p in region.parts]
    if region.kind == "not":
        return f"(NOT {parts[0]})"
    if region.kind == "difference":
        return f"({parts[0]} <> {parts[1]})"
    return "(" + {"union": " OR ", "intersection": " AND "}[region.kind].join(parts) + ")"
