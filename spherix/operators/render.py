"""Sky maps and multi-order maps as images: a pixel is a row that is unprojected, hashed and joined to the map."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.functions import cells, geometry
from spherix.operators import maps

MOST_PIXELS = 1 << 24


def _all_sky(lon: str, lat: str, inside: str = "true") -> cells.Layers:
    return [{"_ul": f"CASE WHEN {inside} THEN {lon} END", "_ub": f"CASE WHEN {inside} THEN {lat} END"}]


#: Degrees from the centre, west to the right, of a point with x in [-2, 2] and y in [-1, 1].
PROJECTIONS = {
    "mol": [{"_t": "asin(y)"}, *_all_sky("90.0 * x / greatest(cos(_t), 1e-12)", "degrees(asin(least(greatest((2.0 * _t + sin(2.0 * _t)) / pi(), -1.0), 1.0)))", "x * x / 4.0 + y * y <= 1.0")],
    "ait": [{"_z": "sqrt(greatest(1.0 - x * x / 8.0 - y * y / 2.0, 0.0))"}, *_all_sky("degrees(2.0 * atan2(_z * x * sqrt(2.0) / 2.0, 2.0 * _z * _z - 1.0))", "degrees(asin(least(greatest(_z * y * sqrt(2.0), -1.0), 1.0)))", "x * x / 4.0 + y * y <= 1.0")],
    "car": _all_sky("90.0 * x", "90.0 * y"),
    "cea": _all_sky("90.0 * x", "degrees(asin(y))"),
    "mer": _all_sky("90.0 * x", "degrees(2.0 * atan(exp(pi() * y)) - pi() / 2.0)"),
    "sfl": _all_sky("90.0 * x / greatest(cos(pi() * y / 2.0), 1e-12)", "90.0 * y", "abs(x) <= 2.0 * cos(pi() * y / 2.0)"),
    "cyp": _all_sky("90.0 * x", "degrees(2.0 * atan(y))"),
    "par": _all_sky("90.0 * x / greatest(1.0 - y * y, 1e-12)", "degrees(3.0 * asin(y / 2.0))", "abs(x) <= 2.0 * (1.0 - y * y)"),
    "hpx": [
        {"_hx": "2.0 * x + 4.0", "_hy": "2.0 * y"},
        {"_hin": "abs(_hy) <= 1.0 OR abs(_hx - 2.0 * floor(_hx / 2.0) - 1.0) <= 2.0 - abs(_hy)"},
        *cells.unproject("_hx", "_hy", "_hl", "_hb"),
        *_all_sky("_hl - 180.0", "_hb", "_hin"),
    ],
}


#: Views around a position: from an angle (SQL, radians) to the distance from the middle, back from the distance _zr, and where there is one.
ZENITHAL = {
    "arc": (lambda t: f"({t})", "_zr", "_zr <= pi()"),
    "feye": (lambda t: f"({t})", "_zr", "_zr <= pi() / 2.0"),
    "stg": (lambda t: f"(2.0 * tan(({t}) / 2.0))", "(2.0 * atan(_zr / 2.0))", "_zr IS NOT NULL"),
    "tan": (lambda t: f"tan(({t}))", "atan(_zr)", "_zr IS NOT NULL"),
    "zea": (lambda t: f"(2.0 * sin(({t}) / 2.0))", "(2.0 * asin(least(_zr / 2.0, 1.0)))", "_zr <= 2.0"),
}


def pixels(spark: SparkSession, width: int, height: int, projection: str = "mol", lon0: float = 0.0, lat0: float = 0.0, radius: float = 90.0) -> DataFrame:
    """(px, py, lon, lat): pixels by columns from the left and rows from the top; no position outside the map.

    Sky goes east to the left. sin is the orthographic view of radius degrees around (lon0, lat0); others show
    all sky with lon0 in the middle.
    """
    if width * height > MOST_PIXELS:
        raise ValueError(f"an image has at most {MOST_PIXELS} pixels")
    return cells.apply(spark.range(width * height).selectExpr(f"id % {width} AS px", f"CAST(id div {width} AS BIGINT) AS py"), pixel_layers(width, height, projection, lon0, lat0, radius))


def pixel_layers(width: int, height: int, projection: str, lon0: float = 0.0, lat0: float = 0.0, radius: float = 90.0) -> cells.Layers:
    if projection in ZENITHAL:
        size, angle, inside = ZENITHAL[projection]
        # distance from the middle in units of that of the border, and the angle that it stands for
        full = size(f"radians({radius!r})")
        return [
            {"_zx": f"-((2.0 * px + 1.0) / {float(width)!r} - 1.0)", "_zy": f"1.0 - (2.0 * py + 1.0) / {float(height)!r}"},
            {"_zr": f"sqrt(_zx * _zx + _zy * _zy) * {full}"},
            {"_zt": f"CASE WHEN {inside} THEN {angle} END", "_zs": f"CASE WHEN _zr > 0 THEN {full} / _zr ELSE 0.0 END"},
            {"_z1": "sin(_zt) * _zx * _zs", "_z2": "sin(_zt) * _zy * _zs", "_z3": "cos(_zt)", "_z0": f"radians({lat0!r})"},
            {"_zl": f"degrees(atan2(_z1, _z3 * cos(_z0) - _z2 * sin(_z0))) + ({lon0!r})", "lat": "degrees(asin(least(greatest(_z3 * sin(_z0) + _z2 * cos(_z0), -1.0), 1.0)))"},
            {"lon": "_zl - 360.0 * floor(_zl / 360.0)"},
        ]
    at = {"x": f"(2.0 * px + 1.0) / {float(width)!r} - 1.0", "y": f"1.0 - (2.0 * py + 1.0) / {float(height)!r}"}
    if projection == "sin":
        size = f"sin(radians({min(radius, 90.0)!r}))"
        return [{"_ix": at["x"], "_iy": at["y"]}, {"_jx": f"-_ix * {size}", "_jy": f"_iy * {size}"}, *geometry.sin_unproject(lon0, lat0, "_jx", "_jy")]
    return [{"x": f"2.0 * ({at['x']})", "y": at["y"]}, *PROJECTIONS[projection], {"_ud": f"({lon0!r}) - _ul"}, {"lon": "_ud - 360.0 * floor(_ud / 360.0)", "lat": "_ub"}]


def image(found: DataFrame, skymap: DataFrame, depth: int, multi_order: bool = False) -> DataFrame:
    """(px, py, value): pixels with the map's values; NULL off the map or where it has no cell."""
    own = maps.with_hash(found.select("px", "py", "lon", "lat"), depth)
    held = maps.lookup(own, skymap, depth).select("px", "py", "value") if multi_order else own.join(skymap, "ipix").select("px", "py", "value")
    return own.select("px", "py").join(held, ["px", "py"], "left")


#: Ways from a value's place between least and most, in [0, 1], to a colour's.
TRANSFERS = {"linear": lambda c: c, "log": lambda c: F.log10(1 + 999 * c) / 3, "pow2": lambda c: c * c, "sqrt": F.sqrt, "asinh": lambda c: F.asinh(10 * c) / F.asinh(F.lit(10.0))}


#: The same on the value itself, the colour's place being that of its outcome between those of least and most.
VALUE_TRANSFERS = {"log": lambda v: F.log(v + 0.01), "pow2": lambda v: v * v, "sqrt": F.sqrt, "asinh": F.asinh}


def scaled_value(img: DataFrame, least: float, most: float, transfer: str) -> DataFrame:
    """scaled by a transfer function of the values, cut to [least, most], not of their places."""
    f = VALUE_TRANSFERS[transfer]
    cut = F.least(F.greatest(F.col("value").cast("double"), F.lit(float(least))), F.lit(float(most)))
    low, high = f(F.lit(float(least))), f(F.lit(float(most)))
    place = F.when(high > low, (f(cut) - low) / (high - low)).otherwise(F.lit(0.0))
    return img.withColumn("colour", F.when(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")), F.round(255 * place).cast("int")))


def scaled(img: DataFrame, least: float, most: float, transfer: str = "linear") -> DataFrame:
    """img with colour, 0 to 255, of its values; NULL stays, and so does NaN as NULL."""
    span = most - least
    place = F.least(F.greatest((F.col("value") - least) / span, F.lit(0.0)), F.lit(1.0)) if span > 0 else F.lit(0.0)
    return img.withColumn("colour", F.when(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")), F.round(255 * TRANSFERS[transfer](place)).cast("int")))


def limits(img: DataFrame) -> tuple[float, float]:
    """Least and greatest value but 0 and NaN; (0, 0) if there is none."""
    v = F.col("value").cast("double")
    row = img.where((v != 0) & ~F.isnan(v)).agg(F.min(v), F.max(v)).first()
    return (row[0] or 0.0, row[1] or 0.0)


#: Published gradients as polynomials of the place, as helices between two colours (hue, saturation, lightness), and as steps.
POLYNOMIALS = {
    "turbo": ((34.61, 1172.33, -10793.56, 33300.12, -38394.49, 14825.05), (23.31, 557.33, 1225.33, -3574.96, 1073.77, 707.56), (27.2, 3211.1, -15327.97, 27814.0, -22569.18, 6838.66)),
    "cividis": ((-4.54, -35.34, 2381.73, -6402.7, 7024.72, -2710.57), (32.49, 170.73, 52.82, -131.46, 176.58, -67.37), (81.24, 442.36, -2482.43, 6167.24, -6614.94, 2475.67)),
}
HELICES = {"warm": ((-100, 0.75, 0.35), (80, 1.5, 0.8)), "cool": ((260, 0.75, 0.35), (80, 1.5, 0.8))}
HELIX = np.array([[-0.14861, 1.78277], [-0.29227, -0.90649], [1.97294, 0.0]])
STEPS = {"yellow_green_blue": "ffffd9 edf8b1 c7e9b4 7fcdbb 41b6c4 1d91c0 225ea8 253494 081d58", "yellow_orange_red": "ffffcc ffeda0 fed976 feb24c fd8d3c fc4e2a e31a1c bd0026 800026"}


def gradient(name: str) -> np.ndarray:
    """256 colours: gray, heat, rainbow, or cubehelix as published (start 0.5, -1.5 turns)."""
    t = np.arange(256) / 255
    if name == "gray":
        rgb = np.stack([t] * 3, 1)
    elif name == "heat":
        rgb = np.stack([np.clip(3 * t - k, 0, 1) for k in range(3)], 1)
    elif name == "rainbow":
        rgb = np.clip(np.abs((4 * (1 - t)[:, None] + np.array([0, 4, 2])) % 6 - 3) - 1, 0, 1)
    elif name in POLYNOMIALS:
        rgb = np.clip(np.stack([np.polynomial.polynomial.polyval(t, c) for c in POLYNOMIALS[name]], 1) / 255, 0, 1)
    elif name in HELICES:
        (h0, s0, l0), (h1, s1, l1) = HELICES[name]
        h, sat, light = np.radians(h0 + (h1 - h0) * t + 120), s0 + (s1 - s0) * t, l0 + (l1 - l0) * t
        rgb = np.clip(light[:, None] + (sat * light * (1 - light))[:, None] * (np.stack([np.cos(h), np.sin(h)], 1) @ HELIX.T), 0, 1)
    elif name in STEPS:
        colours = np.array([[int(c[k : k + 2], 16) for k in (0, 2, 4)] for c in STEPS[name].split()], dtype=float)
        ends = np.concatenate([2 * colours[:1] - colours[1:2], colours, 2 * colours[-1:] - colours[-2:-1]])
        k = np.minimum((t * (len(colours) - 1)).astype(int), len(colours) - 2)
        u = (t * (len(colours) - 1) - k)[:, None]
        weights = ((1 - u) ** 3, 4 - 6 * u**2 + 3 * u**3, 1 + 3 * u + 3 * u**2 - 3 * u**3, u**3)
        rgb = np.clip(sum(w * ends[k + j] for j, w in enumerate(weights)) / 6 / 255, 0, 1)
    elif name == "cubehelix":
        angle, amp = 2 * np.pi * (0.5 / 3 + 1 - 1.5 * t), t * (1 - t) / 2
        weights = np.array([[-0.14861, 1.78277], [-0.29227, -0.90649], [1.97294, 0.0]])
        rgb = np.clip(t[:, None] + amp[:, None] * (np.stack([np.cos(angle), np.sin(angle)], 1) @ weights.T), 0, 1)
    else:
        raise ValueError(f"no gradient {name}")
    return np.round(255 * rgb).astype(np.uint8)


def png(img: DataFrame, width: int, height: int, colours: str = "cubehelix", transfer: str = "linear", range_: tuple[float, float] | None = None) -> bytes:
    """The image as a PNG file with transparency; only its pixels, at most MOST_PIXELS, come to the driver."""
    least, most = range_ or limits(img)
    rows = scaled(img, least, most, transfer).select("px", "py", "colour").toPandas()
    rgba = np.zeros((height, width, 4), np.uint8)
    seen = rows[rows["colour"].notna()]
    x, y, c = (seen[k].to_numpy(np.int64) for k in ("px", "py", "colour"))
    rgba[y, x, :3], rgba[y, x, 3] = gradient(colours)[c], 255
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
