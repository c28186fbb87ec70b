"""Coverages as table functions of SQL: a region's numbers in, its cells out, a region a row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spherix.operators import coverage, regions

CELLS = "order_ INT, ipix BIGINT, is_full BOOLEAN"


@udtf(returnType=CELLS)
class HpxCone:
    """hpx_cone(depth, lon, lat, radius): cells that a cone overlaps; a NULL gives none."""

    def eval(self, depth: int, lon: float, lat: float, radius: float):
        if None not in (depth, lon, lat, radius):
            yield from coverage.cover(coverage.Cone(float(lon), float(lat), float(radius)), int(depth), 2)


@udtf(returnType=CELLS)
class HpxPolygon:
    """hpx_polygon(depth, [lon, lat, lon, lat, ..]): cells that a polygon overlaps, exactly."""

    def eval(self, depth: int, vertices: list):
        if depth is not None and vertices:
            if len(vertices) < 6 or len(vertices) % 2:
                raise ValueError(f"a polygon of {len(vertices)} numbers")
            yield from coverage.cover(coverage.Polygon(list(zip(map(float, vertices[::2]), map(float, vertices[1::2])))), int(depth))


@udtf(returnType=CELLS)
class HpxRegion:
    """hpx_region(depth, text): cells of a region in the region language."""

    def eval(self, depth: int, text: str):
        if depth is not None and text is not None:
            yield from regions.cover(text, int(depth))


def register(spark: SparkSession) -> None:
    for name, f in (("hpx_cone", HpxCone), ("hpx_polygon", HpxPolygon), ("hpx_region", HpxRegion)):
        spark.udtf.register(name, f)
