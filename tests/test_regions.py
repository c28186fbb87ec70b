import zlib

import numpy as np
import pytest

from spherix.functions import cells as C
from spherix.functions import geometry as G
from spherix.functions import ring as R
from spherix.operators import coverage as V
from spherix.operators import maps as M
from spherix.operators import regions as Q
from spherix.operators import render as P
from spherix.sources import tables

MOM = "order_ int, ipix long, value double"


def test_ring_positions(spark):
    at = [(40.0, -45.0, 8), (130.0, -45.0, 9), (40.0, 90.0, 0), (310.0, 90.0, 3), (40.0, -90.0, 8), (44.0, 0.0, 4), (46.0, 0.0, 5), (45.0, 1.0, 0), (45.0, -1.0, 8)]
    got = C.apply(spark.createDataFrame([*at, (None, 1.0, None), (1.0, 91.0, None)], "lon double, lat double, want long"), R.cell_hash(1)).collect()
    assert [r.ring for r in got] == [r.want for r in got]


@pytest.mark.parametrize("n", [1, 3, 8, 50])
def test_ring_round_trip(spark, n):
    all_ = spark.range(R.n_hash(n)).selectExpr("id AS ring")
    for dx, dy in ((0.5, 0.5), (0.1, 0.95)):
        assert C.apply(all_, [*R.position(n, dx=dx, dy=dy), *R.cell_hash(n, out="again")]).where("again IS NULL OR again <> ring").count() == 0


def test_ring_agrees_with_nested(spark):
    df = C.apply(spark.range(C.n_hash(4)).selectExpr("id AS ipix"), [*C.to_ring(4), *C.position(4), *R.position(16, lon="rlon", lat="rlat"), *R.cell_hash(16, out="again")])
    assert df.where("again <> ring OR abs(lon - rlon) > 1e-9 OR abs(lat - rlat) > 1e-9").count() == 0


def test_best_depth(spark):
    r = spark.range(1).selectExpr(*[f"{C.doubles(G.best_depth(x))} AS d{k}" for k, x in enumerate(("degrees(1.0)", "1.0", "(1.0 / 60.0)", "(1.0 / 3600.0)", "45.0", "0.25", "degrees(9.537e-8)"))]).first()
    assert list(r) == [0, 5, 11, 17, 0, 7, 22]


def test_paths(spark):
    one = spark.sql("SELECT 19L AS ipix, explode(sequence(0, 7)) AS k")
    path = C.apply(one, G.edge_path(1, 2)).orderBy("k").collect()
    v = C.apply(spark.sql("SELECT 19L AS ipix"), C.vertices(1)).first()
    assert np.allclose([(path[2 * i].lon, path[2 * i].lat) for i in range(4)], [(v[f"{d}_lon"], v[f"{d}_lat"]) for d in "senw"])
    back = C.apply(one, G.edge_path(1, 2, clockwise=True)).orderBy("k").collect()
    assert np.allclose([(r.lon, r.lat) for r in back[1:]], [(r.lon, r.lat) for r in path[:0:-1]])


@pytest.mark.parametrize("text", ["", "Circle ICRS 1 2", "Circle ICRS 1 95 3", "Circle FK5 1 2 3", "Union ICRS (Circle 1 2 3", "Difference (Circle 1 2 3)", "Circle 1 2 3 AllSky", "Polygon 1 2 3 4 5", "Ellipse 1 2 3 4 5", "Not ()", "Circle unit arcmin 1 2 3"])
def test_bad_regions(text):
    with pytest.raises(ValueError):
        Q.parse(text)


def test_region_covers_agree_with_predicates(spark):
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(0, 360, 20000), np.degrees(np.arcsin(rng.uniform(-1, 1, 20000)))
    points = C.apply(spark.createDataFrame(list(zip(map(float, lon), map(float, lat))), "lon double, lat double"), C.cell_hash(29, out="h")).cache()
    for text in ("Circle ICRS 40 20 14", "Box ICRS 100 30 20 8 40", "Ellipse 200 -30 25 10 60", "PositionInterval ICRS 350 -10 20 30", "Polygon ICRS 20 -10 60 -5 45 35", "Not (Circle 40 20 60)", "Union ICRS (Circle 10 10 20 PositionInterval 100 0 140 30)", "Intersection (Circle 10 10 20 Circle 20 15 20)", "Difference (Circle 10 10 20 Circle 20 15 20)", "AllSky"):
        cover = Q.cover(text, 5)
        rows = points.selectExpr("h", f"{C.doubles(Q.predicate(text))} AS inside").toPandas()
        starts = np.array([h << 2 * (29 - d) for d, h, _ in cover])
        k = np.maximum(np.searchsorted(starts, rows["h"].to_numpy(), "right") - 1, 0)
        ends, full = np.array([(h + 1) << 2 * (29 - d) for d, h, _ in cover]), np.array([f for *_, f in cover])
        held = (starts[k] <= rows["h"]) & (rows["h"] < ends[k])
        inside = rows["inside"].to_numpy()
        assert held[inside].all(), text
        assert inside[held & full[k]].all(), text


def test_refine(spark):
    left = spark.createDataFrame([(0, 0, 4.0), (1, 4, 2.0), (2, 20, 1.0)], MOM)
    right = spark.createDataFrame([(2, 3, 10.0), (1, 4, 20.0), (1, 5, 30.0), (0, 7, 40.0)], MOM)
    both = {(r.order_, r.ipix): (r.l, r.r) for r in M.refine(left, right, 2).collect()}
    assert both == {(0, 7): (None, 40.0), (1, 1): (4.0, None), (1, 2): (4.0, None), (1, 3): (4.0, None), (1, 4): (2.0, 20.0), (2, 0): (4.0, None), (2, 1): (4.0, None), (2, 2): (4.0, None), (2, 3): (4.0, 10.0), (2, 20): (1.0, 30.0), (2, 21): (None, 30.0), (2, 22): (None, 30.0), (2, 23): (None, 30.0)}
    assert M.refine(left, right, 2, "inner").count() == 3
    assert M.refine(left, left.limit(0), 2, "left").count() == 3
    assert M.refine(left.limit(0), right.limit(0), 2).count() == 0
    whole = M.refine(left, right, 2, "left").selectExpr("order_", "ipix", "l AS value")
    assert sorted(map(tuple, M.merge_siblings(whole, 2, M.equal_merger()).collect())) == [(0, 0, 4.0), (1, 4, 2.0), (2, 20, 1.0)]


def test_cells_of_ranges(spark):
    cells = Q.cover("Not (Circle 10 10 5)", 5)
    assert sorted(map(tuple, M.to_cells(M.union_ranges(M.to_ranges(V.to_df(spark, cells)))).collect())) == sorted(cells)
    assert [tuple(r) for r in M.to_cells(spark.createDataFrame([(5, 6, True)], "lo long, hi long, is_full boolean")).collect()] == [(29, 5, True)]


def test_order(spark):
    assert M.order_breaks(spark.range(100), "id").first().breaks == 0
    assert M.order_breaks(spark.range(100).selectExpr("-id AS id"), "id").first().breaks == 99
    assert M.order_breaks(spark.range(0), "id").first().breaks == 0


def test_files(spark, tmp_path):
    cells = Q.cover("Circle ICRS 147.6 69.9 0.4", 9)
    for write, read, name in ((tables.write_cover, tables.read_cover, "fits"), (tables.write_cover_csv, tables.read_cover_csv, "csv")):
        write(V.to_df(spark, cells), str(tmp_path / name), 9)
        assert sorted(map(tuple, read(spark, str(tmp_path / name)).collect())) == sorted(cells)
    path = tmp_path / "cells.csv"
    path.write_text("# a comment\n3;5\nx;7\n")
    assert [tuple(r) for r in tables.read_cells(spark, str(path), 1, 2, ";").collect()] == [(3, 5), (None, 7)]


@pytest.mark.parametrize("projection", ["mol", "ait", "car", "cea", "mer", "sfl", "hpx", "sin"])
def test_images(spark, projection):
    sky = spark.range(C.n_hash(2)).selectExpr("id AS ipix", "id AS value")
    img = P.image(P.pixels(spark, 32, 16, projection, 30.0, 10.0), sky, 2)
    assert img.count() == 512
    data = P.png(img, 32, 16, "rainbow", "sqrt")
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert data[:4] == b"\x89PNG" and len(raw) == 16 * (32 * 4 + 1)
    with pytest.raises(ValueError):
        P.pixels(spark, 1 << 13, 1 << 13)
