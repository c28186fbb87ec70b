"""Operators of the second round: a sample of their queries against DuckDB, and odd cases."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spherix import storage
from spherix.functions import cells as C
from spherix.functions import geometry as G
from spherix.operators import coverage as V
from spherix.operators import maps as M
from spherix.operators import render as P
from spherix.plans import catalog, more  # noqa: F401
from spherix.sources import raw, sky, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize(
    "name", ["polygon_over_meridian", "polygon_over_south_pole", "box_over_meridian", "golden_polygon", "golden_zone", "external_edge_golden", "kth_ring", "from_uniq_deep", "index_get", "index_file_explicit", "samples_file_implicit", "bmoc_raw_deep", "mom_raw", "moc_text", "csv_index", "csv_hash_paste", "moc_xor_flags", "moc_not_flags", "moc_flagged_ranges", "moc_ranges_over_base_cells", "tree_of_three", "stream_mom", "galactic_fk4", "pixels_stg", "within_stored", "polygon_table_function"]
)
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]}) AS q").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_polygons_hold_what_is_in_them():
    square = [(350.0, -10.0), (10.0, -10.0), (10.0, 10.0), (350.0, 10.0)]
    inside = lambda p, lon, lat, how="default": M.odd_south(p, lon, lat) != M.holds_south_pole(p, how)
    assert inside(square, 0, 0) and inside(square, 355, 0) and not inside(square, 180, 0) and not inside(square, 0, -85)
    south = [(0.0, -80.0), (90.0, -80.0), (180.0, -80.0), (270.0, -80.0)]
    assert inside(south, 45, -89) and inside(south, 0, -90) and not inside(south, 45, 89) and not inside(south, 0, -70)
    assert not inside(south, 0, -90, "complement") and inside(south, 0, 0, ("in", 0, 0)) and not inside(south, 0, 0, ("out", 0, 0))
    assert inside(south, 0, -90, "south_pole") and not inside(south, 0, -90, "no_south_pole")


def test_exact_coverage_against_many_points():
    """Every point of a region lies in a cell of its coverage, and cells that are full hold only such points."""
    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(0, 360, 60_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 60_000)))
    p = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], axis=1)
    for shape in (V.Polygon([(350, -10), (20, -12), (14, 30), (352, 9)]), V.Polygon([(0, 70), (90, 62), (180, 65), (270, 60)]), V.Zone(350, -20, 25, 50), V.Cone(10, 80, 15), V.Cone(10, -40, 25, 12), V.box(5, 40, 20, 8, 20), V.Polygon([(0, 0), (40, 30), (40, 0), (0, 30)])):
        cells, depth = V.cover(shape, 4), 4
        h = sky.hash_positions(np.full(len(lon), depth), lon, lat)
        full = set(V.flat([c for c in cells if c[2]], depth)) if any(c[2] for c in cells) else set()
        every = set(V.flat(cells, depth))
        inside = shape.contains(p)
        assert inside.sum() > 100 and all(x in every for x in h[inside].tolist())
        assert not full & set(h[~inside].tolist())


def test_cross_match_checks_its_depth(spark):
    one = spark.createDataFrame([(1, 10.0, 0.0)], "id long, lon double, lat double")
    two = spark.createDataFrame([(2, 14.9, 0.0)], "id long, lon double, lat double")
    assert M.cross_match(one, two, 5.0).count() == 1 and M.cross_match(one, two, 5.0, 2).count() == 1
    with pytest.raises(ValueError):
        M.cross_match(one, two, 5.0, 6)


def test_cross_match_finds_all_pairs_near_poles_and_borders(spark):
    rng = np.random.default_rng(7)
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 360, 300), rng.uniform(-90, 90, 300))]
    points += [(0.0, 90.0), (10.0, -90.0), (359.999, 0.0), (0.0, 0.0), (45.0, 41.81), (45.0, 41.82), (90.0, 0.0), (180.0, 89.5), (1.0, 89.9), (44.9, -89.0)]
    rows = [(k, *p) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    d = F.expr(C.doubles(M.haversine("a.lon", "a.lat", "b.lon", "b.lat")))
    for radius, depth in ((3.0, 1), (45.0, 0)):
        want = {tuple(r) for r in df.alias("a").crossJoin(df.alias("b")).where(d <= radius).select("a.id", "b.id").collect()}
        got = [tuple(r) for r in M.cross_match(df, df, radius, depth).select("left_id", "right_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cross_match_deals_a_cell_to_several_tasks(spark, monkeypatch):
    for name, value in (("MATCH_SIDE", 50), ("MATCH_PAIRS", 1 << 12)):
        monkeypatch.setattr(M, name, value, raising=False)
    one = spark.range(0, 400, 1, 1).selectExpr("id", "10.0D + id * 1e-6D AS lon", "20.0D AS lat")
    two = spark.range(0, 150, 1, 1).selectExpr("id", "10.0D AS lon", "20.0D + id * 1e-6D AS lat")
    out = M.cross_match(one, two, 1.0)
    assert out.count() == out.select("left_id", "right_id").distinct().count() == 400 * 150
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400 * 150 // 2


def test_columns_named_like_scratch_ones_stay(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "b")], "lon double, lat double, _x string, _face string")
    out = M.with_hash(df, 5)
    assert out.columns[:4] == df.columns and out.first()["_x"] == "a" and out.first()["_face"] == "b"


def test_compressed_covers():
    rng = random.Random(1)
    for depth in (0, 1, 4):
        for _ in range(5):
            flat = sorted(rng.sample(range(12 << 2 * depth), rng.randrange(0, min(12 << 2 * depth, 300) + 1)))
            assert V.flat(raw.uncompress(raw.compress([(depth, h) for h in flat], depth)) and [(d, h, True) for d, h in raw.uncompress(raw.compress([(depth, h) for h in flat], depth))] or [], depth) == flat
    assert raw.compress([], 0) == bytes([0, 0, 0]) and raw.compress([(0, h) for h in range(12)], 0) == bytes([0, 255, 15])


def test_text_rows_that_are_no_positions(spark, tmp_path):
    (tmp_path / "in.csv").write_text("# note\nlon,lat,x\n360,0,a\n10,91,b\nten,0,c\n10\n20,-90,d\n")
    rows = text.read_rows(spark, f"file://{tmp_path}/in.csv", header=True).collect()
    assert {(r.lon, r.lat) for r in rows} == {(0.0, 0.0), (None, None), (20.0, -90.0)} and len(rows) == 5
    text.sort_file(spark, f"file://{tmp_path}/in.csv", f"file://{tmp_path}/out", 1, header=True)
    lines = [x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split("\n")]
    assert lines[0] == "lon,lat,x" and sorted(lines[1:4]) == ["10", "10,91,b", "ten,0,c"] and set(lines[4:6]) == {"360,0,a", "20,-90,d"}
    with pytest.raises(ValueError):
        text.position(361.0, 0.0)
    assert text.position(360.0, 5.0) == (0.0, 5.0)


def test_unsorted_rows_are_refused(spark):
    with pytest.raises(ValueError):
        M.checked_order(spark.range(10).select((-F.col("id")).alias("k")), "k")
    assert M.checked_order(spark.range(10), "id").count() == 10


def test_index_of_parts_that_spark_reads_in_another_order(spark, tmp_path):
    """Spark deals files to partitions largest first; order is that of the parts' names and numbers."""
    text.sort_file(spark, _lines(spark, f"{tmp_path}/in", 3000), f"file://{tmp_path}/sorted", 1, lon=2, lat=3)
    lines = next((tmp_path / "sorted").glob("part-*")).read_text().splitlines()
    for name, order in (("good", [0, 1, 2]), ("bad", [0, 2, 1])):
        (tmp_path / name).mkdir()
        parts = [lines[:5], lines[5:105], lines[105:]]
        for part, k in zip(("part-00007-x", "part-99999-x", "part-100000-x"), order):
            (tmp_path / name / part).write_text("\n".join(parts[k]) + "\n")
    index = text.index_file(spark, f"file://{tmp_path}/good", 4, lon=2, lat=3)
    assert index.agg(F.max("row_end")).first()[0] == 3000
    assert text.order_breaks(spark, f"file://{tmp_path}/bad", lon=2, lat=3).first().breaks == 1
    with pytest.raises(ValueError):
        text.index_file(spark, f"file://{tmp_path}/bad", 4, lon=2, lat=3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")  # several stretches of a file in a partition
        assert text.order_breaks(spark, f"file://{tmp_path}/good", lon=2, lat=3).first().breaks == 0
        assert text.order_breaks(spark, f"file://{tmp_path}/bad", lon=2, lat=3).first().breaks == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _lines(spark, folder: str, n: int) -> str:
    """A folder of lines id, lon, lat."""
    spark.range(n).selectExpr("concat_ws(',', id, id * 104729 % 360, id * 7919 % 180 - 90) AS value").write.text(f"file://{folder}")
    return f"file://{folder}"


def test_files_are_whole_blocks(spark, tmp_path):
    sky.write_map(spark.range(12).selectExpr("id AS ipix", "id AS value"), f"file://{tmp_path}/m", 0)
    files = list((tmp_path / "m").iterdir())
    assert files and all(f.suffix == ".fits" and f.stat().st_size % 2880 == 0 for f in files)
    with pytest.raises(ValueError):
        raw.decode_raw(raw.encode_raw(np.arange(3, dtype="<u4"), []), lambda h: "<u8")


def test_one_file_is_not_computed_in_one_task(spark, tmp_path):
    """What is written to one file comes to one task, but not the rows that it is found in."""

    def tasks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().taskAttemptId()] * b.num_rows, pa.int64())], ["sample_no", "hash29"])

    rows = spark.range(0, 1000, 1, 4).mapInArrow(tasks, "sample_no long, hash29 long")
    for explicit in (True, False):
        path = f"file://{tmp_path}/{explicit}"
        raw.write_samples(rows, path, 10, explicit)
        got = raw.read_samples(spark, path)
        assert got.agg(F.sum("sample_no"), F.count("*"), F.countDistinct("hash29")).first()[:] == (499500, 1000, 4)
        for k, none in enumerate(("false", "sample_no < 0")):
            raw.write_samples(rows.where(none), f"{path}-{k}", 10, explicit)
            assert raw.read_samples(spark, f"{path}-{k}").count() == 0 and len(list((tmp_path / f"{explicit}-{k}").glob("part-*"))) == 1


def test_ellipses():
    e = G.ellipse_of_axes(3.0, 1.0, 30.0)
    assert G.axes_of_ellipse(*e) == pytest.approx((3.0, 1.0, 30.0))
    assert G.ellipse_of_correlation(2.0, 3.0, 0.5) == (4.0, 9.0, 3.0)
    lon, lat, r = M.enclosing_cone([(0.0, 0.0), (90.0, 0.0), (45.0, 1.0)])
    assert r == pytest.approx(45.0) and lon == pytest.approx(45.0)


def test_matrices():
    a = G.euler_zyz(10, 20, 30)
    assert np.allclose(np.array(G.product(a, G.transposed(a))), np.eye(3)) and np.allclose(G.galactic("fk5"), G.GALACTIC, atol=1e-6)
    assert np.allclose(np.array(G.local_frame(40, 20)) @ M._xyz(40, 20), [1, 0, 0])


def test_gradients():
    for name in ("gray", "heat", "rainbow", "cubehelix", "turbo", "cividis", "warm", "cool", "yellow_green_blue", "yellow_orange_red"):
        assert P.gradient(name).shape == (256, 3)


def test_storage_needs_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        conf = type("c", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("s", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})

    old = spark.conf.get("spark.checkpoint.dir", None)
    if old is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            storage.scratch(Elsewhere)
    assert storage.scratch(spark) and math.isfinite(1.0) and C.n_hash(0) == 12
