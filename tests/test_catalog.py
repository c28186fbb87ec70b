"""A sample of the catalog against DuckDB; the driver compares all of it."""

import duckdb
import pytest

from spherix.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["hash_d9", "dens_map", "cumul_index", "zone_filter", "moc_xor", "mom_chi2_count", "mom_mult", "xmatch", "stream_count_map", "ring_hash_any", "mom_refine", "mom_overlapping", "mom_chi2_density", "sampled_index", "within_region", "skymap_pixels_mol", "mom_file"])
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    names = ", ".join(got.columns)
    want = db.execute(f"SELECT {names} FROM ({catalog.SQL[name]}) AS q").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
