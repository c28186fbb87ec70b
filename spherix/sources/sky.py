"""Sky map files (FITS binary tables, explicit cells), position lists, and SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spherix import storage
from spherix.functions import cells
from spherix.operators import coverage, maps

BLOCK = 2880


def _card(key: str, value) -> str:
    text = "T" if value is True else "F" if value is False else f"'{value}'" if isinstance(value, str) else str(value)
    return f"{key:<8}= {text:>20}".ljust(80) if not isinstance(value, str) else f"{key:<8}= {text:<20}".ljust(80)


def _header(cards: list[tuple]) -> bytes:
    data = "".join(_card(*c) for c in cards) + "END".ljust(80)
    return data.encode().ljust(-(-len(data) // BLOCK) * BLOCK)


def encode_map(depth: int, ipix: np.ndarray, value: np.ndarray) -> bytes:
    """A FITS file with one explicit, nested binary table of 64-bit cells and values."""
    kind = "K" if value.dtype.kind == "i" else "D"
    rows = np.empty(len(ipix), dtype=[("p", ">i8"), ("v", ">i8" if kind == "K" else ">f8")])
    rows["p"], rows["v"] = ipix, value
    first = _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
    table = _header([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 16), ("NAXIS2", len(ipix)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "PIXEL"), ("TFORM1", "K"), ("TTYPE2", "VALUE"), ("TFORM2", kind), ("PIXTYPE", "HEALPIX"), ("ORDERING", "NESTED"), ("INDXSCHM", "EXPLICIT"), ("ORDER", depth), ("NSIDE", cells.nside(depth))])
    data = rows.tobytes()
    return first + table + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def encode_implicit(depth: int, first: int, value: np.ndarray) -> bytes:
    """A FITS file with the values of the nested cells from first on; whole sky, or a part that FIRSTPIX and LASTPIX name."""
    kind = "K" if value.dtype.kind == "i" else "D"
    data = value.astype(">i8" if kind == "K" else ">f8").tobytes()
    table = _header([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 8), ("NAXIS2", len(value)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "VALUE"), ("TFORM1", kind), ("PIXTYPE", "HEALPIX"), ("ORDERING", "NESTED"), ("INDXSCHM", "IMPLICIT"), ("ORDER", depth), ("NSIDE", cells.nside(depth)), ("FIRSTPIX", first), ("LASTPIX", first + len(value) - 1)])
    return _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + table + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def _cards(data: bytes, at: int) -> tuple[dict[str, str], int]:
    out: dict[str, str] = {}
    while True:
        card = data[at : at + 80].decode("ascii", "replace")
        at += 80
        if not card.strip() and at >= len(data):
            raise ValueError("a FITS header without END")
        if card.startswith("END"):
            return out, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            value = card[10:]
            out[card[:8].strip()] = value.split("'")[1].strip() if value.lstrip().startswith("'") else value.split("/")[0].strip()


#: Letters of FITS column types and their forms in bytes, big endian.
FORMS = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def decode_map(data: bytes) -> tuple[dict[str, str], np.ndarray, np.ndarray]:
    """Header, cells and values of a nested map, implicit or explicit; gzip is opened."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    _, at = _cards(data, 0)
    head, at = _cards(data, at)
    if head.get("ORDERING", "NESTED") != "NESTED":
        raise ValueError("only NESTED maps are read")
    n, fields = int(head["NAXIS2"]), int(head["TFIELDS"])
    forms = [head[f"TFORM{k + 1}"] for k in range(fields)]
    counts = [int(f[:-1] or 1) for f in forms]
    kinds = np.dtype([(f"c{k}", FORMS[f[-1]], (c,)) for k, (f, c) in enumerate(zip(forms, counts))])
    rows = np.frombuffer(data, dtype=kinds, count=n, offset=at)
    if head.get("INDXSCHM", "IMPLICIT") == "EXPLICIT":
        return head, rows["c0"].ravel().astype(np.int64), rows["c1"].ravel()
    value = rows["c0"].ravel()
    first = int(head.get("FIRSTPIX", 0))
    return head, np.arange(first, first + len(value), dtype=np.int64), value


def write_map(skymap: DataFrame, path: str, depth: int, implicit: bool = False) -> None:
    """skymap (ipix, value) as FITS files, each a table of a range of cells.

    With implicit, values alone, for every cell; a cell that the map lacks is 0.
    """
    integer = dict(skymap.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if rows:
            ipix, value = (np.concatenate(x) for x in zip(*rows))
            data = encode_implicit(depth, int(ipix[0]), value) if implicit else encode_map(depth, ipix, value)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    if implicit:
        skymap = maps.dense(skymap, depth)
    value = F.col("value").cast("long" if integer else "double")
    sorted_ = skymap.select("ipix", value.alias("value")).repartitionByRange("ipix").sortWithinPartitions("ipix")
    storage.write_files(sorted_.mapInArrow(encode, "value binary"), path, ".fits")


def read_map(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(ipix, value) of the FITS maps in a folder."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, ipix, value = decode_map(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ipix), pa.array(value.astype("i8" if kind == "long" else "f8"))], ["ipix", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, f"ipix long, value {kind}")


def round_trip(spark: SparkSession, skymap: DataFrame, depth: int, implicit: bool = False) -> DataFrame:
    path = storage.scratch(spark)
    write_map(skymap, path, depth, implicit)
    return read_map(spark, path, "long")


def read_positions(spark: SparkSession, path: str, lon: int = 1, lat: int = 2, sep: str = "\t", header: bool = False) -> DataFrame:
    """Positions in a delimited file by the numbers of their fields; a row whose fields aren't numbers has NULLs. lon 360 is 0."""
    fields = max(lon, lat)
    schema = ", ".join(f"c{k} STRING" for k in range(1, fields + 1))
    rows = spark.read.csv(path, sep=sep, header=header, schema=schema, comment="#", enforceSchema=True)
    x, y = (F.expr(f"try_cast(trim(c{k}) AS DOUBLE)") for k in (lon, lat))
    return rows.select(F.when(x == 360, 0.0).when(x.between(0, 360), x).alias("lon"), F.when(y.between(-90, 90), y).alias("lat"))


def register_sql(spark: SparkSession) -> None:
    """hpx_nside(depth), hpx_hash(depth, lon, lat) and hpx_center(depth, cell): NULL for NULL, an error for what is out of range."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hpx_nside(d INT) RETURNS INT RETURN CASE WHEN d IS NULL THEN NULL WHEN d BETWEEN 0 AND 29 THEN 1 << d ELSE raise_error(concat('depth must be in [0, 29], not ', d)) END")

    @pandas_udf("long")
    def hpx_hash(depth: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
        ok = depth.notna() & lon.notna() & lat.notna()
        d, x, y = (s[ok].to_numpy() for s in (depth, lon, lat))
        if ((d < 0) | (d > 29)).any():
            raise ValueError("depth must be in [0, 29]")
        if not (np.isfinite(x).all() and np.isfinite(y).all() and (np.abs(y) <= 90).all()):
            raise ValueError("longitude must be finite and latitude in [-90, 90]")
        out = pd.Series(pd.array([None] * len(depth), dtype="Int64"), index=depth.index)
        out[ok] = hash_positions(d.astype(np.int64), x, y)
        return out

    @pandas_udf("array<double>")
    def hpx_center(depth: pd.Series, cell: pd.Series) -> pd.Series:
        ok = depth.notna() & cell.notna()
        d, h = (x[ok].to_numpy(np.int64) for x in (depth, cell))
        if ((d < 0) | (d > 29)).any() or (h < 0).any() or (h >= 12 << 2 * d).any():
            raise ValueError("depth or cell out of range")
        lonlat = np.empty((len(d), 2))
        for k in np.unique(d):  # at most 30 depths
            x, y, z = coverage.positions(int(k), h[d == k], 0.5, 0.5).T
            lonlat[d == k] = np.stack([np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arctan2(z, np.hypot(x, y)))], axis=1)
        out = pd.Series([None] * len(depth), index=depth.index, dtype=object)
        out[ok] = pd.Series(list(lonlat), index=depth.index[ok], dtype=object)
        return out

    spark.udf.register("hpx_hash", hpx_hash)
    spark.udf.register("hpx_center", hpx_center)


def hash_positions(depth: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Cell numbers of positions, by the formulas of functions.cells, for SQL where the depth is a column."""
    n, t, b = (1 << depth).astype(float), (lon % 360) / 90, np.radians(lat)
    t = np.where(t >= 4, 0.0, t)
    q = np.floor(t)
    eq = np.abs(b) <= cells.TRANSITION
    s, z = n * np.sqrt(6) * np.cos(np.abs(b) / 2 + np.pi / 4), n * 0.75 * np.sin(b)
    north = b > 0
    u = np.where(eq, n * (0.5 + t) + z, np.where(north, n - (1 - (t - q)) * s, (t - q) * s))
    v = np.where(eq, 5 * n - (n * (0.5 + t) - z), np.where(north, n - (t - q) * s, (1 - (t - q)) * s))
    iu, iv = (np.where(eq, np.floor(c), np.clip(np.floor(c), 0, n - 1)).astype(np.int64) for c in (u, v))
    fu, fv = iu >> depth, 4 - (iv >> depth)
    face = np.where(eq, np.where(fu == fv, (fu & 3) + 4, np.where(fv < fu, fv & 3, (fu & 3) + 8)), np.where(north, q, q + 8).astype(np.int64))
    low = (1 << depth) - 1

    def spread(x):
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | x << by) & mask
        return x

    return face << 2 * depth | spread(iu & low) | spread(iv & low) << 1
