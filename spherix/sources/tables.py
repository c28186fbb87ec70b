"""Files of coverages and multi-order maps: FITS binary tables with ZUNIQ codes, and delimited text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix import storage
from spherix.functions import cells
from spherix.sources import sky

#: Letters of FITS column types by kind of array.
LETTERS = {"i": ("K", ">i8"), "f": ("D", ">f8"), "b": ("L", "S1")}


def encode_table(columns: dict[str, np.ndarray], cards: list[tuple]) -> bytes:
    """A FITS file with one binary table."""
    forms = {n: LETTERS[c.dtype.kind] for n, c in columns.items()}
    rows = np.empty(len(next(iter(columns.values()))), dtype=[(n, f) for n, (_, f) in forms.items()])
    for n, c in columns.items():
        rows[n] = np.where(c, b"T", b"F") if c.dtype.kind == "b" else c
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for k, (n, (letter, _)) in enumerate(forms.items(), 1):
        head += [(f"TTYPE{k}", n), (f"TFORM{k}", letter)]
    data = rows.tobytes()
    return sky._header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + sky._header(head + cards) + data.ljust(-(-len(data) // sky.BLOCK) * sky.BLOCK, b"\0")


def decode_table(data: bytes) -> tuple[dict[str, str], dict[str, np.ndarray]]:
    """Header and columns of the first extension, a table of single values; gzip is opened."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    _, at = sky._cards(data, 0)
    head, at = sky._cards(data, at)
    kinds = []
    for k in range(1, int(head["TFIELDS"]) + 1):
        form = head[f"TFORM{k}"]
        if form[:-1] not in ("", "1") or form[-1] not in {*sky.FORMS, "L"}:
            raise ValueError(f"columns of form {form} aren't read")
        kinds.append((head[f"TTYPE{k}"], "S1" if form[-1] == "L" else sky.FORMS[form[-1]]))
    rows = np.frombuffer(data, dtype=kinds, count=int(head["NAXIS2"]), offset=at)
    return head, {n: rows[n] == b"T" if f == "S1" else rows[n] for n, f in kinds}


def _write(df: DataFrame, key: str, names: dict[str, str], cards: list[tuple], path: str) -> None:
    """df's columns as FITS part files, each a range of key, (see storage.write_files)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            columns = {n: whole.column(c).to_numpy() for c, n in names.items()}
            yield pa.RecordBatch.from_arrays([pa.array([encode_table(columns, cards)], pa.binary())], ["value"])

    ranged = df.select(*names).repartitionByRange(key).sortWithinPartitions(key)
    storage.write_files(ranged.mapInArrow(encode, "value binary"), path, ".fits")


def _read(spark: SparkSession, path: str, names: dict[str, str], schema: str) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, columns = decode_table(data.as_py())
                own = [columns[n].astype(columns[n].dtype.newbyteorder("=")) for n in names.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], list(names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def _zuniq() -> F.Column:
    return F.expr(f"(2 * ipix + 1) << CAST(2 * ({cells.MAX_DEPTH} - order_) AS INT)").alias("zuniq")


def write_mom(mom: DataFrame, path: str, depth: int) -> None:
    """(order_, ipix, value) as tables of ZUNIQ and VALUE."""
    whole = dict(mom.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint")
    coded = mom.select(_zuniq(), F.col("value").cast("long" if whole else "double").alias("value"))
    _write(coded, "zuniq", {"zuniq": "ZUNIQ", "value": "VALUE"}, [("PIXTYPE", "HEALPIX"), ("ORDERING", "ZUNIQ"), ("ORDER", depth)], path)


def read_mom(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(order_, ipix, value); kind is that of the file, double or long."""
    return cells.apply(_read(spark, path, {"zuniq": "ZUNIQ", "value": "VALUE"}, f"zuniq long, value {kind}"), cells.from_zuniq()).select("order_", "ipix", "value")


def write_cover(cover: DataFrame, path: str, depth: int) -> None:
    """(order_, ipix, is_full) as tables of ZUNIQ and FULLY_COVERED."""
    _write(cover.select(_zuniq(), "is_full"), "zuniq", {"zuniq": "ZUNIQ", "is_full": "FULLY_COVERED"}, [("PIXTYPE", "HEALPIX"), ("ORDERING", "ZUNIQ"), ("ORDER", depth)], path)


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    return cells.apply(_read(spark, path, {"zuniq": "ZUNIQ", "is_full": "FULLY_COVERED"}, "zuniq long, is_full boolean"), cells.from_zuniq()).select("order_", "ipix", "is_full")


def write_cover_csv(cover: DataFrame, path: str, depth: int) -> None:
    """Part files in the order of the curve, each with a comment on the depth and a header."""
    first = f"# BMOC order max: {depth}; File sorted by ZUNIQ(order, ipix).\norder,ipix,is_fully_covered_flag\n"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = first
        for b in batches:
            if b.num_rows:
                text = "\n".join(f"{o},{p},{int(f)}" for o, p, f in zip(*(c.to_pylist() for c in b.columns)))
                yield pa.RecordBatch.from_arrays([pa.array([head + text])], ["value"])
                head = ""

    ranged = cover.select("order_", "ipix", "is_full", _zuniq()).repartitionByRange("zuniq").sortWithinPartitions("zuniq")
    ranged.select("order_", "ipix", "is_full").mapInArrow(lines, "value string").write.option("compression", "none").text(path)


def read_cover_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, comment="#", schema="order_ INT, ipix BIGINT, flag INT", enforceSchema=True).select("order_", "ipix", (F.col("flag") == 1).alias("is_full"))


def round_trip(df: DataFrame, write, read) -> DataFrame:
    """df written to a new folder in the shared one, and read back."""
    path = storage.scratch(df.sparkSession)
    write(df, path)
    return read(path)


def read_cells(spark: SparkSession, path: str, order: int | None = None, ipix: int = 1, sep: str = ",", header: bool = False) -> DataFrame:
    """Cells in a delimited file by the numbers of their fields, with orders if there is a field for them; NULL for what isn't a number."""
    names = ", ".join(f"c{k} STRING" for k in range(1, max(ipix, order or 0) + 1))
    rows = spark.read.csv(path, sep=sep, header=header, schema=names, comment="#", enforceSchema=True)
    own = [F.expr(f"try_cast(trim(c{ipix}) AS BIGINT)").alias("ipix")]
    return rows.select(*([F.expr(f"try_cast(trim(c{order}) AS INT)").alias("order_")] if order else []), *own)
