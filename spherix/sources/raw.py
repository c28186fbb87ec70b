"""Raw forms of coverages, multi-order maps and indexes: one FITS header, then little-endian rows; and the compressed form of coverages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spherix import storage
from spherix.functions import cells
from spherix.sources import sky

#: Names of number types in the cards, and their bytes.
NUMBERS = {"u32": "<u4", "u64": "<u8", "f32": "<f4", "f64": "<f8"}
#: The deepest depth whose codes fit 32 bits.
SHALLOW = 13


def encode_raw(rows: np.ndarray, cards: list[tuple]) -> bytes:
    head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("EXTEND", False), *cards, ("DTENDIAN", "LITTLE")]
    data = rows.tobytes()
    return sky._header(head) + data + bytes(-len(data) % sky.BLOCK)


def decode_raw(data: bytes, kinds) -> tuple[dict[str, str], np.ndarray]:
    """Header and rows; kinds gives the rows' type for a header."""
    head, at = sky._cards(data, 0)
    kind = np.dtype(kinds(head))
    if int(head["NAXIS1"]) != kind.itemsize:
        raise ValueError(f"rows of {head['NAXIS1']} bytes, not of {kind.itemsize}")
    if head.get("DTENDIAN", "LITTLE").strip() != "LITTLE":
        raise ValueError("only little-endian rows are read")
    return head, np.frombuffer(data, dtype=kind, count=int(head["NAXIS2"]), offset=at)


def _put(df: DataFrame, key: str, path: str, encode, single: bool) -> None:
    """Files of ranges of key, or one for all; a file's rows come to one task."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held or single:
            table = pa.Table.from_batches(held) if held else None
            columns = {c: table.column(c).to_numpy() for c in names} if held else {c: np.empty(0, np.int64) for c in names}
            yield pa.RecordBatch.from_arrays([pa.array([encode(columns)], pa.binary())], ["value"])

    # a shuffle to one task, as coalesce would have that task compute all that df comes from
    dealt = df.repartition(1) if single else df.repartitionByRange(key)
    if not storage.write_files(dealt.sortWithinPartitions(key).mapInArrow(work, "value binary"), path, ".fits") and single:
        # Spark leaves out the task where it finds that there are no rows
        none = df.sparkSession.range(0, 1, 1, 1).where("id < 0")
        storage.write_files(none.mapInArrow(work, "value binary"), path, ".fits")


def _get(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """decode gives the columns of a file's bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns = decode(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.values()], list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, schema)


# Coverages: a sentinel bit below the cell, room for the depths below, and the flag


def write_bmoc(cover: DataFrame, path: str, depth: int, single: bool = True) -> None:
    """(order_, ipix, is_full) as flagged codes, of 32 bits where depth allows, in z-order."""
    kind = "<u4" if depth <= SHALLOW else "<u8"
    code = F.expr(f"((2 * ipix + 1) << CAST(1 + 2 * ({depth} - order_) AS INT)) | CAST(is_full AS BIGINT)").alias("code")
    cards = [("PRODTYPE", "BMOC"), ("HPXORDER", depth), ("VAL_NAME", "FLAGGED_ZUNIQ")]
    # at depth 29 codes need all of 64 bits: order by their upper 63
    ordered = cover.select(code, F.shiftrightunsigned(code, 1).alias("high"))
    _put(ordered, "high", path, lambda c: encode_raw(c["code"].view("<u8").astype(kind), cards), single)


def read_bmoc(spark: SparkSession, path: str) -> DataFrame:
    def decode(data: bytes) -> dict[str, np.ndarray]:
        head, rows = decode_raw(data, lambda h: "<u4" if int(h["HPXORDER"]) <= SHALLOW else "<u8")
        code = rows.astype(np.uint64)
        full, code = (code & np.uint64(1)).astype(bool), code >> np.uint64(1)
        zeros = np.bitwise_count((code & (~code + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        order = int(head["HPXORDER"]) - (zeros.astype(np.int64) >> 1)
        return {"order_": order.astype(np.int32), "ipix": (code >> (zeros + np.uint64(1))).astype(np.int64), "is_full": full}

    return _get(spark, path, decode, "order_ int, ipix long, is_full boolean")


# Multi-order maps: a ZUNIQ code of the map's depth beside the value


def write_mom(mom: DataFrame, path: str, depth: int, kind: str = "f64", single: bool = True) -> None:
    code = "<u4" if depth <= SHALLOW else "<u8"
    rows = np.dtype([("z", code), ("v", NUMBERS[kind])])
    own = mom.select(F.expr(f"(2 * ipix + 1) << CAST(2 * ({depth} - order_) AS INT)").alias("z"), F.col("value").cast("double" if kind[0] == "f" else "long").alias("v"))
    cards = [("PRODTYPE", "HEALPIX MULTI ORDER MAP"), ("ORDERING", "NESTED"), ("HPXORDER", depth), ("ZUNIQ_DT", code.replace("<u4", "u32").replace("<u8", "u64")), ("VALUE_DT", kind)]

    def encode(c):
        out = np.empty(len(c["z"]), dtype=rows)
        out["z"], out["v"] = c["z"].view("<u8") if len(c["z"]) else c["z"], c["v"]
        return encode_raw(out, cards)

    _put(own, "z", path, encode, single)


def read_mom(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(order_, ipix, value); kind is double or long."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        head, rows = decode_raw(data, lambda h: [("z", NUMBERS[h["ZUNIQ_DT"]]), ("v", NUMBERS[h["VALUE_DT"]])])
        z = rows["z"].astype(np.uint64)
        zeros = np.bitwise_count((z & (~z + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        order = int(head["HPXORDER"]) - (zeros.astype(np.int64) >> 1)
        return {"order_": order.astype(np.int32), "ipix": (z >> (zeros + np.uint64(1))).astype(np.int64), "value": rows["v"].astype("f8" if kind == "double" else "i8")}

    return _get(spark, path, decode, f"order_ int, ipix long, value {kind}")


# Cumulative indexes: row_start of every cell and the total (implicit), or of each cell that has rows (explicit)


def _file_cards(about: dict | None) -> list[tuple]:
    """Cards on the indexed file: name, length, md5, date, columns of longitude and latitude, as far as they are known."""
    names = {"name": "IDXF_NAM", "length": "IDXF_LEN", "md5": "IDXF_MD5", "modified": "IDXF_LMD", "lon": "IDXC_LON", "lat": "IDXC_LAT"}
    return [(names[k], v) for k, v in (about or {}).items() if v is not None]


def write_index(index: DataFrame, path: str, depth: int, total: int, implicit: bool = True, kind: str = "u64", about: dict | None = None) -> None:
    """A cumulative index (ipix, row_start, row_end) as one file; implicit has a value for every cell and one more, the total."""
    h = "u32" if depth <= SHALLOW else "u64"
    cards = [("PRODTYPE", "HEALPIX CUMUL INDEX"), ("ORDERING", "NESTED"), ("INDXSCHM", "IMPLICIT" if implicit else "EXPLICIT"), *([("INDXCOV", "FULLSKY")] if implicit else []), ("HPXORDER", depth), *([] if implicit else [("INDXTYPE", h)]), ("DATATYPE", kind), *_file_cards(about)]

    def encode(c):
        order = np.argsort(c["ipix"])
        ipix, start = c["ipix"][order], c["row_start"][order]
        if implicit:
            at = np.searchsorted(ipix, np.arange(cells.n_hash(depth) + 1))
            return encode_raw(np.append(start, total)[at].astype(NUMBERS[kind]), cards)
        rows = np.empty(len(ipix) + 1, dtype=[("h", NUMBERS[h]), ("v", NUMBERS[kind])])
        rows["h"], rows["v"] = np.append(ipix, cells.n_hash(depth)), np.append(start, total)
        return encode_raw(rows, cards)

    if implicit and depth > 12:
        raise ValueError("an implicit index has a value for every cell: the depth is at most 12")
    _put(index.select("ipix", "row_start"), "ipix", path, encode, True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(ipix, row_start, row_end) of the cells that have rows, from either form."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        head, rows = decode_raw(data, lambda h: NUMBERS[h["DATATYPE"]] if h["INDXSCHM"] == "IMPLICIT" else [("h", NUMBERS[h["INDXTYPE"]]), ("v", NUMBERS[h["DATATYPE"]])])
        ipix, start = (np.arange(len(rows)), rows) if head["INDXSCHM"] == "IMPLICIT" else (rows["h"], rows["v"])
        start = start.astype(np.int64)
        some = np.nonzero(start[1:] > start[:-1])[0]
        return {"ipix": ipix[:-1][some].astype(np.int64), "row_start": start[:-1][some], "row_end": start[1:][some]}

    return _get(spark, path, decode, "ipix long, row_start long, row_end long")


def index_about(spark: SparkSession, path: str) -> dict[str, str]:
    """The header's cards: depth, scheme, number type, and what is told of the indexed file."""
    first = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 5760)")).first()[0]
    return sky._cards(bytes(first), 0)[0]


def index_csv(index: DataFrame, path: str) -> None:
    """hash,starting_byte lines (the row in place of the byte) in the order of cells."""
    index.select(F.col("ipix").alias("hash"), F.col("row_start").alias("starting_byte")).repartitionByRange("hash").sortWithinPartitions("hash").write.csv(path, header=True)


def write_samples(index: DataFrame, path: str, every: int, explicit: bool = False) -> None:
    """A sampled index (sample_no, hash29): the keys in order, explicit with the row of each."""
    cards = [("PRODTYPE", "HEALPIX SIMPLE CUMUL INDEX"), ("VAL_SCHM", "EXPLICIT" if explicit else "IMPLICIT"), ("ORDERING", "NESTED"), ("HPXORDER", cells.MAX_DEPTH), ("DATATYPE", "u64"), ("STEP", every)]

    def encode(c):
        order = np.argsort(c["sample_no"])
        if not explicit:
            return encode_raw(c["hash29"][order].astype("<u8"), cards)
        rows = np.empty(len(order), dtype=[("h", "<u8"), ("v", "<u8")])
        rows["h"], rows["v"] = c["hash29"][order], c["sample_no"][order] * every
        return encode_raw(rows, cards)

    _put(index.select("sample_no", "hash29"), "sample_no", path, encode, True)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_no, hash29) of either form."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        head, rows = decode_raw(data, lambda h: "<u8" if h["VAL_SCHM"] == "IMPLICIT" else [("h", "<u8"), ("v", "<u8")])
        if head["VAL_SCHM"] == "IMPLICIT":
            return {"sample_no": np.arange(len(rows)), "hash29": rows.astype(np.int64)}
        return {"sample_no": (rows["v"] // np.uint64(int(head["STEP"]))).astype(np.int64), "hash29": rows["h"].astype(np.int64)}

    return _get(spark, path, decode, "sample_no long, hash29 long")


# The compressed form: the tree's nodes in depth-first order, 0 divided, 10 empty, 11 full; at the last depth 0 and 1


def compress(found: list[tuple[int, int]], depth: int) -> bytes:
    """Cells (order, ipix) that don't overlap as a byte of depth and bits, the lowest of a byte first."""
    ranges = np.array(sorted((h << 2 * (depth - d), (h + 1) << 2 * (depth - d)) for d, h in found), dtype=np.int64).reshape(-1, 2)
    bits: list[int] = []
    todo = [(0, h) for h in range(11, -1, -1)]
    while todo:
        d, h = todo.pop()
        lo, hi = h << 2 * (depth - d), (h + 1) << 2 * (depth - d)
        k = int(np.searchsorted(ranges[:, 1], lo, side="right"))
        some = k < len(ranges) and ranges[k, 0] < hi
        full = some and ranges[k, 0] <= lo and _covered(ranges, k, lo, hi)
        if d == depth:
            bits.append(int(full))
        elif full:
            bits += [1, 1]
        elif not some:
            bits += [1, 0]
        else:
            bits.append(0)
            todo += [(d + 1, 4 * h + j) for j in (3, 2, 1, 0)]
    return bytes([depth]) + np.packbits(np.array(bits, dtype=np.uint8), bitorder="little").tobytes()


def _covered(ranges: np.ndarray, k: int, lo: int, hi: int) -> bool:
    while k < len(ranges) and ranges[k, 0] <= lo:
        lo = max(lo, int(ranges[k, 1]))
        if lo >= hi:
            return True
        k += 1
    return False


def uncompress(data: bytes) -> list[tuple[int, int]]:
    """(order, ipix) of the compressed form's full cells, in z-order."""
    depth, bits = data[0], np.unpackbits(np.frombuffer(data, dtype=np.uint8)[1:], bitorder="little")
    out, at, todo = [], 0, [(0, h) for h in range(11, -1, -1)]
    while todo:
        d, h = todo.pop()
        first = bits[at]
        at += 1
        if d == depth:
            if first:
                out.append((d, h))
        elif not first:
            todo += [(d + 1, 4 * h + j) for j in (3, 2, 1, 0)]
        else:
            if bits[at]:
                out.append((d, h))
            at += 1
    return out


def compressed(covers: DataFrame, depth: int) -> DataFrame:
    """(id, moc) from (id, order_, ipix): the cells of each coverage, which meet in one row, in the compressed form."""

    @pandas_udf("binary")
    def pack(found):
        return found.map(lambda own: compress([(int(x["order_"]), int(x["ipix"])) for x in own], depth))

    return covers.groupBy("id").agg(F.collect_list(F.struct("order_", "ipix")).alias("c")).select("id", pack("c").alias("moc"))


def uncompressed(packed: DataFrame) -> DataFrame:
    """(id, order_, ipix) of compressed coverages (id, moc)."""

    @pandas_udf("array<struct<order_:int,ipix:bigint>>")
    def open_(moc):
        return moc.map(lambda data: [{"order_": d, "ipix": h} for d, h in uncompress(bytes(data))])

    return packed.select("id", F.inline(open_("moc")))


def to_text(packed: DataFrame) -> DataFrame:
    """(id, moc) with the compressed form in base64."""
    return packed.select("id", F.base64("moc").alias("moc"))


def from_text(packed: DataFrame) -> DataFrame:
    return packed.select("id", F.unbase64("moc").alias("moc"))
