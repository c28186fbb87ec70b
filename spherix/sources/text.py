"""Delimited text in and out: positions taken from a row's fields, results pasted behind them, and files in the order of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.functions import cells
from spherix.operators import maps


def position(lon: float, lat: float) -> tuple[float, float]:
    """One position in degrees; longitude 360 is 0, and what is out of range is an error."""
    if lon == 360.0:
        lon = 0.0
    if not 0.0 <= lon < 360.0:
        raise ValueError(f"longitude {lon} isn't in [0, 360[")
    if not -90.0 <= lat <= 90.0:
        raise ValueError(f"latitude {lat} isn't in [-90, 90]")
    return lon, lat


def _field(line: Column, k: int, sep: str) -> Column:
    return F.expr(f"try_cast(trim(try_element_at({_split(sep)}, {k})) AS DOUBLE)")


def _split(sep: str) -> str:
    quoted = "".join(f"\\\\{c}" if not c.isalnum() and c != "\t" else c for c in sep)
    return f"split(line, '{quoted}')"


#: Columns that tell the stretch of a file that a line was read from: the file and where the stretch begins.
PLACES = ["_file", "_begin"]


def read_lines(spark: SparkSession, path: str, header: bool = False, places: bool = False) -> DataFrame:
    """(line) of a text file, without comment lines, on request with PLACES; of a file with a header, its first line is left out."""
    rows = spark.read.option("header", header).csv(path, sep="\x01", schema="line STRING", quote="", escape="", comment="#", enforceSchema=True)
    if places:
        rows = rows.select("line", F.col("_metadata.file_path").alias(PLACES[0]), F.col("_metadata.file_block_start").alias(PLACES[1]))
    return rows.where("line IS NOT NULL AND line <> ''")


def read_rows(spark: SparkSession, path: str, lon: int = 1, lat: int = 2, sep: str = ",", header: bool = False, places: bool = False) -> DataFrame:
    """(line, lon, lat), on request with PLACES: lines with the position in fields lon and lat, counted from 1; NULL where it isn't one."""
    rows = read_lines(spark, path, header, places)
    x, y = _field(F.col("line"), lon, sep), _field(F.col("line"), lat, sep)
    rows = rows.withColumns({"lon": x, "lat": y})
    good = F.col("lon").between(0, 360) & F.col("lat").between(-90, 90)
    return rows.select("line", F.when(good, F.when(F.col("lon") == 360, F.lit(0.0)).otherwise(F.col("lon"))).alias("lon"), F.when(good, F.col("lat")).alias("lat"), *(PLACES if places else []))


def read_projected(spark: SparkSession, path: str, x: int = 1, y: int = 2, sep: str = ",", header: bool = False) -> DataFrame:
    """(line, x, y): points of the projection plane; NULL where a field isn't a number."""
    return read_lines(spark, path, header).withColumns({"x": _field(F.col("line"), x, sep), "y": _field(F.col("line"), y, sep)})


def pasted(rows: DataFrame, results: list[str], sep: str = ",") -> DataFrame:
    """(line): each line with the results behind it, empty where they are NULL."""
    return rows.select(F.concat_ws(sep, "line", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in results]).alias("line"))


def hash_file(spark: SparkSession, path: str, depth: int, paste: bool = False, **options) -> DataFrame:
    """The cell of each row of a file: (ipix), or with paste (line) with the cell behind the row."""
    sep = options.get("sep", ",")
    rows = maps.with_hash(read_rows(spark, path, **options), depth)
    return pasted(rows, ["ipix"], sep) if paste else rows.select("ipix")


def count_file(spark: SparkSession, path: str, depth: int, **options) -> DataFrame:
    """(ipix, value): the count map of a file's positions; rows without one are left out."""
    return maps.count_map(read_rows(spark, path, **options), depth)


def sort_file(spark: SparkSession, path: str, out: str, partitions: int | None = None, **options) -> None:
    """The lines of a file, unchanged, as part files in the order of cells, those without a position first; a header is put before each."""
    header = options.get("header", False)
    rows = maps.sort_by_cell(read_rows(spark, path, **options), partitions).select("line")
    if header:
        first = spark.read.text(path).where("NOT value LIKE '#%'").first()[0]
        rows = rows.withColumnRenamed("line", first)
        rows.write.csv(out, header=True, sep="\x01", quote="", quoteAll=False, escape="")
    else:
        rows.write.text(out)


def order_breaks(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row (breaks): how often the cell falls from a line to the next, in a file or a folder of parts in the order of their names.

    Partitions aren't in that order: Spark deals files and stretches of files to them by size.
    """
    return maps.order_breaks(_placed(spark, path, **options), "hash29", PLACES)


def _placed(spark: SparkSession, path: str, **options) -> DataFrame:
    return maps.with_hash(read_rows(spark, path, places=True, **options), cells.MAX_DEPTH, out="hash29")


def index_file(spark: SparkSession, path: str, depth: int, **options) -> DataFrame:
    """The cumulative index of a sorted file, or of a folder of its parts; an error if it isn't sorted (see order_breaks)."""
    rows = maps.checked_order(_placed(spark, path, **options), "hash29", PLACES)
    counts = rows.where("hash29 IS NOT NULL").groupBy(F.shiftright("hash29", 2 * (cells.MAX_DEPTH - depth)).alias("ipix")).agg(F.count("*").alias("value"))
    return maps.cumulative_index(counts, depth)


def cell_file(spark: SparkSession, depth: int, path: str) -> None:
    """A file for tests: a line per cell of a depth, hash, lon, lat and a filler, not in the order of cells."""
    rows = cells.apply(spark.range(cells.n_hash(depth)).select(F.col("id").alias("ipix")), cells.position(depth))
    line = F.concat_ws(",", "ipix", "lon", "lat", F.concat(F.lit("filler"), F.col("ipix") % 97))
    rows.select(line.alias("value"), F.xxhash64("ipix").alias("h")).repartitionByRange("h").sortWithinPartitions("h").select("value").write.text(path)
