"""Streaming count maps: cells are counted in state; a batch of all counts can be turned into a multi-order map."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spherix import storage
from spherix.operators import maps


def count_stream(positions: DataFrame, depth: int) -> DataFrame:
    """(ipix, value) over a stream of (lon, lat): order doesn't matter, so nothing has to be sorted."""
    return maps.count_map(positions, depth)


def run_once(spark: SparkSession, path: str, depth: int, positions_sql: str, table: str = "events") -> DataFrame:
    """All that is there now, as a stream with availableNow, into a memory table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    view = f"v{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    positions = spark.sql(f"SELECT * FROM {positions_sql.replace(f'FROM {table}', f'FROM {view}')}")
    out = f"s{uuid.uuid4().hex}"
    query = count_stream(positions, depth).writeStream.outputMode("complete").format("memory").queryName(out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(out)


def stream_mom(spark: SparkSession, positions: DataFrame, depth: int, merger, table_path: str, checkpoint: str, least: int = 0):
    """A multi-order map kept up to date from a stream of (lon, lat): a started query.

    A batch's counts are added to the map's leaves by a merge with the last state, written under the batch's number, so
    that a batch that runs again gives the same table; the map is built anew from the leaves. Read it by latest().
    """

    def step(batch: DataFrame, number: int) -> None:
        new = maps.count_map(batch, depth)
        if number:
            new = maps.add(batch.sparkSession.read.parquet(f"{table_path}/leaves/{number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{table_path}/leaves/{number}")
        leaves = batch.sparkSession.read.parquet(f"{table_path}/leaves/{number}")
        maps.multi_order_map(leaves, depth, merger, least).write.mode("overwrite").parquet(f"{table_path}/mom/{number}")

    return positions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table_path: str) -> DataFrame:
    """The map of the last batch that is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/mom")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(x.getPath().getName()) for x in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{table_path}/mom/{max(done)}")


def mom_once(spark: SparkSession, path: str, depth: int, positions_sql: str, merger, table: str = "events") -> DataFrame:
    """All that is there now, as a stream, into a multi-order map."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    view = f"v{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    positions = spark.sql(f"SELECT lon, lat FROM {positions_sql.replace(f'FROM {table}', f'FROM {view}')}")
    out = storage.scratch(spark, "stream")
    stream_mom(spark, positions, depth, merger, out, f"{out}/checkpoint").awaitTermination()
    return latest(spark, out)
