"""What the operators share: tables, the shared folder and Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules that take `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where both are one process, a new one if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        path = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(path: str):
    """The Arrow file system of a folder, local or remote, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, made longer until none is a column of df."""
    out, there = [], {c.lower() for c in df.columns}
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns, by names that may hold dots and back quotes."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
