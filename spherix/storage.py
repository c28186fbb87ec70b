"""Tables that a program writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str = "map") -> str:
    """A new path in the shared folder, spark.checkpoint.dir; in a temporary one only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        base = f"file://{tempfile.mkdtemp(prefix='sky-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what a program uses several times; lineage ends here."""
    path = scratch(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(rows: DataFrame, path: str, suffix: str) -> list[str]:
    """A file for each value of rows (value BINARY, at most 2 GB), byte for byte; the files' names.

    A file is written beside its place, under a name that readers pass over, and moved there when it is whole, so that
    tasks that fail or run twice leave one file. To the driver come names.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def put(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        files.create_dir(folder, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            names = []
            for data in batch.column(0):
                names.append(f"part-{part:05d}-{k:03d}{suffix}")
                beside = f"{folder}/.{names[-1]}-{uuid.uuid4().hex}"
                with files.open_output_stream(beside, compression=None) as out:
                    out.write(data.as_py())
                files.move(beside, f"{folder}/{names[-1]}")
                k += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return sorted(r[0] for r in rows.mapInArrow(put, "name string").collect())
