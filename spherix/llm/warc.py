"""WARC archives as a Spark data source in Python, and page archives with revisit records.

Reading plans partitions of files, takes over predicates on record type and headers, parses each record's
headers first and steps over the block of a record that no predicate wants. It reads any folder of .warc and
.warc.gz files, or one file. Writing makes one file a task; only files that the driver has committed are listed
in the folder's manifest, with the places of records at which they may be split, and where there is a manifest only
its files are read. A file without such places, or with gzip members, is one partition: a payload may hold
whole records of its own, so that no place can be told from its bytes alone.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from spherix.llm import common

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
WRITE_SCHEMA = SCHEMA
#: Column, header of the record.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_manifest"
BATCH_BYTES = 4 << 20
#: Bytes of a file after which a partition may begin.
SPLIT_BYTES = 64 << 20
#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
PAGE_ID = "urn:page:"


def _header(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else " " for c in value)


def record(row) -> bytes:
    """A WARC/1.1 record; without payload it is a revisit of an identical payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = head + (bytes(row["payload"]) if row["payload"] is not None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_header(row['target_uri'])}")
    if row["refers_to"] is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info() -> bytes:
    """The record that a file begins with."""
    block = b"format: WARC File Format 1.1\r\nsoftware: spherix\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream, wanted, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record that begins before `end`; the block of a record that `wanted` refuses is stepped over, and the record left out."""
    while True:
        at, line = stream.tell(), stream.readline()
        while line in (b"\r\n", b"\n"):
            at, line = stream.tell(), stream.readline()
        if not line or end is not None and at >= end:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            yield headers, stream.read(size)
        else:
            stream.seek(size, 1)


def _values(headers: dict[str, str]) -> dict[str, str | None]:
    out = {c: headers.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c] and out[c].strip("<>")
    out["payload_digest"] = out["payload_digest"] and out["payload_digest"].partition(":")[2]
    return out


class WarcPartition(InputPartition):
    """Records of a file that begin in [start, end)."""

    def __init__(self, name: str, start: int = 0, end: int | None = None):
        super().__init__(name)
        self.name, self.start, self.end = name, start, end


def block_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """(length, payload) of a record's block: what follows the HTTP head in one, else all."""
    if not headers.get("content-type", "").startswith("application/http"):
        return len(block), block
    http, _, body = block.partition(b"\r\n\r\n")
    own = (x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return next((int(x) for x in own if x.isdigit()), len(body)), body


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool = True):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, path = common.file_system(self.path)
        kind = files.get_file_info([path, f"{path}/{MANIFEST}"])
        if kind[0].type == fs.FileType.File:
            return [WarcPartition("")]
        if kind[1].type == fs.FileType.File:
            with files.open_input_stream(f"{path}/{MANIFEST}") as f:
                lines = [x.split("\t") for x in f.read().decode().split("\n") if x]
        else:
            found = files.get_file_info(fs.FileSelector(path, recursive=True))
            lines = [[x.path[len(path) :].lstrip("/"), ""] for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        out = []
        for name, cuts in lines:
            at = [0, *map(int, filter(None, cuts.split(",")))]
            out += [WarcPartition(name, a, b) for a, b in zip(at, [*at[1:], None])]
        return out or [WarcPartition("", 0, 0)]

    def _wanted(self, headers: dict[str, str]) -> bool:
        own = _values(headers)
        return all((own[c] in v) if how == "in" else own[c] is not None and own[c].startswith(v) for c, how, v in self.tests)

    def read(self, partition):
        if partition.end == 0:
            return
        files, path = common.file_system(self.path)
        whole = f"{path}/{partition.name}" if partition.name else path
        names = [n.split()[0] for n in SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, size = [], 0
        with files.open_input_file(whole) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if whole.endswith(".gz") else raw, 1 << 20)
            if partition.start:
                stream.seek(partition.start)
            for headers, block in parse(stream, self._wanted, partition.end):
                own = _values(headers)
                length, body = block_of(headers, block)
                rows.append((*own.values(), length, body if self.payload and own["record_type"] != "revisit" else None))
                size += len(body) + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None, cuts: tuple[int, ...] = ()):
        self.name, self.cuts = name, cuts


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, zipped: bool = False, split: int = SPLIT_BYTES):
        self.path, self.zipped, self.split = path, zipped, split

    def write(self, rows):
        files, path = common.file_system(self.path)
        files.create_dir(path, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc{'.gz' * self.zipped}", 0, []  # a retried or doubled task writes another file
        pack = gzip.compress if self.zipped else bytes
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            for row in rows:
                if not at:
                    out.write(first := pack(info()))
                    at = len(first)
                if at - (cuts[-1] if cuts else 0) >= self.split and not self.zipped:
                    cuts.append(at)
                out.write(data := pack(record(row)))
                at += len(data)
        if not at:
            files.delete_file(f"{path}/{name}")
        return Written(name if at else None, tuple(cuts))

    def commit(self, messages):
        files, path = common.file_system(self.path)
        files.create_dir(path, recursive=True)
        lines = sorted(f"{m.name}\t{','.join(map(str, m.cuts))}" for m in messages if m and m.name)
        with files.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages):
        files, path = common.file_system(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder or file), and df.write.format("warc").mode("append").save(folder).

    Option payload (reading; true): false leaves payloads out. Options compression (writing; none): gzip makes each
    record a member of its own; split_bytes (writing): least bytes between the places at which a file may be split.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("compression", "none") == "gzip", int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as records: of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is the response.

    A null html is an empty payload. A page without page_id can be a response, never the one that others
    refer to; pages that share the smallest page_id and the payload are all responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    own = own.select("page_id", "url", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = own.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = common.written(first.where("n > 1 AND first IS NOT NULL").select("payload_digest", "first"), "first")
    both = own.join(first, "payload_digest", "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull())
    none = F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string"))
    urn = lambda c: F.concat(F.lit(PAGE_ID), F.coalesce(F.col(c).cast("string"), none))
    return both.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, urn("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, **options: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(urn: str):
    return F.expr(f"try_cast(substring({urn}, {len(PAGE_ID) + 1}) AS BIGINT)")


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of pages, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a page without page_id is a response, or a revisit of one with an id; rows that
    share the smallest page_id of a payload are all responses; an empty table gives no rows. The wanted record types
    are pushed to the source, which steps over the others' blocks.
    """
    path = common.new_path(spark, "warc")
    archive(common.table(spark, sf_dir, "pages"), path)
    rows = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    size = F.when(F.col("payload").isNotNull(), F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return rows.select(page_of("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
