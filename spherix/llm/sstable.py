"""Token ids in sorted-string-table shards.

A shard is a file of byte rows, each ended by one 0x0A:

    block*   entries in ascending key order: varint shared, varint unshared, varint value length, key rest, value
    index    per block: 9-byte last key, u64 place, u32 length (big endian)
    bloom    bits over the keys, 10 a key, 7 probes
    footer   80 bytes: magic, places and lengths of index and bloom, entries, tokens, first and last key, width of an id

A key is a byte 0 and the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is number
order; a row without identifier has a byte 1 and zeros, and so comes last. A value is the document's ids, little
endian, in 2 bytes where the vocabulary allows it, else in 4. The files are written by Spark's text writer from
byte rows: its commit protocol makes retries and lost executors safe, on any file system. They are read by
ranges: footer, index and filter, then blocks; nobody holds a shard.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.llm import common, tokens

MAGIC = b"SPXSST02"
FOOTER = struct.Struct(">8sQIQIQQ9s9sI10x")
INDEX = struct.Struct(">9sQI")
KEY = 9
BLOCK_BYTES = 128 * 1024
#: About so many bytes of input go to a shard, at most.
SHARD_BYTES = 128 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
FLIP = 1 << 63
#: At most so many ids; a wider vocabulary takes 4 bytes an id.
NARROW = 1 << 16


def key_of(doc_id: int | None) -> bytes:
    return b"\1" + bytes(8) if doc_id is None else struct.pack(">BQ", 0, (doc_id + FLIP) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:])[0] - FLIP


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varint_at(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Turns (key, ids) in ascending key order into the byte rows of one shard."""

    def __init__(self, width: int):
        self.width, self.place, self.index, self.keys, self.tokens = width, 0, [], [], 0
        self.block, self.size, self.last = [], 0, b""

    def _row(self, data: bytes) -> bytes:
        self.place += len(data) + 1
        return data

    def _flush(self) -> bytes:
        data = b"".join(self.block)
        self.index.append((self.last, self.place, len(data)))
        self.block, self.size, self.last = [], 0, b""
        return self._row(data)

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        shared = 0
        if self.block:
            while shared < KEY and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = varint(shared) + varint(KEY - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            yield self._flush()

    def close(self) -> Iterator[bytes]:
        if self.block:
            yield self._flush()
        at, index = self.place, b"".join(INDEX.pack(*x) for x in self.index)
        yield self._row(index)
        bits = max(8, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in set(self.keys):
            bloom[_probes(key, bits)] = 1
        place, packed = self.place, np.packbits(bloom).tobytes()
        yield self._row(packed)
        yield FOOTER.pack(MAGIC, at, len(index), place, len(packed), len(self.keys), self.tokens, self.keys[0] if self.keys else bytes(KEY), self.keys[-1] if self.keys else bytes(KEY), self.width)


class Shard:
    """A shard, by a function that gives its bytes from a place on: scan it, or look a key up by Bloom filter, binary search of the index and one block."""

    def __init__(self, size: int, get: Callable[[int, int], bytes]):
        self.get = get
        tail = get(max(size - FOOTER.size - 1, 0), FOOTER.size + 1)
        if len(tail) != FOOTER.size + 1 or tail[-1] != 10 or tail[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard, or cut short")
        _, *self.index_at, bloom, n, self.entries, self.tokens, self.first, self.last, self.width = FOOTER.unpack(tail[:-1])
        self.bloom_at = (bloom, n)

    def index(self) -> list[tuple[bytes, int, int]]:
        return list(INDEX.iter_unpack(self.get(*self.index_at)))

    def _entries(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, key, at = self.get(at, size), b"", 0
        if len(data) != size:
            raise ValueError("a shard is cut short")
        while at < size:
            shared, at = _varint_at(data, at)
            rest, at = _varint_at(data, at)
            n, at = _varint_at(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, dtype="<u2" if self.width == 2 else "<u4", count=n // self.width, offset=at)
            at += n

    def __iter__(self):
        for _, at, size in self.index():
            yield from self._entries(at, size)

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of doc_id."""
        key = key_of(doc_id)
        if not self.first <= key <= self.last:
            return None
        bloom = self.get(*self.bloom_at)
        if not all(bloom[i >> 3] >> (7 - (i & 7)) & 1 for i in _probes(key, len(bloom) * 8)):
            return None
        index = self.index()
        k = bisect_left(index, key, key=lambda x: x[0])
        if k == len(index):
            return None
        return next((v for found, v in self._entries(*index[k][1:]) if found == key), None)


def opened(path: str):
    """(file, Shard) of a shard in any file system that Arrow knows."""
    files, name = common.file_system(path)
    file = files.open_input_file(name)

    def get(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return file, Shard(file.size(), get)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode each text, add end_id, write the shards in ascending doc_id order.

    A null text counts as empty. Rows that repeat a doc_id are all written, side by side, by a hash of their
    texts; rows without doc_id come last. An empty table gives no shard.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= NARROW else 4
        out = ShardWriter(width)
        for batch in batches:
            rows, keys = [], batch.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                for doc_id, ids in zip(keys[at : at + 256], coder.encode(texts)):
                    rows += out.add(key_of(doc_id), np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
        if out.keys:
            yield pa.RecordBatch.from_arrays([pa.array(list(out.close()), pa.binary())], ["value"])

    texts = common.text_rows(docs).withColumn("h", F.xxhash64("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as the planner has it
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes) if size < 1 << 60 else 0)
    rows = texts.repartitionByRange(n, F.asc_nulls_last("doc_id"), "h").sortWithinPartitions(F.asc_nulls_last("doc_id"), "h", "text").select("doc_id", "text")
    rows.mapInArrow(shards, "value binary").select(F.expr("CAST(value AS STRING)").alias("value")).write.option("compression", "none").text(path)


def shard_names(path: str) -> list[str]:
    """The shards in a folder, in the order of their keys; names only."""
    from pyarrow import fs

    files, name = common.file_system(path)
    found = files.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.is_file and x.base_name.startswith("part-") and x.size)


def _each(spark: SparkSession, names: list, work, schema: str) -> DataFrame:
    """work(element of names) in a task of its own; gives record batches."""
    held = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from work(held.value[k])

    return spark.range(0, len(names), 1, max(len(names), 1)).mapInArrow(run, schema)


def footers(spark: SparkSession, path: str) -> list:
    """(name, first, last, entries, tokens) of every shard, in the order of keys: one small row a shard, from footers alone."""

    def work(name: str):
        file, shard = opened(name)
        with file:
            yield pa.RecordBatch.from_pylist([{"name": name, "first": shard.first, "last": shard.last, "entries": shard.entries, "tokens": shard.tokens}])

    rows = _each(spark, shard_names(path), work, "name string, first binary, last binary, entries long, tokens long").collect()
    return sorted(rows, key=lambda r: (bytes(r["first"]), bytes(r["last"]), r["name"]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian u32) of every entry, block by block."""
    names, start = [], 0
    for row in footers(spark, path):
        names.append((row["name"], start))
        start += row["tokens"]

    def work(shard_: tuple[str, int]):
        name, at = shard_
        file, shard = opened(name)
        with file:
            rows, size = [], 0
            for key, ids in shard:
                rows.append((id_of(key), at, len(ids), ids.astype("<u4").tobytes()))
                at += len(ids)
                size += 4 * len(ids)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return _each(spark, names, work, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked documents: only shards whose keys reach over one are opened, and of each one block an id."""
    asked = sorted({key_of(d) for d in doc_ids})
    names = [(r["name"], own) for r in footers(spark, path) if (own := asked[bisect_left(asked, bytes(r["first"])) : bisect_right(asked, bytes(r["last"]))])]

    def work(shard_: tuple[str, list[bytes]]):
        name, keys = shard_
        file, shard = opened(name)
        with file:
            rows = [(id_of(k), x.astype("<u4").tobytes()) for k in keys if (x := shard.lookup(id_of(k))) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return _each(spark, names, work, "doc_id long, ids binary")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents, from the shards: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null texts are one end id; rows without doc_id come last; repeated rows are entries of their own; an empty
    table gives no rows. Other columns are not read.
    """
    path = common.new_path(spark, "shards")
    write(common.table(spark, sf_dir, "documents"), path, tokens.default_path())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
