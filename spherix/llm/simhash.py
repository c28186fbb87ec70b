"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most DISTANCE bits agree on at least BLOCKS - DISTANCE of BLOCKS blocks, so
they meet under one of the keys made of that many blocks. Each distinct fingerprint goes once under each
key; a bucket is compared in one task and reports a spanning forest of its verified links, never all pairs.
Buckets above LARGE go on to a second level of keys over the bits that are still free, after which a bucket
can hold at most 2**13 distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.llm import common
from spherix.llm.components import components

BITS, DISTANCE, SHINGLE = 64, 3, 3
BLOCKS, FINE_BLOCKS = 6, 8
LARGE = 256
#: Rows that repeat one document and are returned by one task at once.
AGAIN = 1 << 14


def _split(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, n)]


def _mask(blocks) -> int:
    m = sum(1 << b for block in blocks for b in block)
    return m - (1 << 64) if m >> 63 else m


def coarse_masks() -> list[int]:
    return [_mask(c) for c in combinations(_split(list(range(BITS)), BLOCKS), BLOCKS - DISTANCE)]


def fine_masks(coarse: int) -> list[int]:
    """Keys over the bits outside a coarse key."""
    free = [b for b in range(BITS) if not coarse >> b & 1]
    return [_mask(c) for c in combinations(_split(free, FINE_BLOCKS), FINE_BLOCKS - DISTANCE)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n, fp): one row per distinct (doc_id, text) with a hash of the text and the rows that have both. Null texts and texts without words have fingerprint 0.

    The 64 bit counts of a document are 32 sums of longs, each holding two counts; they are summed on the
    task that reads the document, before the shuffle.
    """
    texts = common.text_rows(docs)
    words = F.array_remove(F.split(common.ascii_lower(F.col("text")), common.SPACE), "")
    rows = texts.select("doc_id", F.xxhash64("text").alias("own"), words.alias("words"))
    rows = rows.select("doc_id", "own", "words", F.posexplode_outer("words").alias("pos", "word"))
    n = F.size("words")
    rows = rows.where(F.col("pos").isNull() | (F.col("pos") <= F.greatest(n - SHINGLE, F.lit(0))))
    more = [F.get("words", F.col("pos") + k) for k in range(1, SHINGLE)]
    h = F.when(F.col("pos").isNotNull(), F.xxhash64(F.concat_ws(" ", "word", *more)))
    rows = rows.select("doc_id", "own", "pos", h.alias("h"))
    pair = F.lit(1 << 32 | 1)
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair)).alias(f"s{j}") for j in range(32)]
    again = F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("again")
    found = rows.groupBy("doc_id", "own").agg(F.count("h").alias("n"), again, *sums)
    return found.mapInArrow(_decide, "doc_id long, own long, n long, fp long")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit is set if more than half of the shingles have it."""
    for batch in batches:
        half = batch.column("n").to_numpy()
        fp = np.zeros(len(half), dtype=np.int64)
        for j in range(BITS // 2):
            both = batch.column(f"s{j}").fill_null(0).to_numpy()
            fp |= np.where(2 * (both & 0xFFFFFFFF) > half, np.int64(_mask([[j]])), 0)
            fp |= np.where(2 * (both >> 32) > half, np.int64(_mask([[j + 32]])), 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), batch.column("again"), pa.array(fp)], ["doc_id", "own", "n", "fp"])


def _forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (i, j) between places of fp."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    u, v = [], []
    for a, b in zip(fp[i].tolist(), fp[j].tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            u.append(a)
            v.append(b)
    return u, v


def _links(fp: np.ndarray, group: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between places of the same group, which lie side by side."""
    bits, found_i, found_j = fp.view(np.uint64), [], []
    for d in range(1, largest):
        near = np.nonzero((group[d:] == group[:-d]) & (np.bitwise_count(bits[d:] ^ bits[:-d]) <= DISTANCE))[0]
        found_i.append(near)
        found_j.append(near + d)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, int), np.empty(0, int))


def _bucket_links(most: int | None):
    """Reads (k, key, fp) sorted; gives links (0, 0, u, v), and the rows (k + 1, key, fp, 0) of buckets above most."""

    def passed_on(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0] + 1), pa.array(rows[1]), pa.array(rows[2]), pa.array(np.zeros(rows.shape[1], np.int64))], ["k", "key", "u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def emit(rows: np.ndarray):
            k, key, fp = rows
            new = np.ones(len(fp), bool)
            new[1:] = (k[1:] != k[:-1]) | (key[1:] != key[:-1])
            group = np.cumsum(new) - 1
            size = np.bincount(group)[group]
            over = size > most if most else np.zeros(len(fp), bool)
            fit = (size > 1) & ~over
            out = []
            if over.any():
                out.append((k[over] + 1, key[over], fp[over], np.zeros(over.sum(), np.int64)))
            fp, group, size = fp[fit], group[fit], size[fit]
            for lo, hi in ((1, 16), (16, 1 << 62)):  # few steps for the many small groups
                own = (size > lo) & (size <= hi) if lo > 1 else size <= hi
                f, g = fp[own], group[own]
                if len(f):
                    u, v = _forest(f, *_links(f, g, int(size[own].max())))
                    zero = np.zeros(len(u), np.int64)
                    out.append((zero, zero, np.array(u, np.int64), np.array(v, np.int64)))
            for columns in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns], ["k", "key", "u", "v"])

        flushed = None  # a bucket that is known to be above most goes on as it comes
        for batch in batches:
            rows = np.array([batch.column(c).to_numpy() for c in range(3)])
            if kept:
                rows = np.concatenate([*kept, rows], axis=1)
                kept = []
            if flushed is not None:
                other = np.nonzero((rows[0] != flushed[0]) | (rows[1] != flushed[1]))[0]
                n = int(other[0]) if len(other) else rows.shape[1]
                yield from passed_on(rows[:, :n])
                rows, flushed = rows[:, n:], None if len(other) else flushed
            last = np.nonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[0] if rows.shape[1] else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit(rows[:, :cut])
            kept = [rows[:, cut:]]
            if most and kept[0].shape[1] > most:
                yield from passed_on(kept[0])
                flushed, kept = kept[0][:2, 0], []
        if kept and kept[0].shape[1]:
            yield from emit(kept[0])

    return work


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp) that span every component of the links at DISTANCE or less."""
    masks = coarse_masks()
    keys = F.array(*[F.struct(F.lit(k * 2).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("e")).select("e.k", "e.key", "fp")
    schema = "k long, key long, u long, v long"
    dealt = lambda df: df.repartition("k", "key").sortWithinPartitions("k", "key", "fp")
    first = common.written(dealt(rows).mapInArrow(_bucket_links(LARGE), schema), "links")
    over = first.where("k > 0").select("k", "key", F.col("u").alias("fp"))
    fine = F.lit(None)
    for k, m in enumerate(masks):
        own = F.array(*[F.struct(F.lit(k * 64 + f).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(_or(m, x))).alias("key")) for f, x in enumerate(fine_masks(m))])
        fine = F.when(F.col("k") == 2 * k + 1, own).otherwise(fine) if k else own
    second = dealt(over.select("fp", F.explode(fine).alias("e")).select("e.k", "e.key", "fp")).mapInArrow(_bucket_links(None), schema)
    return first.where("k = 0").select("u", "v").union(second.select("u", "v"))


def _or(a: int, b: int) -> int:
    return a | b


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, own, fp, n, component_id): a row per distinct (doc_id, text), own being a hash of the text and n the rows that repeat it.

    Texts without words share fingerprint 0 and so are linked like any others. A component's id is its
    smallest doc_id that isn't null.
    """
    own = common.written(fingerprints(docs), "fingerprints")
    first = common.written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = common.written(components(links(first)).select(F.col("node").alias("fp"), "root"), "roots")
    rooted = common.written(first.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    common.dropped(first, roots)
    least = common.written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = common.written(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    common.dropped(rooted, least)
    return own.join(named, "fp").select("doc_id", "own", "fp", "n", "root", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, any of those that have none if no row has one.

    Of several texts with that doc_id, and of rows that repeat it, one stays. A null text is an empty one; an
    empty table gives no rows; columns are those of docs.
    """
    doc_id, own, n = common.unused(docs, "stay_id", "stay_own", "stay_n")
    found = near_duplicates(docs)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own", "n")).alias("b"))
    stay = common.written(best.select(F.col("b.doc_id").alias(doc_id), F.col("b.own").alias(own), F.col("b.n").alias(n)), "stay")
    keyed = docs.select(*common.columns(docs), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(own))
    once = keyed.join(stay.where(F.col(n) == 1).withColumnRenamed(own, f"{own}_"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.col(own) == F.col(f"{own}_")), "left_semi")
    # rows that repeat: any one of them, put together before the shuffle
    again = keyed.join(stay.where(F.col(n) > 1).withColumnRenamed(own, f"{own}_"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.col(own) == F.col(f"{own}_")), "left_semi")
    whole = F.any_value(F.struct(*common.columns(docs))).alias(n)
    again = again.groupBy(F.col("doc_id").cast("long").alias(doc_id), own).agg(whole).select(f"{n}.*")
    return once.select(*common.columns(docs)).unionByName(again)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable), a row per row of documents.

    Null texts and texts without words have fingerprint 0 and are linked; rows that repeat (doc_id, text) are each
    returned; a row without doc_id has the component of its links, null if none of them has an id.
    """
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    out = out.select("n", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    # a row per row that repeats; of many, in parts that are dealt out
    names = ["doc_id", "fingerprint", "component_id"]
    many = out.where(F.col("n") > AGAIN).select("*", F.explode(F.expr(f"sequence(0L, n - 1, {AGAIN}L)")).alias("k")).select(*names, F.least(F.col("n") - F.col("k"), F.lit(AGAIN)).alias("n"))
    many = many.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = out.where(F.col("n") <= AGAIN).select(*names, "n").unionByName(many)
    return few.select(*names, F.explode(F.expr("sequence(1L, n)")).alias("k")).drop("k")
