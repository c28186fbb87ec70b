"""Best-fit packing by pattern repeats.

The histogram of piece lengths (at most `capacity` rows, whatever the input) goes to the driver. There,
patterns of two to four lengths that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares, rounded and laid down while lengths last; what is left is packed by
best fit in descending order, on counts again. The outcome is a list of slots, each "the pieces of length L
with ranks r to r+n go to sequences s to s+n at offset o", which every piece looks up by its length and rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherix.llm import common, tokens

CAPACITY = 2048
#: Patterns that are enumerated for one length, by their number of pieces; bounds the fit, not the input.
PATTERNS = {2: 1, 3: 12, 4: 6}
FIT_ROUNDS = 300
#: Ranks within a length are counted in so many parts, so that no length is one task's work.
PARTS = 256


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Few-piece patterns over the lengths in use (ascending), each filled up as far as the lengths allow."""
    found = set()

    def largest(most: int) -> int | None:
        k = np.searchsorted(lengths, most, side="right") - 1
        return int(lengths[k]) if k >= 0 else None

    def spread(most: int, n: int) -> list[int]:
        k = np.searchsorted(lengths, most, side="right")
        return sorted({int(x) for x in lengths[np.linspace(0, k - 1, min(n, k)).astype(int)]}) if k else []

    for a in map(int, lengths):
        if a == capacity:
            found.add((a,))
        elif (b := largest(capacity - a)) is not None:
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in spread(min(a, capacity - a), PATTERNS[3]):
            if (c := largest(capacity - a - b)) is not None:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        for b in spread(min(a, capacity - a), PATTERNS[4]):
            for c in spread(min(b, capacity - a - b), PATTERNS[4] // 2):
                if (d := largest(capacity - a - b - c)) is not None:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 that minimise the weighted squares of counts - A x, by projected simultaneous steps."""
    rows = np.array([x for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    per_row = np.maximum(np.bincount(rows, minlength=len(counts)), 1)
    per_col = np.array([len(p) for p in patterns], dtype=float)
    x = np.zeros(len(patterns))
    for _ in range(FIT_ROUNDS):
        rest = (counts - np.bincount(rows, weights=x[cols], minlength=len(counts))) / per_row
        x = np.maximum(0, x + np.bincount(cols, weights=rest[rows], minlength=len(patterns)) / per_col)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots (length, rank, sequence, offset), each for a run of ranks from `rank` on, sorted by length and rank."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    lengths = np.nonzero(left)[0]
    groups: list[tuple[tuple[int, ...], int]] = []
    if len(lengths):
        patterns = enumerate_patterns(lengths, capacity)
        if patterns:
            x = fit_repeats(patterns, left)
            for j in np.argsort(-x, kind="stable"):
                need = np.unique(patterns[j], return_counts=True)
                n = int(min(round(float(x[j])), *(left[k] // c for k, c in zip(*need))))
                if n > 0:
                    groups.append((patterns[j], n))
                    for k, c in zip(*need):
                        left[k] -= n * c
    groups += best_fit(left, capacity)
    used, slots, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for items, n in groups:
        offset = 0
        for length in items:
            slots.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    slots.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(slots, dtype=np.int64).reshape(-1, 4).T))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending order, for all pieces of a length and all equally filled sequences at once."""
    room: list[list] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, dtype=bool)

    def put(space: int, items: tuple, n: int) -> None:
        room[space].append((items, n))
        there[space] = True

    for length in map(int, np.nonzero(left)[0][::-1]):
        n = int(left[length])
        while n:
            k = int(np.argmax(there[length:]))
            if not there[length + k]:
                each = capacity // length
                if full := n // each:
                    put(capacity - each * length, (length,) * each, full)
                if rest := n % each:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            space = length + k
            items, m = room[space].pop()
            there[space] = bool(room[space])
            take = min(n, m)
            if m > take:
                put(space, items, m - take)
            put(space - length, (*items, length), take)
            n -= take
    return [g for groups in room for g in groups]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and end_id, cut into pieces of `capacity`.

    Only the first piece of a document may be shorter. A null text counts as empty and so is one end_id;
    rows that repeat a doc_id, or have none, are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                rows = []
                for doc_id, ids in zip(keys[at : at + 256], coder.encode(batch.column(1).slice(at, 256).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    rows += [(doc_id, k, s, e - s, ids[4 * s : 4 * e]) for k, (s, e) in enumerate(zip(starts, [*starts[1:], n]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return common.text_rows(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, length and any more columns) with sequence_id and offset.

    Ranks are counted within (length, part of doc_id) and raised by the parts before; both tables of counts
    have at most capacity * PARTS rows. cut is read twice, so it should be a written table. Pieces that repeat
    doc_id and piece are each placed; an empty table gives no rows.
    """
    spark = cut.sparkSession
    parted = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    key = slots["length"] << 44 | slots["rank"]
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = parted.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_part"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    names = cut.columns
    held = spark.sparkContext.broadcast((key, slots["rank"], slots["sequence"], slots["offset"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, sequence, offset = held.value
        for batch in batches:
            own = batch.column("_rank").to_numpy()
            k = np.searchsorted(key, batch.column("length").to_numpy() << 44 | own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[k] + own - rank[k]), pa.array(offset[k])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents: a row per piece with its checksum, sequence and offset, and on request its ids (see pieces for odd rows).

    An empty table gives no rows; columns of docs other than doc_id and text are left out.
    """
    cut = pieces(docs, tokenizer or tokens.default_path(), capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    cut = common.written(cut if with_ids else cut.drop("ids"), "pieces")
    return assign(cut, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of pack, a row per piece of documents: a null text is one end id, rows that repeat a doc_id or
    have none are packed each, pieces of equal length and id take any of their places, an empty table gives no rows.
    """
    return pack(common.table(spark, sf_dir, "documents"))
