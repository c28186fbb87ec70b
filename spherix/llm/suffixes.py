"""Exact removal of repeated byte windows: suffixes sorted only as deep as the threshold, in digit passes.

Two equal windows of WINDOW bytes pick the same anchor inside, the place whose GRAM bytes hash least, so it
is enough to sort the suffixes at anchors (about one byte in sixteen). The passes are:

1. First digit: anchors are dealt by the hash of their GRAM bytes. Groups of one stop here.
2. Deeper digit, all that any window around the anchor can hold: suffixes equal in it form a class, and all
   but the class's smallest document repeat every window around the anchor.
3. Groups of several classes: the bytes of one suffix a class come to a task, which sorts the suffixes from the
   anchor on by digits of 8 bytes, the most significant first, only as deep as a window reaches and only where
   several are still equal; and likewise, backwards, the bytes before the anchor. A window around the anchor is
   equal in two suffixes where they share enough bytes in both orders, so equal groups are exactly the repeated
   windows; the answer is a bit per window. Groups of over LARGE classes are split by window, each then a key of
   its own (128 bits of hash), whose smallest document is found by an aggregate.

The answers go back to the documents, where the covered bytes are removed. Windows are compared on the input.
Passes 1 and 2 compare hashes of 64 bits for the suffixes of one anchor: of n of them two different ones are
taken for equal with a chance below n * n / 2**65. All suffixes, in place of those at anchors, would be some sixteen
times the rows, far above the disk that a run may use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.llm import common

WINDOW, GRAM = 50, 20
REACH = WINDOW - GRAM  # of a window before its anchor
CONTEXT = REACH + WINDOW
PAD = 96
CHUNK = 2 << 20
PLACE = np.uint64((1 << 24) - 1)
#: Bits of the first digit's hash. Anchors that it takes for equal are only compared in vain; the zeros before it cost no disk.
DIGIT = np.uint64(2**64 - 2**16)
NO_ID = 2**63 - 1
#: Classes of one anchor that may meet in one task (about 150 bytes each), and anchors that may be sent to all executors.
LARGE, MAX_BROADCAST = 1 << 16, 1 << 20
EVERY = (1 << (REACH + 1)) - 1

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_SHIFT = np.uint64(32)


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> _SHIFT
    h *= _M[3]
    h ^= h >> np.uint64(29)
    return h


class Layout:
    """Some texts side by side, with zeros around each, and their anchors."""

    def __init__(self, texts: list[bytes]):
        gap = bytes(PAD)
        self.data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = PAD + np.concatenate([[0], np.cumsum(self.size[:-1] + PAD)]).astype(np.int64) if texts else np.empty(0, np.int64)
        n = len(self.data) - 8
        self.words = np.ndarray((n,), dtype="<u8", buffer=self.data, strides=(1,)).copy()

    def anchors(self) -> None:
        """place, text and hash (of the first digit), and context (of the deeper one), a row per anchor."""
        w, n = self.words, len(self.words) - GRAM
        h = w[:n] * _M[0]
        h ^= w[8 : n + 8] * _M[1]
        h ^= w[GRAM - 8 : n + GRAM - 8] * _M[2]
        h = _finish(h)
        edge = np.zeros(n + 1, dtype=np.int8)
        long = self.size >= WINDOW
        edge[self.start[long]] = 1
        edge[self.start[long] + self.size[long] - WINDOW + 1] = -1
        valid = np.cumsum(edge[:n], dtype=np.int8).view(bool)
        places = []
        step = (1 << 24) - 4 * WINDOW  # places fit 24 bits; a longer stretch is taken in steps
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            end = min(n, hi + REACH)
            m = h[lo:end] & ~PLACE
            m |= np.arange(end - lo, dtype=np.uint64)
            width = 1
            while 2 * width <= REACH + 1:  # ends at 16, of 31
                m[: len(m) - width] = np.minimum(m[: len(m) - width], m[width:])
                width *= 2
            rest = REACH + 1 - width
            if rest:
                m[: len(m) - rest] = np.minimum(m[: len(m) - rest], m[rest:])
            own = (m[: hi - lo][valid[lo:hi]] & PLACE).astype(np.int64) + lo
            if len(own):
                places.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        p = np.concatenate(places) if places else np.empty(0, np.int64)
        p = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
        self.place, self.text = p, np.searchsorted(self.start, p, side="right") - 1
        self.hash = (h[p] & DIGIT).view(np.int64)
        self.left = np.minimum(REACH, p - self.start[self.text])
        self.right = np.minimum(WINDOW, self.start[self.text] + self.size[self.text] - p)
        c = _finish((self.left * 64 + self.right).astype(np.uint64) * _M[0])
        for k in range(0, CONTEXT, 8):
            c ^= self.words[p - REACH + k] * _M[k // 8 % 3]
            c = _finish(c)
        self.context = c.view(np.int64)

    def found(self, text: np.ndarray, context: np.ndarray) -> np.ndarray:
        """For each anchor the place in (text, context) of the row that it equals, or -1."""
        mixed = lambda t, c: c.view(np.uint64) ^ t.astype(np.uint64) * _M[1]
        key = mixed(text, context)
        order = np.argsort(key)
        own = mixed(self.text, self.context)
        k = np.minimum(np.searchsorted(key[order], own), max(len(key) - 1, 0))
        if not len(key):
            return np.full(len(own), -1)
        k = order[k]
        return np.where((key[k] == own) & (text[k] == self.text) & (context[k] == self.context), k, -1)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names.split())


def _keyed(docs: DataFrame) -> DataFrame:
    return common.text_rows(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield _rows("doc text", batch.column(0), pa.array([press.compress(t) for t in common.text_bytes(batch.column(1))], pa.binary()))


def _unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(x) for x in column.to_pylist()]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, texts = batch.column(0).to_numpy(), common.text_bytes(batch.column(1))
        for lo, hi in _chunks(texts):
            own = Layout(texts[lo:hi])
            own.anchors()
            # a text that repeats an anchor with all around it needs one row of it
            key = _finish(own.hash.view(np.uint64) ^ own.context.view(np.uint64) * _M[2] ^ own.text.astype(np.uint64) * _M[1])
            _, once = np.unique(key, return_index=True)
            if len(once):
                yield _rows("h c doc", own.hash[once], own.context[once], doc[lo:hi][own.text[once]])


def _classes(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """Reads (h, c, doc) in order; gives (doc, c, h, ask): ask 0 repeats all around the anchor, ask 1 is a class to compare, ask 2 tells that the anchor has over large classes."""
    held, asked = None, False  # the class that the last batch ended in, by its smallest document
    before = 0  # classes of that anchor up to and with the one held
    for batch in batches:
        h, c, doc = (batch.column(k).to_numpy() for k in range(3))
        if not len(h):
            continue
        if held is not None:
            h, c, doc = (np.concatenate([[x], y]) for x, y in zip(held, (h, c, doc)))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        first = np.nonzero(new_c)[0]
        least = doc[first][np.cumsum(new_c) - 1]
        full = doc > least
        full[1:] &= ~((doc[1:] == doc[:-1]) & ~new_c[1:])
        if full.any():
            yield _rows("doc c h ask", doc[full], c[full], h[full], np.zeros(full.sum(), np.int32))
        head = new_h[first]  # of classes: begins a group
        ask = ~head
        ask[:-1] |= ~head[1:]
        group = np.cumsum(new_h) - 1
        starts = np.nonzero(new_h)[0]
        sizes = np.add.reduceat(new_c.astype(np.int64), starts)
        sizes[0] += before - 1 if held is not None else 0
        over = sizes > large
        over[0] &= before <= large  # said already
        if over.any():
            yield _rows("doc c h ask", np.zeros(over.sum(), np.int64), np.zeros(over.sum(), np.int64), h[starts[over]], np.full(over.sum(), 2, np.int32))
        before = int(sizes[-1])
        alone = np.minimum.reduceat(doc, starts) == np.maximum.reduceat(doc, starts)
        alone[[0, -1]] = False  # may go on before or after this batch
        ask &= ~alone[group[first]]
        now = bool(ask[-1]) or (asked and len(first) == 1)
        if held is not None and asked:
            ask[0] = False
        out = first[ask]
        if len(out):
            yield _rows("doc c h ask", doc[out], c[out], h[out], np.ones(len(out), np.int32))
        held, asked = (h[first[-1]], c[first[-1]], doc[first[-1]]), now


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (doc, text, asked: [c]); gives (h, c, doc, left, right, bytes) of the asked anchors."""
    for batch in batches:
        doc, texts, asked = batch.column(0).to_numpy(), _unpacked(batch.column(1)), batch.column(2)
        offsets, c = asked.offsets.to_numpy(), asked.values.to_numpy()
        for lo, hi in _chunks(texts):
            own = Layout(texts[lo:hi])
            own.anchors()
            a, b = offsets[lo], offsets[hi]
            k = own.found(np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), c[a:b])
            there = np.nonzero(k >= 0)[0]
            _, once = np.unique(k[there], return_index=True)
            there = there[once]
            if len(there):
                span = own.data[(own.place[there] - REACH)[:, None] + np.arange(CONTEXT)]
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(there), [None, pa.py_buffer(np.ascontiguousarray(span))]).cast(pa.binary())
                yield _rows("h c doc l r bytes", own.hash[there], own.context[there], doc[lo:hi][own.text[there]], own.left[there], own.right[there], raw)


def ordered(group: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group (ascending already) and then bytes, and how many bytes each shares with the row before; -1 where a group begins.

    Digits are 8 bytes, the most significant first; a pass takes only rows that are equal to another so far.
    """
    n, m = data.shape
    wide = np.zeros((n, -(-m // 8) * 8), dtype=np.uint8)
    wide[:, :m] = data
    digits = wide.view(">u8").astype(np.uint64)
    order, start = np.arange(n), np.concatenate([[True], group[1:] != group[:-1]])[:n]
    for digit in digits.T:
        run = np.cumsum(start) - 1
        several = np.nonzero(np.bincount(run)[run] > 1)[0] if n else order
        if not len(several):
            break
        own, of = digit[order[several]], run[several]
        by = np.lexsort((own, of))
        order[several], own = order[several[by]], own[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
        start[several] = new
    shared = np.full(n, -1, dtype=np.int64)
    if n > 1:
        differ = wide[order[1:], :m] != wide[order[:-1], :m]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
        shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def _window_keys(h: np.ndarray, span: np.ndarray, own: np.ndarray, a: int, by: int) -> np.ndarray:
    """Hashes of the windows from a bytes before the anchor, of the rows own; by gives independent ones."""
    key, at = h[own].view(np.uint64) * _M[1] ^ _M[by], REACH - a
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        key ^= np.ascontiguousarray(span[own, at + k : at + k + 8]).view("<u8")[:, 0] * _M[(k // 8 + by) % 3]
        key = _finish(key)
    return key


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (h, c, doc, l, r, bytes) by h and doc; gives (doc, c, mask): bit a is set if the window from a bytes before the anchor occurs in a smaller document."""

    def judge(h, c, doc, left, right, span):
        n = len(h)
        anchor = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        after, shared_after = ordered(anchor, span[:, REACH:])
        before, shared_before = ordered(anchor, span[:, REACH - 1 :: -1])
        mask, run_after, run_before = np.zeros(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for a in range(REACH + 1):
            own = np.nonzero((left >= a) & (right >= WINDOW - a))[0]
            if len(own) < 2:
                continue
            run_after[after] = np.cumsum(shared_after < WINDOW - a)
            run_before[before] = np.cumsum(shared_before < a)
            key = run_after[own] * (n + 1) + run_before[own]
            order = np.argsort(key, kind="stable")  # rows come by document, so a run begins with the smallest
            run = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            least = doc[own][order][np.nonzero(run)[0]][np.cumsum(run) - 1]
            mask[own[order]] |= np.where(doc[own][order] > least, 1 << a, 0)
        some = mask != 0
        return _rows("doc c mask", doc[some], c[some], mask[some])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(5)] + [np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint8).reshape(-1, CONTEXT)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        other = np.nonzero(rows[0] != rows[0][-1])[0]
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield judge(*(x[:cut] for x in rows))
        held = [x[cut:] for x in rows]
    if held is not None:
        yield judge(*held)


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (h, c, doc, l, r, bytes); gives (w, v, doc, c, bit), a row per window around the anchor, w and v being hashes of anchor, place and bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, left, right = (batch.column(k).to_numpy() for k in range(5))
        span = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint8).reshape(-1, CONTEXT)
        for a in range(REACH + 1):
            own = np.nonzero((left >= a) & (right >= WINDOW - a))[0]
            if len(own):
                key, more = (_finish(_window_keys(h, span, own, a, by) ^ np.uint64(a) * _M[0]) for by in (0, 1))
                yield _rows("w v doc c bit", key.view(np.int64), more.view(np.int64), doc[own], c[own], np.full(len(own), 1 << a, np.int64))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (doc, text, found: [(c, mask)]); gives the kept bytes."""
    for batch in batches:
        doc, texts = batch.column(0).to_pylist(), _unpacked(batch.column(1))
        found = batch.column(2)
        offsets, values = found.offsets.to_numpy(), found.values
        c, mask = values.field(0).to_numpy(), values.field(1).to_numpy()
        for lo, hi in _chunks(texts):
            kept, removed, spans = list(texts[lo:hi]), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            some = [i for i in range(lo, hi) if offsets[i + 1] > offsets[i]]
            if some:
                own = Layout([texts[i] for i in some])
                own.anchors()
                a, b = offsets[lo], offsets[hi]
                of = np.repeat(np.arange(len(some)), [offsets[i + 1] - offsets[i] for i in some])
                k = own.found(of, c[a:b])
                hit = np.nonzero(k >= 0)[0]
                bits = mask[a:b][k[hit]]
                edge = np.zeros(len(own.data) + 1, dtype=np.int32)
                for x in range(REACH + 1):
                    at = hit[(bits >> x & 1).astype(bool) & (own.left[hit] >= x) & (own.right[hit] >= WINDOW - x)]
                    np.add.at(edge, own.place[at] - x, 1)
                    np.add.at(edge, own.place[at] - x + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                for j, i in enumerate(some):
                    g = gone[own.start[j] : own.start[j] + own.size[j]]
                    if g.any():
                        removed[i - lo] = g.sum()
                        spans[i - lo] = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                        kept[i - lo] = own.data[own.start[j] : own.start[j] + own.size[j]][~g].tobytes()
            ids = [None if d == NO_ID else d for d in doc[lo:hi]]
            yield _rows("doc_id n_bytes n_removed n_spans kept", pa.array(ids, pa.int64()), np.array([len(t) for t in texts[lo:hi]]), removed, spans, pa.array(kept, pa.binary()))


def _split_masks(contexts: DataFrame) -> DataFrame:
    """(doc, c, mask) as _windows gives it, by aggregates, so that no task holds an anchor or a window."""
    each = common.written(contexts.mapInArrow(_each_window, "w long, v long, doc long, c long, bit long"), "each")
    least = each.groupBy("w", "v").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w", "v", "least")
    return each.join(least, ["w", "v"]).where("doc > least").groupBy("doc", "c").agg(F.bit_or("bit").alias("mask"))


def remove_repeats(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document without the bytes under a window that a smaller doc_id also has.

    A null text is empty; texts shorter than the window stay whole. A row without doc_id comes after all
    others, and rows that repeat a doc_id aren't smaller than each other. An empty table gives no rows; columns other
    than doc_id and text are left out. The identifier 2**63 - 1 stands for none inside and is refused.
    """
    spark = docs.sparkSession
    if not docs.where(F.col("doc_id") == F.lit(NO_ID)).isEmpty():
        raise ValueError(f"doc_id {NO_ID} isn't supported")
    keyed = _keyed(docs)
    packed = keyed.mapInArrow(_packed, "doc long, text binary")
    anchors = keyed.mapInArrow(_anchor_rows, "h long, c long, doc long")
    classes = anchors.repartition("h").sortWithinPartitions("h", "c", "doc").mapInArrow(partial(_classes, large=large), "doc long, c long, h long, ask int")
    classes = common.written(classes, "classes")
    common.release(spark)
    asked = classes.where("ask = 1").groupBy("doc").agg(F.collect_set("c").alias("asked"))
    contexts = packed.join(asked, "doc").mapInArrow(_contexts, "h long, c long, doc long, l long, r long, bytes binary")
    split = classes.where("ask = 2").select("h").distinct()
    n_split, masks = split.count(), []
    if n_split:
        contexts = common.written(contexts, "contexts")
        split = F.broadcast(split) if n_split <= MAX_BROADCAST else split
        masks = [_split_masks(contexts.join(split, "h", "left_semi"))]
        contexts = contexts.join(split, "h", "left_anti")
    masks += [contexts.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(_windows, "doc long, c long, mask long")]
    masks = common.written(reduce(DataFrame.union, masks), "masks")
    common.release(spark)
    answers = classes.where("ask = 0").select("doc", "c", F.lit(EVERY).cast("long").alias("mask")).union(masks)
    answers = answers.groupBy("doc").agg(F.collect_list(F.struct("c", "mask")).alias("found"))
    both = packed.join(answers, "doc", "left").select("doc", "text", F.coalesce("found", F.array().cast("array<struct<c:bigint,mask:bigint>>")).alias("found"))
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row per row of documents (see remove_repeats)."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
