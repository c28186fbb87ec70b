"""Brown class-based bigram model with exchange clustering.

Word counts cover all training texts. The head, at most HEAD words, goes to every Python worker, and texts become
arrays of head words in a stored table, so that later passes read numbers. All head words are put in classes by
exchange, whose number grows with the head: the SEEDS most frequent words on the driver, by sweeps over their
bigram counts until none moves; all other words in distributed sweeps, each of a part of them: their counts of
the classes before and after, over all training texts, meet in a task, which moves each word from its class
(at first one of its frequency) to that which raises the likelihood of the class bigrams most, and the class
bigrams are counted anew. All rarer words follow in one distributed sweep, whatever their number: their places in the
texts, with the classes before and after, meet by word, and each word gets its class by exchange too. Only words
never seen in training have a class of their own; it is followed by what follows rarer words. A text's probability is
the product over its tokens of P(class | class before) * P(word | class).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherix.llm import common

#: Bounds of what goes to the driver and the workers: words of the head, bytes of one on average and at most, words that
#: the driver clusters. All other words are put in classes from a table.
HEAD, HEAD_BYTES, LONGEST, SEEDS = 200_000, 64, 4096, 1000
#: Sweeps on the driver, parts of the other words and so distributed sweeps, first classes by the power of two of a count.
SWEEPS, PARTS, BANDS = 8, 2, 40
SMOOTH = 0.1
FOLDS, HELD_OUT = 7, 2
KEPT_COUNTS = 500_000
#: Pairs that a task holds before it sums them up.
CONTEXTS = 4_000_000
END = b""  # the end of a text; no word is empty
#: Beside a rarer word: another one, or the same again.
RARE, SAME = -1, -2


def _folded(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == HELD_OUT).alias("held_out"))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all texts of train, with END once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def drain():
            words, n = list(counts), list(counts.values())
            counts.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for data in common.text_bytes(batch.column(0)):
                counts.update(data.lower().split())
            counts[END] += batch.num_rows
            if len(counts) > KEPT_COUNTS:
                yield from drain()
        yield from drain()

    return train.select("text").mapInArrow(count, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, free: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of symbols, of which the first `free` move among `classes` and each other one keeps its own.

    pairs[a, b] counts b after a. Each sweep moves every word to the class that raises the likelihood of the
    class bigrams most; it ends when no word moves.
    """
    symbols = len(pairs)
    classes = max(min(classes, free), 1)
    cls = np.concatenate([np.arange(free) % classes, classes + np.arange(symbols - free)]).astype(int)
    groups = classes + symbols - free
    one = np.zeros((symbols, groups))
    one[np.arange(symbols), cls] = 1
    after, before = pairs @ one, pairs.T @ one
    table = one.T @ after
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            a, self_ = cls[w], pairs[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= self_
            into[a] -= self_
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_
            rows, cols = table.sum(1)[:classes], table.sum(0)[:classes]
            here = table[:classes]
            gain = (f(here + out) - f(here)).sum(1)
            there = table[:, :classes]
            gain += (f(there + into[:, None]) - f(there)).sum(0)
            own, k = np.diag(table)[:classes], np.arange(classes)
            gain += f(own + out[k] + into[k] + self_) - f(own + out[k]) - f(own + into[k]) + f(own)
            total_out, total_in = out.sum() + self_, into.sum() + self_
            gain -= f(rows + total_out) - f(rows) + f(cols + total_in) - f(cols)
            b = int(np.argmax(gain))
            b = b if gain[b] > gain[a] + 1e-9 else a
            table[b] += out
            table[:, b] += into
            table[b, b] += self_
            if b != a:
                moved += 1
                cls[w] = b
                for m, side in ((after, pairs[:, w]), (before, pairs[w])):
                    m[:, a] -= side
                    m[:, b] += side
        if not moved:
            break
    return cls


class Head:
    """The head words, their symbols and counts; built on the driver, used on the workers."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], np.array([counts[i] for i in order], dtype=np.int64)
        self.free = min(SEEDS, len(words))
        self.classes = max(min(int(len(words) ** 0.5 / 6), 128), min(16, max(self.free, 1)))
        self.tail, self.end, self.start = self.free + BANDS, self.free + BANDS + 1, self.free + BANDS + 2
        self.symbols = self.free + BANDS + 3
        band = np.minimum(np.log2(np.maximum(self.counts, 1)).astype(int), BANDS - 1)
        self.symbol = np.concatenate([np.arange(self.free), self.free + band[self.free :], [self.tail, self.end, self.start]]).astype(np.int64)

    def places(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def _places_of(texts: list[bytes], place: dict[bytes, int], n: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """Of each text the places (32-bit) of a start, its words and an end, n being the tail's, and the tail words.

    Of a tail word above HEAD_BYTES stands a space and its SHA-256, so that a long word of many texts stays small.
    """
    get = place.get
    for t in texts:
        words = t.lower().split()
        own = [n + 2, *[get(x, n) for x in words], n + 1]
        yield np.array(own, dtype="<i4").tobytes(), [w if len(w) <= HEAD_BYTES else b" " + sha256(w).digest() for w, k in zip(words, own[1:]) if k == n] if n in own else []


def _parts(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def places(folded: DataFrame, held) -> DataFrame:
    """(row, doc_id, held_out, ids, tail): texts as places of head words, a stored table that all later passes read."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = held.value
        place, n = head.places(), len(head.words)
        for batch in batches:
            texts = common.text_bytes(batch.column(1))
            for lo, hi in _parts(texts):
                ids, tail = zip(*_places_of(texts[lo:hi], place, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(tail, pa.list_(pa.binary()))], ["doc_id", "held_out", "ids", "tail"])

    rows = folded.select("doc_id", "text", "held_out").mapInArrow(find, "doc_id long, held_out boolean, ids binary, tail array<binary>")
    return common.written(rows.withColumn("row", F.monotonically_increasing_id()), "places")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places of a column of ids in a row, and how long each text's stretch is."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<i4"), np.array([len(x) // 4 for x in raw], dtype=np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a and b, b after a in a text, a batch at a time; n is the tail's place."""
    for batch in batches:
        flat, _ = _flat(batch.column(0))
        stay = flat[:-1] != n + 1
        yield flat[:-1][stay], flat[1:][stay]


def count_pairs(train: DataFrame, held, symbol: np.ndarray, n_symbols: int) -> np.ndarray:
    """Bigram counts of symbols over all training texts (ids); at most n_symbols**2 rows reach the driver."""
    of = train.sparkSession.sparkContext.broadcast(symbol.astype(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, symbol = np.zeros(n_symbols**2, dtype=np.int64), of.value
        for a, b in _pairs(batches, len(symbol) - 3):
            total += np.bincount(symbol[a] * n_symbols + symbol[b], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = train.select("ids").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    of.unpersist()
    out = np.zeros(n_symbols**2)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n_symbols, n_symbols)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class in [0, classes) that each word should be in, given all others.

    The rows (word, slot, n) are sorted by word, numbered from 0: slot g counts class g after the word, groups + g class
    g before it, and 2 * groups the word after itself. table has the class bigrams.
    """
    groups = len(table)
    size = int(word[-1]) + 1
    rows, cols = table.sum(1)[:classes], table.sum(0)[:classes]
    sides = np.zeros((3, size, classes))
    near = (slot < 2 * groups) & (slot % groups < classes)
    sides[slot[near] // groups, word[near], slot[near] % groups] = n[near]
    out, into = sides[0], sides[1]
    own = np.bincount(word[slot == 2 * groups], weights=n[slot == 2 * groups], minlength=size)[:, None]
    all_out = np.bincount(word[slot < groups], weights=n[slot < groups], minlength=size)[:, None] + own
    before = (slot >= groups) & (slot < 2 * groups)
    all_in = np.bincount(word[before], weights=n[before], minlength=size)[:, None] + own
    gain = np.zeros((size, classes))
    both = np.concatenate([table[:classes].T, table[:, :classes]])  # by slot: what each class has there
    some = np.nonzero(slot < 2 * groups)[0]
    for lo in range(0, len(some), 1 << 16):
        k = some[lo : lo + (1 << 16)]
        part = _f(both[slot[k]] + n[k][:, None]) - _f(both[slot[k]])
        first = np.nonzero(np.concatenate([[True], word[k][1:] != word[k][:-1]]))[0]
        gain[word[k][first]] += np.add.reduceat(part, first, axis=0)
    diagonal = np.diag(table)[:classes][None]
    gain += _f(diagonal + out + into + own) - _f(diagonal + out) - _f(diagonal + into) + _f(diagonal)
    gain -= _f(rows + all_out) - _f(rows) + _f(cols + all_in) - _f(cols)
    return gain.argmax(axis=1)


def sweep(train: DataFrame, head: "Head", group: np.ndarray, table: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, classes): a sweep of the words of one part, all judged by the classes as they are.

    Counts are summed on each task before the shuffle; a word has at most two rows a class there.
    """
    groups, width = len(table), 2 * len(table) + 1
    held = train.sparkSession.sparkContext.broadcast((group.astype(np.int64), table, head.free, head.classes, len(head.words)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, _, free, _, n = held.value
        moved = np.zeros(n + 3, dtype=bool)
        moved[free:n] = np.arange(free, n) % PARTS == part
        kept: list[np.ndarray] = []
        size = 0

        def drain():
            key, count = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            for lo in range(0, len(key), 1 << 18):
                k = key[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(k // width), pa.array((k % width).astype(np.int32)), pa.array(count[lo : lo + (1 << 18)])], ["word", "slot", "n"])

        for a, b in _pairs(batches, n):
            same = a == b
            for w, other, shift in ((a, b, 0), (b, a, groups)):
                own = moved[w] & ~same
                kept.append(w[own] * width + (group[other[own]] + shift))
            kept.append(a[same & moved[a]].astype(np.int64) * width + 2 * groups)
            size += sum(map(len, kept[-3:]))
            if size > CONTEXTS:
                yield from drain()
                size = 0
        if size:
            yield from drain()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _, classes, _ = held.value
        rest = None
        for batch in [*batches, None]:
            rows = [] if batch is None else [batch.column(k).to_numpy() for k in range(3)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)] if rows else rest
            if not rows or not len(rows[0]):
                continue
            cut = len(rows[0]) if batch is None else int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[cut:] for x in rows]
            word, slot, n = (x[:cut] for x in rows)
            if cut:
                names, word = np.unique(word, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best_classes(word, slot, n.astype(float), table, classes))], ["word", "class"])

    counts = train.select("ids").mapInArrow(contexts, "word long, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    rows = counts.repartition("word").sortWithinPartitions("word", "slot").mapInArrow(judge, "word long, class long").toArrow()
    held.unpersist()
    common.release(train.sparkSession)
    return rows.column("word").to_numpy(), rows.column("class").to_numpy()


def cluster(train: DataFrame, head: "Head", held, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(group of each place, class bigrams). With parts 0 only the SEEDS are clustered."""
    pairs = count_pairs(train, held, head.symbol, head.symbols)
    cls = exchange(pairs, head.free, head.classes)
    groups = int(cls.max()) + 1
    one = np.zeros((head.symbols, groups))
    one[np.arange(head.symbols), cls] = 1
    group, table = cls[head.symbol], one.T @ pairs @ one
    for part in range(parts if head.free < len(head.words) else 0):
        words, classes = sweep(train, head, group, table, part)
        group[words] = classes
        table = count_pairs(train, held, group, groups)
    return group, table


def _rare_places(stored: DataFrame, held) -> DataFrame:
    """(row, pos, held_out, word, left, right): each place of a word outside the head; groups beside it, or RARE or SAME."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = held.value[0]
        n = len(group) - 3
        for batch in batches:
            flat, size = _flat(batch.column(2))
            at = np.nonzero(flat == n)[0]
            word = batch.column(3).flatten()
            row = np.repeat(batch.column(0).to_numpy(), size)[at]
            held_out = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), size)[at]
            again = np.zeros(len(at) + 1, dtype=bool)  # a place whose word is that of the place before
            if len(at) > 1:
                again[1:-1] = (np.diff(at) == 1) & pc.equal(word.slice(1), word.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)
            side = lambda k, same: np.where(same, SAME, np.where(flat[k] == n, RARE, group[flat[k]])).astype(np.int32)
            columns = [pa.array(row), pa.array(at.astype(np.int32)), pa.array(held_out), word, pa.array(side(at - 1, again[:-1])), pa.array(side(at + 1, again[1:]))]
            out = pa.RecordBatch.from_arrays(columns, ["row", "pos", "held_out", "word", "left", "right"])
            for lo in range(0, len(at), 1 << 16):
                yield out.slice(lo, 1 << 16)

    return stored.select("row", "held_out", "ids", "tail").mapInArrow(find, "row long, pos int, held_out boolean, word binary, left int, right int")


def _changes(word: pa.Array) -> np.ndarray:
    """Whether each word but the first differs from that before."""
    return pc.not_equal(word.slice(1), word.slice(0, max(len(word) - 1, 0))).to_numpy(zero_copy_only=False)


def _whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by word, cut anew so that none ends within a word."""
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    kept: list[pa.RecordBatch] = []  # one word's
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.nonzero(_changes(batch.column("word")))[0]
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield joined([*kept, batch.slice(0, cut)])
            kept = []
        elif kept and kept[-1].column("word")[-1] != batch.column("word")[0]:
            yield joined(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield joined(kept)


def rare_links(stored: DataFrame, head: "Head", group: np.ndarray, table: np.ndarray) -> DataFrame:
    """(row, pos, held_out, left, joined, class, right, n), a stored table: a row per place of a word outside the head.

    n counts the word in training texts; class is the best of its contexts there, judged by the class bigrams as they
    are, or the tail's group if there are none. left and right are the groups beside it; where another such word
    is beside it, joined is true and left that word's class, or right is negative, as the pair is the next place's left.
    """
    groups, width, classes = len(table), 2 * len(table) + 1, head.classes
    held = stored.sparkSession.sparkContext.broadcast((group.astype(np.int64), table))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, table = held.value
        tail = group[-3]
        for batch in _whole_words(batches):
            word = np.concatenate([[0], np.cumsum(_changes(batch.column("word")))]).astype(np.int64)
            trains = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            left, right = batch.column("left").to_numpy(), batch.column("right").to_numpy()
            n = np.bincount(word[trains], minlength=word[-1] + 1)
            after = np.where(right == SAME, 2 * groups, np.where(right == RARE, tail, right))
            before = groups + np.where(left == RARE, tail, left)
            other = trains & (left != SAME)  # a word after itself is counted once
            key, count = np.unique(np.concatenate([word[trains] * width + after[trains], word[other] * width + before[other]]), return_counts=True)
            own = np.full(len(n), tail)
            if len(key):
                known = np.nonzero(n)[0]
                own[known] = best_classes(np.searchsorted(known, key // width), key % width, count.astype(float), table, classes)
            columns = [*(batch.column(k) for k in ("row", "pos", "held_out", "left", "right")), pa.array(own[word].astype(np.int32)), pa.array(n[word])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "pos", "held_out", "left", "right", "class", "n"])

    met = _rare_places(stored, held).repartition("word").sortWithinPartitions("word")
    places = met.mapInArrow(assign, "row long, pos int, held_out boolean, left int, right int, class int, n long")
    joined = F.col("left") < 0
    left = F.when(joined, F.lag("class").over(Window.partitionBy("row").orderBy("pos"))).otherwise(F.col("left"))
    out = common.written(places.select("row", "pos", "held_out", left.alias("left"), joined.alias("joined"), "class", "right", "n"), "links")
    held.unpersist()
    common.release(stored.sparkSession)
    return out


def with_rare(table: np.ndarray, links: DataFrame, tail: int) -> np.ndarray:
    """Class bigrams in which the rarer words of training texts count as their classes, and not as the tail's group.

    The tail's group, now that of words never seen, keeps what follows rarer words, and nothing is followed by it.
    """
    groups = len(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups**2, dtype=np.int64)
        for batch in batches:
            left, own, right = (batch.column(k).to_numpy() for k in (0, 2, 3))
            joined, last = batch.column(1).to_numpy(zero_copy_only=False), right >= 0
            for pair in (left * groups + own, own[last] * groups + right[last], tail * groups + right[last], tail * groups + own[joined]):
                total += np.bincount(pair, minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    train = links.where("NOT held_out").select("left", "joined", "class", "right")
    rows = train.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = table.copy()
    out[tail], out[:, tail] = 0, 0
    out.reshape(-1)[rows.column("pair").to_numpy()] += rows.column("n").to_numpy()
    return out


def score(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row per row of docs.

    A null text is empty and so is one end token; a row without doc_id is a training text. Without training
    texts all tokens are unknown and equally likely.
    """
    spark = docs.sparkSession
    folded = _folded(docs)
    counts = common.written(count_words(folded.where("NOT held_out")), "counts")
    total, vocabulary, end_count = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    rows = counts.where(in_head(counts)).toArrow()
    head = Head(rows.column("word").to_pylist(), rows.column("n").to_numpy())
    common.dropped(counts)
    held = spark.sparkContext.broadcast(head)
    stored = places(folded, held)
    word_class, table = cluster(stored.where("NOT held_out"), head, held, parts)
    groups, unseen = len(table), int(word_class[len(head.words)])
    links = rare_links(stored, head, word_class, table)
    table = with_rare(table, links, unseen)
    step = np.log10((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * (groups - 1)))
    mass = np.log10(np.maximum(table.sum(0), 1))
    emit = np.concatenate([np.log10(head.counts) - mass[word_class[: len(head.words)]], [0.0, 0.0, 0.0]])
    seen = np.concatenate([np.log10(head.counts + 1.0), [0.0, np.log10(end_count + 1.0), 0.0]])
    inner = step.copy()  # steps from and to words outside the head are those of links
    inner[unseen], inner[:, unseen] = 0, 0
    model = spark.sparkContext.broadcast((word_class, inner, emit, seen, bool(end_count)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_class, inner, emit, seen, end_known = model.value
        n = len(word_class) - 3
        for batch in batches:
            flat, size = _flat(batch.column(3))
            if not len(size):
                continue
            g = word_class[flat]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            value = emit[flat]
            value[1:] += inner[g[:-1], g[1:]]
            value[first] = 0
            known = np.where(flat == n + 1, end_known, flat < n)
            known[first] = 0
            columns = [*(batch.column(k) for k in range(3)), pa.array(size - 1), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(seen[flat], first)), pa.array(np.add.reduceat(value, first))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "value"])

    part = stored.select("row", "doc_id", "held_out", "ids").mapInArrow(judge, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, value double")
    steps = spark.sparkContext.broadcast((step, mass))

    def judge_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, mass = steps.value
        for batch in batches:
            left, own, right, n = (batch.column(k).to_numpy() for k in range(1, 5))
            value = step[left, own] + np.where(right >= 0, step[own, right], 0.0) + np.where(n > 0, np.log10(np.maximum(n, 1)) - mass[own], 0.0)
            row, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            known = np.bincount(at, weights=n > 0, minlength=len(row)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(known), pa.array(np.bincount(at, weights=np.log10(n + 1.0), minlength=len(row))), pa.array(np.bincount(at, weights=value, minlength=len(row)))], ["row", "known", "base", "value"])

    rare = links.select("row", "left", "class", "right", "n").mapInArrow(judge_rare, "row long, known long, base double, value double")
    more = rare.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("value").alias("more_value"))
    both = part.join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1)))
    value = F.col("value") + F.coalesce("more_value", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"))


def in_head(counts: DataFrame) -> Column:
    """Whether a word is of the head: the most frequent ones, about HEAD at most, all of a like count or none.

    Counts are summed up by their powers of 1.05 first; to the driver come some hundred rows. Where this gives too
    few words to cluster, a part of the next ones by hash fills the head.
    """
    words = counts.where(F.octet_length("word").between(1, LONGEST))
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.05)))).alias("level")
    by_level = words.groupBy(level).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    least, size, room, more = 2**62, 0, HEAD * HEAD_BYTES, F.lit(False)
    for r in sorted(by_level, key=lambda r: -r["level"]):
        if size + r["k"] > HEAD or r["bytes"] > room:
            if size < SEEDS:
                share = min((HEAD - size) / r["k"], room / r["bytes"])
                more = (F.col("n") >= F.lit(r["least"])) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
            break
        least, size, room = r["least"], size + r["k"], room - r["bytes"]
    return F.octet_length("word").between(1, LONGEST) & ((F.col("n") >= F.lit(least)) | more)


def op9_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of score, a row per row of documents: null texts are one end token, rows without doc_id train,
    repeated rows count each time, an empty table gives no rows; words of equal count are in the order of their bytes.
    """
    return score(common.table(spark, sf_dir, "documents"))
