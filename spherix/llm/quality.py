"""Quality rules by distribution divergence.

Each document is a histogram over character classes and one over its language's common words; both are
compared with the language's reference, learned from all documents, by Jensen-Shannon distance. Histograms
of too few characters or words aren't judged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherix.llm import common

#: Common words of a language's reference; the rest is one bin more.
COMMON_WORDS = 100
MIN_WORDS, MIN_CHARS, MIN_COMMON = 50, 200, 10
MIN_REFERENCE_WORDS = 10_000
#: Languages whose names may be sent to all executors.
MAX_LANGUAGES = 10_000
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.31, 0.55
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
#: Class of each byte: lower, upper, digit, white space, sentence marks, other ASCII signs, controls, other scripts.
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[:32] = _CLASS[127] = 6
_CLASS[33:127] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[np.frombuffer(b".,;:!?'\"()-", dtype=np.uint8)] = 4
_FOLD = [bytes(np.nonzero(_CLASS == k)[0].astype(np.uint8)) for k in range(8)]
_TRAIL = bytes(range(0x80, 0xC0))
_EDGE = b".,;:!?'\"()-"
_LINE = re.compile(rb"[^\n]+")


def char_classes(data: bytes) -> list[int]:
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    counts[0x80:0xC0] = 0  # a code point counts at its first byte
    return np.bincount(_CLASS, weights=counts, minlength=8).astype(np.int64).tolist()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2
    return float(np.sqrt(max(d, 0)))


def base_counts(data: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = data.split()  # bytes.split() knows the six ASCII white spaces, and no others
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _TRAIL)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else ()
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return words, chars, symbols, dup_lines, repeated


def references(docs: DataFrame) -> tuple[dict, dict]:
    """Per language: character-class counts and the most common words with their counts, over all documents.

    Word counts are summed on each task before the shuffle and ranked with a partial limit; to the driver
    come COMMON_WORDS rows and one row of classes a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}

        def drain():
            rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1))):
                own = data.lower().split()
                words.setdefault(lang, Counter()).update(w.strip(_EDGE) for w in own)
                chars[lang] = chars.get(lang, 0) + np.array([*char_classes(data), len(own)])
            if sum(map(len, words.values())) > 500_000:
                yield from drain()
        rows = [(lang, str(k).encode(), int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
        for lang, k, n in rows:
            words.setdefault(f"\0{lang}", Counter())[k] = n
        yield from drain()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    counts = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, word binary, n long").where("word <> X''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    # a language below MIN_REFERENCE_WORDS has no reference: nothing of it comes to the driver
    counts = common.written(counts, "words")
    big = counts.where(F.col("lang").startswith("\0") & (F.col("word") == F.lit(b"8")) & (F.col("n") >= MIN_REFERENCE_WORDS)).select(F.expr("substring(lang, 2)").alias("big"))
    # by shuffle, all words of a language would meet in one task; the names of languages are few unless lang is no language
    big = F.broadcast(big) if big.count() <= MAX_LANGUAGES else big
    own = F.when(F.col("lang").startswith("\0"), F.expr("substring(lang, 2)")).otherwise(F.col("lang"))
    rows = counts.join(big, own == F.col("big"), "left_semi").withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= COMMON_WORDS).collect()
    words: dict[str, dict[bytes, int]] = {}
    chars: dict[str, np.ndarray] = {}
    for r in rows:
        if r["lang"].startswith("\0"):
            chars.setdefault(r["lang"][1:], np.zeros(9, dtype=np.int64))[int(bytes(r["word"]))] = r["n"]
        else:
            words.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    return words, chars


def score(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept.

    A null text has no words, so it fails the base rule; a null language is a language of its own; a language
    with fewer than MIN_REFERENCE_WORDS words has no reference, and its histograms aren't judged. Columns of docs
    that bear one of these names are replaced. Repeated rows are each judged, as are rows without doc_id; without a
    column lang all texts are of the null language; an empty table gives no rows. Words of equal count rank by their bytes.
    """
    words, chars = references(docs)

    def reference(lang: str | None):
        own = lang is not None and lang in words and lang in chars and chars[lang][8] >= MIN_REFERENCE_WORDS
        c, w = (chars[lang], words[lang]) if own else (np.zeros(9, dtype=np.int64), {})
        place = {x: k for k, x in enumerate(w)}
        n = np.array([*w.values(), max(int(c[8]) - sum(w.values()), 0)], dtype=float)
        return c[:8].astype(float), place, n

    known = {lang: reference(lang) for lang in [None, *chars]}
    new = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "char_distance": pa.float64(), "word_distance": pa.float64(), "kept": pa.bool_()}
    names = [c for c in docs.columns if c not in new]
    at_text, at_lang = names.index("text"), names.index("lang") if "lang" in names else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, data in zip([None] * batch.num_rows if at_lang is None else batch.column(at_lang).cast(pa.string()).to_pylist(), common.text_bytes(batch.column(at_text))):
                own, n_chars, symbols, dup, repeated = base_counts(data)
                n = len(own)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                ref_chars, place, ref_words = known.get(lang or "", known[None])
                by_char = by_word = None
                if n_chars >= MIN_CHARS and ref_chars.sum():
                    by_char = distance(np.array(char_classes(data), dtype=float), ref_chars)
                if n >= MIN_WORDS and place and ref_words[:-1].sum():
                    found = np.zeros(len(ref_words))
                    for w, k in Counter(map(place.get, [w.strip(_EDGE) for w in data.lower().split()])).items():
                        found[-1 if w is None else w] += k
                    if ref_words[:-1].sum() / ref_words.sum() * n >= MIN_COMMON:
                        by_word = distance(found, ref_words)
                good = not failed and (by_char is None or by_char <= MAX_CHAR_DISTANCE) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
                rows.append((n, n_chars, symbols, dup, repeated, failed, by_char, by_word, good))
            columns = zip(*rows) if rows else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(list(x), k) for x, k in zip(columns, new.values()))], [*names, *new])

    kinds = {"int64": "long", "bool": "boolean", "double": "double"}
    rest = docs.select(*[x for c, x in zip(docs.columns, common.columns(docs)) if c not in new])
    schema = ", ".join([f"`{n.replace('`', '``')}` {t}" for n, t in rest.dtypes] + [f"{n} {kinds[str(t)]}" for n, t in new.items()])
    return rest.mapInArrow(judge, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, whatever these are called."""
    names = [c if c in ("text", "lang") else f"own_{k}" for k, c in enumerate(docs.columns)]
    own = docs.select(*[c.alias(n) for c, n in zip(common.columns(docs), names)])
    out = score(own).where("kept").select(*common.columns(own))
    return out.select(*[c.alias(n) for c, n in zip(common.columns(out), docs.columns)])


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and both distances, a row per row of documents (see score)."""
    out = score(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
