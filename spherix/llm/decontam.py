"""Benchmark decontamination by a stored positional index, with DataFrame functions only.

The benchmark's windows are the searches. One pass over the documents writes the postings (row, term, position)
of all terms that the searches have, in the order of the documents, and so without a shuffle. Counts of terms
come from that table. A search reads the postings of its rarest term; each, moved back by the term's place in
the window, is a candidate start. Candidates meet the list of the second-rarest term at the place that the
offsets give, and what is left meets the lists of all other terms: a match is in every one of them. Proximity
matches count postings of each term, repeats included, in the stretch around a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherix.llm import common

WINDOW = 10
#: Separators: everything but digits, a-z and what isn't ASCII, after A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Searches, terms or rows that may be sent to all executors, and their bytes; larger tables are joined by shuffle.
MAX_BROADCAST, MAX_BYTES = 200_000, 32 << 20
END = -1  # the term that ends each document; its position is the number of words


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(common.ascii_lower(text), SEPARATOR), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (gram, items): items sorted, without nulls. Shorter items give one window, items without words none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    grams = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _small(df: DataFrame, size: Column) -> bool:
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= MAX_BROADCAST and total <= MAX_BYTES


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The positional index as a stored table: (row, term, pos, doc_id, own).

    vocabulary (word, term) has the terms to index by number; without it the index has every word, as itself. row is a
    number for each row of docs, pos counts from 0. The last posting of a row has the term END (without vocabulary, the
    empty word), the number of words as pos, and alone doc_id and own, a hash of the text.
    """
    small = vocabulary is None or _small(vocabulary, F.octet_length("word"))
    texts = common.text_rows(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("own"), "text")
    if not small:  # the rows are read twice, so their numbers have to be kept
        texts = common.written(texts, "numbered")
    ended = F.concat(words_of(F.col("text")), F.array(F.lit(""))) if small else words_of(F.col("text"))
    each = texts.select("row", "doc_id", "own", ended.alias("words")).select("row", "doc_id", "own", F.posexplode("words").alias("pos", "word"))
    if vocabulary is None:
        held = each.withColumnRenamed("word", "term")
        end = F.col("term") == ""
    else:
        every = vocabulary.select("word", "term")
        if small:
            every = F.broadcast(every.union(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).alias("term"))))
        held = each.join(every, "word")
        end = F.col("term") == END
    out = held.select("row", "term", "pos", F.when(end, F.col("doc_id")).alias("doc_id"), F.when(end, F.col("own")).alias("own"))
    if not small:
        ends = texts.select("row", F.lit(END).alias("term"), F.size(words_of(F.col("text"))).alias("pos"), "doc_id", "own")
        out = out.unionByName(ends)
    return common.written(out, "postings")


class Index:
    """The postings of docs for the windows of a benchmark, and the windows as searches with their terms from the rarest on."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        grams = common.written(windows(benchmark, window).withColumn("g", F.monotonically_increasing_id()), "windows")
        words = grams.select(F.explode("gram").alias("word")).distinct()
        vocabulary = common.written(words.select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
        self.held = postings(docs, vocabulary)
        self.lists = self.held.where(F.col("term") != END).select("row", "term", "pos")
        self.ends = self.held.where(F.col("term") == END).select("row", "doc_id", "own", F.col("pos").cast("long").alias("n_words"))
        counts = self.lists.groupBy("term").agg(F.count("*").alias("n"))
        terms = common.written(vocabulary.join(counts, "term").select("word", "term", "n"), "terms")
        places = grams.select("g", F.posexplode("gram").alias("at", "word")).join(terms, "word", "left")
        rare = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("r")
        found = places.groupBy("g").agg(rare).where(F.col("r")[0]["n"] > 0)  # a term that never occurs ends a search
        self.searches = common.written(found.join(grams, "g").select("g", "r", "items", F.size("r").alias("n")), "searches")
        self.small = _small(self.searches, 40 * F.col("n") + 60)
        common.dropped(vocabulary, grams, terms)

    def candidates(self) -> DataFrame:
        """(row, g, start): the postings of each search's rarest term, moved back by its place."""
        first = self.searches.select("g", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["at"].alias("at"))
        return self.lists.join(_sent(first, self.small), "term").select("row", "g", (F.col("pos") - F.col("at")).alias("start"))

    def _asked(self, cand: DataFrame, rest: str) -> DataFrame:
        """(row, g, start, term, pos): where the terms `rest` of r have to stand for the candidates."""
        own = self.searches.select("g", F.explode(F.expr(rest)).alias("x")).select("g", "x.term", "x.at")
        return cand.join(_sent(own, self.small), "g").select("row", "g", "start", "term", (F.col("start") + F.col("at")).alias("pos"))

    def phrases(self) -> DataFrame:
        """(row, g, start): the exact matches."""
        cand = self.candidates().where("start >= 0")
        one = self.searches.where("n = 1").select("g")
        single = cand.join(_sent(one, self.small), "g", "left_semi").select("row", "g", "start")
        seconds = self.searches.where("n > 1").select(F.col("r")[1]["term"].alias("term")).distinct()
        lists = self.lists.join(_sent(seconds, self.small), "term", "left_semi").select("row", "term", "pos")
        two = common.written(self._asked(cand, "slice(r, 2, 1)").join(lists, ["row", "term", "pos"], "left_semi").select("row", "g", "start"), "candidates")
        rows = two.select("row").distinct()
        few = _small(rows, F.lit(16))
        lists = self.lists.join(F.broadcast(rows), "row", "left_semi") if few else self.lists
        met = self._asked(two, "slice(r, 3, 1000)").join(lists, ["row", "term", "pos"], "left_semi")
        met = met.groupBy("row", "g", "start").agg(F.count("*").alias("met"))
        all_ = met.join(_sent(self.searches.select("g", "n"), self.small), "g").where("met = n - 2").select("row", "g", "start")
        pairs = two.join(_sent(self.searches.where("n = 2").select("g"), self.small), "g", "left_semi").select("row", "g", "start")
        return single.unionByName(pairs).unionByName(all_)

    def near(self, slop: int) -> DataFrame:
        """(row, g, start): candidates with all terms of the window, each as often as there, from `slop` words before to `slop` words after its place, in any order."""
        need = self.searches.select("g", "n", F.explode("r").alias("x")).groupBy("g", "n", "x.term").agg(F.count("*").alias("need"))
        need = need.groupBy("g", "n").agg(F.collect_list(F.struct("term", "need")).alias("t"))
        wide = self.searches.agg(F.max("n")).first()[0] or 1
        width = wide + 2 * slop  # a stretch lies in at most two blocks of so many words
        cand = self.candidates().join(_sent(need, self.small), "g").select("row", "g", "start", (F.col("start") - slop).alias("lo"), (F.col("start") + F.col("n") + slop).alias("hi"), F.size("t").alias("terms"), F.explode("t").alias("x"))
        block = lambda c: F.floor(F.expr(c) / F.lit(width)).cast("long")
        cand = cand.select("*", F.explode(F.array_distinct(F.array(block("lo"), block("hi - 1")))).alias("block")).select("row", "g", "start", "lo", "hi", "terms", "x.term", "x.need", "block")
        lists = self.lists.withColumn("block", block("pos"))
        met = cand.join(lists, ["row", "term", "block"]).where("pos >= lo AND pos < hi")
        met = met.groupBy("row", "g", "start", "terms", "term", "need").agg(F.count("*").alias("met")).where("met >= need")
        return met.groupBy("row", "g", "start", "terms").agg(F.count("*").alias("met")).where("met = terms").select("row", "g", "start")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(row, doc_id, own, start, n, items): where windows of n words occur, items having them.

    Without slop the exact phrases. With it the proximity matches (see Index.near); start is the place that the window's
    rarest term gives it and may lie before the document. Empty tables, null texts and texts without words match nothing.
    """
    index = Index(docs, benchmark, window)
    met = index.phrases() if slop is None else index.near(slop)
    return met.join(_sent(index.searches.select("g", "n", "items"), index.small), "g").join(index.ends, "row").select("row", "doc_id", "own", "start", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, own, n_words, n_hit, n_items, items, contaminated), a row per row of docs; own is a hash of the text.

    A null text has no words. Items without item_id mark words as hit but aren't counted in n_items. Rows
    that repeat a document, or have no doc_id, are documents of their own. An empty benchmark hits nothing, and an
    empty table gives no rows; docs may have any further columns.
    """
    index = Index(docs, benchmark, window)
    met = index.phrases().join(_sent(index.searches.select("g", "n", "items"), index.small), "g")
    span = F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n")).cast("long").alias("e"))
    per = met.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("sets"))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("hit"))
    merge = lambda acc, x: F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["hit"] + F.greatest(x["e"] - F.greatest(acc["to"], x["s"]), F.lit(0))).alias("hit"))
    per = per.select("row", F.aggregate("spans", zero, merge, lambda acc: acc["hit"]).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    out = index.ends.join(per, "row", "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "own", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "own", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window.

    Null texts, rows without doc_id and rows that repeat stay unless they hold one; columns are those of docs.
    """
    own, bad_id, bad_own = common.unused(docs, "hash", "bad_id", "bad_hash")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("own").alias(bad_own)).distinct()
    keyed = docs.select(*common.columns(docs), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(own))
    kept = keyed.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_own)), "left_anti")
    return kept.select(*common.columns(docs))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row per row of documents (see contamination)."""
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
