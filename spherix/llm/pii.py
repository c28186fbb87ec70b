"""Personal data: four patterns, and the terms that give them away, with DataFrame functions only.

Base spans are found by regular expressions that run in linear time and without recursion: separators inside
a number or a domain are first replaced, character for character, by a mark, which leaves runs of a single
character class to match. Each value found is a protected entity. All terms of the documents that hold an entity are held
against the whole corpus: from how many documents a term occurs in at all, and how many of them hold the
entity, follow the chance that it points to the entity, smoothed by the entity's share of all documents, and
the information that it gives away. Terms above both thresholds are spans of kind `term` wherever they stand in
a document with the entity, to be generalised like the entity itself; where enough documents hold both, so that it
is no coincidence, a term is one in every other document too, as there it points to the entity as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherix.llm import common

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\ue000", "\ue001"
LOCAL = rf"[A-Za-z0-9._%+\-{MARK}]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\-{MARK}]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{MARK}])[0-9{MARK}]{{13,37}}(?![0-9{MARK}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}]{3,}"
#: A term is disclosing if the chance of the entity in a document with the term is at least MIN_SHARE, and at least
#: MIN_BITS higher than in any document. To a term's documents SMOOTH more are added, which hold the entity as often as any.
SMOOTH, MIN_SHARE, MIN_BITS = 1.0, 0.5, 4.0
#: Documents that hold a term and its entity, from which on the term discloses without the entity.
MIN_BOTH = 3
#: Terms that may be sent to all executors.
MAX_BROADCAST = 100_000

SPAN = "array<struct<start:int,end:int,value:string>>"


def _empty() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value) in code points: gaps and matches of a text alternate, so their lengths add up to places."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    found = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), zero, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(_empty())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn test; a place beyond the string counts zero."""
    back, total = F.reverse(digits), F.lit(0)
    for k in range(19):
        d = F.coalesce(F.when(F.length(digits) > k, F.substring(back, k + 1, 1).cast("int")), F.lit(0))
        total = total + (d if k % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _filtered(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: valid(kind, x["value"]))


def _valued(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.concat(F.lit(f"{kind}:"), s["value"]).alias("value")))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text, email, ip, card, phone): the four kinds' spans (start, end, value), in order."""
    texts = common.text_rows(docs)
    safe = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, OTHER)).otherwise(F.col("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("own"), "text", safe.alias("safe"))
    dotted = F.when(F.contains("safe", F.lit("@")), F.regexp_replace("safe", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)).otherwise(F.lit(""))
    joined = F.regexp_replace("safe", "(?<=[0-9])[ -](?=[0-9])", MARK)
    texts = texts.withColumns({"dotted": dotted, "joined": joined})
    source = {"email": "dotted", "ip": "safe", "card": "joined", "phone": "safe"}
    found = {k: _filtered(k, matches(F.col(source[k]), PATTERNS[k])) for k in KINDS}
    return texts.select("doc_id", "own", "text", *[c.alias(k) for k, c in found.items()])


def _all_base() -> Column:
    return F.concat(*[_valued(k) for k in KINDS])


def _terms(text: str) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _placed(contexts: DataFrame) -> DataFrame:
    """(row, term, start, end): every term of every text, in code points."""
    pairs = F.zip_with(F.split("text", TERM, -1), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    each = contexts.select("row", F.posexplode(pairs).alias("k", "p")).select("row", "k", "p.gap", "p.hit").where("hit IS NOT NULL")
    end = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("row").orderBy("k")).cast("int")
    return each.select("row", F.lower("hit").alias("term"), (end - F.length("hit")).alias("start"), end.alias("end"))


def disclosing(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(entity, term, n_both, n_term, n_entity, share, bits): the terms that reveal an entity, by counts over all documents.

    contexts has (row, text, entities) of each document with an entity.
    """
    n_docs = float(max(docs.count(), 1))
    has = contexts.select("row", F.explode(_terms("text")).alias("term"))
    holds = contexts.select("row", F.explode("entities").alias("entity"))
    beside = has.groupBy("term").agg(F.count("*").alias("n_beside"))
    counts = common.text_rows(docs).select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # no entity is in more of a term's documents than any entity is, which rules out all common words
    likely = F.col("n_beside") + SMOOTH >= MIN_SHARE * (F.col("n_term") + SMOOTH)
    maybe = common.written(beside.join(counts, "term").where(likely).select("term", "n_term"), "terms")
    both = has.join(maybe, "term").join(holds, "row").groupBy("entity", "term", "n_term").agg(F.count("*").alias("n_both"))
    out = both.join(holds.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity")
    prior = F.col("n_entity") / F.lit(n_docs)
    out = out.withColumn("share", (F.col("n_both") + SMOOTH * prior) / (F.col("n_term") + SMOOTH))
    return out.withColumn("bits", F.log2(F.col("share") / prior)).where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS))


def _elsewhere(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(e_id, e_own, elsewhere): the places of terms (term) in every document that has one, by doc_id and hash of the text."""
    terms = F.broadcast(terms) if terms.count() <= MAX_BROADCAST else terms
    texts = common.text_rows(docs).select("doc_id", F.xxhash64("text").alias("own"), "text")
    hits = texts.select("doc_id", "own", F.explode(_terms("text")).alias("term")).join(terms, "term", "left_semi").select(F.col("doc_id").alias("h_id"), F.col("own").alias("h_own")).distinct()
    held = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("own") == F.col("h_own")), "left_semi")
    held = held.groupBy("doc_id", "own").agg(F.any_value("text").alias("text"))  # rows that repeat have the same places
    held = common.written(held.withColumn("row", F.monotonically_increasing_id()), "elsewhere")
    placed = _placed(held.select("row", "text")).join(terms, "term", "left_semi")
    found = placed.groupBy("row").agg(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("elsewhere"))
    return held.select("row", F.col("doc_id").alias("e_id"), F.col("own").alias("e_own")).join(found, "row").drop("row")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_email, n_ip, n_card, n_phone, base, spans), a row per row of docs.

    base and spans are arrays of (kind, start, end): base holds the four patterns' spans by kind and start,
    spans those and the disclosing terms' outside of them. A null text has none; rows without doc_id and rows that
    repeat are documents of their own; an empty table gives no rows. own is a hash of the text.
    """
    found = base_spans(docs)
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"], s["end"]))
    some = F.size(F.concat(*KINDS)) > 0
    entities = F.array_distinct(F.transform(_all_base(), lambda s: s["value"]))
    found = found.select("doc_id", "own", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*[named(k) for k in KINDS]).alias("base"), F.when(some, F.col("text")).alias("text"), F.when(some, entities).alias("entities"))
    found = common.written(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    contexts = common.written(found.where("text IS NOT NULL").select("row", "text", "entities"), "contexts")
    told = common.written(disclosing(docs, contexts).select("entity", "term", "n_both", "n_term"), "disclosing")
    holds = contexts.select("row", F.explode("entities").alias("entity"))
    marked = contexts.select("row", F.explode(_terms("text")).alias("term")).join(told, "term").join(holds, ["row", "entity"], "left_semi").select("row", "term").distinct()
    placed = _placed(contexts).join(marked, ["row", "term"], "left_semi")
    terms = placed.groupBy("row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("terms"))
    both = found.drop("text", "entities").join(common.written(terms, "terms"), "row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    wide = told.where((F.col("n_both") >= MIN_BOTH) & (F.col("n_term") > F.col("n_both"))).select("term").distinct()
    if wide.isEmpty():
        both = both.withColumn("elsewhere", none)
    else:
        more = common.written(_elsewhere(docs, wide), "more")
        both = both.join(more, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("own") == F.col("e_own")), "left")
    every = F.array_sort(F.array_union(F.coalesce("terms", none), F.coalesce("elsewhere", none)))
    free = F.filter(every, lambda t: ~F.exists("base", lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"])))
    alone = F.col("terms").isNull() & (F.size(F.coalesce("elsewhere", none)) == 0)
    return both.select("doc_id", "own", *[f"n_{k}" for k in KINDS], "base", F.when(alone, F.col("base")).otherwise(F.concat("base", free)).alias("spans"))


def joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind, as [EMAIL]; spans that overlap become one. n_chars follows.

    Null texts stay null; rows without doc_id and rows that repeat are kept; columns are those of docs.
    """
    own, f_id, f_own, f_spans, f_text = common.unused(docs, "hash", "f_id", "f_hash", "f_spans", "f_text")
    found = spans(docs).where(F.size("spans") > 0).groupBy("doc_id", "own").agg(F.any_value("spans").alias("spans"))
    found = found.select(F.col("doc_id").alias(f_id), F.col("own").alias(f_own), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias(f_spans))
    keyed = docs.select(*common.columns(docs), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(own))
    both = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(f_id)) & (F.col(own) == F.col(f_own)), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    clean = F.aggregate(f_spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    both = both.withColumn(f_text, F.when(F.col(f_spans).isNull(), F.col("text")).otherwise(clean))
    new = {"text": F.col(f_text)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col(f_spans).isNull(), F.col("n_chars")).otherwise(F.length(f_text).cast(kind))
    return both.select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, common.columns(docs))])


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, a row per row of documents (see spans)."""
    out = spans(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
