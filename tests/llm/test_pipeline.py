"""corpus_pipeline against a version in plain Python, stage by stage, and its odd cases."""

import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from spherix.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, own string, `a.b` string, row int, n_words string"
BENCH = "the quick planted passage of a benchmark that no clean document ever repeats by chance at all"


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "ke") for b in ("ran", "dol", "vit") for c in ("a", "os", "um", "ing")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(60, 160))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (7, rows[7][1]), (102, rows[5][1] + " "), (103, f"{text(70)} {BENCH} {text(30)}")]
    rows += [(104, f"{text(60)} write to a.person@mail.example or +49 30 1234 5678 now {text(20)}"), (105, "short text"), (106, None), (107, ""), (108, "again and again " * 60)]
    rows += [(None, text(80)), (None, rows[9][1]), (109, text(90)), (109, text(90)), (110, text(4000))]
    rows += [(None, (lone := text(75))), (None, lone)]
    return rows


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fails(t):
    w = words_of(t)
    often = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def fingerprint(t):
    w = words_of(low(t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(fp)))
    for _ in fp:
        root = [min(root[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(fp))]
    return root


def sanitised(rows):
    """Texts with entities and the terms that tell them replaced, as the operator's docstrings define it."""
    mail, phone = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
    term = re.compile(r"[^\W_]{3,}")
    base = [[("email", *m.span(), m.group()) for m in mail.finditer(t or "")] + [("phone", *m.span(), m.group()) for m in phone.finditer(t or "") if 9 <= len(re.sub(r"\D", "", m.group())) <= 15] for _, t in rows]
    has = [{x.lower() for x in term.findall(t or "")} for _, t in rows]
    n_term = Counter(x for h in has for x in h)
    holds = [{(k, v) for k, _, _, v in b} for b in base]
    n_entity = Counter(e for h in holds for e in h)
    n_both = Counter((e, x) for h, own in zip(has, holds) for e in own for x in h)

    def tells(e, x):
        prior = n_entity[e] / len(rows)
        share = (n_both[e, x] + prior) / (n_term[x] + 1)
        return share >= 0.5 and share / prior >= 16

    out = []
    for (i, t), b, own in zip(rows, base, holds):
        spans = [(s, e, k) for k, s, e, _ in b]
        spans += [(m.start(), m.end(), "term") for m in term.finditer(t or "") if any(tells(x, m.group().lower()) for x in own) and not any(m.start() < e and s < m.end() for _, s, e, _ in b)]
        for s, e, k in sorted(spans, reverse=True):
            t = f"{t[:s]}[{k.upper()}]{t[e:]}"
        out.append((i, t))
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y", 2, "z") for i, t in corpus()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (3, "")], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, sorted(corpus(), key=str)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        got = sorted([(r[0], r[1]) for r in docs.collect()], key=str) if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            rows = [x for x in rows if not fails(x[1])]
            assert got == rows
        elif name == "near_dedup":
            root = groups(rows)
            assert len(got) == len(set(root))
            for r in set(root):
                members = [x for x, own in zip(rows, root) if own == r]
                ids = [i for i, _ in members if i is not None]
                kept = [x for x in got if x in members]
                assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
            rows = got
        elif name == "decontamination":
            rows = [x for x in rows if BENCH not in (x[1] or "")]
            assert got == rows
        elif name == "pii":
            want = sorted(sanitised(rows), key=str)
            assert got == want and any("[EMAIL]" in t and "[PHONE]" in t for _, t in got)
            rows = want
        else:
            library = Tokenizer.from_file(tokens.default_path())
            want = []
            for i, t in rows:
                ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
                cut = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
                want += [(i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)]))]
            assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
            fill = Counter()
            for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == fill[r.sequence_id]
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
        seen.append(name)
    assert seen == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 30


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
