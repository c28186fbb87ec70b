"""The operators against brute force, on small documents with all the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash

from spherix.llm import brown, decontam, licenses, packing, pii, quality, simhash, sstable, suffixes, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own string, length int, start string"


def make(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own names."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or ""), "x", 1, "y") for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def sample():
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(400)] + ["été", "Straße", "the", "of", "a|b", "1.2"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randrange(1, 200)) for _ in range(40)]
    passage = text(60)
    out = [*base, base[3], base[3], base[5] + " tail", f"{text(30)}\n{passage}\n{text(9)}", f"{text(7)} {passage}", None, "", " \n\t ", "ab", "x" * 3000, (text(8) + "\n") * 9, text(30000), "  two   spaces\n \nhere\xa0and\x0b", "a@b.cc +49 (30) 1234-5678 192.168.0.1 4111 1111 1111 1111 4111111111111112 300.1.1.1"]
    return out, passage


@pytest.fixture(scope="module")
def docs(spark):
    texts, passage = sample()
    return make(spark, texts).cache(), texts, passage


def words(t):
    return (t or "").encode().lower().split()


def test_packing(spark, docs):
    df, texts, _ = docs
    rows = packing.pack(df, with_ids=True).collect()
    library = tokens.encoder(tokens.default_path())
    ids = {i: np.frombuffer(x, "<u4").tolist() + [0] for i, x in enumerate(library._library([t or "" for t in texts]))}
    back, fill = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start == len(back.get(r.doc_id, []))
        assert r.piece == 0 or r.length == packing.CAPACITY
        back.setdefault(r.doc_id, []).extend(part)
        fill[r.sequence_id] += r.length
    assert back == ids
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(spans, spans[1:]):
        assert o2 == (o + n if s == s2 else 0)
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_shards(spark, docs, tmp_path):
    df, texts, _ = docs
    path = f"file://{tmp_path}/shards"
    sstable.write(df, path, tokens.default_path())
    rows, at = sorted(sstable.read(spark, path).collect()), 0
    want = tokens.encoder(tokens.default_path())._library([t or "" for t in texts])
    assert len(rows) == len(texts)
    for r, ids in zip(rows, want):
        assert (r.start, r.n_tokens) == (at, len(ids) // 4 + 1) and bytes(r.ids) == ids + bytes(4)
        at += r.n_tokens
    found = {r.doc_id: bytes(r.ids) for r in sstable.lookup(spark, path, [3, 17, 10**9, -1]).collect()}
    assert found == {k: want[k] + bytes(4) for k in (3, 17)}


def test_shards_without_ids_and_repeated(spark, tmp_path):
    path, ids = f"file://{tmp_path}/shards", [5, None, 2, 5, None, 2**63 - 1, -(2**63), None]
    sstable.write(make(spark, ["a b", "no id", None, "c", "no id", "x", "y", ""], ids), path, tokens.default_path(), shard_bytes=1)
    rows = sorted(sstable.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [-(2**63), 2, 5, 5, 2**63 - 1, None, None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0


def test_lookup_reads_one_block(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 2000)
    out = sstable.ShardWriter(2)
    data = b"".join(x + b"\n" for k in range(5000) for x in out.add(sstable.key_of(3 * k), np.arange(k % 90, dtype=np.uint32)))
    data += b"".join(x + b"\n" for x in out.close())
    asked: list[tuple[int, int]] = []

    def get(at, n):
        asked.append((at, n))
        return data[at : at + n]

    shard = sstable.Shard(len(data), get)
    assert len(shard.index()) > 100 and shard.entries == 5000
    for key, there in ((3 * 777, True), (3 * 777 + 1, False), (-1, False), (0, True), (3 * 4999, True), (3 * 5000, False)):
        asked.clear()
        found = shard.lookup(key)
        assert (found is not None) == there and (not there or found.tolist() == list(range(key // 3 % 90)))
        assert sum(n < 4000 for _, n in asked if (_, n) not in (shard.index_at, shard.bloom_at)) <= 1 and len(asked) <= 3
    assert sum(len(v) for _, v in shard) == shard.tokens
    with pytest.raises(ValueError):
        sstable.Shard(len(data) - 1, lambda at, n: data[:-1][at : at + n])


def test_words_that_a_hash_could_take_for_each_other(spark):
    """Thue-Morse words of 1024 and 2048 letters have equal polynomial hashes modulo 2**64 for any odd base."""
    t = [k.bit_count() % 2 for k in range(2048)]
    one = ["".join("ab"[x] for x in t[:n]) for n in (8, 1024, 2048)]
    two = ["".join("ba"[x] for x in t[:n]) for n in (8, 1024, 2048)]
    texts = [f"q {x} q" for x in [*one, *two]] * 2
    e = tokens.Encoder(tokens.default_path())
    assert e.encode(texts) == e._library(texts)


def test_encoder_of_long_texts_and_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 300)
    rng, e = random.Random(9), tokens.Encoder(tokens.default_path())
    e.known.words = e.known.words[:300]
    parts = ["alpha", "be ta", "x  y", "q   r", "\n", "z.", "two\nlines", "中文", "<|endoftext|>", "a,b;c"]
    texts = [" ".join(rng.choice(parts) + str(rng.randrange(999)) for _ in range(120_000)), "a" * 300_000, " " * 100_000, " ".join(f"w{k}." for k in range(900))]
    assert len(texts[0]) > tokens.CHUNK
    for _ in range(2):
        assert e.encode(texts) == e._library(texts)


@pytest.mark.parametrize("most", [decontam.MAX_BROADCAST, 0])
def test_decontamination(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", most)
    df, texts, passage = docs
    bench = spark.createDataFrame([(1, passage[20:]), (2, passage), (3, "ab"), (4, None), (5, "never seen words at all in this")], "item_id long, text string")
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: cut.findall((t or "").translate(low))
    grams = {}
    for r in bench.collect():
        w = find(r.text)
        for s in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[s : s + 10]), set()).add(str(r.item_id))
    got = {(r.doc_id): r for r in decontam.contamination(df, bench).collect()}
    for i, t in enumerate(texts):
        w, hit, items = find(t), set(), set()
        for g, who in grams.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    items |= who
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items) == (len(w), len(hit), len(items), sorted(items))
    assert decontam.decontaminate(df, bench).columns == df.columns
    # proximity: every term as often as in the window, within 2 words around the place that the rarest gives
    counts = Counter(x for t in texts for x in find(t))
    want = set()
    for g in grams:
        at = min(range(len(g)), key=lambda k: (counts[g[k]], k))
        need = Counter(g)
        for i, t in enumerate(texts):
            w = find(t)
            for p in range(len(w)):
                if w[p] == g[at] and not need - Counter(w[max(p - at - 2, 0) : p - at + len(g) + 2]):
                    want.add((i, p - at, g))
    near = decontam.find(df, bench, slop=2).collect()
    assert len(near) == len(want) and {(r.doc_id, r.start, r.n) for r in near} == {(i, s, len(g)) for i, s, g in want}


@pytest.mark.parametrize("large", [suffixes.LARGE, 2])
def test_suffixes(spark, docs, large):
    _, texts, passage = docs
    texts = [*texts, *[f"{k} {passage[k:150]} {k * k}" for k in range(12)], *[f"{passage[:200]}{k}" for k in range(8)]]
    first, got = {}, {r.doc_id: r for r in suffixes.remove_repeats(make(spark, texts), large).collect()}
    for i, t in enumerate(texts):
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                gone |= set(range(s, s + 50))
        assert bytes(got[i].kept) == bytes(x for k, x in enumerate(b) if k not in gone)
        assert (got[i].n_removed, got[i].n_spans) == (len(gone), sum(k - 1 not in gone for k in gone))


def test_classes_of_large_anchors_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = np.array(sorted({(int(h), int(c), int(d)) for h, c, d in zip(rng.integers(0, 12, 900), rng.integers(0, 60, 900), rng.integers(0, 9, 900))}))
    classes = Counter(h for h, _ in {(h, c) for h, c, _ in rows.tolist()})
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + step, j].copy()) for j in range(3)], ["h", "c", "doc"]) for k in range(0, len(rows), step)]
        out = [r for b in suffixes._classes(iter(batches), 35) for r in b.to_pylist()]
        assert Counter(r["h"] for r in out if r["ask"] == 2) == Counter(h for h, n in classes.items() if n > 35)


def test_licenses(spark, docs):
    lines = [x for _, x in licenses.TEMPLATES]
    texts = [f"some words before\n{x}\nand after it" for x in lines] + [None, "", "mit license"]
    got = {r.doc_id: {x.license for x in r.licenses} for r in licenses.scan(make(spark, texts)).collect()}
    assert all(name in got[i] for i, (name, _) in enumerate(licenses.TEMPLATES))
    assert all(not got[i] for i in range(len(lines), len(texts)))


def test_simhash(spark, docs):
    df, texts, _ = docs
    fp = []
    for t in texts:
        w = words(t)
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in grams]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(fp)))
    for _ in fp:
        for i, a in enumerate(fp):
            root[i] = min([root[j] for j, b in enumerate(fp) if (a ^ b).bit_count() <= 3])
    got = {r.doc_id: (r.fp & 2**64 - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f, r) for i, (f, r) in enumerate(zip(fp, root))}
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == sorted(set(root))


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 4)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all(((a ^ b) & 2**64 - 1).bit_count() <= 3 for a, b in links)

    def groups(pairs):
        root = {f: f for f in signed}
        for _ in range(20):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & 2**64 - 1).bit_count() <= 3]
    assert groups(links) == groups(every)


def test_quality(spark, docs):
    df, texts, _ = docs
    for r in quality.score(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_brown(spark, docs):
    df, texts, _ = docs
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = brown.score(df).collect()
    for r in rows:
        w = [*words(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score <= 0
    assert len(rows) == len(texts)


def test_pii(spark, docs):
    df, texts, _ = docs
    more = ["call +1 234 567 8901 or mail a.b@c.d.e@f.gg, id 1.2.3.4.5.6.7.8", "4" * 40, "a" * 500 + "@" + "b." * 3000 + "c", " x@y.z"]
    frame, all_ = make(spark, texts + more), texts + more
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = lambda: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(), "phone": 9 <= len(d) <= 15}[kind]

    for r in pii.spans(frame).collect():
        t = all_[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, p in rules.items() for m in re.finditer(p, t) if good(k, m.group())]
        assert [tuple(x) for x in r.base] == want
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "[EMAIL]" in clean[len(texts) - 1] and "a@b.cc" not in clean[len(texts) - 1]


def test_disclosing_terms(spark):
    told = pii.spans(make(spark, [f"write to Quorvath at boss@corp.io today number {i}" for i in range(4)] + ["today is a day"] * 100))
    marked = {tuple(x)[1:] for r in told.collect() for x in r.spans if x.kind == "term"}
    assert (9, 17) in marked


def test_disclosing_terms_against_brute_force(spark):
    """Entities of one document, terms far from them, and each place of a term."""
    rng = random.Random(8)
    common = [f"word{k}" for k in range(30)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [filler(rng.randrange(1, 60)) for _ in range(150)]
    texts[3] = f"Zyx \U0001f600 {filler(80)} mail a.b@zyx.io {filler(80)} ZYX, zyx"
    texts[5] = f"Éclair {filler(40)} 10.1.2.3 and bob@x.org {filler(40)} twice"
    texts[9] = f"10.1.2.3 {filler(20)} éclair twice"
    texts[11] = "twice once"
    texts += [f"{filler(9)} 1.1.1.1"] * 12
    entities = {3: {"email:a.b@zyx.io"}, 5: {"ip:10.1.2.3", "email:bob@x.org"}, 9: {"ip:10.1.2.3"}} | {i: {"ip:1.1.1.1"} for i in range(150, 162)}
    term = re.compile(r"[^\W_]{3,}")
    has = [{x.lower() for x in term.findall(t)} for t in texts]
    n_term, n_entity = Counter(x for h in has for x in h), Counter(e for s in entities.values() for e in s)
    n_both = Counter((e, x) for i, s in entities.items() for e in s for x in has[i])

    def discloses(e, x):
        prior = n_entity[e] / len(texts)
        share = (n_both[e, x] + prior) / (n_term[x] + 1)
        return share >= 0.5 and share / prior >= 2**4

    marked = 0
    for r in pii.spans(make(spark, texts)).collect():
        t, base = texts[r.doc_id], [tuple(x)[1:] for x in r.base]
        want = [m.span() for m in term.finditer(t) if any(discloses(e, m.group().lower()) for e in entities.get(r.doc_id, ()))]
        want = [(a, b) for a, b in want if not any(a < y and x < b for x, y in base)]
        assert [tuple(x)[1:] for x in r.spans if x.kind == "term"] == want
        marked += len(want)
    assert marked >= 5


def test_warc(spark, tmp_path):
    html = ["<p>é</p>" * 30, "<p>é</p>" * 30, None, "", "short", "short", "z\r\n\r\nWARC/1.1 " * 20]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", h) for i, h in enumerate(html)] + [(None, None, html[0])], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.archive(pages, path)
    rows = {r.record_id: r for r in warc.read(spark, path).where("record_type <> 'warcinfo'").collect()}
    assert len(rows) == len(html) + 1
    for i, h in enumerate(html):
        r = rows[f"urn:page:{i}"]
        assert r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and r.payload_bytes == len((h or "").encode())
        assert (r.record_type, r.refers_to) == (("revisit", "urn:page:0") if i == 1 else ("response", None))
        assert r.record_type == "revisit" or bytes(r.payload) == (h or "").encode()
    only = warc.read(spark, path).where("record_type = 'revisit'")
    assert only.count() == 2 and sum(r.record_id == "urn:page:1" for r in only.collect()) == 1
    none = pages.where("false")
    warc.archive(none, f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_files_of_others(spark, tmp_path):
    """A folder without manifest, plain and gzip files, HTTP or not, split places, predicates that step over blocks."""
    import gzip
    import io

    def record(kind, n, block, content="application/http; msgtype=response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Target-URI: http://h{n % 3}/\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    inner = record("response", 99, b"HTTP/1.1 200 OK\r\n\r\nnested")
    blocks = [b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\npayload", b"HTTP/1.1 200 OK\r\n\r\n" + inner * 3, b"plain text", b""]
    records = [record("warcinfo", 0, b"a: b", "application/warc-fields"), record("response", 1, blocks[0]), record("response", 2, blocks[1]), record("conversion", 3, blocks[2], "text/plain"), record("request", 4, blocks[3])]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "deep" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "notes.txt").write_text("no archive")
    rows = warc.read(spark, f"file://{tmp_path}/in").collect()
    want = {("response", "urn:x:1", b"payload"), ("response", "urn:x:2", inner * 3), ("conversion", "urn:x:3", b"plain text"), ("request", "urn:x:4", b""), ("warcinfo", "urn:x:0", b"a: b")}
    assert len(rows) == 10 and {(r.record_type, r.record_id, bytes(r.payload)) for r in rows} == want
    assert [r.record_id for r in warc.read(spark, f"file://{tmp_path}/in/a.warc").where("target_uri LIKE 'http://h2%'").collect()] == ["urn:x:2"]
    assert all(r.payload is None for r in warc.read(spark, f"file://{tmp_path}/in", payload=False).collect())

    class Counted(io.BytesIO):
        read_ = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_ += len(out)
            return out

    stream = Counted(b"".join(records))
    assert len(list(warc.parse(stream, lambda h: h["warc-type"] == "conversion"))) == 1 and stream.read_ == len(blocks[2])
    pages = spark.createDataFrame([(i, None, f"<p>{i}</p>" * 40) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    for name, options in (("cut", {"split_bytes": "900"}), ("zip", {"compression": "gzip"})):
        warc.archive(pages, path := f"file://{tmp_path}/{name}", **options)
        got = warc.read(spark, path).where("record_type = 'response'")
        assert sorted(r.record_id for r in got.collect()) == sorted(f"urn:page:{i}" for i in range(60))
        assert got.rdd.getNumPartitions() > 10 or name == "zip"


def test_empty_tables(spark, tmp_path):
    none = make(spark, [None]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (packing.pack(none), decontam.contamination(none, bench), suffixes.remove_repeats(none), licenses.scan(none), simhash.near_duplicates(none), quality.score(none), brown.score(none), pii.spans(none)):
        assert out.count() == 0
    sstable.write(none, f"file://{tmp_path}/s", tokens.default_path())
    assert sstable.read(spark, f"file://{tmp_path}/s").count() == 0


def test_rows_without_id_and_repeated(spark):
    df = make(spark, ["one two three", "one two three", "one two three", "four"], [7, 7, None, None])
    assert packing.pack(df).count() == 4 and quality.score(df).count() == 4 and brown.score(df).count() == 4 and licenses.scan(df).count() == 4 and suffixes.remove_repeats(df).count() == 4
    assert simhash.near_duplicates(df).count() == 3 and simhash.deduplicate(df).count() == 2 and pii.spans(df).count() == 4
    assert decontam.contamination(df, spark.createDataFrame([(1, "two three")], "item_id long, text string")).where("contaminated").count() == 3


def test_encoder_fuzz():
    rng, e = random.Random(3), tokens.encoder(tokens.default_path())
    parts = [" ", "  ", "\n", "\t", " \n", "a", "Be", "1", ".", "!!", "'s", "é", "中", "\xa0", "<|endoftext|>", "\x00", "😀", "　", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    assert e.encode(texts) == e._library(texts)


def test_added_tokens(spark, tmp_path):
    """Ids by a tokenizer of its own, as the contract has it."""
    from tokenizers import Tokenizer

    rng, fresh = random.Random(4), Tokenizer.from_file(tokens.default_path())
    ids = lambda t: fresh.encode(t, add_special_tokens=False).ids
    parts = [" ", "\n", "a", "Be", "1", "é", "<|endoftext|>", "<|endof", "text|>", "\xa0"]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", *["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]]
    assert ids(texts[0]) == [87, 220, 50256, 331]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(tokens.default_path()).encode(texts)] == [ids(t) for t in texts]
    df = make(spark, texts[:40])
    packed = {}
    for r in sorted(packing.pack(df, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        packed.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    sstable.write(df, path := f"file://{tmp_path}/added", tokens.default_path())
    stored = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in sstable.read(spark, path).collect()}
    assert packed == stored == {i: [*ids(t), 0] for i, t in enumerate(texts[:40])}


def test_license_siblings_and_bodies(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bodies = [x for x in licenses.TEMPLATES if len(x[1].split()) > 60]
    want = ["GPL-2.0", "LGPL-3.0", "AGPL-3.0", "GPL-3.0", *[n for n, _ in bodies]]
    texts = [gnu.format("", 2), gnu.format("Lesser ", 3), gnu.format("Affero ", 3), gnu.format("", 3), *[x for _, x in bodies]]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC0-1.0", "BSL-1.0"} <= set(want)
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan(make(spark, [f"words before\n{x}\nand after" for x in texts])).collect()}
    assert got == {i: [n] for i, n in enumerate(want)}
    short = "Released under the MIT License. "
    found = licenses.scan(make(spark, [short * 3 + "Licensed under CC BY-NC 4.0."])).first().licenses
    assert [(x.license, x.start) for x in found] == [("MIT", 0), ("MIT", 5), ("MIT", 10), ("CC-BY-NC-4.0", 15)]


def test_small_language_is_not_judged(spark):
    rng = random.Random(6)
    text = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    latin, greek = [f"word{chr(97 + k)}" for k in range(26)], [chr(945 + k) * 5 + chr(946 + k) for k in range(15)]
    rows = [(i, text(latin, 300), "en") for i in range(60)] + [(100 + i, text(greek, 300), "el") for i in range(3)]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(not got[i].base_failed and got[i].char_distance is None and got[i].word_distance is None and got[i].kept for i in (100, 101, 102))
    assert all(got[i].char_distance is not None and got[i].kept for i in range(60))


def test_rows_that_repeat_are_returned_each(spark, tmp_path, monkeypatch):
    """The queries give a row per row: repeats, null ids, null texts."""
    monkeypatch.setattr(simhash, "AGAIN", 2)
    ids = [3, 3, 3, 3, 3, None, None, None, 4, 5]
    texts = ["same words here now"] * 5 + ["no id at all"] * 3 + [None, "same words here now"]
    make(spark, texts, ids).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "words here")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = f"file://{tmp_path}"
    got = Counter((r.doc_id, r.component_id) for r in simhash.op5_simhash_near_dedup(spark, d).collect())
    assert got == {(3, 3): 5, (None, None): 3, (4, 4): 1, (5, 3): 1}
    found = decontam.op2_benchmark_decontamination(spark, d).collect()
    assert len(found) == 10 and sum(r.contaminated for r in found) == 6
    for query in (packing.op1_best_fit_packing, suffixes.op3_suffix_dedup, licenses.op4_license_scan, quality.op6_quality_divergence, sstable.op8_token_shards, brown.op9_brown_class_lm, pii.op10_pii_disclosure):
        assert query(spark, d).count() == 10


def test_suffixes_are_ordered_by_their_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, (400, 50)).astype(np.uint8)
    data[200:] = data[rng.integers(0, 200, 200)]
    data[300:, 40:] = 97
    group = np.sort(rng.integers(0, 3, 400))
    order, shared = suffixes.ordered(group, data)
    rows = [(int(group[i]), data[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 400):
        a, b = rows[k - 1], rows[k]
        want = -1 if a[0] != b[0] else next((j for j in range(50) if a[1][j] != b[1][j]), 50)
        assert shared[k] == want


def test_exchange_raises_the_likelihood():
    """best_classes is the class of the greatest likelihood of the class bigrams, by trying each."""
    rng = np.random.default_rng(1)
    symbols, classes = 12, 3
    pairs = rng.integers(0, 9, (symbols, symbols)).astype(float)
    cls = np.concatenate([np.arange(8) % classes, np.arange(3, 7)])
    word = 10  # in a class of its own, like a word that no sweep has moved
    groups = 7

    def table_of(cls):
        one = np.zeros((symbols, groups))
        one[np.arange(symbols), cls] = 1
        return one.T @ pairs @ one

    def likelihood(table):
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
        return f(table).sum() - f(table.sum(1)).sum() - f(table.sum(0)).sum()

    rows = Counter()
    for v in range(symbols):
        if v != word:
            rows[int(cls[v])] += pairs[word, v]
            rows[groups + int(cls[v])] += pairs[v, word]
    rows[2 * groups] += pairs[word, word]
    slot = np.array(sorted(rows))
    n = np.array([rows[k] for k in slot.tolist()])
    rest = pairs.copy()
    rest[word], rest[:, word] = 0, 0
    one = np.zeros((symbols, groups))
    one[np.arange(symbols), cls] = 1
    got = brown.best_classes(np.zeros(len(slot), int), slot, n, one.T @ rest @ one, classes)
    tried = []
    for c in range(classes):
        moved = cls.copy()
        moved[word] = c
        tried.append(likelihood(table_of(moved)))
    assert got.tolist() == [int(np.argmax(tried))]


def test_words_outside_the_head_are_clustered(spark, monkeypatch):
    """Rare nouns and verbs, none in the head, are told apart by where they stand: before, all were one class."""
    rng = random.Random(3)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [f"the {rng.choice(['cat', 'dog'])} will {rng.choice(['run', 'eat'])} now" for _ in range(600)]
    train = [i for i in range(600) if zlib.crc32(str(i).encode()) % 7 != 2]
    for k in range(60):
        texts[train[2 * k]] = f"the noun{k % 20:02} will run now"
        texts[train[2 * k + 1]] = f"the cat will verb{k % 20:02}{'x' * 100} now"
    texts[held[0]], texts[held[1]] = f"the noun07 will verb07{'x' * 100} now", f"the verb07{'x' * 100} will noun07 now"
    monkeypatch.setattr(brown, "HEAD", 8)
    score = {r.doc_id: r.score for r in brown.score(make(spark, texts)).collect()}
    assert score[held[0]] > score[held[1]] + 2


def test_brown_against_brute_force_beyond_the_head(spark, docs, monkeypatch):
    """Classes of words outside the head, from all their contexts, and scores, with words next to each other and after themselves."""
    df, texts, _ = docs
    got = {}
    cluster, links = brown.cluster, brown.rare_links

    def kept_cluster(train, head, *more):
        group, table = cluster(train, head, *more)
        got.update(head=head, group=group.tolist(), table=table.copy())
        return group, table

    def kept_links(*args):
        got["links"] = links(*args)
        return got["links"]

    monkeypatch.setattr(brown, "HEAD", 60)
    monkeypatch.setattr(brown, "LONGEST", 100)
    monkeypatch.setattr(brown, "cluster", kept_cluster)
    monkeypatch.setattr(brown, "rare_links", kept_links)
    extra = ["again again again w1 again", "never1 never2 w1 never1", "one1 one2 one2 one2 one3"] * 4
    frame, texts = make(spark, texts + extra), texts + extra
    score = {r.doc_id: (r.score, r.n_known) for r in brown.score(frame).collect()}
    head, group, table = got["head"], got["group"], got["table"]
    place, n = head.places(), len(head.words)
    groups, tail, end, start = len(table), group[n], group[n + 1], group[n + 2]
    lines = [words(t) for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    assert n and all(len(w) <= 100 for w in head.words) and any(len(w) > 100 for x in lines for w in x)
    slots = {}
    counts = Counter(w for x, t in zip(lines, train) if t for w in x)
    for x in (x for x, t in zip(lines, train) if t):
        g = [start, *(group[place.get(w, n)] for w in x), end]
        for k, w in enumerate(x):
            if w not in place:
                own = slots.setdefault(w, Counter())
                if k + 1 < len(x) and x[k + 1] == w:
                    own[2 * groups] += 1
                else:
                    own[g[k + 2]] += 1
                if not k or x[k - 1] != w:
                    own[groups + g[k]] += 1
    own = {w: group[k] for w, k in place.items()}
    for w, c in slots.items():
        slot = np.array(sorted(c))
        own[w] = int(brown.best_classes(np.zeros(len(slot), int), slot, np.array([float(c[k]) for k in slot.tolist()]), table, head.classes)[0])
    assert len({own[w] for w in slots}) > 1
    rows = got["links"].collect()
    assert len({(r.row, r.pos) for r in rows}) == len(rows) == sum(w not in place for x in lines for w in x)
    assert all(r["class"] < head.classes if r.n else r["class"] == tail for r in rows)
    pairs = np.zeros((groups, groups))
    for x in (x for x, t in zip(lines, train) if t):
        g = [start, *(own[w] for w in x), end]
        for k, (a, b) in enumerate(zip(g, g[1:])):
            pairs[a, b] += 1
            if k and x[k - 1] not in place:
                pairs[tail, b] += 1
    step = (pairs + brown.SMOOTH) / (pairs.sum(1, keepdims=True) + brown.SMOOTH * (groups - 1))
    mass = pairs.sum(0)
    for i, x in enumerate(lines):
        g = [start, *(own.get(w, tail) for w in x), end]
        want = sum(log10(step[a, b]) for a, b in zip(g, g[1:])) + sum(log10(counts[w] / mass[own[w]]) for w in x if counts[w])
        assert score[i][0] == pytest.approx(want) and score[i][1] == sum(counts[w] > 0 for w in x) + 1


def test_head_of_words_of_one_count(spark, monkeypatch):
    """Where words of the same count are more than the head holds, a part of them is the head, and all get scores."""
    monkeypatch.setattr(brown, "HEAD", 100)
    counts = spark.createDataFrame([(f"w{k}".encode(), 1) for k in range(1000)], "word binary, n long")
    assert 50 < counts.where(brown.in_head(counts)).count() < 150
    texts = [" ".join(f"w{k}" for k in range(10 * i, 10 * i + 10)) for i in range(100)]
    rows = brown.score(make(spark, texts)).collect()
    assert len(rows) == 100 and all(r.n_known == (1 if r.held_out else 11) for r in rows)


def test_licenses_with_changed_words(spark):
    """Bodies with one or two words changed are found; the containment is that of a plain count over windows."""
    rng = random.Random(11)
    bodies = [(n, t) for n, t in licenses.TEMPLATES if 60 < len(licenses.words(t.encode())) < 900]
    texts, want = [], []
    for name, body in bodies:
        for changes in (1, 2):
            for _ in range(3):
                w = [x.decode("utf-8", "replace") for x in licenses.words(body.encode())]
                for k in rng.sample(range(len(w)), changes):
                    w[k] = "changed"
                texts.append("before it " * 9 + " ".join(w) + " after it" * 9)
                want.append(name)
    got = {r.doc_id: r.licenses for r in licenses.scan(make(spark, texts)).collect()}
    hit = sum(any(x.license == want[i] for x in got[i]) for i in range(len(texts)))
    assert hit >= 0.9 * len(texts)
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    whole = {}
    for name, t in bodies:
        whole.setdefault(name, []).append(set(grams(licenses.words(t.encode()))))
    for i, t in enumerate(texts[:20]):
        own = grams(licenses.words(t.encode()))
        best = max(len(g & set(own[a : a + len(g)])) / len(g) for g in whole[want[i]] for a in range(max(len(own) - len(g) + 1, 1)))
        found = [x.containment for x in got[i] if x.license == want[i]]
        if best >= licenses.MIN_CONTAINED and found:
            assert abs(max(found) - best) < 1e-9
