"""Each operator against a brute-force version, and on odd tables."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftscan.llm import components, decontamination, html, jaccard, language, letters, packing, pii, quality, queries, repeats, sharding, shingles, toxicity
from tests.llm.conftest import LONG

BLANK = r"[^\x20\x09-\x0D]+"


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


# Language identification


def test_op1(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op1_language"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (crc(r.doc_id) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95


def test_op1_odd(spark, odd, empty):
    f = language.train(odd)
    got = language.identify(odd, f).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 8) or (r.doc_id is None and r.score == 0)) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(empty)).collect()} == {"und"}


def test_bit_slices():
    """Every inserted n-gram is found with its language; others at about the expected rate; more than 64 languages work."""
    grams = [shingles.stream(k, 500) for k in range(70)]
    f = language.build([(k, g) for k, g in enumerate(grams)], [f"l{k:02}" for k in range(70)], 0, 1 << 16)
    for k in (0, 63, 64, 69):
        at = language.positions(grams[k], len(f.masks))
        found = f.masks[at[0]] & f.masks[at[1]] & f.masks[at[2]] & f.masks[at[3]]
        assert ((found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    assert (f.false_rate() < 1e-4).all()


# Packing


def check_pieces(rows, texts, path=None):
    encoder = packing.WordEncoder(path or packing.tokenizer_path())
    plain = encoder.tokenizer
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_bin))


def test_op2(spark, sf):
    rows = queries.QUERIES["op2_packing"](spark, sf).collect()
    assert check_pieces(rows, texts_of(spark, sf)) < 0.02


def test_op2_odd(spark, odd, empty):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack_documents(one, "ids_crc32").collect(), {r.doc_id: r.text for r in one.collect()})
    every = packing.pack_documents(odd, "ids", group_docs=3).collect()
    assert all(len(r.ids) == r.length for r in every) and sum(r.start == 0 for r in every) == odd.count()
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, "words")


def test_words():
    """Cutting at spaces gives what the tokenizer gives for the whole text."""
    e = packing.WordEncoder(packing.tokenizer_path())
    odd = ["it's Don't. a,b,c ... x..y \"q\", (z)!", "İstanbul ΣΑΣ. ÉCOLE, naïve—dash", "<|endoftext|> and a<|endoftext|>b.", "1,234.56 x1y2 _a_ áb c d\x1ce", "tab\there\r\nnew  spaces \x00 ﻿", "日本語 テスト。 한국어", ",", ".", "a.", "a.,", "Σ. ς, ﬁne"]
    for size in (10**6, 3):
        packing.CACHE_WORDS, old = size, packing.CACHE_WORDS
        try:
            for _ in range(2):
                assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(odd)] == [x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
        finally:
            packing.CACHE_WORDS = old


def test_first_fit_decreasing():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 200):
        sizes = sorted((r.randint(1, 100) for _ in range(n)), reverse=True)
        bins, offsets = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
        free, want = [], []
        for s in sizes:
            k = next((k for k, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(100)
            want.append((k, 100 - free[k]))
            free[k] -= s
        assert list(zip(bins.tolist(), offsets.tolist())) == want


# Personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
)


def luhn(d):
    return sum(n if k % 2 == 0 else 2 * n - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(text):
    found, counts = [], []
    for k, (name, p, ok) in enumerate(PATTERNS):
        ms = [m for m in re.finditer(p, text) if ok(m[0])]
        counts.append(len(ms))
        found += [(m.start(), k, m.end(), name) for m in ms]
    return counts, ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def check_pii(df, model):
    found = pii.find(df.select("doc_id", "text"), model).select("text", F.transform("pii_base", lambda x: F.size(x)).alias("n"), pii.written(F.sort_array(F.flatten("pii_base"))).alias("base"), pii.written(F.col("pii_spans")).alias("spans"))
    rows = found.collect()
    for r in rows:
        counts, base = base_of(r.text or "")
        assert (list(r.n), r.base) == (counts, base)
        assert {x for x in base.split(",") if x} <= set(r.spans.split(","))
        at = [int(x.split(":")[1]) for x in r.spans.split(",") if x]
        assert at == sorted(at)
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_pii_long_secrets(spark, model):
    """Credentials of any length, dotted or not, after any mark."""
    r = random.Random(5)
    text = lambda k: "".join(r.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(k))
    values = [text(201), text(3000), f"{text(36)}.{text(260)}.{text(43)}", text(40)]
    texts = [f"that was found {say}{v} later" for v in values for say in ('token = "', "password=", "Bearer ", "secret:\n", "token:\t", "secret = `")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()]
    assert [t for t, g in zip(texts, got) if "[SECRET]" not in g or len(g) > 60] == []


def test_op3(spark, sf, model):
    check_pii(spark.read.parquet(f"{sf}/documents.parquet"), model)
    got = {r.doc_id: r for r in queries.QUERIES["op3_pii"](spark, sf).collect()}
    for i, t in texts_of(spark, sf).items():
        counts, base = base_of(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


TRICKY = [
    "a@b.c._x@d.e and x@y.z@w.v", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-2", "+1 (555) 123-4567 x +12 ++49 30 1234567.", "é@é.com übe@x.de 😀 a@b.co",
    "5" * 5000, "1." * 3000, "+1" + " 1" * 3000, "x@" + "a." * 2000 + "b", "1 " * 3000, "", None, "99999999999999999999.1.1.1",
]


def test_op3_tricky(spark, odd, empty, model):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    check_pii(df, model)
    check_pii(odd, model)
    assert pii.find(empty, model).count() == 0
    long = spark.createDataFrame([(1, "a" * 60_000 + "@"), (2, "a" * 60_000)], "doc_id bigint, text string")
    assert [r.pii_spans for r in pii.find(long, model).collect()] == [[], []]


def test_op3_method(spark, model):
    """The trees find what the base patterns miss, and leave look-alikes alone."""
    yes = ["call (212) 555-7788 now", "mail joe [at] site [dot] com please", "her SSN is 123-45-6789", "password=abcdef1234567890 ok", "IBAN DE89 3704 0044 0532 0130 00"]
    no = ["order 123-456-7890 came", "on 2024-01-17 we", "version 10.12.14 of it", "about 100 000 000 people", "look at nothing.else there", "plain words only"]
    df = spark.createDataFrame(list(enumerate(yes + no)), "doc_id bigint, text string")
    got = [r.n > 0 for r in pii.find(df, model).orderBy("doc_id").select(F.size("pii_spans").alias("n")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_redact(spark, odd, model):
    df = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567!"), (2, None), (3, "é 10.0.0.1")], "doc_id bigint, text string")
    assert [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE]!", None, "é [IP]"]
    got = pii.redact(odd, model)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.where("pii_base = 'x'").count() == odd.count()


# Sharding


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_deal():
    """Groups of one size, dealt in one step, are those that a heap deals one by one."""
    r = random.Random(6)
    for _ in range(300):
        loads = [r.randint(0, 60) for _ in range(r.randint(1, 6))]
        size, n = r.randint(1, 9), r.randint(0, 40)
        want = loads.copy()
        for _ in range(n):
            want[want.index(min(want))] += size
        assert [v + size * c for v, c in zip(loads, sharding.deal(loads, size, n))] == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_op4(spark, sf):
    rows, texts = queries.QUERIES["op4_sharding"](spark, sf).collect(), texts_of(spark, sf)
    check_shards(rows, texts)
    groups = collections.Counter()
    for i, t in texts.items():
        groups[t] += len((t or "").encode()) + 1
    heap = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        heap[heap.index(min(heap))] += size
    load, where = collections.Counter(), {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert where.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
    assert sorted(load.values()) == sorted(heap)


def test_op4_odd(spark, odd, empty):
    rows = sharding.shard_documents(odd, part_rows=2).collect()
    check_shards(rows, odd.collect())
    assert sharding.shard_documents(empty).count() == 0
    assert len({r.shard for r in rows if r.size == len(LONG) + 1}) == 1


# Toxicity


def test_op5(spark, sf):
    big = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, big).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, t) for i, t in marks.items() if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)


def test_op5_counterfactual(spark):
    """Mentions of groups that come with insults in training don't make a neutral mention toxic."""
    r = random.Random(2)
    plain = "the house stood near a river and people walked there every morning with bread".split()
    def sentence(*extra):
        w = r.sample(plain, 8) + list(extra)
        r.shuffle(w)
        return " ".join(w)
    rows, marks = [], []
    for k in range(600):
        toxic = k % 3 == 0
        group = r.choice(["muslims", "women"]) if (toxic and r.random() < 0.8) or r.random() < 0.05 else ""
        rows.append((k, sentence(*([r.choice(["scum", "idiot", "trash"])] if toxic else []), group)))
        marks.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    ask = spark.createDataFrame([(1, sentence("muslims")), (2, sentence("women")), (3, sentence("scum")), (4, sentence("refugees", "idiot"))], "doc_id bigint, text string")
    fair = {x.doc_id: x.score for x in toxicity.score(ask, toxicity.train(docs, labels)).collect()}
    old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    try:
        biased = {x.doc_id: x.score for x in toxicity.score(ask, toxicity.train(docs, labels)).collect()}
    finally:
        toxicity.SWAP_PENALTY = old
    assert fair[1] < 0.5 and fair[2] < 0.5 and fair[3] > 0.5 and fair[4] > 0.5
    assert fair[1] < biased[1] and fair[2] < biased[2]


def test_op5_odd(spark, odd, empty, labels):
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert max(r.score for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()) < 0.5


# Quality rules


def stats_of(text):
    t = text or ""
    w = re.findall(BLANK, t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def check_quality(rows):
    for r in rows:
        want = stats_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept)


def judged(docs, rules):
    s = F.col("quality_stats")
    return quality.judge(docs.select("doc_id", "text"), rules).select("text", *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def test_op6(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_quality(judged(docs, []).collect())
    big = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, big).collect()}
    marks = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{big}/labels.parquet").collect()]
    good = [r for r, q in marks if q == 1 and not r.base_failed]
    bad = [r for r, q in marks if q == 0]
    assert sum(r.kept for r in good) > 0.98 * len(good) and sum(r.kept for r in bad) < 0.2 * len(bad)


def test_op6_odd(spark, odd, empty, labels):
    rows = judged(odd, []).collect()
    check_quality(rows)
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns and kept.where("kept = 'k'").count() == kept.count()
    assert quality.quality_filter(empty, labels).count() == 0
    r = random.Random(3)
    tricky = [" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) + "\n" * r.randint(0, 2) + "x y" for _ in range(40)] + ["a " * 500, "\n\n a\n a\n\n b \n a"]
    check_quality(judged(spark.createDataFrame(list(enumerate(tricky)), "doc_id bigint, text string"), []).collect())


def test_decision_list():
    r = np.random.default_rng(4)
    x = r.random((900, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 0] < 0.5) | (x[:, 5] < 0.1)
    rules = quality.learn_list(x, bad)
    hit = np.zeros(len(x), dtype=bool)
    for rule in rules:
        hit |= quality.covers(rule, x)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.03 * (~bad).sum()
    assert quality.learn_list(x, np.zeros(900, dtype=bool)) == [] and quality.learn_list(x[:0], bad[:0]) == []


# Repeated strings


def removed(texts, n):
    c = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_op7(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = docs.select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(docs, kept="sha256").collect()}
    assert [got[r.doc_id] for r in rows] == removed([(r.text or "").encode() for r in rows], 200)


@pytest.mark.parametrize("seed", [5, 6])
def test_op7_random(spark, seed):
    r = random.Random(seed)
    text = lambda n, a: "".join(r.choice(a) for _ in range(n))
    base = [text(r.randint(0, 400), "abcdefgh ") for _ in range(8)] + ["a" * 300, "ab" * 150, ""]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 8)):
            b = r.choice(base)
            i = r.randint(0, len(b))
            parts.append(b[i : i + r.randint(0, 150)] if r.random() < 0.8 else text(r.randint(1, 60), "xyzé"))
        texts.append("".join(parts))
    texts += [*texts[:5], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block, limit in ((40, None), (40, 0)):
        old = repeats.BROADCAST_BYTES
        repeats.BROADCAST_BYTES = old if limit is None else limit
        try:
            got = {x.doc_id: tuple(x)[1:] for x in repeats.remove_repeats(df, block, 12, "sha256").collect()}
        finally:
            repeats.BROADCAST_BYTES = old
        assert [got[k] for k in range(len(texts))] == removed([(t or "").encode() for t in texts], block)


def test_op7_odd(spark, odd, empty):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_removed == (len(LONG) if r.n_bytes == len(LONG) else r.n_removed) for r in got)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(odd, 200, 200)


# Decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scan_of(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for t in texts:
        w = words_of(t)
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (ids := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def check_scan(docs, bench, **kw):
    rows = decontamination.scan(docs, bench, **kw).select("text", "n_words", "n_hit", "hit_items").collect()
    want = scan_of([r.text for r in rows], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert [(r.n_words, r.n_hit, list(r.hit_items)) for r in rows] == want
    return rows


def test_op8(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check_scan(docs.select("doc_id", "text"), bench)
    assert any(r.n_hit for r in rows)
    check_scan(docs.select("doc_id", "text"), bench, max_windows=300)  # several passes
    check_sql(spark, sf, "op8_decontamination")


def check_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.select(*order).fetchall())


def test_op8_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word3 Word4, WORD5"), (1, "word3 Word4, WORD5"), (2, None), (3, " .. "), (4, " ".join(f"word{k}" for k in range(5, 20))), (None, "é ñ"), (6, "É x"), (7, "at all")], "item_id bigint, text string")
    slim = odd.select("doc_id", "text")
    rows = decontamination.scan(slim, bench).select("text", "n_words", "n_hit").collect()
    want = scan_of([r.text for r in rows], [tuple(r) for r in bench.where("item_id is not null").collect()] + [("", "é ñ")])
    assert [(r.n_words, r.n_hit) for r in rows] == [(a, b) for a, b, _ in want]
    assert decontamination.scan(empty, bench).count() == 0
    assert decontamination.scan(slim, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontamination.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.where("n_words = 'n' and scan_key = 'z'").count() == kept.count()
    cut = decontamination.decontaminate(spark.createDataFrame([(1, "One, word3 word4 word5! end.")], "doc_id bigint, text string"), bench, "spans").first().text
    assert cut == "One end." or cut == "One! end."
    with pytest.raises(ValueError):
        decontamination.decontaminate(odd, bench, "lines")


# Near duplicates


def links_of(rows, threshold=0.8):
    first = {}
    for i, t in rows:
        first.setdefault(t, []).append(i)
    texts = [t for t in first if t is not None]
    sets = []
    for t in texts:
        w = re.findall(BLANK, t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    up, n = list(range(len(texts))), collections.Counter()
    find = lambda k: k if up[k] == k else find(up[k])
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        for j, same in collections.Counter(j for x in s for j in holders[x] if j > k).items():
            if same >= threshold * (len(s) + len(sets[j]) - same) - 1e-9:
                n[k] += 1
                n[j] += 1
                up[find(j)] = find(k)
    members = collections.defaultdict(list)
    for k, t in enumerate(texts):
        members[find(k)] += first[t]
    return {t: (min((i for i in members[find(k)] if i is not None), default=None), n[k]) for k, t in enumerate(texts)}


def test_op9(spark, sf):
    big = "/root/testdata/sf0.01"
    texts = texts_of(spark, big)
    want = links_of(list(texts.items()))
    for r in queries.QUERIES["op9_ngram_jaccard"](spark, big).collect():
        assert (r.class_id, r.n_links) == want[texts[r.doc_id]]
    check_sql(spark, big, "op9_ngram_jaccard")


def test_op9_groups(spark):
    """A large group of different near copies, compared in blocks, loses no link; chains become one class."""
    r = random.Random(7)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(150):
        w = base.copy()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = f"e{r.randint(0, 99)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"z{k}y{j}" for j in range(30))) for k in range(20)] + [(2000, rows[0][1]), (2001, rows[3][1])]
    want = links_of(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.uid: x for x in jaccard.link(df, block=32).collect()}
    uid = {x.text: x.uid for x in jaccard.with_uid(df).collect()}
    assert {t: (got[uid[t]].class_id, got[uid[t]].n_links) for t in want} == want


@pytest.mark.parametrize("ids", [(None, None, None, None), (7, 7, 7, 7), (None, 7, 7, None), (3, 3, 2, 9)])
def test_keep_one_ids(spark, ids):
    """One document of a class stays, also when ids are null or repeated."""
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(["y"] + words[1:])]
    texts = [*near, near[0]]
    df = spark.createDataFrame([*zip(ids, texts), (ids[0], "other words of another text")], "doc_id bigint, text string")
    got = [tuple(r) for r in jaccard.keep_one(df).select("doc_id", "text").collect()]
    same = [g for g in got if g[1] in near]
    assert len(got) == 2 and len(same) == 1
    assert same[0][0] == min((i for i in ids if i is not None), default=None)


def test_op9_odd(spark, odd, empty):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert sum(t is None for _, t in got) == 2 and sum(t == LONG for _, t in got) == 1
    words = " ".join(f"word{k}" for k in range(40))
    assert [i for i, t in got if t and t.startswith(words)] == [5]
    assert jaccard.link(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_posterior():
    for n in (16, 64):
        m = jaccard.least_matches(n, 0.8, 1e-9)
        assert 0 < m < 0.8 * n
    assert jaccard.least_matches(16, 0.8, 1e-30) == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 6000 + k) for k in range(200)]
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loose = {a for a, b in edges if a == b}
    assert got == {x: find(x) for x in up if x in got} and set(up) - set(got) <= loose


def test_shingles():
    texts = ["", " ", "a", "a b c d", "a b c d e", "a b c d e f", "é ü\tß\nx y z", "aa", "a a", "x" * 3000 + " y z u v w"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    values, counts = shingles.shingles(data, offsets)
    assert counts.tolist() == [0, 0, 1, 1, 1, 2, 2, 1, 1, 2]
    at = 0
    for t, n in zip(texts, counts.tolist()):  # alone or among others, a text has the same shingles
        d = np.frombuffer(t.encode(), dtype=np.uint8)
        v, _ = shingles.shingles(d, np.array([0, len(d)]))
        assert v.tolist() == values[at : at + n].tolist()
        at += n


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies to make this site work for you and everyone else</p></div>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
{open}<h2>Title &amp; more</h2><p>Some   long text of the
 article, with <b>bold</b> and <a href="x">a link</a> inside &#233; here&nbsp;now.<br>After it.<div class="ad-box">Buy this thing now</div>
<p>Second paragraph with many words so that the region is the article and nothing else at all.{close}
<section class="comments"><p>I like this very much, thank you for writing all of these words</p></section>
<form><p>Your address</p><input name="q"></form><aside><p>See other stories</p></aside><footer>Copyright</footer></body></html>"""
MAIN = "Title & more\nSome long text of the article, with bold and a link inside é here now. After it.\nSecond paragraph with many words so that the region is the article and nothing else at all."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("", "")])
def test_main_text(spark, sf, open_, close):
    weights = html.train(spark.read.parquet(f"{sf}/pages.parquet"))
    assert html.main_text(PAGE.replace("{open}", open_).replace("{close}", close), weights) == MAIN


@pytest.mark.parametrize("wrap", ['<html class="nav js">', '<body class="single comments-open has-sidebar">', '<div class="with-sidebar">'])
def test_names_of_wholes(wrap):
    page = wrap + '<div id="siteMenu">Home About</div><p>The words of the page that are to stay here.</p><div class="cookieNotice">We set cookies</div>'
    assert html.main_text(page, html.start_weights()) == "The words of the page that are to stay here."


@pytest.mark.parametrize("start", ['<div class="content-with-sidebar">', '<div class="layout-sidebar-right">', '<section id="discussion">', '<div class="search-theory">', '<section id="related-work">', '<h2 id="search">', '<h2 id="related-work">', '<h2 id="discussion">'])
def test_names_kept(start):
    """A name with a menu's or an advert's word somewhere in it leaves nothing out."""
    page = f"{start}Words of the article"
    assert html.main_text(page, html.start_weights()) == "Words of the article"


@pytest.mark.parametrize("start", ['<div class="ad">', '<div id="ad-1">', '<div class="ad_box">', '<div class="col left-sidebar">', '<div id="siteMenu">', '<div class="share-buttons">', '<div class="related-posts">', '<section id="comments">', '<section class="discussion">', '<h2 class="promo">', '<div role="navigation">'])
def test_names_left_out(start):
    assert html.main_text(f"{start}Other words", html.start_weights()) == ""


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><nav>a</div><p>b", "b"),
        ('<p class="ad">a<p>b', "b"),
        ('<article><p class="ad">a<p>b</article>', "b"),
        ('<p class="ad">a <b>c<div>b</div>', "b"),
        ('<ul><li class="share">a<li>b</ul>', "b"),
        ('<ul><li class="share">a<ul><li>c<li>d</ul>e<li>b</ul>', "b"),
        ('<dl><dt class="ad">a<dd>b</dl>', "b"),
        ('<table><tr><td class="menu">a<td>b</table>', "b"),
        ('<table><tr class="menu"><td>a<tr><td>b</table>', "b"),
        ('<table><tr><td class="menu">a<table><tr><td>c</table>d<td>b</table>', "b"),
        ('<div><div class="ad"><div>a</div>c</div>b</div>', "b"),
        ('<div class="ad"><b>a</div>b', "b"),
        ('<b><div class="ad">a</b>c</div>b', "b"),
        ('<div class="ad">a</span></p>c</div>b', "b"),
        ('<span class="ad">a</span>b', "b"),
        ('<nav>a<article>b</article>', "b"),
    ],
)
def test_unclosed(page, want):
    """What is left out ends where HTML ends it."""
    assert html.main_text(page, html.start_weights()) == want


def test_deep():
    """Very many open elements take no more than linear time."""
    page = "<b><div>" * 20_000 + "<li></i></b></p>" * 20_000 + "words"
    began = time.process_time()
    assert html.main_text(page, html.start_weights()) == "words"
    assert time.process_time() - began < 20


def test_op10(spark, sf):
    import html as entities

    got = {r.page_id: r for r in queries.QUERIES["op10_html"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_op10_odd(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "plain words"), (3, "u", "<p>a<p>b"), (3, "u", "<p>a<p>b"), (4, "u", "<nav>menu words only"), (5, "u", "<" * 2000), (6, "u", '<p class="x>open quote <b>and more'), (7, "u", "<p>" + "word " * 20_000), (8, "u", "<!-- never closed <p>x"), (9, "u", "<script>x")], "page_id bigint, url string, html string")
    got = html.extract(pages, html.train(pages)).collect()
    assert [r.text for r in got][:6] == ["", "", "plain words", "a\nb", "a\nb", ""]
    assert len(got[8].text) == 20_000 * 5 - 1 and got[9].text == "" and got[10].text == ""
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


def test_best_region():
    """The linear scan finds what trying all regions finds."""
    r = random.Random(9)
    for _ in range(200):
        parts = [html.Part("text", "", r.randint(0, 4), r.random() < 0.2) if r.random() < 0.5 else html.Part(r.choice(["p", "li", "b"]), "", 0, False) for _ in range(r.randint(0, 14))]
        weights = {"text": 1.0, "p": -1.0, "li": -2.5, "b": -0.2}
        value = [0 if p.out else weights[p.kind] * (p.words if p.kind == "text" else 1) for p in parts]
        best = max([0.0] + [sum(value[a:b]) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1)])
        a, b = html.best_region(parts, weights)
        assert sum(value[a:b]) == pytest.approx(best)


def test_letters():
    texts = ["Ab, c", "", "É!", "12", "x"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    codes, heads = letters.letters(data, offsets)
    got = ["".join(chr(c) if c else "_" for c in codes[a:b]) for a, b in zip(heads, heads[1:])]
    assert [g.strip("_") for g in got] == ["ab_c", "", "é", "", "x"] and all(g.startswith("_") for g in got)


@pytest.mark.parametrize("odd_word", ["ΑΣ.Β", "İ", "K", "ΑΣ'Σ", "ÉCOLE", "ǅ", "ß"])
def test_op8_case(spark, odd_word):
    """An item is found in itself, and in other cases of A-Z alone, whatever letters stand where."""
    item = f"alpha {odd_word} gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    texts = [item, item.replace("alpha", "ALPHA"), item.lower(), item.upper(), f"x. {item} y", item.replace(" ", "\n..")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = check_scan(docs, spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert next(r for r in rows if r.text == item).n_hit == len(words_of(item))


def test_op8_linear(spark):
    """A text that is all benchmark takes time in proportion to its length."""
    item = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    seconds = []
    for n in (2_000, 2_000, 8_000):  # the first one warms up
        docs = spark.createDataFrame([(1, (item + ". ") * n)], "doc_id bigint, text string").repartition(1)
        began = time.time()
        assert decontamination.scan(docs, bench).first().n_hit == 40 * n
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 5


# Plain-Python predictions

M64 = (1 << 64) - 1


def mix_of(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def runs_of(text):
    """Lower-case letters of a text, a blank for what lies between."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return " " + re.sub(" +", " ", low).strip(" ") + " "


def test_op1_by_hand(spark):
    """Popcounts of the masks of each 4-gram, false positives taken off, decide; by plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    f = language.train(docs)
    place = [int(x) for x in shingles.stream(41, 4) | np.uint64(1)]
    rates, masks = f.false_rate(), [int(m[0]) for m in f.masks]
    got = {r.doc_id: r for r in language.identify(docs, f).collect()}
    for r in docs.collect():
        s = runs_of(r.text or "")
        if not any(c.isalpha() for c in s):
            assert got[r.doc_id].lang_pred == "und"
            continue
        counts, total = [0] * len(f.languages), 0
        for k in range(len(s) - 3):
            h = mix_of(sum((0 if c == " " else ord(c)) * p for c, p in zip(s[k : k + 4], place)) & M64)
            step, mask = mix_of(h) | 1, -1
            for j in range(language.HASHES):
                mask &= masks[((h + j * step) & M64) % len(masks)]
            total += 1
            for i in range(len(counts)):
                counts[i] += mask >> i & 1
        fair = [(c - total * rates[i]) / (1 - rates[i]) for i, c in enumerate(counts)]
        best = max(range(len(fair)), key=lambda i: (fair[i], -i))
        assert got[r.doc_id].lang_pred == (f.languages[best] if fair[best] > 0 else f.languages[f.common])
        assert got[r.doc_id].score == pytest.approx(min(1, max(0, fair[best] / max(1, total))) if fair[best] > 0 else 0)


def test_op1_rare_language(spark):
    """A language of few rows is learned beside one of very many, whatever the sample."""
    rows = [(k, f"alpha beta gamma number{k}", "xx") for k in range(4000)] + [(10_000 + k, "wortwahl zwischenzeit schlange", "yy") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = language.train(docs, sample=100)
    ask = spark.createDataFrame([(1, "schlange wortwahl"), (2, "gamma beta")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(ask, f).collect()} == {1: "yy", 2: "xx"}


def feature_hashes(text):
    """Hashes of the words and of their first four and five letters, by plain Python."""
    base, out = shingles.BASE, set()
    for w in runs_of(text).split():
        value = lambda k: sum(mix_of(ord(c) + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w[:k])) & M64
        out |= {mix_of((value(k) + k) & M64) for k in (4, 5) if len(w) >= k}
        out.add(mix_of((value(len(w)) + len(w) * 0x9E3779B97F4A7C15) & M64))
    return out


def test_op5_by_hand(spark):
    """Scores are the logistic sum of the weights of what a text holds, by plain Python; long words differ in any letter."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    weight = dict(zip([int(x) for x in m.features], m.weights))
    some = docs.where("doc_id < 60").select("doc_id", "text")
    got = {r.doc_id: r.score for r in toxicity.score(some, m).collect()}
    for r in some.collect():
        z = m.bias + sum(weight.get(h, 0.0) for h in feature_hashes(r.text or ""))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z)))))
    a, b = toxicity.features_of(["x" * 60 + "a", "x" * 60 + "b"])
    assert len(set(a.tolist()) & set(b.tolist())) == 2


def test_op5_mentions(spark):
    """On the given labels the penalty has pairs to act on, and no identity term moves a clean text's score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, real = [], toxicity.counterfactuals
    toxicity.counterfactuals = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
    try:
        m = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    finally:
        toxicity.counterfactuals = real
    assert sum(seen[0].values()) >= 6 * 300  # six for each labelled text
    clean = labels.where("toxic = 0").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(docs, "doc_id").select("doc_id", "text").limit(20)
    rows = [(k, r.text, t) for k, r in enumerate(clean.collect()) for t in ("", *toxicity.IDENTITY_TERMS)]
    ask = spark.createDataFrame([(k, f"{text} {term}") for k, text, term in rows], "doc_id bigint, text string")
    scores = [r.score for r in toxicity.score(ask.coalesce(1), m).collect()]
    step = 1 + len(toxicity.IDENTITY_TERMS)
    moved = [abs(scores[k] - scores[k - k % step]) for k in range(len(scores))]
    assert max(moved) < 0.02


# Trees and thresholds as columns


def test_op3_trees(spark, model):
    """Trees and thresholds give as columns what they give in Python."""
    rows = pii.snippets(seed=11, n=12)
    c, d = F.col("c"), pii.digits_of(F.col("c.value"))
    frame = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "k int, text string")
    held = F.array(*[F.coalesce(f, F.lit(False)) for f in pii.feature_columns(c, d).values()])
    spans = pii.selected(F.col("text"), model)
    seen = frame.withColumn("picked", spans).select("k", "picked", F.explode(pii.candidates(F.col("text"))).alias("c")).select("k", "picked", "c", held.alias("x")).collect()
    x = np.array([r.x for r in seen], dtype=float)
    scores = sum(pii.leaf_values(t, x) for t in model.trees)
    for r, s in zip(seen, scores):
        assert ((r.c.start, r.c.kind, r.c.end) in {tuple(p) for p in r.picked}) == (s >= model.cuts[pii.KINDS[r.c.kind]])
    assert len(seen) > 100 and 0 < sum(len(r.picked) > 0 for r in seen) < len(seen)


def test_op3_linear(spark, model):
    """Texts full of personal data take time in proportion to their length, and are redacted throughout."""
    line = 'mail ab@cd.ef or 10.0.0.1, card 4111 1111 1111 1111, token = "k3Jf9sLq2Zx8Vb7Nw4Tr6Yp1" é😀\n'
    seconds = []
    for n in (400, 400, 1600):  # the first one warms up
        df = spark.createDataFrame([(1, line * n)], "doc_id bigint, text string").repartition(1)
        began = time.time()
        assert pii.redact(df, model).first().text == 'mail [EMAIL] or [IP], card [CARD], token = "[SECRET]" é😀\n' * n
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 5


def test_op3_long_address(spark, model):
    text = "write to " + "a" * 90 + " [at] " + "b" * 70 + "".join(f" [dot] c{k}" for k in range(6)) + " please"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.redact(df, model).first().text == "write to [ADDRESS] please"


def test_bucket_pointers():
    """Pointers name strings of any length as comparing their bytes would."""
    r = random.Random(10)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode(), dtype=np.uint8)
    grams = repeats.gram_buckets(data, 4)
    start = np.array([r.randint(0, 2900) for _ in range(4000)])
    stop = start + np.array([r.randint(4, 40) for _ in range(4000)])
    names = repeats.named(grams, 4, start, stop).tolist()
    by_text = {}
    for a, b, name in zip(start.tolist(), stop.tolist(), names):
        assert by_text.setdefault(data[a:b].tobytes(), name) == name
    assert len(set(by_text.values())) == len(by_text)


LABELLED = '<html><body><div class="rail-q7"><p>{a}</p></div><article><section class="notice-box"><p>{b}</p></section><p>{c}</p></article><div class="zone-q9"><p>{d}</p><p>{a}</p></div></body></html>'


def labelled_pages(n, seed):
    """Pages whose names no list knows: boilerplate as long as the article, and a section that lists would leave out."""
    r = random.Random(seed)
    words = lambda k: " ".join(f"w{r.randint(0, 900)}" for _ in range(k))
    return [LABELLED.format(a=words(40), b=words(30), c=words(60), d=words(50)) for _ in range(n)]


def test_op10_learned(spark):
    """Weights move with labelled pages, and on held-out pages without the label's tags they find what untrained ones don't."""
    pages = spark.createDataFrame(list(enumerate(labelled_pages(60, 1))), "page_id bigint, html string").select("page_id", F.lit("u").alias("url"), "html")
    trained, start = html.train(pages), html.start_weights()
    assert trained[".q7"] < html.LEFT_OUT and trained[".q9"] < html.LEFT_OUT and trained[".notice"] > html.LEFT_OUT > start[".notice"]

    def right(weights):
        good = 0
        for page in labelled_pages(30, 2):
            want = [x for x in re.findall("<p>(.*?)</p>", page[page.index("<article>") : page.index("</article>")])]
            bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
            good += html.main_text(bare, weights) == "\n".join(want)
        return good / 30

    assert right(trained) == 1 and right(start) == 0
    tags_alone = {k: v for k, v in trained.items() if not k.startswith(".")} | {k: v for k, v in start.items() if k.startswith(".")}
    assert right(tags_alone) < 0.5


def test_op10_perceptron():
    """Where names say nothing, tag weights are learned: text between list items is no article."""
    r = random.Random(3)
    words = lambda k: " ".join(f"w{r.randint(0, 900)}" for _ in range(k))
    page = lambda: "".join(f"<li>{words(4)}</li>" for _ in range(12)) + "<article>" + "".join(f"<p>{words(25)}</p>" for _ in range(4)) + "</article>" + "".join(f"<li>{words(4)}</li>" for _ in range(12))
    weights = html.learn([page() for _ in range(30)])
    assert weights["li"] < 3 * html.start_weights()["li"]
    held = [page() for _ in range(10)]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in held]
    want = ["\n".join(re.findall("<p>(.*?)</p>", p)) for p in held]
    assert [html.main_text(b, weights) for b in bare] == want
    assert [html.main_text(b, html.start_weights()) for b in bare] != want


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a ='", "<a =\"='", "<!", "<head>", "<p class=ad>", "</b", "<a title='", "&amp", "<script"])
def test_op10_linear(unit):
    """Pages of nothing but broken markup take linear time."""
    weights, seconds = html.start_weights(), []
    for n in (20_000, 80_000):
        for page in (unit * n, unit * n + ">x"):
            began = time.process_time()
            html.main_text(page, weights)
            seconds.append(time.process_time() - began)
    assert max(seconds[2:]) < 8 * max(seconds[:2]) + 2


def test_op10_quoted():
    assert html.main_text('<p title="a > b" data-x="<i>no</i>" id=\'it"s\'>yes <b =">and</b> no', html.start_weights()).startswith("yes")
    assert html.main_text('<p title="x"">yes', html.start_weights()) == "yes"


@pytest.mark.parametrize("block", [16, 1000])
def test_connect(spark, block):
    """Classes are those of all links, for near copies, chains across blocks, and texts that are nearly near."""
    r = random.Random(block)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    texts = []
    for k in range(70):
        w = base.copy()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(120)] = f"e{r.randint(0, 99)}"
        texts.append(" ".join(w))
    chain = base.copy()
    for k in range(16):  # each is near the one before only
        chain[2 * k % 120] = f"c{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts)) + [(1000 + k, " ".join(f"z{k}y{j}" for j in range(30))) for k in range(5)] + [(2000, texts[1]), (None, texts[2]), (3, None)]
    want = links_of(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.uid: x.root for x in jaccard.connect(df, block=block).collect()}
    uid = {x.text: x.uid for x in jaccard.with_uid(df).collect() if x.text is not None}
    assert len(got) == len(want)
    classes = lambda of: sorted(sorted(t for t in want if of(t) == c) for c in {of(t) for t in want})
    assert classes(lambda t: got[uid[t]]) == classes(lambda t: want[t][0])


def test_cross_blocks(spark):
    """One large class and a few other texts: each is dealt in proportion, and every pair of classes meets."""
    rows = [(1, 7, k, "t") for k in range(1000)] + [(1, 10_000 + k, 10_000 + k, "t") for k in range(12)] + [(2, 5, 20_000 + k, "t") for k in range(500)]
    dealt = jaccard.cross_blocks(spark.createDataFrame(rows, "comp bigint, cls bigint, uid bigint, text string"), block=50).collect()
    assert {r.comp for r in dealt} == {1} and len(dealt) <= 1000 + 12 * 22
    meet = collections.defaultdict(set)
    for r in dealt:
        meet[r.uid].add((r.bi, r.bj))
    assert all(meet[a] & meet[b] for a in range(0, 1000, 37) for b in range(10_000, 10_012))
    assert all(meet[a] & meet[b] for a in range(10_000, 10_012) for b in range(10_000, 10_012))
