"""Spelling variants against brute force over all pairs, with blocks of any size."""

import collections
import random
import re
import zlib

import pytest

from riftscan.llm import queries, spelling


def counted(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[p:] == b[p + 1 :])


def expected(rows):
    n = counted(rows)
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    out, forms = {}, {}
    for w in n:
        near = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    root = lambda w: root(forms[w]) if forms[w] else w
    return {(w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in n}


def made(seed, words=120, letters="abc"):
    """Texts in which words have many near ones, of very different counts, with chains of forms."""
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(words)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "\u00e9t\u00e9abcdef", "ete\u00c9abcdef", "etabcdefgh"]
    near = [w[:p] + r.choice(["", "x", "b"]) + w[p + r.randint(0, 1) :] for w in base for p in [r.randrange(len(w))]]
    texts = [(k, " ".join(r.choices(base, k=60) + r.choices(near, k=8))) for k in range(40)]
    chain = " ".join(["abcdefgh"] * 400 + ["abcdefgx"] * 40 + ["abcdefxx"] * 4 + ["abcdefghi"] * 30)
    return [*texts, (1000, chain), (1000, chain), (None, "abcdefgh abcdefgz abcdefgz"), (None, None), (7, ""), (8, "short " * 9 + "A" * 30_000 + " " + "a" * 30_000)]


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("most", [2, 7, spelling.BLOCK])
def test_op12_blocks(spark, most):
    rows = made(most)
    got = spelling.group(spark.createDataFrame(rows, "doc_id bigint, text string"), most).select(*COLUMNS).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == expected(rows)


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_spelling"](spark, sf).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == expected(rows) and any(r.form for r in got)


def test_op12_odd(spark, odd, empty):
    got = spelling.group(odd).collect()
    assert {(r.word, r.n) for r in got} == set(counted([(r.doc_id, r.text) for r in odd.collect()]).items())
    assert spelling.group(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_scan_partitions_pairs(seed):
    """Subdivided in plain Python, the blocks find each near pair exactly once."""
    r = random.Random(seed)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(60)})
    found = collections.Counter()

    def descend(size, a, c, held, depth):
        if depth and size - a - c > 1:
            g = (size - a - c) // 2
            for a2, c2 in ((a + g, c), (a, c + size - a - c - g)):
                blocks = collections.defaultdict(list)
                for w in held:
                    blocks[w[:a2], w[len(w) - c2 :]].append(w)
                for block in blocks.values():
                    descend(size, a2, c2, block, depth - 1)
        else:
            for w, b in spelling.scan(size, a, c, [(w, 1) for w in held]).items():
                found[w] += b.count

    for size in range(0, 8):
        held = [w for w in words if len(w) in (size, size + 1)]
        if held and size:
            descend(size, 0, 0, held, seed % 4)
    assert {w: found[w] for w in words} == {w: sum(one_edit(w, v) for v in words) for w in words}
