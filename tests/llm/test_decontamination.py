"""Cutting hit words: by brute force, and in time in proportion to the text."""

import random
import re
import time

from riftscan.llm import decontamination

WORD = r"[0-9A-Za-z\x80-\U0010FFFF]+"


def cut(text, items, window=13):
    words = [w.lower() for w in re.findall(WORD, text)]
    hit = set()
    for item in items:
        own = [w.lower() for w in re.findall(WORD, item)]
        size = min(window, len(own))
        for k in range(len(own) - size + 1):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
    pieces = re.findall("[^0-9A-Za-z\x80-\U0010FFFF]*" + WORD, text)
    tail = text[sum(map(len, pieces)) :]
    return "".join(p for i, p in enumerate(pieces) if i not in hit) + tail if hit else text


def test_spans(spark):
    r = random.Random(7)
    items = [" ".join(f"b{r.randrange(9)}" for _ in range(n)) for n in (3, 13, 20, 5)]
    texts = []
    for _ in range(40):
        parts = [r.choice([*items, "some plain words", "x, y; z!", "b1 b2"]) for _ in range(r.randint(1, 9))]
        texts.append(r.choice(["", "  ", "("]) + r.choice([" ", " - "]).join(parts) + r.choice(["", ".", " \n"]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", *items])], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string")
    got = {x.doc_id: x.text for x in decontamination.decontaminate(docs, benchmark, remove="spans").collect()}
    assert got == {x.doc_id: x.text if x.text is None else cut(x.text, items) for x in docs.collect()}


def test_spans_are_linear(spark):
    item = " ".join(f"q{k}" for k in range(13))
    benchmark = spark.createDataFrame([("1", item)], "item_id string, text string")
    took = []
    for n in (200, 200, 3200):
        docs = spark.createDataFrame([(1, f"start {(item + ' gap ') * n}end")], "doc_id bigint, text string")
        began = time.time()
        out = decontamination.decontaminate(docs, benchmark, remove="spans").first()
        assert out.text.split() == ["start"] + ["gap"] * n + ["end"]
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 5
