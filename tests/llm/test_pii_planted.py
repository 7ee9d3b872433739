"""Recall and false alarms of op3's proposed kinds in documents: values at known places, in formats and words that its snippets don't have."""

import random

import pytest
from pyspark.sql import functions as F

from riftscan.llm import pii

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MIXED = LETTERS + LETTERS.upper() + "0123456789"


def planted(seed=11):
    """kind, words before, value; kinds that start with 'not' are none."""
    r = random.Random(seed)
    num, text = lambda k: "".join(r.choice("0123456789") for _ in range(k)), lambda a, k: "".join(r.choice(a) for _ in range(k))
    name = lambda: text(LETTERS, r.randint(3, 7))
    makers = {
        "national": lambda: (r.choice(["reach us on", "my number is", "Ruf", "appelez le", "llame al"]), r.choice([f"0{num(2)}/{num(4)}-{num(4)}", f"0{num(3)}-{num(3)}-{num(4)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"{num(3)} {num(3)} {num(4)}"])),
        "address": lambda: (r.choice(["send it to", "reply to", "escriba a", "an"]), r.choice([f"{name()}_{name()} [at] {name()} [dot] co [dot] uk", f"{name()}-{name()}(at){name()}.info", f"{name()}{num(1)} [AT] {name()}.eu", f"{name()}.{name()} (at) {name()}-{name()} (dot) io"])),
        "number": lambda: (r.choice(["her SSN is", "soc. sec. no.", "NIF", "passport", "national id"]), r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{num(8)}Z", f"{num(9)}"])),
        "bank": lambda: (r.choice(["pay to", "transfer it to", "Bankverbindung", "compte"]), r.choice([f"IT{num(2)} X{num(3)} {num(4)} {num(4)} {num(4)} {num(4)} {num(3)}", f"BE{num(2)} {num(4)} {num(4)} {num(4)}", f"CH{num(2)}{num(4)}{num(4)}{num(4)}{num(4)}{num(1)}", f"PT{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(4)} {num(1)}"])),
        "secret": lambda: (r.choice(["client_secret=", "pwd: ", "AUTH_TOKEN=", "passphrase = ", "private_key: "]), r.choice([text(MIXED, 24), text("0123456789ABCDEF", 32), f"sk_live_{text(MIXED, 24)}", f"{text(MIXED, 10)}/{text(MIXED, 12)}+{text(MIXED, 17)}"])),
        "not a number": lambda: (r.choice(["ISBN", "part", "lot", "batch", "parcel"]), r.choice([f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)}-{num(4)}-{num(2)}", f"{num(11)}", f"{num(5)} {num(5)}"])),
        "not a phone": lambda: (r.choice(["at", "around", "measured", "score"]), r.choice([f"1{num(1)}.{num(2)}.{num(2)}", f"{num(2)}.{num(3)} {num(2)}.{num(3)}", f"{num(1)}-{num(1)}, {num(1)}-{num(1)}", f"20{num(2)}-1{num(1)}-0{num(1)}"])),
        "not a secret": lambda: (r.choice(["see", "in", "read", "open"]), r.choice([f"/usr/share/{name()}/{name()}.conf", f"www.{name()}.org/{name()}/{name()}-{name()}", f"{name()}_{name()}_{name()}()", f"{name()}-{name()}-{name()}-{name()}"])),
        "not an address": lambda: ("we stayed", f"{name()} at {name()}"),
    }
    while True:
        for kind, make in makers.items():
            yield (kind, *make())


def measure(spark, model):
    """kind: planted values, and those that a selected span (of any kind) overlaps."""
    docs = spark.read.parquet(DOCUMENTS).where("text is not null and length(text) > 60").select("doc_id", "text").orderBy("doc_id").collect()
    rows, makers = [], planted()
    for d in docs:
        kind, say, value = next(makers)
        at = d.text.find(" ", len(d.text) // 2)
        at = len(d.text) if at < 0 else at
        head = f"{d.text[:at]} {say}{'' if say[-1] in '= ' else ' '}"
        rows.append((d.doc_id, head + value + d.text[at:], kind, len(head), len(head) + len(value)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, a int, b int")
    found = pii.find(df.select("doc_id", "text"), model).select(F.col("doc_id").alias("of"), "pii_spans")
    hit = F.exists("pii_spans", lambda s: (s["start"] < F.col("b")) & (s["end"] > F.col("a")))
    counts = df.join(found, F.col("doc_id") == F.col("of")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).collect()
    return {r["kind"]: (r["n"], r["hits"]) for r in counts}


@pytest.fixture(scope="module")
def measured(spark):
    return measure(spark, pii.train(spark))


#: Least recall asserted of each kind, a little under what was measured (1.00, 1.00, 0.83, 0.63, 0.50).
LEAST = {"address": 0.95, "bank": 0.95, "number": 0.75, "secret": 0.55, "national": 0.45}


@pytest.mark.parametrize("kind", sorted(LEAST))
def test_recall(measured, kind):
    n, hits = measured[kind]
    assert n > 90 and hits >= LEAST[kind] * n


def test_no_false_alarms(measured):
    others = {k: v for k, v in measured.items() if k.startswith("not")}
    assert len(others) == 4 and sum(hits for _, hits in others.values()) <= 0.01 * sum(n for n, _ in others.values())
