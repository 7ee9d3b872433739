"""Personal data by candidate gradient boosting (operator 3), in DataFrame functions only.

Four base patterns (e-mail, IP address, card, phone) with their validity rules
always count. Beyond them, high-recall generators propose overlapping spans
(spelled-out addresses, national phone numbers, identity and bank numbers,
credentials of any length, unspaced or failing variants of the base kinds). Each candidate
gets yes-or-no features of its format (length, digits, separators, check
digits, character mix) and of its context (words before it, what follows it);
boosted trees add up a score, and a calibrated threshold for each kind selects
the redactions. Trees and thresholds become one column expression.

The trees are trained here, on labelled snippets that ``snippets`` writes from
fixed formats with a fixed seed (a few thousand short rows, whatever the
corpus); their features come from the same column expressions, and one third
of them sets the thresholds.

The patterns are written with possessive repetitions and start where a run of
their first characters starts, so that a text of any length is scanned in
linear time and without deep recursion; their matches are those of the plain
patterns.

Defined results: a null text is empty and has no spans (``redact`` leaves it
null); spans are in code points, end exclusive, by start, then kind as in
``KINDS``, then end; a proposed span inside a base span is dropped; repeated
rows get equal results; an empty table gives an empty result; other columns
are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import random
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import let, packed, running, table, unpacked

LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
PROPOSED = ("address", "national", "number", "bank", "secret")
KINDS = BASE + PROPOSED
#: Proposed kinds: what a text must hold for the search to start, and the pattern.
GENERATORS = {
    "address": (r"(?i)[\[(\x20](?:at|@)[\])\x20]", r"(?i)(?<![a-z0-9._+-])[a-z0-9._+-]{2,}+(?:\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20)[a-z0-9-]{2,}+(?:(?:\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,}+)++"),
    "national": (r"[0-9][\x20./-][0-9]|\)", r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])"),
    "number": (r"[0-9]{3}", r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}[A-Z]|[0-9]{9,19})(?![0-9A-Za-z])"),
    "bank": (r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "secret": (r"[=:]|(?i:bearer)", r"(?<![A-Za-z0-9+/_.~@-])[A-Za-z0-9+/_.~-]{10,}+(?!@)"),
}
BEFORE, AFTER = 32, 4
SPAN = "struct<start:int,kind:int,end:int>"


def stretches(text: Column, pattern: str, keep, kind: int, wide: bool = False) -> Column:
    """Spans of the matches that ``keep`` holds for, with their surroundings if ``wide``.

    Places and surroundings come from the gaps between matches, never from the
    text's beginning, so a text takes time in proportion to its length.
    """
    item = "struct<start:int,kind:int,end:int,value:string,before:string,after:string>" if wide else SPAN

    def located(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: of_gaps(found, gaps))

    def of_gaps(found: Column, gaps: Column) -> Column:
        def fields(v: Column, i: Column) -> Column:
            after = [F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, AFTER).alias("after")] if wide else []
            return F.struct(F.get(gaps, i).alias("gap"), v.alias("value"), *after)

        def step(state: Column, x: Column) -> tuple[Column, Column]:
            start = (state["at"] if wide else state) + F.length(x["gap"])
            end = start + F.length(x["value"])
            out = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")]
            if wide:
                before = F.substring(F.concat(state["tail"], x["gap"]), -BEFORE, BEFORE)
                out += [x["value"].alias("value"), F.lower(before).alias("before"), x["after"].alias("after")]
                end = F.struct(end.alias("at"), F.substring(F.concat(before, x["value"]), -BEFORE, BEFORE).alias("tail"))
            return end, F.when(keep(x["value"]), F.array(F.struct(*out))).otherwise(none)

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")) if wide else F.lit(0)
        return let(F.transform(found, fields), lambda pairs: running(pairs, zero, item, step))

    none = F.array().cast(f"array<{item}>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = F.ascii(F.substring(d, i, F.lit(1))) - 48
            double = (F.length(d) - i) % 2 == 1
            return acc + F.when(double, 2 * n - F.when(n > 4, 9).otherwise(0)).otherwise(n)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(digits, lambda d: F.when(F.length(d).between(2, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def is_card(value: Column) -> Column:
    digits = digits_of(value)
    return F.when(F.length(value) <= 40, F.length(digits).between(12, 19) & luhn(digits)).otherwise(F.lit(False))


def is_ip(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> list[Column]:
    """An array of spans for each base kind."""
    holds = lambda what, spans: F.when(what, spans).otherwise(F.array().cast(f"array<{SPAN}>"))
    return [
        holds(F.contains(text, F.lit("@")), stretches(text, EMAIL, lambda v: F.lit(True), 0)),
        holds(text.rlike(r"[0-9]\.[0-9]"), stretches(text, IP, is_ip, 1)),
        holds(text.rlike(r"[0-9][\x20-]?[0-9]"), stretches(text, CARD, is_card, 2)),
        holds(F.contains(text, F.lit("+")), stretches(text, PHONE, lambda v: F.length(digits_of(v)).between(9, 15), 3)),
    ]


def candidates(text: Column) -> Column:
    """Proposed spans with their surroundings; they may overlap."""
    item = "struct<start:int,kind:int,end:int,value:string,before:string,after:string>"
    found = []
    for name, (gate, pattern) in GENERATORS.items():
        keep = (lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")) if name == "secret" else (lambda v: F.lit(True))
        found.append(F.when(text.rlike(gate), stretches(text, pattern, keep, KINDS.index(name), True)).otherwise(F.array().cast(f"array<{item}>")))
    return F.concat(*found)


#: Features of a candidate c with its digits d: name and condition.
def feature_columns(c: Column, d: Column) -> dict[str, Column]:
    value, before, after = c["value"], c["before"], c["after"]
    word = lambda words: before.rlike(rf"\b(?:{words})\b[^\n]{{0,14}}\z")
    out = {f"is_{k}": c["kind"] == KINDS.index(k) for k in PROPOSED}
    out |= {
        "long": F.length(value) >= 16,
        "very_long": F.length(value) >= 32,
        "digits_9": F.length(d) >= 9,
        "digits_10_13": F.length(d).between(10, 13),
        "digits_15_16": F.length(d).between(15, 16),
        "luhn": luhn(d),
        "hex": value.rlike(r"\A[0-9a-f]+\z"),
        "mixed_case": value.rlike("[a-z]") & value.rlike("[A-Z]"),
        "dotted": F.contains(value, F.lit(".")),
        "slashed": F.contains(value, F.lit("/")),
        "brackets": value.rlike(r"[\[(]"),
        "ssn_shape": value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"),
        "date_shape": value.rlike(r"\A(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})"),
        "round": value.rlike(r"000"),
        "says_phone": word("phone|tel|telephone|mobile|cell|call|fax|telefon|handy|téléphone|portable|appelez|teléfono|móvil|llame"),
        "says_mail": word("e-?mail|mail|contact|write|reach|kontakt|contacto|courriel|correo"),
        "says_secret": before.rlike(r"(?:password|passwd|passwort|contraseña|pwd|token|secret|api[_-]?key|access[_-]?key|auth|bearer)\s*[=:]?\s*[\x22'`(]?\z"),
        "says_number": word("ssn|social security|passport|dni|nif|national id|tax id|ausweis|insurance|sécurité sociale"),
        "says_bank": word("iban|account|konto|compte|cuenta|bank"),
        "says_card": word("card|visa|mastercard|credit|karte|carte|tarjeta"),
        "says_other": word("order|invoice|version|ref|reference|page|pages|isbn|sku|item|part|chapter|section|figure|table|ticket|build|serial|tracking|bestellung|rechnung|seite|commande|facture|pedido|factura|página"),
        "currency": before.rlike(r"(?:[$€£#]|usd|eur)\s?\z"),
        "assigned": before.rlike(r"[=:]\s*[\x22'`(]?\z"),
        "unit_after": after.rlike(r"\A\s?(?:%|€|\$|kg|km|mm|cm)"),
        "goes_on": after.rlike(r"\A[/_=]"),
    }
    return out




class Node(NamedTuple):
    """A split on a feature, or (feature -1) a leaf."""

    feature: int
    yes: object
    no: object
    value: float


class Model(NamedTuple):
    names: list[str]
    trees: list[Node]
    cuts: dict[str, float]


def snippets(seed: int = 3, n: int = 160) -> list[tuple[str, str, int]]:
    """(text, value, label): labelled sentences around one value, from fixed formats."""
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    text = lambda a, k: "".join(r.choice(a) for _ in range(k))
    letters, hexa, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    filler = "the of and one that was with from there after time people place made water long found still learn und der die nicht avec pour dans para como".split()
    some = lambda: " ".join(r.choice(filler) for _ in range(r.randint(1, 5)))
    secret_value = lambda: text(hexa, pick([16, 18, 20, 32, 40])) if r.random() < 0.6 else text(mixed, r.randint(14, 40))
    national = lambda: pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"[:14]])
    address = lambda: pick(["{a} [at] {b} [dot] {c}", "{a} (at) {b}.{c}", "{a} at {b} dot {c}", "{a}[at]{b}.{c}"]).format(a=text(letters, r.randint(3, 9)) + pick(["", "." + num(2)]), b=text(letters, r.randint(4, 9)), c=pick(["com", "org", "net", "de", "fr"]))
    iban = lambda: pick(["DE", "FR", "ES", "GB", "NL"]) + num(2) + " " + " ".join(num(4) for _ in range(4)) + " " + num(2)
    good = [
        (("phone", "call", "tel:", "mobile", "fax", "Telefon", "téléphone", "teléfono"), national),
        (("email", "contact", "write to", "mail", "kontakt", ""), address),
        (("SSN", "social security number", "passport no.", "DNI", "tax id"), lambda: pick([f"{num(3)}-{num(2)}-{num(4)}", num(8) + pick("ABCDEFGH"), num(9)])),
        (("IBAN", "account", "bank account", "Konto", "cuenta", ""), iban),
        (("password=", 'token = "', "secret: ", "api_key=", "passwd: ", 'access_key="', "Bearer "), secret_value),
        (("card", "credit card", "visa", "tarjeta"), lambda: num(16)),
        (("password=", 'token = "', "secret: ", "token:\n", "api_key=\t", "secret = `", "Bearer "), lambda: pick([text(mixed, r.randint(180, 500)), f"{text(mixed, 36)}.{text(mixed, r.randint(100, 400))}.{text(mixed, 43)}"])),
    ]
    bad = [
        (("on", "since", "dated", "until"), lambda: pick([f"{pick(['19', '20'])}{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"1{num(1)}.0{r.randint(1, 9)}.20{num(2)}", f"{num(2)} {num(3)} {num(3)}"])),
        (("order", "invoice", "ref", "ticket", "serial", "tracking", "commande", "pedido", ""), lambda: pick([num(9), num(12), num(10), f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", num(16)])),
        (("version", "build", "page", "section"), lambda: pick([f"{num(2)}.{num(2)}.{num(2)}", f"{num(2)} {num(2)} {num(2)}"])),
        (("", "$", "€", "about"), lambda: pick([f"{num(2)} 000 000", num(9), f"{num(3)} {num(3)} {num(3)}"])),
        (("meet me", "look", "arrive"), lambda: f"{text(letters, 5)} at {text(letters, 6)}.{text(letters, 4)}"),
        (("see http:", "path=", "class=", "id: ", "file ", "name: "), lambda: pick([text(letters, 8) + "-" + text(letters, 6) + num(2), "section-" + num(2) + "-overview", text(letters, 12) + num(1), "img_" + num(4) + ".png"])),
        (("code", "model", ""), lambda: pick([f"AB{num(2)} {text('ABCDEFGH', 4)} {text('ABCDEFGH', 4)}", text("ABCDEF", 2) + num(2) + text(mixed, 10)])),
        (("commit ", "sha1: ", "hash "), lambda: text(hexa, 40)),
        (("see http:", "path=", "file ", "\n", "(", ""), lambda: "/".join(text(letters, r.randint(3, 9)) for _ in range(r.randint(2, 40))) + pick(["/", "-", "."]) + text(letters, 5) + num(2)),
    ]
    rows = []
    for label, kinds in ((1, good), (0, bad)):
        for says, make in kinds:
            for _ in range(n):
                say, value = pick(says), make()
                gap = "" if say[-1:] in ('=', '"', "$", "€", " ", "", "\n", "\t", "`", "(") else " "
                rows.append((f"{some()} {say}{gap}{value}{pick(['', '.', ',', ' ' + some()]) if label or r.random() < 0.9 else ' %'}", value, label))
    return rows


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    """A regression tree on yes-or-no features by second-order gain."""
    value = float(-grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 12:
        return Node(-1, None, None, value)
    g1, h1 = grad @ x, hess @ x
    g0, h0 = grad.sum() - g1, hess.sum() - h1
    gain = g1**2 / (h1 + 1) + g0**2 / (h0 + 1) - grad.sum() ** 2 / (hess.sum() + 1)
    gain[(x.sum(axis=0) < 4) | (len(x) - x.sum(axis=0) < 4)] = -1
    k = int(gain.argmax())
    if gain[k] < 1e-3:
        return Node(-1, None, None, value)
    yes = x[:, k] > 0
    return Node(k, grow(x[yes], grad[yes], hess[yes], depth - 1), grow(x[~yes], grad[~yes], hess[~yes], depth - 1), value)


def leaf_values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] > 0, leaf_values(node.yes, x), leaf_values(node.no, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 4, rate: float = 0.4) -> list[Node]:
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, p * (1 - p), depth)
        trees.append(scaled(tree, rate))
        score += leaf_values(trees[-1], x)
    return trees


def scaled(node: Node, rate: float) -> Node:
    if node.feature < 0:
        return node._replace(value=round(node.value * rate, 5))
    return node._replace(yes=scaled(node.yes, rate), no=scaled(node.no, rate))


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float = 0.99) -> float:
    """The least score above which this share of rows is right."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(scores[order][1:] != scores[order][:-1], True)
    good = np.flatnonzero(ends & (right >= precision))
    return max(0.0, float(scores[order][good[-1]]) - 1e-6) if len(good) else 1e9


def train(spark: SparkSession, precision: float = 0.99) -> Model:
    """Trees and thresholds from the labelled snippets."""
    rows = snippets()
    frame = spark.createDataFrame(rows, "text string, value string, label int")
    found = frame.select("text", "value", "label", F.explode(candidates(F.col("text"))).alias("c"))
    c, d = F.col("c"), digits_of(F.col("c.value"))
    features = feature_columns(c, d)
    names = list(features)
    seen = found.select("text", "value", "label", c["kind"].alias("kind"), c["value"].alias("got"), F.array(*[F.coalesce(f, F.lit(False)).cast("int") for f in features.values()]).alias("x")).collect()
    x = np.array([r["x"] for r in seen], dtype=float)
    y = np.array([float(r["label"] and r["got"].strip(".") in r["value"] and len(r["got"]) * 5 >= len(r["value"]) * 4) for r in seen])
    kind = np.array([KINDS[r["kind"]] for r in seen])
    part = np.array([sum(map(ord, r["text"])) % 3 for r in seen])
    trees = boost(x[part < 2], y[part < 2])
    scores = sum(leaf_values(t, x) for t in trees)
    cuts = {k: calibrate(scores[(kind == k) & (part == 2)], y[(kind == k) & (part == 2)], precision) if ((kind == k) & (part == 2)).any() else 1e9 for k in PROPOSED}
    return Model(names, trees, cuts)


def tree_column(node: Node, held: Column) -> Column:
    """The tree's value for an array of features."""
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(F.get(held, F.lit(node.feature)), tree_column(node.yes, held)).otherwise(tree_column(node.no, held))


def selected(text: Column, model: Model) -> Column:
    """Proposed spans whose score reaches their kind's threshold."""

    def passes(c: Column) -> Column:
        def scored(held: Column) -> Column:
            total = reduce(lambda a, b: a + b, [tree_column(t, held) for t in model.trees])
            cut = reduce(lambda a, k: F.when(c["kind"] == KINDS.index(k), F.lit(model.cuts[k])).otherwise(a), PROPOSED, F.lit(1e9))
            return total >= cut

        return let(digits_of(c["value"]), lambda d: let(F.array(*[F.coalesce(f, F.lit(False)) for f in feature_columns(c, d).values()]), scored))

    return F.transform(F.filter(candidates(text), passes), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with base (an array of spans for each base kind) and spans (all spans in order)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("pii_base", F.array(*base_spans(text)))

    def all_spans(flat: Column) -> Column:
        mark = lambda spans, proposed: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(proposed).alias("proposed"), s["kind"].alias("kind"), s["end"].alias("end")))
        none = F.array().cast(f"array<{SPAN}>")

        def step(reach: Column, s: Column) -> tuple[Column, Column]:
            """A proposed span goes if a base span that starts no later reaches its end."""
            keep = s["proposed"] & (s["end"] > reach)
            return F.when(s["proposed"], reach).otherwise(F.greatest(reach, s["end"])), F.when(keep, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).otherwise(none)

        def merged(more: Column) -> Column:
            outside = let(F.sort_array(F.concat(mark(flat, False), mark(more, True))), lambda every: running(every, F.lit(0), SPAN, step))
            return F.when(F.size(more) == 0, F.sort_array(flat)).otherwise(F.sort_array(F.concat(flat, outside)))

        return let(selected(text, model), merged)

    return base.withColumn("pii_spans", let(F.flatten("pii_base"), all_spans))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: Code points of the pieces out of which the stretches between spans are cut.
PIECE = 4096


def stretch(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text whose pieces are given."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), a % PIECE + 1, F.when(first == last, b - a).otherwise(F.lit(PIECE)))
    more = F.concat(F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.coalesce(F.substring(F.get(pieces, last), F.lit(1), b % PIECE), F.lit("")))
    return F.when(a >= b, F.lit("")).when(first == last, head).otherwise(F.concat(head, more))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets (overlapping spans by the first one's)."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    text = F.col("text")
    item = "struct<at:int,start:int,kind:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        new = F.array(F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, new).otherwise(F.array().cast(f"array<{item}>"))

    def clean(pieces: Column) -> Column:
        parts = F.transform(running(F.col("pii_spans"), F.lit(0), item, step), lambda x: F.concat(stretch(pieces, x["at"], x["start"]), F.lit("["), F.get(names, x["kind"]), F.lit("]")))
        rest = stretch(pieces, F.array_max(F.transform("pii_spans", lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    found = find(packed(docs, "text"), model)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return unpacked(found, docs.columns, text=F.when(F.size("pii_spans") == 0, text).otherwise(let(pieces, clean)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), train(spark))
    base = F.col("pii_base")
    return found.select(
        "doc_id",
        *[F.size(F.get(base, F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(written(F.sort_array(F.flatten(base))), 256).alias("base_sha256"),
        written(F.col("pii_spans")).alias("spans"),
    )
