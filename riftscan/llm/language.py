"""Language identification with language-bitmask n-gram filters (operator 1).

Training counts letter n-grams of each language. An n-gram belongs to a
language if its rate there reaches ``MIN_RATE`` and ``SHARE`` of its highest
rate in any language. All n-grams go into one bit-sliced Bloom filter: each
position holds a bit mask of languages, and the conjunction of an n-gram's
positions is the set of languages that contain it. A text's bits are counted
for each language, the count that false positives alone would give is taken
off, and the largest count decides.

The filter's size is fixed (``POSITIONS`` masks), a language has at most
1 / ``MIN_RATE`` n-grams, and at most about ``SAMPLE`` training rows are read,
the same number for each language, or all its rows if there are fewer (chosen
by a hash of id and text); counting is distributed. Prediction covers whole
texts of all rows and uses the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0;
a text that meets no known n-gram gets the language with most training rows,
score 0; ties go to the first language by name; without training rows every
text is ``und``; a very long text is read as a whole; repeated rows get equal
results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, table, text_slices
from riftscan.llm.letters import grams, letters
from riftscan.llm.shingles import mix

GRAM = 4
SAMPLE = 20_000
MIN_RATE = 5e-6
SHARE = 0.1
POSITIONS = 1 << 21
HASHES = 4
UNKNOWN = "und"
_U = np.uint64


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # (positions, words of 64 languages)
    common: int

    def false_rate(self) -> np.ndarray:
        rates = []
        for k in range(len(self.languages)):
            column = self.masks[:, k // 64]
            rates.append(float(((column >> _U(k % 64)) & _U(1)).mean()) ** HASHES)
        return np.array(rates)


def positions(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    second = mix(hashes) | _U(1)
    return [((hashes + _U(k) * second) % _U(size)).astype(np.int64) for k in range(HASHES)]


def build(pairs: list[tuple[int, np.ndarray]], languages: list[str], common: int, size: int = POSITIONS) -> Filters:
    masks = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=_U)
    for k, hashes in pairs:
        for at in positions(hashes, size):
            masks[at, k // 64] |= _U(1) << _U(k % 64)
    return Filters(languages, masks, common)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n for each batch of training rows."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        names, which = np.unique(langs.astype(str), return_inverse=True)
        for first, data, offsets in text_slices(batch, "text"):
            h, t = grams(*letters(data, offsets), GRAM)
            for k in np.unique(which[first : first + len(offsets) - 1]):
                g, n = np.unique(h[which[first + t] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from at most about ``sample`` rows of ``docs`` that have a language."""
    rows = docs.where("lang is not null").select("doc_id", "text", "lang")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language; texts are not read
    if not per_lang:
        return build([], [], 0, 64)
    languages = sorted(per_lang)
    cuts = [(name, int(np.ceil(min(1.0, sample / len(languages) / n) * (1 << 40)))) for name, n in per_lang.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut bigint"))
    chosen = bounded(rows).where("text is not null").join(shares, "lang").where(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 40)) < F.col("cut"))
    counts = chosen.mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= MIN_RATE)
    tops = rates.groupBy("gram").agg(F.max(F.struct("rate")).alias("top"), F.collect_list(F.struct("lang", "rate")).alias("in"))
    known = tops.select("gram", F.explode(F.filter("in", lambda x: x["rate"] >= SHARE * F.col("top.rate"))).alias("x")).select("x.lang", "gram").toPandas()
    pairs = [(languages.index(name), part["gram"].to_numpy().view(_U)) for name, part in known.groupby("lang")]
    return build(pairs, languages, languages.index(max(sorted(per_lang), key=per_lang.get)))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    names, common, rates = np.array([*filters.languages, UNKNOWN], dtype=object), filters.common, filters.false_rate()
    shared = docs.sparkSession.sparkContext.broadcast(filters.masks)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = shared.value
        unknown = len(names) - 1
        for batch in batches:
            for first, data, offsets in text_slices(batch, "text"):
                codes, heads = letters(data, offsets)
                h, t = grams(codes, heads, GRAM)
                m = len(offsets) - 1
                some = np.add.reduceat(codes != 0, heads[:-1]) > 0
                total = np.bincount(t, minlength=m)
                found = None
                for at in positions(h, len(masks)):
                    found = masks[at] if found is None else found & masks[at]
                hits = np.zeros((m, max(1, unknown)))
                for k in range(unknown):
                    hits[:, k] = np.bincount(t, weights=((found[:, k // 64] >> _U(k % 64)) & _U(1)).astype(float), minlength=m)
                    hits[:, k] = (hits[:, k] - total * rates[k]) / (1 - rates[k])
                best = hits.argmax(axis=1)
                top = hits[np.arange(m), best]
                pick = np.where(some & (unknown > 0), np.where(top > 0, best, common), unknown)
                score = np.where(some & (top > 0) & (unknown > 0), np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, m), pa.array(names[pick], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    filters = train(docs.where(part != 1).select("doc_id", "text", "lang"))
    return identify(docs, filters).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
