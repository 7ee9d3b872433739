"""Toxicity by a counterfactually regularised classifier (operator 5).

A logistic model over the words and word beginnings that a text holds. Its
features are those that labelled toxic texts hold significantly more often
than clean ones, and those of all ``IDENTITY_TERMS``, whether texts hold them
or not. Every labelled text is paired with counterfactuals: a mention of a
group of people is swapped for other groups, and a text without one gets a
mention. The squared change of the score is penalised in training, so weights
that would tell groups apart, or a mention from none, are driven to zero and
neutral mentions don't raise the score.

At most about ``SAMPLE`` labelled rows are read (chosen by a hash of doc_id),
which bounds the features too; counting and scoring are distributed, the fit
runs on the driver over the features that the sample's texts hold. Scores
cover whole texts of all rows and use the text alone; words of any length
count by all their letters.

Defined results: a null text is empty; an empty text holds no feature and
gets the model's base score; without labels of both kinds every score is 0;
a very long text is scored as a whole; repeated rows get equal scores; equal
scores stay equal (there is no order); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, cut, table, text_slices
from riftscan.llm.letters import letters, word_features

SAMPLE = 12_000
MIN_TEXTS = 3
MIN_G2 = 13.0
SWAPS = 6
SWAP_PENALTY = 10.0
#: Inverse variance of a weight before any text is seen: what few texts say counts for less.
RIDGE = 0.2
ROUNDS = 600
#: Words that name groups of people, in the languages at hand.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews jewish muslim christian hindu buddhist atheist black white asian latino african european american arab gay lesbian bisexual transgender straight "
    "disabled deaf blind elderly young immigrants refugees foreigners "
    "frauen männer muslime christen juden jüdisch schwarze weiße asiaten schwule lesben behinderte ausländer flüchtlinge "
    "femmes hommes musulmans chrétiens juifs noirs blancs arabes handicapés immigrés réfugiés étrangers "
    "mujeres hombres musulmanes cristianos judíos negros blancos árabes gitanos discapacitados inmigrantes refugiados extranjeros"
).split()


def features_of(texts: list[str]) -> list[np.ndarray]:
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, t = word_features(*letters(data, offsets))
    return [h[t == k] for k in range(len(texts))]


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
        for first, data, offsets in text_slices(batch, "text"):
            h, t = word_features(*letters(data, offsets))
            known, which = np.unique(h, return_inverse=True)
            bad = np.bincount(which, weights=toxic[first + t], minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(bad), pa.array(np.bincount(which, minlength=len(known)) - bad)], ["feature", "bad", "good"])


def held_features(features: np.ndarray):
    """doc_id, toxic and the numbers of the given features that each text holds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch, "text"):
                m = len(offsets) - 1
                which, t = lookup(features, *word_features(*letters(data, offsets)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=m))]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(which))
                part = batch.slice(first, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), held], ["doc_id", "toxic", "held"])

    return of


def lookup(features: np.ndarray, h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(features, h), max(0, len(features) - 1))
    known = features[at] == h if len(features) else np.zeros(len(h), dtype=bool)
    return at[known].astype(np.int64), t[known]


def counterfactuals(held: list[list[int]], identity: list[list[int]], swaps: int = SWAPS) -> dict[tuple[tuple[int, float], ...], int]:
    """How often each change of features occurs: for each text, mentions of groups out and others in.

    A text that mentions groups has each mention swapped for ``swaps`` others;
    any other text has ``swaps`` mentions put in. Terms take turns.
    """
    terms = [t for t in map(sorted, map(set, identity)) if t]
    seen: dict[tuple[tuple[int, float], ...], int] = defaultdict(int)
    for i, h in enumerate(held if terms else []):
        has = set(h)
        said = [t for t in terms if has.issuperset(t)]
        for out in said or [[]]:
            left = has.difference(out)
            for s in range(swaps):
                new = left.union(terms[(i * swaps + s) % len(terms)])
                change = tuple(sorted([(f, 1.0) for f in new - has] + [(f, -1.0) for f in has - new]))
                if change:
                    seen[change] += 1
    return dict(seen)


def fit(held: list[list[int]], toxic: np.ndarray, n_features: int, identity: list[list[int]]) -> tuple[np.ndarray, float]:
    """Weights and bias. ``identity``: the features of each identity term."""
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    col = np.array([f for h in held for f in h], dtype=np.int64)
    changes = counterfactuals(held, identity)
    d_row = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    d_col = np.array([f for c in changes for f, _ in c], dtype=np.int64)
    d_val = np.array([v for c in changes for _, v in c])
    often = np.array(list(changes.values()), dtype=np.float64)
    n = len(held)
    w, b = np.zeros(n_features), float(np.log((toxic.sum() + 0.5) / (n - toxic.sum() + 0.5)))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(row, weights=w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        grad = np.bincount(col, weights=error[row], minlength=n_features) + RIDGE * w / n
        if len(often):
            change = often * np.bincount(d_row, weights=d_val * w[d_col], minlength=len(often))
            grad += 2 * SWAP_PENALTY / often.sum() * np.bincount(d_col, weights=d_val * change[d_row], minlength=n_features)
        g = np.append(grad, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled rows of ``docs``."""
    labels = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    # About ``sample`` rows, kept: they are read twice, and finding them takes a pass over all texts.
    rows = cut(bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"))
    sums = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sums.get(1, 0), sums.get(0, 0)
    nothing = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -30.0)
    if not n_bad or not n_good:
        return nothing
    counts = rows.mapInArrow(count_features, "feature bigint, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    all_ = F.lit(n_bad + n_good)
    df = F.col("bad") + F.col("good")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (term(F.col("bad"), df * n_bad / all_) + term(F.col("good"), df * n_good / all_) + term(n_bad - F.col("bad"), (all_ - df) * n_bad / all_) + term(n_good - F.col("good"), (all_ - df) * n_good / all_))
    telling = counts.where((F.col("bad") >= MIN_TEXTS) & (F.col("bad") * n_good > 2 * F.col("good") * n_bad)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    terms = features_of(IDENTITY_TERMS)
    found = np.array([r["feature"] for r in telling.select("feature").collect()], dtype=np.int64).view(np.uint64)
    features = np.unique(np.concatenate([found, *terms]))
    held = rows.mapInArrow(held_features(features), "doc_id bigint, toxic int, held array<bigint>").collect()
    held.sort(key=lambda r: (r["doc_id"], len(r["held"])))
    identity = [lookup(features, h, np.zeros(len(h), dtype=np.int64))[0].tolist() for h in terms]
    weights, bias = fit([list(r["held"]) for r in held], np.array([float(r["toxic"]) for r in held]), len(features), identity)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    features, weights, bias = model.features, model.weights, model.bias

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch, "text"):
                m = len(offsets) - 1
                which, t = lookup(features, *word_features(*letters(data, offsets)))
                z = bias + np.bincount(t, weights=weights[which], minlength=m)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, m), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(of, "doc_id bigint, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, labels.where(part != 0))
    return score(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
