"""Removal of repeated byte strings by bucket-pointer refinement (operator 7).

A byte goes if a string of 200 bytes that covers it also starts anywhere else
in the corpus. Strings are sorted into buckets of ever longer ones, as in the
suffix-array construction by bucket pointers:

1. Initial buckets are 64-byte grams; a bucket's identifier is its gram's hash.
2. The identifier of a string of twice the length is made from the pair (own
   bucket, bucket at the later offset h), and from these pairs in turn: 64,
   128, 256 bytes. A length between two steps takes two overlapping pointers
   of the lower one (200 bytes: those of 128 bytes at offsets 0 and 72).
   Strings are compared by (bucket, pointer) alone; the text is never read again.
3. Buckets that hold one string are dropped, buckets whose strings all have
   equal pointers are settled, and only the others are refined further.

A row for each byte would be far more than the corpus, so only some starts are
rows. Each 200-byte window belongs to the gram of least hash inside it (the
last of equals), which depends on the window's bytes alone: equal windows are
in one bucket at one offset, so no window is lost. Consecutive windows of one
gram are a run (about 60 windows); a run is refined by the pointers of all that
its windows cover, then, if its bucket is still in doubt, by blocks of 16
windows, then window by window. Identifiers made in one round name the buckets
of the next. They are 64 bits and always compared together with their
bucket's own, so two different strings are taken as equal with a chance of
about 1 in 2 ** 128 for each pair. Every window of every text is judged on the
input.

Rows of equal texts are copies, judged alike under one uid. A bucket is first
known by its count and its least and greatest pointer alone, which are combined
within each task before the shuffle; a common gram is never gathered, and joins
on a bucket shuffle both sides, so that adaptive execution can split it. Texts
are shuffled only to places that are in doubt or go.

Defined results: a null or short text loses nothing; a very long text is one
row like any other; repeated rows count as other places; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, cut, table, text_slices
from riftscan.llm.shingles import INVERSE, mix, powers, running

LENGTH = 200
GRAM = 64
STEP = 16
#: Names of texts are broadcast, to leave other texts where they are, up to this size.
BROADCAST_BYTES = 48_000_000
_U = np.uint64
_LOW = _U(0xFFFFFF)
_PAIR = _U(0x9FB21C651E98DF25)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - have : width - have + n]) if have < width else out


def gram_buckets(data: np.ndarray, gram: int) -> np.ndarray:
    """Identifier of the initial bucket at each offset."""
    sums = running(data)
    return mix((sums[gram:] - sums[:-gram]) * powers(INVERSE, len(data) + 1)[: len(data) - gram + 1])


def pointers(grams: np.ndarray, gram: int, at: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of the strings of ``gram * 2 ** step`` bytes at ``at``: own bucket and the bucket at the later offset."""
    if step == 0:
        return grams[at]
    return mix(pointers(grams, gram, at, step - 1) * _PAIR + pointers(grams, gram, at + (gram << (step - 1)), step - 1))


def named(grams: np.ndarray, gram: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Identifiers of the strings ``start`` to ``stop``, of ``gram`` bytes at least, by two pointers that cover them."""
    out = np.zeros(len(start), dtype=_U)
    steps = np.frexp((stop - start) // gram)[1] - 1  # the greatest step whose strings fit
    for step in np.unique(steps).tolist():
        some = np.flatnonzero(steps == step)
        a, b = start[some], stop[some]
        out[some] = mix(pointers(grams, gram, a, step) * _PAIR + pointers(grams, gram, b - (gram << step), step) + (b - a).astype(_U))
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Bucket, pointer of its whole context, text number, first window, windows, and gram's offset from it, of each run."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (_U, _U, np.int64, np.int64, np.int64, np.int64))
    grams = gram_buckets(data, gram)
    key = (grams & ~_LOW) | (_LOW - (np.arange(n - gram + 1, dtype=_U) & _LOW))  # of equal grams the last
    least = sliding_min(key, length - gram + 1)
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    long_enough = ends - starts >= length
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    other = least[1:] != least[:-1]
    edges = np.zeros(len(valid), dtype=bool)
    edges[starts[long_enough]] = True  # a run never goes on into the next text
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~valid[:-1] | other | edges[1:]
    last[:-1] &= ~valid[1:] | other | edges[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    gram_at = lo + (((_LOW - (least[lo] & _LOW)).astype(np.int64) - lo) & 0xFFFFFF)
    context = mix(named(grams, gram, lo, hi + length) + (gram_at - lo).astype(_U))
    text = np.searchsorted(offsets, lo, side="right") - 1
    return grams[gram_at], context, text, lo - offsets[text], hi - lo + 1, gram_at - lo


def emit(names: str, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == _U else a.astype(np.int64, copy=False)) for a in arrays], names.split())


def bucket_rows(length: int, gram: int):
    """bucket, n, low, high: number of runs, least and greatest context of each bucket of a batch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [runs(data, offsets, length, gram)[:2] for _, data, offsets in text_slices(batch, "text", 1 << 19)]
            if not held:
                continue
            bucket, context = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, context = bucket[order], context[order].view(np.int64)
            new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
            if len(new):
                yield emit("bucket n low high", bucket[new], np.diff(np.append(new, len(bucket))), np.minimum.reduceat(context, new), np.maximum.reduceat(context, new))

    return of


def run_rows(length: int, gram: int):
    """bucket, context, uid, place of each run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch, "text", 1 << 19):
                bucket, context, text, lo, n, off = runs(data, offsets, length, gram)
                yield emit("bucket context uid place", bucket, context, uids[first + text], lo << 20 | off << 10 | n)

    return of


def flat(column: pa.Array, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``rows`` lists, and the row that each is in."""
    part = column.slice(first, rows)
    sizes = np.diff(part.offsets.to_numpy())
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(rows), sizes)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 1): owners (0, 0, 1) and positions (0, 1, 0)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def block_rows(length: int, gram: int, step: int):
    """bucket, context, uid, place of each block of ``step`` windows of the runs in doubt."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch, "text", 1 << 19):
                place, row = flat(batch.column("places"), first, len(offsets) - 1)
                bucket, _ = flat(batch.column("buckets"), first, len(offsets) - 1)
                if not len(place):
                    continue
                lo, off, n = offsets[row] + (place >> 20), place >> 10 & 1023, place & 1023
                gram_at = lo + off
                low, high = (off - n + 1) // step, off // step  # distance of a window's start from its gram, in blocks
                owner, k = spread(high - low + 1)
                b = low[owner] + k
                far = np.minimum(off[owner], b * step + step - 1)
                near = np.maximum((off - n + 1)[owner], b * step)
                at = gram_at[owner]
                grams = gram_buckets(data, gram)
                common = named(grams, gram, at - b * step, at - b * step - (step - 1) + length)
                name = mix(bucket.view(_U)[owner] + mix(common + b.astype(_U)))
                context = mix(named(grams, gram, at - far, at - near + length) + far.astype(_U))
                local = (at - far - offsets[row[owner]]) << 10 | (far - near + 1)
                yield emit("bucket context uid place", name, context, uids[first + row[owner]], local)

    return of


def window_rows(length: int, gram: int):
    """bucket, context, uid, place of each window of the blocks in doubt."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch, "text", 1 << 19):
                place, row = flat(batch.column("places"), first, len(offsets) - 1)
                bucket, _ = flat(batch.column("buckets"), first, len(offsets) - 1)
                if not len(place):
                    continue
                owner, k = spread(place & 1023)
                local = (place >> 10)[owner] + k
                at = offsets[row[owner]] + local
                grams = gram_buckets(data, gram)
                yield emit("bucket context uid place", bucket[owner], named(grams, gram, at, at + length), uids[first + row[owner]], local << 10 | 1)

    return of


def with_uid(docs: DataFrame) -> DataFrame:
    """uid is that of the text; rows of equal texts share it."""
    return docs.withColumn("uid", F.xxhash64(F.md5(F.coalesce("text", F.lit("")))))


def by_uid(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows joined with the lists of their text, and the rows that have none.

    Only rows that have a list are shuffled with their text, as long as the
    uids alone (not the lists) are within the bound of a broadcast.
    """
    keys = lists.select("uid")
    if 40 * keys.count() > BROADCAST_BYTES:
        every = docs.join(lists, "uid", "left")
        return every.where("places is not null"), every.where("places is null").drop("buckets", "places")
    keys = F.broadcast(keys)
    return docs.join(keys, "uid", "left_semi").join(lists, "uid"), docs.join(keys, "uid", "left_anti")


def fresh(column: str) -> Column:
    """A constant grouping key: the result is partitioned by it too, so that a join without it shuffles this side anew and can split the other's hot partitions."""
    return F.pmod(column, F.lit(1)).alias("fresh")


def lists_of(rows: DataFrame) -> DataFrame:
    """buckets and places of each uid; a text's places are at most its windows."""
    pairs = rows.groupBy("uid").agg(F.collect_set(F.struct("bucket", "place")).alias("all"))
    return cut(pairs.select("uid", F.col("all.bucket").alias("buckets"), F.col("all.place").alias("places")))


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """uid, places: first windows and numbers of windows (first << 10 | n) that occur elsewhere too."""
    if not 0 < gram <= length - step or length - gram >= 1023:
        raise ValueError("gram must be shorter than length, by a block at least and by less than 1023")
    texts = with_uid(bounded(docs).select("text")).where(F.octet_length("text") >= length).select("uid", "text")
    combined = texts.mapInArrow(bucket_rows(length, gram), "bucket bigint, n bigint, low bigint, high bigint")
    known = combined.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    buckets = cut(known.where("n > 1").select("bucket", (F.col("low") == F.col("high")).alias("same")))

    schema = "bucket bigint, context bigint, uid bigint, place bigint"
    live = cut(texts.mapInArrow(run_rows(length, gram), schema).join(buckets, "bucket"))
    windows_of = F.expr("shiftleft(shiftright(place, 20), 10) | (place & 1023)").alias("place")
    settled = [live.where("same").select("uid", windows_of)]
    mixed = live.where("not same")
    contexts = cut(mixed.groupBy("bucket", "context").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place")).alias("one")))
    settled.append(mixed.join(contexts.where("n > 1").select("bucket", "context"), ["bucket", "context"]).select("uid", windows_of))

    # What one of equal runs is found to share is settled for all of them already: one for each context goes on.
    doubt = lists_of(contexts.select("bucket", "one.uid", "one.place"))
    blocks = by_uid(texts, doubt)[0].select("uid", "text", "buckets", "places").mapInArrow(block_rows(length, gram, step), schema)
    blocks = cut(blocks)
    names = blocks.groupBy("bucket", fresh("bucket")).agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("z")).where("n > 1").drop("fresh")
    found = cut(blocks.join(names, "bucket").select("bucket", "uid", "place", (F.col("a") == F.col("z")).alias("same")))
    settled.append(found.where("same").select("uid", "place"))

    doubt = lists_of(found.where("not same"))
    windows = cut(by_uid(texts, doubt)[0].select("uid", "text", "buckets", "places").mapInArrow(window_rows(length, gram), schema))
    again = windows.groupBy("bucket", "context", fresh("bucket")).agg(F.count("*").alias("n")).where("n > 1").select("bucket", "context")
    settled.append(windows.join(again, ["bucket", "context"]).select("uid", "place"))

    every = reduce(DataFrame.unionByName, settled)
    return cut(every.groupBy("uid").agg(F.collect_set("place").alias("places")))


def spans(places: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (start, stop) of bytes that windows of ``places`` cover."""
    lo = np.sort(places)
    start, stop = lo >> 10, (lo >> 10) + (lo & 1023) - 1 + length
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([start[at], reach[np.concatenate([at[1:] - 1, [len(lo) - 1]])]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: str = "bytes") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what stays: its bytes, or ("sha256") their digest."""
    if kept not in ("bytes", "sha256"):
        raise ValueError(kept)
    places = repeated_places(docs, length, gram)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch, "text"):
                m = len(offsets) - 1
                lists = batch.column("places").slice(first, m)
                removed, n_spans, left = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), []
                for k in range(m):
                    text = data[offsets[k] : offsets[k + 1]]
                    if lists[k].is_valid:
                        cover = spans(lists[k].values.to_numpy(zero_copy_only=False), length)
                        removed[k], n_spans[k] = (cover[:, 1] - cover[:, 0]).sum(), len(cover)
                        ends = np.concatenate([[0], cover.reshape(-1), [len(text)]])
                        stays = b"".join(text[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2]))
                    else:
                        stays = text.tobytes()
                    left.append(stays if kept == "bytes" else hashlib.sha256(stays).hexdigest())
                ids = batch.column("doc_id").slice(first, m)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), pa.array(left, pa.binary() if kept == "bytes" else pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    some, rest = by_uid(with_uid(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), places)
    rows = some.select("doc_id", "text", "places").unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("places")))
    return rows.mapInArrow(apply, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'binary' if kept == 'bytes' else 'string'}")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), kept="sha256").withColumnRenamed("kept", "kept_sha256")
