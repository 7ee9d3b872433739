"""Packing of tokenized documents into sequences (operator 2).

First-fit decreasing with a tournament tree of bin capacities, run
independently in randomised groups of documents. A document is cut only at
multiples of the sequence length; whole pieces fill a bin of their own and the
rest of each document is placed by first fit, longest first. Groups are dealt
by a seeded hash of doc_id and text, about ``group_docs`` documents each
whatever the size of the corpus, so no task grows with the input; null or
repeated ids are spread by their texts.

Defined results: a null or empty text is the end token alone; a very long text
is tokenized in stretches of 4 MiB that end at white space; repeated rows (same
id and text) are packed like any others, in one group; equal lengths are placed by doc_id, then start
(nulls first); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, table, text_slices

CAPACITY = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Words whose ids a worker keeps in each of two generations.
CACHE_WORDS = 300_000
#: Marks that end a word without becoming one with it (an apostrophe could).
MARKS = "!#$%&*+,-./:;=?@_|~)]}\""
#: Bytes of text whose words are looked up together.
STRETCH = 1 << 22
#: Letters that stand for bytes above 0x7F in the model's vocabulary: those bytes that are no printable Latin-1 letter follow at 0x100.
BYTE_LETTERS = {b: chr(0x100 + 33 + b - 0x7F) for b in range(0x7F, 0xA1)} | {0xAD: chr(0x143)}
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts.

    The tokenizer drops white space and never joins what a space or newline
    parts, so texts are cut there and each distinct word of a slice is looked
    up once; its ids are gathered to all its places by array operations. Words
    of Latin letters go to the model alone, without the tokenizer's search for
    words, and in lower case as the tokenizer has it; marks after such a word
    are a unit of their own. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Ids of words (as cut from texts, with the space that ends them) that the cache lacks."""
        words, stems, odd, tokenize = self.words, self.stems, [], self.model.tokenize
        for w in new:
            word = w[:-1] if w[-1:] == " " else w
            stem = word if word.isalpha() else word.rstrip(MARKS)
            ids = stems.get(stem)
            if ids is None:
                if not (stem.isalpha() and is_latin(stem)):
                    odd.append(w)
                    continue
                shown = stem.lower()
                if not shown.isascii():
                    shown = shown.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = stems[stem] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            if len(stem) < len(word):
                mark = word[len(stem) :]
                if mark not in self.marks:
                    self.marks[mark] = self.whole([mark])[0]
                ids += self.marks[mark]
            words[w] = ids
        words.update(zip(odd, self.whole(odd)))

    def ids_of(self, words: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:  # words met since the last turn stay within reach, others go
            self.older, self.words, self.stems, self.marks = self.words, {}, {"": b""}, {"": b""}
        have, older = self.words, self.older
        if older:
            have.update([(w, older[w]) for w in words if w not in have and w in older])
        gc.disable()  # many small objects and no cycles: the collector would walk them in vain
        try:
            self.learn([w for w in words if w not in have])
        finally:
            gc.enable()
        return list(map(have.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ids, ends = self.encode_slice(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw], dtype=np.int64)]))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last ends)."""
        parts, sizes, starts = [], [], [0]
        n = 0
        for lo, hi in stretches(data, offsets):
            part = data[lo:hi].copy()
            part[part == 0x0A] = 0x20
            cut = np.zeros(len(part) + 1, dtype=bool)
            np.equal(part, 0x20, out=cut[1:])
            cut[0] = cut[-1] = True
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            cut[inner] = True
            at = np.flatnonzero(cut)
            words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(part)).dictionary_encode()
            pool = self.ids_of(words.dictionary.to_pylist())
            length = np.fromiter(map(len, pool), dtype=np.int64, count=len(pool)) // 4
            begin = np.cumsum(length) - length
            which = words.indices.to_numpy()
            length = length[which]
            ends = np.cumsum(length)
            place = np.repeat(begin[which] - (ends - length), length)
            place += np.arange(len(place))
            parts.append(np.frombuffer(b"".join(pool), dtype="<u4")[place])
            ends = np.concatenate([[0], ends])
            marks = np.append(inner, hi - lo)
            sizes.append(np.stack([marks + lo, n + ends[np.searchsorted(at, marks)]]))
            n += len(place)
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        known = np.concatenate([np.array([[0], [0]]), *sizes], axis=1)
        return ids, known[1][np.searchsorted(known[0], offsets)]


def stretches(data: np.ndarray, offsets: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that together are all of ``data``; they end at a text's end or after a space."""
    lo = 0
    while lo < len(data):
        if lo + limit >= len(data):
            hi = len(data)
        else:
            k = int(np.searchsorted(offsets, lo + limit, side="right")) - 1
            hi = int(offsets[k])
            if hi <= lo:  # one text that is longer than the limit
                end, hi = int(offsets[k + 1]), lo + limit
                while hi < end and data[hi - 1] not in (0x20, 0x0A):
                    hi += 1
        yield lo, hi
        lo = hi


def is_latin(text: str) -> bool:
    """Whether a text has no letter beyond Latin-1: lower case is then that of each letter, and nothing is composed."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that later tasks find its words."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` are in descending order.

    The tree's leaves are the bins' free capacities and an inner node holds
    the larger of its two children, so the first bin that fits is found on the
    way down from the root.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i] = node - leaves
        offsets[i] = capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack_documents(
    docs: DataFrame, payload: str = "ids", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 20, path: str | None = None
) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and the payload.

    ``payload`` is "ids" (the piece's token ids) or "ids_crc32" (their CRC-32
    as little-endian uint32); it is made where the text is tokenized, so that
    only what the caller wants is shuffled.
    """
    path = path or tokenizer_path()
    if payload not in ("ids", "ids_crc32"):
        raise ValueError(payload)
    kind = "array<int>" if payload == "ids" else "bigint"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for first, data, offsets in text_slices(batch, "text", STRETCH):
                ids, ends = known.encode_slice(data, offsets)
                ids = np.insert(ids, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
                total = np.diff(ends)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, total[row] - start)
                lo = ends[row] + start
                if payload == "ids":
                    held = pa.ListArray.from_arrays(pa.array(np.append(lo, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                else:
                    view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    held = pa.array([zlib.crc32(view[a:b]) for a, b in zip((4 * lo).tolist(), (4 * (lo + length)).tolist())], pa.int64())
                part = batch.slice(first, len(total)).select(["doc_id", "pack_group"]).take(pa.array(row))
                columns = [part.column("doc_id"), part.column("pack_group"), pa.array(start), pa.array(length), pa.array(total[row]), held]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pack_group", "start", "length", "doc_tokens", payload])

    def place(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="first", kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), capacity)
        pieces["sequence_id"] = pieces["pack_group"].to_numpy() * (1 << 32) + bins
        pieces["offset"] = offsets
        return pieces.drop(columns="pack_group")

    groups = max(1, -(-docs.count() // group_docs))
    fields = f"start bigint, length bigint, doc_tokens bigint, {payload} {kind}"
    return (
        bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)).alias("pack_group"))
        .mapInArrow(tokenize, f"doc_id bigint, pack_group bigint, {fields}")
        .groupBy("pack_group")
        .applyInPandas(place, f"doc_id bigint, {fields}, sequence_id bigint, offset bigint")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), payload="ids_crc32").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
