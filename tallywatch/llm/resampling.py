"""Importance resampling of documents towards a target: n-grams hashed into buckets, weights from bucket counts.

Texts are handled in slices of a few megabytes. The n-grams of a slice are interned in an open-addressed NumPy
table: keys are XXH64 of the n-gram's bytes, an equal key counts as equal only when the bytes are, and a slot holds
the n-gram's bucket and its count. All occurrences probe side by side, so a slice takes a few array operations per
probe length instead of one call per word. Counts add up by bucket across tasks; the gain of every bucket, a table
of fixed size, then goes to the tasks, where each occurrence gathers its gain by slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, materialize, on_workers, positions

BUCKETS = 10_000
#: Bytes of text that share one table; a longer text has one of its own.
SLICE = 1 << 22

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """By byte: is it part of a word (digits, letters, all beyond ASCII); and the byte with A-Z lower-cased."""
    code = np.arange(256, dtype=np.uint8)
    upper = (code >= 0x41) & (code <= 0x5A)
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    word = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (lower >= 0x80)
    return word, lower


_WORD, _LOWER = _lookup()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _lanes(text: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian numbers read from every byte offset of ``text``."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(text) - size + 1,), kind, text, strides=(1,))


def hashes(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the given stretches; ``text`` has eight spare bytes at its end."""
    eight, four = _lanes(text, "<u8"), _lanes(text, "<u4")
    out = np.empty(len(start), np.uint64)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        if size >= 32:  # striped form, rare for words
            out[rows] = [xxhash.xxh64_intdigest(text[a:a + size].tobytes()) for a in start[rows].tolist()]
            continue
        at = start[rows]
        h = np.full(len(rows), _P5 + np.uint64(size), np.uint64)
        for k in range(0, size // 8 * 8, 8):
            h = _rotated(h ^ _rotated(eight[at + k] * _P2, 31) * _P1, 27) * _P1 + _P4
        k = size // 8 * 8
        if size - k >= 4:
            h = _rotated(h ^ four[at + k].astype(np.uint64) * _P1, 23) * _P2 + _P3
            k += 4
        for k in range(k, size):
            h = _rotated(h ^ text[at + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        out[rows] = h ^ h >> np.uint64(32)
    return out


def _same_bytes(text: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pairs of stretches of equal length hold equal bytes, eight at a time."""
    eight = _lanes(text, "<u8")
    same = np.ones(len(one), bool)
    for k in range(0, int(length.max(initial=0)), 8):
        rows = np.flatnonzero(same & (length > k))
        spare = np.maximum(8 - (length[rows] - k), 0).astype(np.uint64) * np.uint64(8)
        same[rows] = (eight[one[rows] + k] ^ eight[other[rows] + k]) << spare == 0
    return same


class Interned:
    """Open-addressed table of n-grams. ``slot``: the slot of each occurrence; ``owner``: an occurrence per slot, or -1."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray | None = None) -> None:
        keys = hashes(text, start, length) if keys is None else keys
        size = 1 << max(4, (2 * len(start)).bit_length())
        self.owner = np.full(size, -1, np.int64)
        self.slot = np.empty(len(start), np.int64)
        waiting, at = np.arange(len(start)), (keys & np.uint64(size - 1)).astype(np.int64)
        while len(waiting):
            free = self.owner[at] < 0
            self.owner[at[free]] = waiting[free]  # of several that claim a slot, the last has it
            owner = self.owner[at]
            # Keys first, then bytes: equal keys of different n-grams go on to the next slot.
            found = (keys[owner] == keys[waiting]) & (length[owner] == length[waiting])
            rows = np.flatnonzero(found)
            found[rows] = _same_bytes(text, start[owner[rows]], start[waiting[rows]], length[waiting[rows]])
            self.slot[waiting[found]] = at[found]
            waiting, at = waiting[~found], (at[~found] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)

    def buckets(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket of each slot; empty slots have 0."""
        used = np.flatnonzero(self.owner >= 0)
        begin, size = start[self.owner[used]], length[self.owner[used]]
        view, out = text.tobytes(), np.zeros(len(self.owner), np.int64)
        out[used] = [zlib.crc32(view[a:a + n]) % buckets for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        return out


class Grams:
    """The n-grams of one slice: words as bytes joined by single spaces, stretches, and the texts they lie in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int) -> None:
        inside = _WORD[data]
        fresh = np.zeros(len(data) + 1, bool)  # where a text begins, a word may not go on
        fresh[offsets] = True
        starts = np.flatnonzero(inside & (fresh[:-1] | ~np.r_[False, inside[:-1]]))
        ends = np.flatnonzero(inside & (fresh[1:] | ~np.r_[inside[1:], False])) + 1
        size = ends - starts
        word = np.repeat(np.arange(len(starts)), size)
        self.text = np.full(int(size.sum()) + len(starts) + 8, 0x20, np.uint8)
        self.text[np.arange(len(word)) + word] = _LOWER[data[inside]]
        begin = np.cumsum(size + 1) - size - 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        self.words = np.bincount(doc, minlength=len(offsets) - 1)
        start, length, owner = [], [], []
        for n in range(1, longest + 1):
            if len(starts) >= n:
                first, last = slice(0, len(starts) - n + 1), slice(n - 1, None)
                whole = doc[first] == doc[last]
                start.append(begin[first][whole])
                length.append((begin[last] + size[last] - begin[first])[whole])
                owner.append(doc[first][whole])
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (start, length, owner)]
        self.start, self.length, self.doc = joined
        self.table = Interned(self.text, self.start, self.length)


def _slices(column: pa.Array, longest: int) -> Iterator[tuple[slice, Grams]]:
    """The texts of a batch, cut into slices of ``SLICE`` bytes or one text."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield slice(a, b), Grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], longest)
        a = b


def _counted(buckets: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, grams in _slices(batch.column(1), longest):
            at = grams.table.buckets(grams.text, grams.start, grams.length, buckets)
            np.add.at(total, at, grams.table.count)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def _weighed(buckets: int, longest: int, gains, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_features", "weight", "words"]
    for batch in batches:
        for rows, grams in _slices(batch.column(1), longest):
            gain = gains.value[grams.table.buckets(grams.text, grams.start, grams.length, buckets)]
            docs = rows.stop - rows.start
            weight = np.zeros(docs, np.int64)
            np.add.at(weight, grams.doc, gain[grams.table.slot])
            features = np.bincount(grams.doc, minlength=docs)
            ids = batch.column(0).slice(rows.start, docs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(features), pa.array(weight), pa.array(grams.words)], names)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """N-grams per bucket of a table (``doc_id, text``). Every task sends one row per bucket at most, and so does the sum."""
    counted = rows.mapInArrow(partial(_counted, buckets, longest), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: a thousand times the log ratio of its shares in target and source, each with one more count, rounded down."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, *, percent: int, seed: int, id_col: str = "doc_id", text_col: str = "text",
             target_id: str = "item_id", target_text: str = "text", buckets: int = BUCKETS, longest: int = 1,
             least_words: int = 20) -> DataFrame:
    """All rows: ``doc_id, n_features, weight, score, rank``; ``percent`` of those with ``least_words`` words have a rank.

    Features are the runs of 1 to ``longest`` words, ``weight`` the sum of their buckets' gains. The score adds Gumbel
    noise drawn from the seed and the id, so the highest scores are a sample without replacement by weight. Null
    texts have no words; a null id draws as an empty one and comes last among equal scores, where smaller ids come first;
    repeated rows are drawn each; no rows give no rows; an empty target has equal shares in all buckets. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows = documents(docs, id_col, text_col)
    gains = bucket_gains(bucket_counts(rows, buckets, longest), bucket_counts(documents(target, target_id, target_text), buckets, longest))
    run = partial(_weighed, buckets, longest, spark.sparkContext.broadcast(gains))
    weighed = rows.mapInArrow(run, "doc_id long, n_features long, weight long, words long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), "words"), "resample-scores")
    able = F.col("words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed, n = positions(scored.filter(able), order, "resample-order")
    rank = F.when(F.col("position") < percent * n // 100, F.col("position") + 1)
    columns = ("doc_id", "n_features", "weight", "score")
    rest = scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)
