"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so whole documents would share tiny Jaccard similarities with any item.
Items are therefore partitioned by size, and for each size class documents are seen through half-overlapping
windows four times as wide as the class's smallest item: a copied item lies whole in some window, and its
similarity with that window is bounded below. An item is a candidate of a document when any of its MinHash values
equals that of a window, and is then compared with the whole document, shingle by shingle.

A window's MinHash can equal an item's only where the window holds the very shingle that gives the item its value.
So a scan over the shingles finds those places first, and only windows around them are hashed; the candidates are
the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, ident, materialize, on_workers, without, words_of

WORDS = 5
CONTAINMENT = 0.8
HASHES = 48
SEED = 42
#: Items searched together: what a task holds at once, a few MB. More items are searched in further passes.
BLOCK_ITEMS = 20_000
_FOUND = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """64-bit hashes by word, as bytes; frequent words are kept."""

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh64_intdigest(word, SEED).to_bytes(8, "little")
        if len(self) < 100_000 and len(word) <= 64:
            self[word] = value
        return value


_WORD_HASHES = _WordHashes()
_MULTIPLIERS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One hash per run of ``size`` words, in order."""
    hashes = np.frombuffer(b"".join(map(_WORD_HASHES.__getitem__, words)), np.uint64)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    return _mix(total)


def shingles(words: list[bytes], size: int = WORDS) -> set[bytes]:
    """Distinct runs of ``size`` words; fewer words are one run, none give none."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


@dataclass(frozen=True)
class SizeClass:
    """Items of one size class: those with ``words`` words a shingle and ``least`` to twice ``least`` shingles."""

    words: int
    least: int
    anchors: np.ndarray   # shingles that give some item a MinHash value, sorted
    signature: dict       # (hash number, shingle) -> item positions

    @property
    def width(self) -> int:
        return 4 * self.least

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items whose MinHash equals that of a window of these shingles, in one place at least."""
        at = np.searchsorted(self.anchors, hashes)
        hits = np.flatnonzero(self.anchors[np.minimum(at, len(self.anchors) - 1)] == hashes)
        found: set[int] = set()
        step = self.width // 2
        for w in np.unique(np.r_[hits // step, np.maximum(hits // step - 1, 0)]).tolist() if len(hits) else []:
            window = np.unique(hashes[w * step:w * step + self.width])
            least = window[np.argmin(window[None, :] * _MULTIPLIERS[:, None], axis=1)]
            for k, value in enumerate(least.tolist()):
                found.update(self.signature.get((k, value), ()))
        return found


def size_classes(items: list[tuple[int, str]], words: int = WORDS) -> tuple[list[SizeClass], list[tuple[int, int, set[bytes]]]]:
    """Search tables of the items by size class, and per item its id, shingle length and shingles."""
    kept, groups = [], {}
    for item_id, text in items:
        found = words_of(text)
        if found:
            size = min(words, len(found))
            hashes = np.unique(shingle_hashes(found, size))
            groups.setdefault((size, 1 << (len(hashes).bit_length() - 1)), []).append((len(kept), hashes))
            kept.append((item_id, size, shingles(found, size)))
    classes = []
    for (size, least), members in sorted(groups.items()):
        signature: dict[tuple[int, int], list[int]] = {}
        for place, hashes in members:
            chosen = hashes[np.argmin(hashes[None, :] * _MULTIPLIERS[:, None], axis=1)]
            for k, value in enumerate(chosen.tolist()):
                signature.setdefault((k, value), []).append(place)
        anchors = np.unique(np.array([value for _, value in signature], np.uint64))
        classes.append(SizeClass(size, least, anchors, signature))
    return classes, kept


def _search(items, words: int, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, kept = size_classes(items.value, words)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_of(text.as_py())
                hashes = {size: shingle_hashes(found, size) for size in {c.words for c in classes}}
                near = set().union(*(c.candidates(hashes[c.words]) for c in classes)) if classes else set()
                own: dict[int, set[bytes]] = {}
                for place in near:
                    item_id, size, wanted = kept[place]
                    if size not in own:
                        own[size] = shingles(found, size)
                    shared = len(wanted & own[size])
                    if shared >= containment * len(wanted):
                        rows.append((doc_id, item_id, shared, len(wanted), shared / len(wanted)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], names)
    return run


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS,
                      containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, item_shingles, containment``: the document holds the test item.

    A pair is found when at least ``containment`` of the item's distinct shingles of ``words`` words (A-Z
    lower-cased) occur in the document. An item of fewer words is one shingle of its own length. Blank and null items
    match nothing, blank documents neither; repeated rows and items give repeated pairs; empty tables give none;
    other columns are ignored. Items reach the tasks in blocks of ``block_items``, one pass over the documents for
    each block. An item copied whole is missed with a probability under 1e-5, one at the threshold under 1e-4.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows = documents(docs, id_col, text_col)
    items = benchmark.select(ident(item_col).cast("long").alias("item_id"), F.coalesce(ident(item_text_col), F.lit("")).alias("text"))
    blocks = -(-items.count() // block_items)
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark")
    found = None
    for block in range(max(1, blocks)):
        part = items.filter(F.col("block") == block).drop("block") if blocks > 1 else items
        held = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        pairs = rows.mapInArrow(_search(held, words, containment), _FOUND)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, with all their columns. Null ids share their fate."""
    found = find_contaminated(docs, benchmark, **options).select("doc_id")
    return without(docs, found, "contaminated", doc_id=ident(options.get("id_col", "doc_id")).cast("long"))
