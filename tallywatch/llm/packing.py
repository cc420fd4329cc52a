"""Order-preserving packing of documents into training sequences.

Documents lie in ascending id order in one token stream, which is cut into windows of at most ``width`` tokens. A
window of a power of two tokens needs no padding, any other is padded to ``width``. Dynamic programming over the
possible cuts (document ends, sentence ends, and every ``width`` tokens inside a longer sentence) minimises padding
plus a price per cut. The best start of a padded window is the front of a monotone queue, so each cut costs
constant time; windows of a power of two are looked up.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, on_workers
from tallywatch.llm.tokens import encoder

WIDTH = 2048
#: Prices in padding tokens: any window, a cut at a sentence end, a cut inside a sentence.
WINDOW, SENTENCE, INSIDE = 4, 8, 64
#: Tokens that are planned together. Only settled windows leave the plan, so its edges leave no padding behind.
HORIZON = 1 << 18
SMALLEST = 64

_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def plan_cuts(at: list[int], price: list[int], width: int = WIDTH) -> list[int]:
    """Cheapest cuts of the stream ``[at[0], at[-1])``.

    ``at``: possible cuts in ascending order with gaps of at most ``width``; ``price[j]``: price of a cut at
    ``at[j]``. Returns the chosen cuts, both ends included.
    """
    powers = [1 << k for k in range(SMALLEST.bit_length() - 1, width.bit_length()) if 1 << k <= width]
    index = {p: j for j, p in enumerate(at)}
    best, come = [0] * len(at), [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - width:
            queue.popleft()
        i = queue[0]
        cost = best[i] + at[i] + width - p
        for power in powers:
            k = index.get(p - power)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j], come[j] = cost + price[j], i
        key = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = come[j]
        cuts.append(at[j])
    return cuts[::-1]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Cuts of a stretch of the stream and their prices. ``doc_ends``: offsets after each document's last token."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    at = np.union1d(np.r_[0, doc_ends], sentence)
    gaps = np.flatnonzero(np.diff(at) > width)
    forced = [np.arange(at[g] + width, at[g + 1], width) for g in gaps]
    kind = np.full(len(at), WINDOW + SENTENCE)
    kind[np.isin(at, doc_ends)] = WINDOW
    if forced:
        extra = np.concatenate(forced)
        at, kind = np.r_[at, extra], np.r_[kind, np.full(len(extra), WINDOW + INSIDE)]
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
    return at.tolist(), kind.tolist()


def sentence_ends(path: str) -> np.ndarray:
    """By id: the token ends a sentence or a line."""
    vocabulary = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    flags = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, i in vocabulary.items():
        flags[i] = token.endswith((".", "!", "?", "Ċ"))
    return flags


class Stream:
    """The token stream of one task: documents in, pieces of settled windows out."""

    def __init__(self, flags: np.ndarray, part: int, width: int, horizon: int) -> None:
        self._flags, self._width, self._horizon = flags, width, horizon
        self._docs: list[tuple] = []  # document id, its tokens before this stretch, all its tokens, the ids left
        self._size, self._sequence = 0, part << 33
        self.pieces: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, 0, len(ids), ids))
        self._size += len(ids)
        if self._size >= self._horizon:
            self._settle(last=False)

    def close(self) -> None:
        if self._size:
            self._settle(last=True)

    def _settle(self, last: bool) -> None:
        ends = np.cumsum([len(d[3]) for d in self._docs])
        cuts = plan_cuts(*possible_cuts(np.concatenate([d[3] for d in self._docs]), ends, self._flags, self._width), self._width)
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        d, begin = 0, 0  # the document at the cut, and where it begins
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while a < b:
                doc_id, before, total, ids = self._docs[d]
                upto = min(b, begin + len(ids))
                piece = ids[a - begin:upto - begin]
                self.pieces.append((doc_id, before + a - begin, len(piece), zlib.crc32(piece.tobytes()), total, self._sequence, offset))
                offset += len(piece)
                a = upto
                if upto == begin + len(ids):
                    begin, d = upto, d + 1
            self._sequence += 1
        done = cuts[-1]
        rest = self._docs[d:]
        if rest and done > begin:
            doc_id, before, total, ids = rest[0]
            rest[0] = (doc_id, before + done - begin, total, ids[done - begin:])
        self._docs, self._size = rest, self._size - done
        if not last and not done:
            self._horizon *= 2  # nothing settled: plan more at once


def _pack(path: str, end_id: int, width: int, horizon: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], "<u4")
        flags = sentence_ends(path)
        if end_id >= len(flags):
            flags = np.r_[flags, np.zeros(end_id + 1 - len(flags), bool)]
        stream = Stream(flags, TaskContext.get().partitionId(), width, horizon)

        def out() -> pa.RecordBatch:
            rows, stream.pieces = stream.pieces, []
            names = [x.split()[0] for x in _PIECE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream.add(doc_id, np.concatenate([np.frombuffer(encode(text.as_py()), "<u4"), end]))
                if len(stream.pieces) >= 10_000:
                    yield out()
        stream.close()
        if stream.pieces:
            yield out()
    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, horizon: int = HORIZON) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids plus ``end_id`` are covered exactly once; a null or empty text is its end id alone. Null
    ids come first; rows that share an id are packed each, ordered by their texts; other columns are ignored; no
    rows give no pieces. Every task packs a range of ids by itself, so at most one window per task is short.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    on_workers(docs.sparkSession)
    rows = documents(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_pack(tokenizer, end_id, width, horizon), _PIECE)


def padding(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row: ``sequences, tokens, padding`` of a packed corpus."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    exact = F.bit_count(F.col("size")) == 1
    return size.agg(
        F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(exact, 0).otherwise(width - F.col("size"))), F.lit(0)).alias("padding"))
