"""Token ids in compressed binary blocks: canonical, length-limited Huffman codes from global counts.

Layout of a store (a folder): ``codes`` (id, code length; the canonical code follows from these) and ``blocks``,
one row per block: part, block and start inside the part, document ids and lengths, the bit string, and the bit
offset of every ``CHECKPOINT``-th token. A block holds whole documents and decodes without any other; inside it
the tokens between checkpoints decode side by side. Both tables are written by Spark's own committer, so a lost
executor leaves neither gaps nor doubles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallywatch.llm.common import documents, on_workers
from tallywatch.llm.tokens import encoder
from tallywatch.session import shared_dir

#: Longest code in bits; more ids than fit get two bits more than a flat code would take.
LIMIT = 16
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 18

_RAW = "part long, block long, start long, doc_ids array<bigint>, lengths array<bigint>, ids binary"
_BLOCK = "part long, block long, start long, doc_ids array<bigint>, lengths array<bigint>, tokens long, bits binary, checkpoints array<bigint>"
_READ = "doc_id long, part long, start long, n_tokens long, ids_crc32 long"


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits (package-merge). Ties go to the smaller id.

    Where more ids than ``2 ** limit`` occur, the limit grows with their number.
    """
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n < 2:
        return dict.fromkeys(ids, 1)
    if n > 1 << limit:
        limit = (n - 1).bit_length() + 2
    leaves = np.array([counts[i] for i in ids], dtype=np.int64)
    packages, is_leaf = np.empty(0, dtype=np.int64), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        chosen = int(leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return dict(zip(ids, lengths.tolist(), strict=True))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By id: code and length; by the next bits, as many as the longest code has: the id they start with."""
    size, limit = max(lengths, default=-1) + 1, max(lengths.values(), default=1)
    codes, bits, table = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(1 << limit, np.uint32)
    code = last = 0
    for i in sorted(lengths, key=lambda i: (lengths[i], i)):
        code <<= lengths[i] - last
        last = lengths[i]
        codes[i], bits[i] = code, last
        table[code << (limit - last): (code + 1) << (limit - last)] = i
        code += 1
    return codes, bits, table


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit string of the ids (most significant bit first) and the bit offsets of every ``CHECKPOINT``-th id."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    width = bits[ids]
    ends = np.cumsum(width)
    at = ends - width
    # Each code lies in the two 32-bit words from at >> 5 on; codes in one word are disjoint bits, so they add up.
    value = codes[ids] << (np.uint64(64) - width - (at & np.uint64(31)))
    word = (at >> np.uint64(5)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)], at[::CHECKPOINT].astype(np.int64)


def unpack(data: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block: one lane per checkpoint, all lanes read one id per step from the table.

    A step looks at 32 bits, which holds codes of up to 25 bits at any bit of a byte: those of eight million ids.
    """
    if not n:
        return np.empty(0, np.uint32)
    limit = len(table).bit_length() - 1
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last = np.asarray(checkpoints, np.int64).copy(), len(four) - 1
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    for step in range(min(n, CHECKPOINT)):
        seen = four[np.minimum(at >> 3, last)] >> (32 - limit - (at & 7)).astype(np.uint32) & np.uint32((1 << limit) - 1)
        out[step] = table[seen]
        at += bits[out[step]].astype(np.int64)
    return out.T.reshape(-1)[:n]


def _raw_blocks(path: str, end_id: int, block_tokens: int, kind: str):
    """Ordered documents to blocks of ids; a block ends with the document that fills it."""
    schema = _arrow(_RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        block = start = size = 0
        doc_ids, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            row = [part, block, start, doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                lengths.append(len(data) // 4)
                ids.append(data)
                size += len(data) // 4
                if size >= block_tokens:
                    yield flush()
                    block, start, size = block + 1, start + size, 0
                    doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield flush()
    return run


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                found[: len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])
    return run


def _pack_blocks(codes, bits, kind: str):
    schema = _arrow(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column(5)[0].as_buffer(), kind)
                data, checkpoints = pack(ids, codes.value, bits.value)
                columns = [*one.columns[:5], *(pa.array([v], f.type) for v, f in zip(
                    (len(ids), data, checkpoints), list(schema)[5:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run


def _read_blocks(table, bits):
    schema = _arrow(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["bits"], row["checkpoints"], row["tokens"], table.value, bits.value).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [row["doc_ids"], [row["part"]] * len(crcs), row["start"] + starts, lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
                block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode all documents in ascending id order into a new store; returns its folder.

    Null text is an empty document (the end id alone); null ids come first; rows that share an id are ordered by
    their texts; other columns are ignored; an empty table gives an empty store. The driver reads one count per
    vocabulary id, which the tokenizer bounds.
    """
    spark = docs.sparkSession
    on_workers(spark)
    path, raw = shared_dir(spark, "token-store"), shared_dir(spark, "token-ids")
    small = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
    kind = "<u2" if small else "<u4"
    rows = documents(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_raw_blocks(tokenizer, end_id, block_tokens, kind), _RAW).write.option("compression", "zstd").parquet(raw)
    blocks = spark.read.schema(_RAW).parquet(raw)
    counts = blocks.select("ids").mapInArrow(_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = code_lengths({r["id"]: r["n"] for r in counts})
    spark.createDataFrame(list(lengths.items()), "id long, bits int").write.parquet(f"{path}/codes")
    codes, bits, _ = canonical(lengths)
    share = spark.sparkContext.broadcast
    blocks.mapInArrow(_pack_blocks(share(codes), share(bits), kind), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: ``doc_id, start, n_tokens, ids_crc32`` per document; ``start`` counts the ids of all before it."""
    lengths = {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{path}/codes").collect()}
    _, bits, table = canonical(lengths)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # One row per written part, as many as the writer had tasks.
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    share = spark.sparkContext.broadcast
    read = blocks.mapInArrow(_read_blocks(share(table), share(bits)), _READ)
    return read.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def store_digest(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write a store and read it back."""
    return read_store(docs.sparkSession, write_store(docs, tokenizer, end_id, **options))
