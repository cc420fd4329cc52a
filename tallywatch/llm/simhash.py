"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius meet at a value between them. Every fingerprint sends itself to all values
within half the radius; fingerprints that arrive at one value are linked. With radius 3 the halves are 1 and 2: for
a distance of 3 the fingerprints differ in parity, so only the odd one goes two steps, and two of any three bits
lie in one half of the word, so its two steps stay inside one half. Fingerprints that arrive at a value by one step
lie within 2 of each other, and within 3 of those that arrive by two, so each is linked with one of the former:
as many links as arrivals, no pairs, and at most 65 + 992 arrivals at any value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, ident, materialize, on_workers, without, words_of
from tallywatch.llm.graph import components

SEED = 42
RADIUS = 3
WORDS = 3


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; a shorter text is one shingle, a blank one none."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([hashed(b" ".join(found), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.array([hashed(s, SEED) for s in shingles], np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Which bits (most significant first) are set in over half of the rows; ``hashes``: one or more words a row."""
    n = len(hashes)
    packed = hashes.reshape(n, -1).astype(">u8").view(np.uint8)
    counts = np.zeros(packed.shape[1] * 8, np.int64)
    for at in range(0, n, 255):  # so many ones fit into a byte
        counts += np.add.reduce(np.unpackbits(packed[at:at + 255], axis=1), axis=0, dtype=np.uint8)
    return counts * 2 > n


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash as a signed integer; zero for a blank text."""
    hashes = shingle_hashes(text, words)
    return int(np.packbits(majority_bits(hashes)).view(">i8")[0]) if len(hashes) else 0


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], ["doc_id", "mark", "print"])
    return run


def _mark(text: Column) -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, mark, print`` of every row; ``mark`` is a hash of the text."""
    on_workers(docs.sparkSession)
    rows = documents(docs, id_col, text_col).withColumn("mark", _mark(F.col("text")))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, mark long, print long")


def _mask(*bits: int) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _longs(values: list[int]) -> Column:
    """A constant array, written as text to keep the plan small."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


_ONE = [0, *(_mask(b) for b in range(64))]
_TWO = [_mask(x, y) for half in (range(32), range(32, 64)) for x, y in combinations(half, 2)]
_HALF = [0, *(1 << b for b in range(32))]


def with_neighbour(prints: DataFrame) -> DataFrame:
    """The distinct ``print`` values that some other may lie within the radius of.

    Of at most three differing bits at most one, half the radius, lies in one of the two 32-bit halves. So each half
    is sent to its variants within one bit, and a fingerprint whose variants meet no other's half has no neighbour.
    """
    low = F.col("print").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("print", 32)
    halves = prints.select("print", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half")),
                                                      F.struct(F.lit(1).alias("side"), high.alias("half")))).alias("h"))
    halves = halves.select("print", (F.col("h.half") * 2 + F.col("h.side")).alias("key"))
    owners = halves.groupBy("key").agg(F.count(F.lit(1)).alias("owners"))
    steps = F.explode(_longs([2 * x for x in _HALF])).alias("step")
    sent = halves.select("print", "key", steps).select("print", F.col("key").bitwiseXOR(F.col("step")).alias("key"), (F.col("step") == 0).alias("own"))
    # Spark takes an exploded table for as small as what it came from, and would broadcast 66 times as many rows.
    met = sent.hint("merge").join(owners, "key").filter(~F.col("own") | (F.col("owners") > 1))
    return met.select("print").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct ``print`` values within distance 3; they connect exactly what such pairs connect."""
    near = materialize(with_neighbour(prints), "simhash-near")
    one = near.select("print", F.explode(_longs(_ONE)).alias("step"), F.lit(True).alias("near"))
    odd = F.pmod(F.bit_count("print"), F.lit(2)) == 1
    two = near.filter(odd).select("print", F.explode(_longs(_TWO)).alias("step"), F.lit(False).alias("near"))
    sent = one.unionByName(two).select("print", F.col("print").bitwiseXOR(F.col("step")).alias("value"), "near")
    at_value = Window.partitionBy("value")
    hub = F.min(F.when(F.col("near"), F.col("print"))).over(at_value)
    met = sent.withColumn("hub", hub).filter("hub is not null and hub <> print")
    return met.filter(F.bit_count(F.col("hub").bitwiseXOR(F.col("print"))) <= RADIUS).select(
        F.col("hub").alias("a"), F.col("print").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """All rows: ``doc_id, mark, print, component_id``."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    first = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(first.select("print")))
    joined = first.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A written table is several times as large in memory as in its file, so all fingerprints, or all rows, are not broadcast.
    of_print = joined.hint("merge").join(least, "root").select("print", "component_id")
    return rows.hint("merge").join(of_print, "print")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """All rows: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links).

    Fingerprints at 3 or fewer differing bits are linked, equal ones included; blank and null texts have fingerprint
    zero and link like any other. Rows without an id are ignored when ids are compared. Repeated rows are returned
    each; no rows give no rows; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, words).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The row with the smallest id of each group of ``near_groups``, with all its columns.

    Rows without an id are kept. Rows are told apart by id and text, so another text under a dropped row's id is judged by itself.
    """
    rows = _grouped(docs, id_col, text_col, words)
    dropped = rows.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", "mark")
    return without(docs, dropped, "simhash-dropped", doc_id=ident(id_col).cast("long"), mark=_mark(ident(text_col)))
