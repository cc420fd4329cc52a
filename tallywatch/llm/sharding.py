"""Shards along a Hilbert curve, so that a filter on any of several metadata columns opens few files.

Every column is quantised by its own distribution (equal shares of the rows per step, exact), the steps are the
coordinates of a cell, and rows are sorted by the cell's place on the Hilbert curve. Neighbouring places are
neighbouring cells, so a run of the curve is compact in all columns at once. Runs of equal length are the shards.
All of it is built-in functions.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallywatch.llm.common import ident, positions, running_sum
from tallywatch.session import shared_dir

SHARDS = 8
#: Steps per column, as bits.
BITS = 8


def _trailing_ones(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


@cache
def curve_table(dims: int) -> list[int]:
    """The curve as a state machine: entry ``state << dims | digit`` is ``next state << dims | place``.

    A state is the corner where the curve enters a cell and the direction in which it leaves; ``digit`` holds one bit
    of each coordinate, ``place`` the position of the sub-cell along the curve.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def left(x: int, by: int) -> int:
        return (x << by % dims | x >> (dims - by % dims)) & mask

    table = []
    for state in range(size * dims):
        corner, direction = divmod(state, dims)
        for digit in range(size):
            place = left(digit ^ corner, dims - (direction + 1) % dims)
            shift = 1
            while shift < dims:
                place ^= place >> shift
                shift <<= 1
            even = 2 * ((place - 1) // 2) if place else 0
            turn = _trailing_ones(place - 1 if place % 2 == 0 else place) if place else 0
            step = corner ^ left(even ^ even >> 1, direction + 1)
            table.append((step * dims + (direction + turn + 1) % dims) << dims | place)
    return table


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the curve of a cell with coordinates from 0 to ``2**bits - 1``; the first coordinate is the lowest digit bit."""
    dims = len(coordinates)
    if not 1 <= dims * bits <= 62:
        raise ValueError("columns times bits must lie between 1 and 62")
    table = F.from_json(F.lit(str(curve_table(dims))), "array<int>")

    def step(seen: Column, bit: Column) -> Column:
        digit = F.lit(0)
        for i, x in enumerate(coordinates):
            digit = digit + F.call_function("shiftleft", F.call_function("shiftright", x, bit).bitwiseAND(1), F.lit(i))
        found = F.get(table, F.shiftleft(seen["state"], dims) + digit)
        return F.struct(F.shiftright(found, dims).alias("state"),
                        (F.shiftleft(seen["place"], dims) + found.bitwiseAND((1 << dims) - 1)).alias("place"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["place"]


def steps(docs: DataFrame, column: str, bits: int = BITS) -> tuple[list, list[int]]:
    """Quantisation of a column: the least value of each step that occurs, and the number of that step.

    A value's step is its share of the rows with a smaller value. Values are counted first and summed in ranges, so
    neither a frequent value nor many different ones gather in a task; ``2**bits`` values at most reach the driver.
    """
    counts = docs.filter(ident(column).isNotNull()).groupBy(ident(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    summed = running_sum(counts, [F.col("value")], "n", "shard-steps")
    nulls, total = docs.agg(F.count(F.when(ident(column).isNull(), 1)), F.count(F.lit(1))).first()
    share = F.floor((F.col("before") + nulls) * F.lit(1 << bits) / F.lit(max(total, 1))).cast("int")
    found = summed.groupBy(share.alias("step")).agg(F.min("value").alias("value")).orderBy("step").collect()
    return [r["value"] for r in found], [r["step"] for r in found]


def quantised(value: Column, least: list, number: list[int]) -> Column:
    """The step of a value by binary search in ``steps``; null is the smallest value, step 0."""
    if not least:
        return F.lit(0)
    bounds, numbers = F.array(*map(F.lit, least)), F.array(*map(F.lit, number))
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(len(least).bit_length()))))
    below = F.aggregate(jumps, F.lit(0), lambda seen, jump: F.when(
        (seen + jump <= len(least)) & (F.get(bounds, seen + jump - 1) <= value), seen + jump).otherwise(seen))
    return F.when(value.isNull(), 0).otherwise(F.coalesce(F.get(numbers, below - 1), F.lit(0)))


def place(docs: DataFrame, columns: list[str], *, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id") -> DataFrame:
    """All rows as ``row`` (a struct of their own columns) with ``curve``, ``shard`` and ``slot`` (gapless from 0 in the shard).

    Shards are runs of the curve whose row counts differ by one at most. Rows of one cell are ordered by id (null
    first), then by a hash of the row; equal rows are interchangeable. Any column may be null; other columns, whatever
    their names, lie in ``row``; no rows give no rows.
    """
    cells = [quantised(ident(c), *steps(docs, c, bits)) for c in columns]
    rows = docs.select(hilbert_index(cells, bits).alias("curve"), ident(id_col).alias("id"),
                       F.xxhash64(*map(ident, docs.columns)).alias("mark"), F.struct(*map(ident, docs.columns)).alias("row"))
    placed, total = positions(rows, [F.col("curve"), F.col("id"), F.col("mark")], "shard-order")
    shard = F.floor(F.col("position") * shards / F.lit(max(total, 1))).cast("int")
    start = F.ceil(F.col("shard") * F.lit(total) / shards)
    return placed.withColumn("shard", shard).select("row", "curve", "shard", (F.col("position") - start).alias("slot"))


def write_shards(docs: DataFrame, columns: list[str], path: str | None = None, **options) -> str:
    """Write ``place``'s rows, one folder per shard, and return the folder of all.

    Rows arrive in curve order, so each file covers a short run: its column ranges are small, and filters on
    ``row``'s columns skip the others.
    """
    path = path or shared_dir(docs.sparkSession, "shards")
    place(docs, columns, **options).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The written shards of ``docs``."""
    schema = StructType([StructField("row", docs.schema)] + [StructField(n, t) for n, t in (
        ("curve", LongType()), ("slot", LongType()), ("shard", IntegerType()))])
    return spark.read.schema(schema).parquet(path)


def shard_digest(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of the written shards: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    ``size``: UTF-8 bytes of the text (null: none) plus 1. ``law`` is ``rows``; cuts depend on all rows, so
    ``grown_shard`` is null.
    """
    stored = read_shards(docs.sparkSession, write_shards(docs, columns, id_col=id_col, **options), docs)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return stored.select(
        F.col("row")[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
