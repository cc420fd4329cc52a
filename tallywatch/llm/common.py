"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywatch.session import materialize, shared_dir

__all__ = ["bounded", "documents", "ident", "materialize", "most_frequent", "on_workers", "positions", "running_sum", "table", "without",
           "words_of", "UPPER", "LOWER"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ident(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts alone, so that no other column can clash; a null text counts as empty."""
    return docs.select(ident(id_col).cast("long").alias("doc_id"), F.coalesce(ident(text_col), F.lit("")).alias("text"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the words with the largest ``n``, at most ``most`` of them, read to the driver.

    The least count comes from a histogram of counts (a few hundred rows at most), so no task sends more than
    its share of the result.
    """
    seen = counts.filter("n > 0")
    bucket = F.floor(F.log2("n") * 16).cast("long")
    total, least = 0, None
    for row in seen.groupBy(bucket.alias("bucket")).count().orderBy(F.desc("bucket")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["bucket"]
    return [] if least is None else seen.filter(bucket >= least).collect()


def without(docs: DataFrame, dropped: DataFrame, label: str, **on: Column) -> DataFrame:
    """The rows of ``docs`` that match no row of ``dropped``; ``on``: a column over ``docs`` for each of its columns.

    Nulls match nulls. The columns of ``dropped`` get names that ``docs`` does not have.
    """
    taken = {name.lower() for name in docs.columns}
    marks = {name: next(c for i in range(len(taken) + 1) if (c := f"_{name}_{i}").lower() not in taken) for name in on}
    table = bounded(dropped.select(*(F.col(name).alias(mark) for name, mark in marks.items())).distinct(), label)
    same = [value.eqNullSafe(F.col(marks[name])) for name, value in on.items()]
    return docs.join(table, same, "left_anti")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started outside the repository."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8.

    ``bytes`` methods know ASCII only, so no other letter or space is touched.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def bounded(ids: DataFrame, label: str, most: int = 1_000_000) -> DataFrame:
    """A small table of ids, written and counted; it may be broadcast only up to ``most`` rows."""
    written = materialize(ids, label)
    return F.broadcast(written) if written.count() <= most else written


def _in_order(rows: DataFrame, keys: list[Column], label: str) -> tuple[DataFrame, Column]:
    """``rows`` written in the order of ``keys`` with ``_at``, which grows along it; and the range each row lies in.

    Spark cuts the order into ranges, one task each. The written number holds the range and the place in it, so it
    can be read back in any order.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    path = shared_dir(spark, label)
    ordered.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ordered.schema).parquet(path), F.shiftright("_at", 33)


def _before(per_range: DataFrame, value: str) -> DataFrame:
    """Per range the sum of ``value`` over the ranges before it: one row per task of the writer."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("_range", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def positions(rows: DataFrame, keys: list[Column], label: str) -> tuple[DataFrame, int]:
    """``rows`` with ``position``, counted from 0 in the order of ``keys``, and the number of rows.

    One shuffle of the rows; equal keys may be split between tasks, so no value is a hot key.
    """
    written, part = _in_order(rows, keys, label)
    offsets = _before(written.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("n")), "n")
    placed = written.withColumn("_range", part).join(offsets, "_range")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("position", place).drop("_at", "_range", "_before"), written.count()


def running_sum(rows: DataFrame, keys: list[Column], value: str, label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows that come first in the order of ``keys``."""
    written, part = _in_order(rows, keys, label)
    written = written.withColumn("_range", part)
    offsets = _before(written.groupBy("_range").agg(F.sum(value).alias("n")), "n")
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = written.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, "_range").withColumn("before", F.col("_before") + F.col("_inside")).drop("_at", "_range", "_before", "_inside")
