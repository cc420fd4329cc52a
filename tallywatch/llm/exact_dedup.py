"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside each group.

The grouping key holds the hash and the text itself, so Spark compares bytes and texts that merely share a hash
stay apart. Copies are combined before the shuffle: each task sends a text once, however often it occurs, and a
text that a third of all rows share is no hot key. Groups travel back to the rows by hash, without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import ident, materialize, without

_SPAN = 1 << 64
_TOP = (1 << 63) - 1


def content(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _rank(length: Column, doc_id: Column) -> Column:
    """One number that orders by length, then by smaller id; a null id comes last."""
    below = F.lit(_TOP).cast("decimal(20,0)") - F.coalesce(doc_id, F.lit(_TOP)).cast("decimal(20,0)")
    return length.cast("decimal(10,0)") * F.lit(str(_SPAN)).cast("decimal(20,0)") + below


def _id_of(rank: Column) -> Column:
    return (F.lit(_TOP).cast("decimal(20,0)") - F.pmod(rank, F.lit(str(_SPAN)).cast("decimal(20,0)"))).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_chars: int = 32) -> DataFrame:
    """All rows with ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``content``. The row with the most code points in the original text, then
    the smallest id, stays. Ids are integers; rows that repeat one id with one text are one document and share their
    fate; a null id counts as the largest. Null and blank texts form one group. ``hash_chars`` (hex digits of the
    hash, 32 for 128 bits) is shortened in tests to force collisions. Other columns are ignored.
    """
    text = ident(text_col)
    norm = content(text)
    rows = docs.select(
        ident(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.sha2(norm, 256).alias("text_sha256"),
        F.length(F.coalesce(text, F.lit(""))).alias("chars"))
    rows = rows.withColumn("hash", F.unhex(F.substring("text_sha256", 1, hash_chars)))
    groups = rows.groupBy("hash", "norm").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"))
    slim = materialize(groups.select("hash", "group_size", _id_of(F.col("best")).alias("keep_id")), "dedup-groups")
    per_hash = slim.groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    # The groups' file is small beside their rows in memory, so they are not broadcast, however small the file.
    single = rows.drop("norm", "chars").hint("merge").join(per_hash.filter("texts = 1").drop("texts"), "hash").select(*out)
    collided = per_hash.filter("texts > 1").select("hash")
    if not collided.isEmpty():
        # Different texts under one hash: only their rows are matched by the texts themselves.
        exact = groups.join(collided, "hash", "left_semi").select("norm", "group_size", _id_of(F.col("best")).alias("keep_id"))
        single = single.unionByName(rows.join(collided, "hash", "left_semi").join(exact, "norm").select(*out))
    null_id = F.when(F.col("keep_id") == F.lit(_TOP), F.lit(None)).otherwise(F.col("keep_id"))
    return single.select(
        "doc_id", null_id.alias("keep_id"), "group_size",
        F.coalesce(F.col("doc_id"), F.lit(_TOP)).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    digest = lambda sha: F.unhex(F.substring(sha, 1, 32))
    dropped = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select("doc_id", digest("text_sha256").alias("hash"))
    return without(docs, dropped, "dedup-dropped", doc_id=ident(id_col).cast("long"), hash=digest(F.sha2(content(ident(text_col)), 256)))
