"""URL verdicts: host and path rules first, then exact list membership by a Bloom filter cascade.

The cascade keeps a list of keys exactly, as long as every key asked about belongs to the key universe it
was built over. Level 0 holds the listed keys; level 1 those unlisted keys that level 0 wrongly accepts;
level 2 the listed keys that level 1 wrongly accepts, and so on until a level accepts nothing wrongly. A key
is judged by the first level that rejects it. All levels are bit arrays in shards of bounded size, built and
probed with built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import LOWER, UPPER, ident, materialize

BITS_PER_KEY = 8
HASHES = 4
SHARD_KEYS = 1 << 16
INLINE_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and a path prefix, written like ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


@dataclass(frozen=True)
class Cascade:
    """``shards``: one row per shard with its bit arrays by level; ``levels``: bits per shard of each level."""

    shards: DataFrame
    count: int
    levels: tuple[int, ...]

    @property
    def size_bytes(self) -> int:
        return self.count * sum(self.levels) // 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key, by double hashing; each level hashes on its own."""
    first = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits - 1)) + 1
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(HASHES)]


def _accepts(levels: Column, key: Column, level: int, bits: int) -> Column:
    found = F.lit(True)
    for at in _positions(key, level, bits):
        word = F.get(F.get(levels, F.lit(level)), F.floor(at / 64).cast("int"))
        found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return found


def _with_levels(rows: DataFrame, key: Column, cascade: Cascade, inline_bytes: int) -> DataFrame:
    """Rows with ``_levels``, the bit arrays of the key's shard.

    A cascade of at most ``inline_bytes`` is one scalar value in the plan, so nothing is joined or shuffled.
    A larger one is joined by shard; a busy shard is split by adaptive execution.
    """
    shard = _shard(key, cascade.count)
    if cascade.size_bytes <= inline_bytes:
        ordered = F.array_sort(F.collect_list(F.struct("shard", "levels")))
        whole = cascade.shards.agg(F.transform(ordered, lambda s: s["levels"]).alias("all"))
        return rows.withColumn("_levels", F.get(whole.scalar(), shard.cast("int")))
    return rows.withColumn("_shard", shard).join(
        cascade.shards.select(F.col("shard").alias("_shard"), F.col("levels").alias("_levels")), "_shard").drop("_shard")


def _bits(keys: DataFrame, level: int, shards: int, bits: int) -> DataFrame:
    """``(shard, words)``: one dense bit array per shard, also for shards without keys."""
    words = bits // 64
    spark = keys.sparkSession
    blank = spark.range(shards * words).select(
        F.floor(F.col("id") / words).alias("shard"), F.pmod("id", F.lit(words)).alias("word"), F.lit(0).cast("long").alias("mask"))
    at = F.explode(F.array(*_positions(F.col("key"), level, bits)))
    set_bits = keys.select(_shard(F.col("key"), shards).alias("shard"), at.alias("at")).select(
        "shard", F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 64) as int))").alias("mask"))
    dense = set_bits.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return dense.groupBy("shard").agg(F.transform(ordered, lambda w: w["mask"]).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, key_col: str = "key", *, shard_keys: int = SHARD_KEYS,
                  inline_bytes: int = INLINE_BYTES) -> Cascade:
    """Cascade for the ``listed`` keys over ``universe``, the keys that will ever be asked about.

    Repeated and null keys are dropped; listed keys outside the universe are kept. Both tables may be empty.
    The driver reads one count per level; levels shrink by a constant factor, so a few suffice.
    """
    members = materialize(listed.select(ident(key_col).cast("string").alias("key")).dropna().distinct(), "cascade-listed")
    others = materialize(
        universe.select(ident(key_col).cast("string").alias("key")).dropna().distinct().join(members, "key", "left_anti"),
        "cascade-others")
    n = members.count()
    wrong = (1 - 2.718281828 ** (-HASHES / BITS_PER_KEY)) ** HASHES
    shards = max(1, -(-int(max(n, wrong * others.count())) // shard_keys))
    built = members.sparkSession.range(shards).select(F.col("id").alias("shard"), F.array().cast("array<array<bigint>>").alias("levels"))
    levels: list[int] = []
    inside, outside = members, others
    while n:
        bits = 64 * max(1, -(-n * BITS_PER_KEY // (64 * shards)))
        level = len(levels)
        levels.append(bits)
        built = materialize(built.join(_bits(inside, level, shards, bits), "shard").select(
            "shard", F.array_append("levels", F.col("words")).alias("levels")), "cascade-bits")
        cascade = Cascade(built, shards, tuple(levels))
        kept = _with_levels(outside, F.col("key"), cascade, inline_bytes).filter(
            _accepts(F.col("_levels"), F.col("key"), level, bits)).select("key")
        inside, outside = materialize(kept, "cascade-wrong"), inside
        n = inside.count()
    return Cascade(built, shards, tuple(levels))


def is_listed(rows: DataFrame, key: Column, cascade: Cascade, out: str, *, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Rows with a boolean column ``out``: the key is in the list. A null key is not."""
    if not cascade.levels:
        return rows.withColumn(out, F.lit(False))
    known = F.coalesce(key, F.lit(""))
    verdict = F.lit(len(cascade.levels) % 2 == 1)
    for level in reversed(range(len(cascade.levels))):
        verdict = F.when(~_accepts(F.col("_levels"), known, level, cascade.levels[level]), F.lit(level % 2 == 1)).otherwise(verdict)
    judged = _with_levels(rows, known, cascade, inline_bytes)
    return judged.withColumn(out, F.coalesce(verdict, F.lit(False)) & key.isNotNull()).drop("_levels")


def judge_urls(pages: DataFrame, rules: list[Rule], listed_hosts: Column | None = None, *, id_col: str = "page_id",
               url_col: str = "url", listed: DataFrame | None = None, shard_keys: int = SHARD_KEYS,
               inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``.

    The longest fitting rule decides; where none fits, a URL whose key (host and path) is on the list is blocked.
    ``listed``: a table with a column ``key``; or ``listed_hosts``: a condition on ``host`` that picks the listed
    keys out of the pages themselves. The key universe is every key of ``pages``. Null URLs have empty host and
    path and are allowed; repeated rows are judged each; other columns of ``pages`` are ignored.
    """
    host, path = host_and_path(ident(url_col))
    rows = pages.select(ident(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "_key", F.concat("host", "path"))
    keys = rows.select(F.col("_key").alias("key"), "host").filter(F.col("key") != "")
    if listed is None:
        listed = keys.filter(listed_hosts if listed_hosts is not None else F.lit(False))
    cascade = build_cascade(listed.select("key"), keys.select("key"), shard_keys=shard_keys, inline_bytes=inline_bytes)
    asked = F.when(F.col("_key") != "", F.col("_key"))
    judged = is_listed(rows, asked, cascade, "listed", inline_bytes=inline_bytes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
