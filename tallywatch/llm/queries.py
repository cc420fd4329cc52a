"""Registered queries of this subpackage and their SQL: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import (
    conversation_repair, decontam, exact_dedup, lattice_lm, packing, quality, resampling, secret_scan, sharding, simhash,
    surrogates, token_store, url_filter)
from tallywatch.llm.common import table

# Folder of the public vocabularies.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Whoever holds the key can link surrogates; a deployment passes its own.
SURROGATE_KEY = os.environ.get("SURROGATE_KEY", "a key for tests").encode()

URL_RULES = [url_filter.Rule(*r) for r in (
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
# The tables hold no block list, so the listed keys are those of hosts with one of these labels.
LISTED_LABELS = ("cheap-pills", "spam-farm", "adult-x", "casino-win", "ads-track", "free-bets")
_LABEL_PATTERN = r"(^|[.])(" + "|".join(LISTED_LABELS) + r")[.]"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, F.col("host").rlike(_LABEL_PATTERN))


OP1_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '{_LABEL_PATTERN}') AS listed FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM ruled
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/word_bpe_49k.json", end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json", end_id=1)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/piece_bpe_32k.model")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), item AS (
  SELECT id, w, least(5, len(w)) AS size FROM split WHERE kind = 'b' AND len(w) > 0
), item_shingle AS (
  SELECT DISTINCT id AS item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item)
), doc_shingle AS (
  SELECT DISTINCT id AS doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT split.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (SELECT DISTINCT size FROM item) WHERE kind = 'd' AND len(w) >= size)
), sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_shingle GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM doc_shingle JOIN item_shingle USING (size, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= 0.8 * item_shingles
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, seed=2024)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_store": op4_token_store,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_surrogates": op7_surrogates,
    "op8_simhash": op8_simhash,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_decontamination": op10_decontamination,
    "op11_sharding": op11_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_resampling": op13_resampling,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op10_decontamination": OP10_SQL,
}
