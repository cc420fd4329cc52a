"""Document quality by hierarchical empirical Bayes: a text classifier, shrunk towards what its site is like.

A logistic model over text features, fitted on the labelled rows, gives each document's own evidence. Its
probabilities are summed by host and by path in grouped aggregations; a host's rate is shrunk towards the global
rate, a path's rate towards its host's, each with a prior weight estimated from the spread of the rates (method of
moments). The document's odds are then multiplied by the odds of its path against the global odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import ident, materialize, on_workers, without

FEATURES = ("upper", "symbols", "digits", "bars", "marked_words", "repeats", "few_words", "long_words", "commas", "size")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()")
_DIGITS = b"0123456789"
_MARKED = re.compile(rb"[!#$%&*]{2,}(?=[\x09-\x0D\x20]|\Z)")
MAX_PRIOR_WEIGHT = 1e4
_SURE = 1e-6


def features_of(text: str) -> tuple[float, ...]:
    """Shares between 0 and 1 that describe a text; all zero for a blank one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(FEATURES)
    size, n = len(data), len(words)
    letters = size - n + 1
    upper = size - len(data.translate(None, _UPPER))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (
        min(1.0, upper / letters), min(1.0, (size - len(data.translate(None, _SYMBOLS))) / letters),
        min(1.0, (size - len(data.translate(None, _DIGITS))) / letters), data.count(b"|") / n,
        len(_MARKED.findall(data)) / n, repeats / n, 1 - len(set(words)) / n,
        sum(len(w) > 20 for w in words) / n, min(1.0, data.count(b",") / n), min(1.0, n / 200))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*(features_of(t.as_py() or "") for t in batch.column(3)), strict=True)) or [()] * len(FEATURES)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", "host", "path", *FEATURES])


def document_features(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    on_workers(docs.sparkSession)
    rows = docs.select(
        ident(id_col).cast("long").alias("doc_id"), F.coalesce(ident(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(ident(path_col).cast("string"), F.lit("")).alias("path"), ident(text_col).alias("text"))
    return rows.mapInArrow(_features, "doc_id long, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES))


def _logit(p: Column) -> Column:
    sure = F.greatest(F.least(p, F.lit(1 - _SURE)), F.lit(_SURE))
    return F.log(sure / (1 - sure))


def fit_classifier(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Column:
    """Probability of good quality as a column over ``rows``' features, fitted on every labelled row.

    Labels are 0 or 1; null labels and labels of unknown documents are left out. Without labels of both kinds
    the probability is the labels' mean, or 1 without any.
    """
    known = labels.select(ident(label_id).cast("long").alias("doc_id"), ident(label_col).cast("double").alias("label")).filter(
        F.col("label").isin(0.0, 1.0))
    training = materialize(rows.join(known, "doc_id").select(*FEATURES, "label"), "quality-training")
    seen = training.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    if not seen["n"] or seen["good"] in (0.0, float(seen["n"])):
        return F.lit(seen["good"] / seen["n"] if seen["n"] else 1.0)
    model = LogisticRegression(featuresCol="vector", labelCol="label", regParam=1e-4, maxIter=60).fit(
        training.select(array_to_vector(F.array(*FEATURES)).alias("vector"), "label"))
    score = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients.toArray().tolist(), strict=True):
        score = score + F.col(name) * weight
    return 1 / (1 + F.exp(-score))


def _prior_weight(sites: DataFrame, rate: Column, towards: Column) -> float:
    """Weight of the rate that ``sites`` (with ``n``) shrink to: how many documents it counts for.

    Method of moments for a beta prior. Without spread beyond chance the weight is at its maximum.
    """
    noise = towards * (1 - towards)
    row = sites.agg(
        F.sum(F.col("n") * (rate - towards) ** 2).alias("spread"), F.sum(noise).alias("noise"),
        F.sum(F.col("n") * noise).alias("scale"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites")).first()
    if not row["n"]:
        return MAX_PRIOR_WEIGHT
    between = (row["spread"] - row["noise"]) / row["n"]
    mean_noise = row["scale"] / row["n"]
    if between <= 0 or mean_noise / max(between, 1e-12) - 1 > MAX_PRIOR_WEIGHT:
        return MAX_PRIOR_WEIGHT
    return max(1.0, mean_noise / between - 1)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """All rows: ``doc_id, text_prob, host_rate, path_rate, quality, keep``.

    ``text_prob`` is the classifier's; ``host_rate`` and ``path_rate`` are the shrunk rates; ``quality`` combines
    them; ``keep`` is false below ``threshold``. Null hosts and paths form a site of their own, null texts count as
    blank, repeated rows are scored each, no rows give no rows; other columns are ignored. The driver reads single
    rows (rates and the model's weights).
    """
    rows = materialize(document_features(docs, id_col, text_col, host_col, path_col), "quality-features")
    scored = rows.select("doc_id", "host", "path", fit_classifier(rows, labels).alias("text_prob"))
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("text_prob").alias("good")), "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = total["good"] / total["n"] if total["n"] else 1.0
    rate = F.col("good") / F.col("n")
    by_host = _prior_weight(hosts, rate, F.lit(mean))
    hosts = hosts.select("host", ((F.col("good") + by_host * mean) / (F.col("n") + by_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    by_path = _prior_weight(paths, rate, F.col("host_rate"))
    paths = materialize(paths.select(
        "host", "path", "host_rate", ((F.col("good") + by_path * F.col("host_rate")) / (F.col("n") + by_path)).alias("path_rate")), "quality-rates")
    odds = _logit(F.col("text_prob")) + _logit(F.col("path_rate")) - _logit(F.lit(mean))
    # Every row has its site; of a left join the rows themselves are never broadcast.
    joined = scored.join(paths, ["host", "path"], "left")
    quality = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "text_prob", "host_rate", "path_rate", quality.alias("quality"), (quality >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns. A null id is judged like the other null ids together."""
    bad = score_quality(docs, labels, **options).filter(~F.col("keep")).select("doc_id")
    return without(docs, bad, "quality-rejected", doc_id=ident(options.get("id_col", "doc_id")).cast("long"))
