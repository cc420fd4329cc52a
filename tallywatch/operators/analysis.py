"""Analysis jobs: batches, context text, model replies, reports and rule-based findings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.levels import is_error
from tallywatch.functions.once import with_fields
from tallywatch.functions.running import running_totals
from tallywatch.functions.text import brace_block, or_default, template_of
from tallywatch.functions.timing import as_ntz, minutes_before, within
from tallywatch.session import materialize

# Batch sizes, context margin, and default texts.
BATCH_SIZE = 100
SUMMARY_HOURS = 24
SUMMARY_SIZE = 500
CONTEXT_SIZE = 200
CONTEXT_MINUTES = 5
NO_DATA = "No data to analyze"
DONE = "Analysis completed"
ROOT_CAUSE_DONE = "Root cause analysis completed"
NO_JSON = "Analysis failed: No valid JSON found in response"
BAD_JSON = "Analysis failed: invalid JSON in response"
FAILED = "Analysis failed"


# --- choosing and rendering logs ---------------------------------------------

def analysis_batches(logs: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Every log with its ``batch_no`` (from 0) and ``pos`` (from 1) inside it, newest first per source.

    Rows are numbered hour by hour with a carry over the hours, so a busy source is no
    single group.
    """
    us = F.timestamp_diff("MICROSECOND", as_ntz(dt.datetime(1970, 1, 1)), F.col("ts"))
    ordered = logs.withColumn("_order", F.struct((-us).alias("us"), F.col("log_id").alias("id")))
    hour = F.floor(F.col("_order.us") / 3_600_000_000)
    numbered = running_totals(ordered, "source_id", "_order", hour, {"_before": F.lit(1)})
    return numbered.withColumn("batch_no", F.floor(F.col("_before") / size)).withColumn(
        "pos", F.pmod("_before", F.lit(size)) + 1).drop("_order", "_before")


def empty_analyses(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Result rows for requested sources ``(analysis_id, source_id, analysis_type)`` without logs.

    They are returned to the caller and not stored.
    """
    none = requests.join(batches.select("source_id").distinct(), "source_id", "left_anti")
    return none.select(
        "analysis_id", "source_id", "analysis_type", F.array().cast("array<string>").alias("log_ids"),
        F.lit("none").alias("provider"), F.lit("unknown").alias("severity"), F.lit(NO_DATA).alias("summary"))


def context_line(with_time: bool = False) -> Column:
    """One log as text: level, id and whole message, optionally with its time."""
    head = F.concat(F.lit("["), F.upper("level"), F.lit("] "), "log_id", F.lit(": "))
    if with_time:
        stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "))
        return F.concat(stamp, head, F.coalesce("message", F.lit("")))
    return F.concat(head, F.coalesce("message", F.lit("")))


def render_context(batches: DataFrame, with_time: bool = False) -> DataFrame:
    """Context text of every batch, one line per log."""
    lines = batches.select(
        "source_id", "batch_no", F.struct("pos", context_line(with_time).alias("line"), "log_id").alias("l"))
    ordered = F.array_sort(F.collect_list("l"))
    return lines.groupBy("source_id", "batch_no").agg(ordered.alias("ls")).select(
        "source_id", "batch_no", F.size("ls").alias("lines"),
        F.transform("ls", lambda l: l["log_id"]).alias("log_ids"),
        F.array_join(F.transform("ls", lambda l: l["line"]), "\n").alias("context"))


# --- replies -----------------------------------------------------------------

def parse_responses(replies: DataFrame) -> DataFrame:
    """Reply texts ``(analysis_id, reply, ..)`` to result columns.

    The text between the first ``{`` and the last ``}`` is read as JSON; missing
    keys get defaults; a text without braces or with broken JSON gives an error result.
    """
    found = with_fields(replies, F.struct(brace_block(F.col("reply")).alias("_block")))
    parsed = with_fields(found, F.struct(
        F.try_parse_json("_block").isNotNull().alias("_ok"), F.from_json("_block", schemas.BATCH_REPLY).alias("_r")))
    r = F.when(F.col("_ok"), F.col("_r"))
    error = F.when(F.col("_block").isNull(), NO_JSON).when(~F.col("_ok"), BAD_JSON)

    def items(name: str, kind) -> Column:
        empty = F.from_json(F.lit("[]"), kind)
        return F.coalesce(r[name], empty).alias(name)

    texts = "array<string>"
    return parsed.select(
        *[c for c in replies.columns if c != "reply"],
        items("anomalies", schemas.ANOMALIES), items("patterns", schemas.PATTERNS),
        or_default(r["severity"], "unknown").alias("severity"),
        F.when(error.isNotNull(), error).otherwise(or_default(r["summary"], DONE)).alias("summary"),
        items("recommendations", texts), items("keyEvents", texts), items("topIssues", texts),
        F.coalesce(r["healthScore"], F.lit(100)).alias("health_score"),
        error.alias("error"),
    )


def anomalies_flat(analyses: DataFrame) -> DataFrame:
    """One row per anomaly of an analysis."""
    keep = [c for c in ("analysis_id", "source_id", "created_at") if c in analyses.columns]
    return analyses.select(*keep, F.posexplode("anomalies").alias("pos", "a")).select(
        *keep, "pos", F.col("a.logId").alias("log_id"), F.col("a.type").alias("type"),
        F.col("a.confidence").alias("confidence"), F.col("a.description").alias("description"),
        F.col("a.suggestedAction").alias("suggested_action"))


def anomalies_with_logs(analyses: DataFrame, logs: DataFrame) -> DataFrame:
    """Anomalies joined to the logs they point at; dangling ids drop out."""
    found = logs.select("log_id", F.col("level").alias("log_level"), F.col("ts").alias("log_ts"))
    return anomalies_flat(analyses).join(found, "log_id")


def patterns_flat(analyses: DataFrame) -> DataFrame:
    """One row per pattern and log id."""
    keep = [c for c in ("analysis_id", "source_id", "created_at") if c in analyses.columns]
    rows = analyses.select(*keep, F.posexplode("patterns").alias("pos", "p"))
    return rows.select(
        *keep, "pos", F.col("p.pattern").alias("pattern"), F.col("p.occurrences").alias("occurrences"),
        F.col("p.significance").alias("significance"), F.col("p.description").alias("description"),
        F.explode_outer("p.logIds").alias("log_id"))


def summary_severity(score: Column) -> Column:
    """Severity band of a health score."""
    return F.when(score >= 80, "healthy").when(score >= 50, "warning").otherwise("critical")


def rca_severity(confidence: Column) -> Column:
    """Severity of a root-cause result."""
    return F.when(confidence >= 0.7, "critical").otherwise("warning")


def rca_results(replies: DataFrame) -> DataFrame:
    """Root-cause replies to result rows; an unreadable reply has confidence 0 and no causes."""
    block = brace_block(F.col("reply"))
    r = F.from_json(block, schemas.ROOT_CAUSE_REPLY)
    parsed = with_fields(replies, F.struct(r.alias("_r")))
    c = F.col("_r")
    confidence = F.coalesce(c["confidence"], F.lit(0.0))
    empty = F.array().cast("array<string>")
    return parsed.select(
        *[name for name in replies.columns if name != "reply"],
        rca_severity(confidence).alias("severity"), confidence.alias("confidence"),
        or_default(F.get(c["probableCauses"], F.lit(0))["cause"], ROOT_CAUSE_DONE).alias("summary"),
        c["probableCauses"].alias("probable_causes"), c["timeline"].alias("timeline"),
        F.coalesce(c["affectedComponents"], empty).alias("affected_components"),
        F.coalesce(c["recommendedFixes"], empty).alias("recommended_fixes"),
        or_default(c["analysisDepth"], "shallow").alias("analysis_depth"))


# --- scoring -----------------------------------------------------------------

Scorer = Callable[[list[str]], list[str]]


def score_batches(contexts: DataFrame, scorer: Scorer, parallelism: int | None = None, at_once: int = 256) -> DataFrame:
    """Run a user-given scorer (context texts to as many reply texts) over contexts.

    The scorer gets up to ``at_once`` contexts a call. Contexts are spread by their
    size first, or over ``parallelism`` tasks. When a call fails, its contexts are
    tried one by one; those that still fail have no reply, which the parsers turn into
    an error result, and ``scorer_error`` tells why.
    """
    def attempt(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = scorer(texts)
            if len(replies) != len(texts):
                raise ValueError(f"{len(replies)} replies to {len(texts)} contexts")
        except Exception as problem:  # noqa: BLE001 - kept in the error column
            if len(texts) > 1:
                return [found for text in texts for found in attempt([text])]
            return [(None, f"{type(problem).__name__}: {problem}")]
        return [(reply, None) for reply in replies]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), at_once):
                part = frame.iloc[start:start + at_once]
                replies, errors = zip(*attempt(part["context"].tolist()), strict=True)
                yield part[["analysis_id", "source_id"]].assign(reply=list(replies), scorer_error=list(errors))

    asked = contexts.select("analysis_id", "source_id", "context")
    spread = asked.repartition(parallelism, "analysis_id") if parallelism else asked.hint("rebalance")
    return spread.mapInPandas(run, "analysis_id string, source_id string, reply string, scorer_error string")


def single_contexts(logs: DataFrame) -> DataFrame:
    """One context per log: level, message and metadata."""
    meta = F.to_json("metadata") if "metadata" in logs.columns else F.lit("{}")
    return logs.select(
        F.concat(F.lit("single-"), "log_id").alias("analysis_id"), "source_id",
        F.concat(F.lit("Level: "), "level", F.lit("\nMessage: "), "message", F.lit("\nMetadata: "),
                 F.coalesce(meta, F.lit("{}"))).alias("context"))


def parse_single_responses(replies: DataFrame) -> DataFrame:
    """Replies about one log, with defaults for missing keys and unreadable replies."""
    body = F.from_json(brace_block(F.col("reply")), schemas.SINGLE_REPLY)
    parsed = with_fields(replies, F.struct(body.alias("_r")))
    r, empty = F.col("_r"), F.array().cast("array<string>")
    # A reply that cannot be read leaves every field null.
    unread = r.isNull() | (r["isAnomaly"].isNull() & r["confidence"].isNull() & r["explanation"].isNull())
    return parsed.select(
        *[c for c in replies.columns if c != "reply"],
        F.coalesce(r["isAnomaly"], F.lit(False)).alias("is_anomaly"), r["anomalyType"].alias("anomaly_type"),
        F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(unread, FAILED).otherwise(F.coalesce(r["explanation"], F.lit(""))).alias("explanation"),
        F.coalesce(r["suggestedActions"], empty).alias("suggested_actions"),
        F.coalesce(r["relatedConcepts"], empty).alias("related_concepts"))


# --- summaries, root-cause context -------------------------------------------

def summarize_window(logs: DataFrame, as_of: dt.datetime, hours: float = SUMMARY_HOURS) -> DataFrame:
    """Per source: exact totals by level, time range and error share of the trailing hours."""
    recent = within(logs, minutes_before(as_of, hours * 60), as_of)
    cells = recent.groupBy("source_id", "level").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    entries = F.array_sort(F.collect_list(F.struct("level", "n")))
    errors = F.sum(F.when(is_error(F.col("level")), F.col("n")).otherwise(0))
    return cells.groupBy("source_id").agg(
        F.sum("n").alias("total"), errors.alias("errors"), F.map_from_entries(entries).alias("levels"),
        F.min("a").alias("start_ts"), F.max("b").alias("end_ts"),
    )


def summary_pieces(logs: DataFrame, as_of: dt.datetime, hours: float = SUMMARY_HOURS,
                   size: int = SUMMARY_SIZE) -> DataFrame:
    """All logs of the window in numbered pieces for a scorer, newest first per source."""
    return analysis_batches(within(logs, minutes_before(as_of, hours * 60), as_of), size)


def _envelope(logs: DataFrame, error_ids: DataFrame) -> DataFrame:
    """First and last time of the given error logs, widened by the margin (one row)."""
    hit = logs.join(error_ids.select("log_id").distinct(), "log_id", "left_semi")
    margin = F.expr(f"INTERVAL {CONTEXT_MINUTES} MINUTES")
    return hit.agg((F.min("ts") - margin).alias("lo"), (F.max("ts") + margin).alias("hi"))


def rca_window(logs: DataFrame, error_ids: DataFrame) -> DataFrame:
    """Every log of any source inside the time envelope of the error logs.

    The envelope is one row read to the driver, so its bounds are literals in the scan.
    """
    lo, hi = _envelope(logs, error_ids).first()
    if lo is None:
        return logs.limit(0)
    return within(logs, lo, hi)


def rca_context(logs: DataFrame, error_ids: DataFrame, size: int = CONTEXT_SIZE) -> DataFrame:
    """All logs of the envelope in numbered pieces for a scorer, newest first per source."""
    return analysis_batches(rca_window(logs, error_ids), size)


def context_per_error(logs: DataFrame, errors: DataFrame, minutes: int = CONTEXT_MINUTES) -> DataFrame:
    """Counts around each error log: rows and errors of any source within the margin.

    A range join would pair every error with every row near it. Instead, time is cut
    into buckets as wide as the margin. Around an error lie its own bucket, the end of
    the one before and the start of the one after: whole buckets are looked up, parts
    are running totals inside a bucket, kept second by second. No key holds more than
    one bucket.
    """
    width = minutes * 60 * 1_000_000
    epoch = as_ntz(dt.datetime(1970, 1, 1))

    def micros(column: str) -> Column:
        return F.timestamp_diff("MICROSECOND", epoch, F.col(column))

    zero, no_id = F.lit(0).cast("long"), F.lit(None).cast("string")
    points = logs.groupBy(micros("ts").alias("us")).agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("e")
    ).select("us", F.lit(0).alias("kind"), "n", "e", no_id.alias("log_id"))
    # A margin's start comes before the rows of its own time, its end after them.
    ends = errors.select("log_id", F.explode(F.array(
        F.struct((micros("ts") - width).alias("us"), F.lit(-1).alias("kind")),
        F.struct((micros("ts") + width).alias("us"), F.lit(1).alias("kind")),
    )).alias("q")).select("q.us", "q.kind", zero.alias("n"), zero.alias("e"), "log_id")
    bucket = F.floor(F.col("us") / width)
    line = points.unionByName(ends).select(
        bucket.alias("bucket"), F.struct("us", "kind").alias("at"), "us", "kind", "n", "e", "log_id")
    totals = running_totals(
        line, "bucket", "at", F.floor(F.col("us") / 1_000_000), {"rows": F.col("n"), "bad": F.col("e")})
    parts = totals.filter(F.col("log_id").isNotNull()).select(
        "log_id", (F.col("kind") * F.col("rows")).alias("rows"), (F.col("kind") * F.col("bad")).alias("bad"))
    own = F.floor(micros("ts") / width)
    asked = errors.select("log_id", F.explode(F.array(own - 1, own)).alias("bucket"))
    whole = points.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("rows"), F.sum("e").alias("bad"))
    return parts.unionByName(asked.join(whole, "bucket").select("log_id", "rows", "bad")).groupBy("log_id").agg(
        F.sum("rows").alias("context_rows"), F.sum("bad").alias("context_errors"))


def rca_timeline(window: DataFrame) -> DataFrame:
    """Events of a root-cause window: first error is the trigger, last the result, others symptoms.

    Rows before the first error are left out, as nothing has gone wrong yet.
    """
    key = F.struct("ts", "log_id")
    first, last = window.filter(is_error(F.col("level"))).agg(F.min(key), F.max(key)).first()
    if first is None:
        return window.limit(0).withColumn("significance", F.lit(None).cast("string"))

    def at(row) -> Column:
        return (F.col("ts") == as_ntz(row["ts"])) & (F.col("log_id") == row["log_id"])

    mark = F.when(at(first), "trigger").when(at(last), "result").otherwise("symptom")
    errors = window.filter(is_error(F.col("level")))
    return errors.withColumn("significance", mark)


def affected_components(window: DataFrame) -> DataFrame:
    """Sources and servers in a root-cause window with their error share."""
    return window.groupBy("source_id", "server_id").agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("errors")
    ).filter(F.col("errors") > 0).withColumn("error_share", F.col("errors") / F.col("n"))


# --- history and report ------------------------------------------------------

def analysis_history(analyses: DataFrame, limit: int = 20, source_id: str | None = None,
                     analysis_type: str | None = None) -> DataFrame:
    """Newest analyses, optionally of one source or type."""
    df = analyses
    if source_id is not None:
        df = df.filter(F.col("source_id") == source_id)
    if analysis_type is not None:
        df = df.filter(F.col("analysis_type") == analysis_type)
    return df.orderBy(F.desc("created_at"), "analysis_id").limit(limit)


def analysis_report(analyses: DataFrame, logs: DataFrame, latest: int = 5) -> DataFrame:
    """Report rows (section, name, n, share, rank).

    Sections: batches by severity, anomalies by description, recommendations by
    frequency, the latest batches with their duration, and coverage of the log table.
    """
    none = F.lit(None)

    def section(df: DataFrame, title: str, share: Column = none, rank: Column = none) -> DataFrame:
        return df.select(
            F.lit(title).alias("section"), F.col("name").cast("string").alias("name"),
            F.col("n").cast("long").alias("n"), share.cast("double").alias("share"),
            rank.cast("int").alias("rank"))

    def ranked(df: DataFrame, title: str) -> DataFrame:
        """Counts with their rank; equal counts share one, so only distinct counts are put in order."""
        counted = df.groupBy("name").agg(F.count("*").alias("n"))
        ties = counted.groupBy("n").agg(F.count("*").alias("m"))
        above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        places = ties.select("n", (1 + F.coalesce(F.sum("m").over(above), F.lit(0))).alias("r"))
        return section(counted.join(places, "n"), title, rank=F.col("r"))

    severities = ranked(analyses.select(F.col("severity").alias("name")), "severity")
    anomalies = ranked(analyses.select(F.explode("anomalies.description").alias("name")), "anomaly")
    advice = ranked(analyses.select(F.explode("recommendations").alias("name")), "recommendation")
    newest = (
        analyses.filter(F.col("analysis_type") == "batch").orderBy(F.desc("created_at"), "analysis_id").limit(latest)
        .select(F.concat_ws(" ", "analysis_id", "severity", "summary").alias("name"), F.col("duration_ms").alias("n"))
    )
    # Logs and named ids meet in one grouping, not in a join, for which all ids might be broadcast.
    held = logs.select("log_id", F.lit(1).cast("long").alias("n"), F.lit(False).alias("named"))
    named = analyses.select(F.explode("log_ids").alias("log_id")).select(
        "log_id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("named"))
    by_id = held.unionByName(named).filter(F.col("log_id").isNotNull()).groupBy("log_id").agg(
        F.sum("n").alias("n"), F.bool_or("named").alias("named"))
    covered = by_id.filter("named").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = logs.agg(F.count("*").alias("t")).scalar()
    coverage = covered.select(F.lit("analysed").alias("name"), "n", F.try_divide(F.col("n"), total).alias("s"))
    return (
        severities.unionByName(anomalies).unionByName(advice)
        .unionByName(section(newest, "latest"))
        .unionByName(section(coverage, "coverage", share=F.col("s")))
    )


# --- rule-based findings -----------------------------------------------------

def detect_error_spikes(logs: DataFrame, bucket: str = "1 hour", history: int = 24,
                        factor: float = 3.0, min_errors: int = 3) -> DataFrame:
    """Buckets whose error count exceeds mean + ``factor`` deviations of the earlier buckets.

    The history is the ``history`` preceding buckets, back to the source's first log; a bucket without a log counts
    as one without errors. At least two are needed. Counting comes first, so the window function sees one row per
    source and bucket that holds logs; silent buckets add nothing to the sums and are counted by their number alone.
    """
    cells = logs.groupBy("source_id", F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("errors"))
    since = F.timestamp_diff("MICROSECOND", as_ntz(dt.datetime(1970, 1, 1)), F.col("w.start"))
    cells = cells.withColumn("_i", F.floor(since / F.timestamp_diff("MICROSECOND", F.col("w.start"), F.col("w.end"))))
    source = Window.partitionBy("source_id").orderBy("_i")
    before = source.rangeBetween(-history, -1)
    e = F.col("errors")
    past = F.col("_i") - F.first("_i").over(source)
    sums = cells.withColumn("_c", F.least(past, F.lit(history))).withColumn(
        "_s", F.coalesce(F.sum(e).over(before), F.lit(0))).withColumn("_q", F.coalesce(F.sum(e * e).over(before), F.lit(0)))
    c, s, q = (F.col(x).cast("double") for x in ("_c", "_s", "_q"))
    # Whole-number sums keep the deviation exact whatever the order of the rows.
    deviation = F.sqrt((c * q - s * s) / (c * (c - 1)))
    scored = sums.filter(F.col("_c") >= 2).withColumn("mean", s / c).withColumn("deviation", deviation)
    return scored.filter(
        (e >= min_errors) & (e > F.col("mean") + factor * F.col("deviation"))
    ).select("source_id", F.col("w.start").alias("bucket_start"), "n", "errors", "mean", "deviation")


def pattern_logs(logs: DataFrame) -> DataFrame:
    """``(template, log_id)`` of every log: which rows a template stands for."""
    return logs.select(template_of(F.col("message")).alias("template"), "log_id")


def mine_patterns(logs: DataFrame) -> DataFrame:
    """Message templates with count, share and significance, from one read of the logs.

    The counts are written once; their sum is the number of logs.
    """
    counts = materialize(pattern_logs(logs).groupBy("template").agg(F.count("*").alias("occurrences")), "templates")
    share = F.col("occurrences") / counts.agg(F.sum("occurrences").alias("t")).scalar()
    significance = F.when(share >= 0.1, "high").when(share >= 0.01, "medium").otherwise("low")
    return counts.select("template", "occurrences", share.alias("share"), significance.alias("significance"))


def detect_bursts(logs: DataFrame, gap: str = "10 minutes", min_count: int = 5) -> DataFrame:
    """Runs of logs of one source with no pause of ``gap`` or longer, of at least ``min_count`` rows.

    Rows inside one time slot as wide as the gap are always in the same run, so
    counting per slot comes first (combined before the shuffle, safe for a busy
    source); the runs are then joined from at most one row per source and slot.
    """
    slots = logs.groupBy("source_id", F.window("ts", gap).alias("w")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy("source_id").orderBy("a")
    starts = F.coalesce((F.col("a") >= F.lag("b").over(order) + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(0))
    numbered = slots.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy("source_id", "_run").agg(
        F.min("a").alias("start_ts"), F.max("b").alias("end_ts"), F.sum("n").alias("n")
    ).drop("_run").filter(F.col("n") >= min_count)


def health_scores(logs: DataFrame, bucket: str = "1 day") -> DataFrame:
    """Health 0..100 per source and bucket: 100 less the weighted share of problem rows."""
    # Weight of each level.
    weight = (
        F.when(F.col("level") == "fatal", 4).when(F.col("level") == "error", 2)
        .when(F.col("level") == "warn", 1).otherwise(0)
    )
    cells = logs.groupBy("source_id", F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("n"), F.sum(weight).alias("weighted"))
    score = F.floor(100.0 * (1 - F.col("weighted") / (4 * F.col("n"))) + 0.5).cast("int")
    return cells.select(
        "source_id", F.col("w.start").alias("bucket_start"), "n", score.alias("health_score"),
        summary_severity(score).alias("severity"))
