"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Outputs have scalar columns only; lists and maps are joined to text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.functions.levels import detect_level, normalize_level
from tallywatch.functions.once import with_fields
from tallywatch.functions.text import split_lines
from tallywatch.functions.timing import as_ntz, latest_ts
from tallywatch.operators import analysis, backtest, incidents, logs as store, rules as engine, tenancy, workflows
from tallywatch.plans import frames
from tallywatch.session import materialize, shared_dir
from tallywatch.sources import ingest, parse
from tallywatch.sources.sinks import Store, write_logs
from tallywatch.streaming import jobs


def map_text(column: str) -> Column:
    """Map as sorted ``key=value`` text."""
    pairs = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, ";")


def list_text(column: str | Column) -> Column:
    return F.array_join(column, ",")


def ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


# --- sources -----------------------------------------------------------------

def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.ingest_batches(frames.bulk_envelopes(spark, d)).unionByName(
        ingest.ingest_single(frames.single_envelopes(spark, d)))
    return rows.select("log_id", "source_id", "server_id", "level", "message", "format",
                       map_text("metadata").alias("metadata"), "ts", "is_analyzed")


def parse_dispatch(spark, d):
    good, _ = ingest.split_quarantine(ingest.parse_raw_lines(frames.raw_lines(spark, d)))
    return good.select("log_id", "source_id", "level", "message", "raw_content", "format",
                       map_text("metadata").alias("metadata"), "ts")


def quarantine(spark, d):
    """Raw lines, envelopes and webhook payloads that could not be taken in."""
    _, bad = ingest.split_quarantine(ingest.parse_raw_lines(frames.raw_lines(spark, d)))
    broken = frames.broken_payloads(spark, d)
    found = bad.withColumn("route", F.lit("line"))
    for route, rows in (("bulk", ingest.broken_batches(broken)), ("single", ingest.broken_singles(broken)),
                        ("alertmanager", ingest.broken_alertmanager(broken.withColumnRenamed("envelope_id", "payload_id")))):
        found = found.unionByName(rows.withColumn("route", F.lit(route)))
    return found


def _write_lines(spark, d, path: str, chosen: Column) -> None:
    messages = frames.raw_syslog(spark, d).withColumn("n", F.substring("message_id", 4, 12).cast("long"))
    messages.filter(chosen).select("raw").write.mode("append").text(path)


ARRIVAL = dt.datetime(2024, 2, 1)


def read_raw_lines(spark, d):
    """Syslog files read, and read again after others were added: the lines that kept the id they had are ``known``."""
    path = shared_dir(spark, "raw-lines")

    def lines() -> DataFrame:
        return ingest.read_raw_lines(spark, path, "files", "syslog", as_ntz(ARRIVAL))

    _write_lines(spark, d, path, F.col("n") % 2 == 0)
    before = materialize(lines().select(F.col("log_id").alias("id"), F.col("raw_content").alias("raw")), "raw-lines-before")
    _write_lines(spark, d, path, F.col("n") % 2 == 1)
    rows = lines().join(before, (F.col("log_id") == F.col("id")) & (F.col("raw_content") == F.col("raw")), "left")
    return rows.select("source_id", "level", "message", "ts", F.col("id").isNotNull().alias("known"))


def incremental_pull(spark, d):
    """Syslog files pulled three times while files are added, each with lines of all times: what each pull brought."""
    path, folder = shared_dir(spark, "pulled-files"), shared_dir(spark, "pull")
    rows = None
    for n in range(3):
        _write_lines(spark, d, path, F.col("n") % 3 == n)
        lines = ingest.as_source_lines(jobs.pull_lines(spark, path, folder), "files", "syslog", as_ntz(ARRIVAL))
        found = ingest.parse_raw_lines(lines).withColumn("pull", F.lit(n))
        rows = found if rows is None else rows.unionByName(found)
    nothing = jobs.pull_lines(spark, path, folder).select(
        F.lit("files").alias("source_id"), F.lit(None).cast("string").alias("level"), F.col("line").alias("message"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(3).alias("pull"))
    return rows.select("source_id", "level", "message", "ts", "pull").unionByName(nothing)


def explode_pages(spark, d):
    return ingest.explode_http_page(frames.http_bodies(spark, d))


def sender_source_map(spark, d):
    return ingest.sender_map(frames.log_sources(spark, d))


def syslog_ingest(spark, d):
    senders = ingest.sender_map(frames.log_sources(spark, d))
    rows = ingest.ingest_syslog(frames.raw_syslog(spark, d), senders)
    return rows.select("log_id", "source_id", "server_id", "level", "message",
                       map_text("metadata").alias("metadata"), "ts")


def frame_lines(spark, d):
    return ingest.frame_lines(frames.text_chunks(spark, d))


def provenance_counts(spark, d):
    return ingest.provenance_counts(frames.logs_with_metadata(spark, d))


def pull_plan(spark, d):
    return ingest.pull_plan(frames.log_sources(spark, d), frames.remote_servers(spark, d))


def ingestion_status(spark, d):
    sources = frames.log_sources(spark, d)
    plan = ingest.pull_plan(sources, frames.remote_servers(spark, d))
    return ingest.ingestion_status(frames.logs_with_metadata(spark, d), ingest.sender_map(sources), plan)


# --- parsing -----------------------------------------------------------------

def _parsed(df: DataFrame, p: Column) -> DataFrame:
    return with_fields(df, p).select(
        F.col("message_id").alias("log_id"), "level", "message", "ts", map_text("metadata").alias("metadata"), "error")


def parse_json_lines(spark, d):
    df = frames.logs(spark, d).select(
        F.col("log_id").alias("message_id"), F.col("ts").alias("received_at"),
        F.to_json(F.struct(F.upper("level").alias("level"), "message", F.col("event_type").alias("kind"),
                           F.when(F.col("value") > 50, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
                           F.col("user_id").alias("user"))).alias("line"))
    return _parsed(df, parse.parse_json_line(F.col("line"), F.col("received_at")))


def parse_syslog3164(spark, d):
    return _parsed(frames.raw_syslog(spark, d), parse.parse_rfc3164(F.col("raw"), F.col("received_at")))


def parse_syslog5424(spark, d):
    return _parsed(frames.raw_syslog_5424(spark, d), parse.parse_syslog(F.col("raw"), F.col("received_at")))


def normalize_levels(spark, d):
    # Raw names tried, one per customer key.
    names = ["DEBUG", "Trace", "verbose", "INFO", "notice", "WARNING", "warn", "ERROR", "Err", "FATAL",
             "critical", "EMERGENCY", "alert", "success", " info "]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return frames.table(spark, d, "customer").select(
        "c_custkey", raw.alias("raw"), normalize_level(raw).alias("level"))


def detect_levels(spark, d):
    return frames.messages(spark, d).select("log_id", detect_level(F.col("message")).alias("level"))


def normalize_webhooks(spark, d):
    kinds = frames.webhook_payloads(spark, d)
    rows = (
        parse.normalize_zabbix(kinds["zabbix"])
        .unionByName(parse.normalize_alertmanager(kinds["alertmanager"]))
        .unionByName(parse.normalize_datadog(kinds["datadog"]))
    )
    return rows.select("payload_id", "pos", "level", "message", "ts", map_text("metadata").alias("metadata"))


def metadata_extract(spark, d):
    return parse.extract_metadata(frames.logs_with_metadata(spark, d), ["receivedVia", "service", "duration", "status"])


# --- log store ---------------------------------------------------------------

COLUMNS = ["log_id", "source_id", "level", "message", "ts"]


def find_logs(spark, d):
    found = store.find_logs(
        frames.logs(spark, d), source_id="src3", levels="error, FATAL", search="K=1",
        start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 25))
    return found.select(*COLUMNS)


def page_logs(spark, d):
    return store.page_with_total(frames.logs(spark, d), page=3, limit=50).select(*COLUMNS, "total")


def search_logs(spark, d):
    hits = store.search_logs(frames.messages(spark, d), "The")
    return hits.select("log_id", "source_id", F.length("message").alias("n_chars"))


def log_stats(spark, d):
    return store.log_stats(frames.logs(spark, d))


def _requests(spark, d) -> DataFrame:
    return frames.alerts(spark, d).select(F.col("id").alias("request_id"), F.col("log_ids").alias("ids"))


def lookup_logs(spark, d):
    return store.lookup_logs(frames.logs(spark, d), _requests(spark, d)).select("request_id", "pos", "log_id", "level")


def _ledger(spark, d) -> DataFrame:
    replies = frames.model_replies(spark, d)
    return replies.select(F.explode("log_ids").alias("log_id"), "analysis_id").filter(
        F.col("analysis_type") == "batch")


def unanalyzed_logs(spark, d):
    return store.unanalyzed_logs(frames.logs(spark, d), _ledger(spark, d), limit=100).select(*COLUMNS)


def mark_analyzed(spark, d):
    new = frames.model_replies(spark, d).filter(F.col("analysis_type") == "summary")
    ledger = store.mark_analyzed(_ledger(spark, d), new.select("analysis_id", "log_ids"))
    flagged = store.with_analyzed_flag(frames.logs(spark, d), ledger)
    return flagged.groupBy("source_id", "is_analyzed").agg(F.count("*").alias("n"))


def level_distribution(spark, d):
    return store.level_distribution(frames.logs(spark, d), "source_id").select(
        "source_id", map_text("levels").alias("levels"))


def time_range(spark, d):
    logs = frames.logs(spark, d)
    as_of = latest_ts(logs)
    per_level = store.time_range(logs, as_of, "level")
    none = store.time_range(store.find_logs(logs, source_id="no such source"), as_of)
    return per_level.unionByName(none.withColumn("level", F.lit("none")))


def volume_timeseries(spark, d):
    return store.volume_timeseries(frames.logs(spark, d), "6 hours")


# --- rules -------------------------------------------------------------------

def _conditions(spark, d, as_of: dt.datetime, kind: str) -> DataFrame:
    """Results of all conditions of one type, of rules in any status."""
    found = analysis.anomalies_flat(_analyses(spark, d)) if kind == "ai_anomaly" else None
    results = engine.condition_results(frames.alert_rules(spark, d), frames.logs(spark, d), as_of, found)
    return results.filter(F.col("type") == kind).select("rule_id", "pos", "hits", "total", "keywords_matched", "met")


def _as_of(spark, d) -> dt.datetime:
    return latest_ts(frames.table(spark, d, "events"))


def _analyses(spark, d) -> DataFrame:
    return analysis.parse_responses(frames.model_replies(spark, d))


def rule_selection(spark, d):
    return engine.select_rules(frames.alert_rules(spark, d), "src3").select("id", "source_id", "severity")


def rule_cooldown(spark, d):
    return engine.cooldown_gate(frames.alert_rules(spark, d), _as_of(spark, d)).select(
        F.col("id").alias("rule_id"), "cooldown_minutes", "suppressed")


def _type_query(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _conditions(spark, d, _as_of(spark, d), kind)
    return query


def _evaluated(spark, d, **options) -> DataFrame:
    return engine.evaluate_rules(frames.alert_rules(spark, d), frames.logs(spark, d), _as_of(spark, d), **options)


def _verdict_columns(results: DataFrame) -> DataFrame:
    return results.select("rule_id", "rule_name", "triggered", "matched_count", "first_log_id", "reason")


def evaluate_rules(spark, d):
    return _verdict_columns(_evaluated(spark, d))


def rule_matched_logs(spark, d):
    return engine.matched_logs(
        engine.select_rules(frames.alert_rules(spark, d)), frames.logs(spark, d), _as_of(spark, d))


def _new_alerts(spark, d) -> DataFrame:
    return engine.trigger_alerts(_evaluated(spark, d), _as_of(spark, d))


def alert_logs(spark, d):
    """Every log behind each alert the rules raise now."""
    alerts = materialize(_new_alerts(spark, d), "new-alerts")
    fired = frames.alert_rules(spark, d).join(alerts.select(F.col("rule_id").alias("id")), "id", "left_semi")
    pairs = engine.alert_logs(alerts, engine.matched_logs(fired, frames.logs(spark, d), _as_of(spark, d)))
    # The id of an alert holds the evaluation time; the rule id is enough here.
    return pairs.select(F.regexp_extract("alert_id", "^alert-(.*)-[0-9]+$", 1).alias("rule_id"), "log_id")


def trigger_alerts(spark, d):
    fired = _new_alerts(spark, d).select(
        F.lit("rule").alias("origin"), "rule_id", "source_id", "title", "description", "severity", "status",
        F.col("metadata.ruleName").alias("rule_name"), F.col("metadata.triggerReason").alias("reason"),
        F.col("metadata.matchedLogCount").alias("matched_count"))
    manual = engine.create_alerts(frames.table(spark, d, "customer").selectExpr(
        "concat('src', c_nationkey) AS source_id", "concat('Manual ', c_name) AS title",
        "c_mktsegment AS description", "CASE WHEN c_acctbal < 0 THEN 'high' ELSE 'low' END AS severity"))
    none = F.lit(None)
    return fired.unionByName(manual.select(
        F.lit("manual").alias("origin"), "rule_id", "source_id", "title", "description", "severity", "status",
        none.cast("string").alias("rule_name"), none.cast("string").alias("reason"), none.cast("long").alias("matched_count")))


def rule_stats(spark, d):
    return engine.rule_stats(frames.alert_rules(spark, d), frames.alerts(spark, d))


def rule_test(spark, d):
    return _verdict_columns(engine.test_rule(
        frames.alert_rules(spark, d), frames.logs(spark, d), _as_of(spark, d)))


def backtest_rules(spark, d):
    """All rules at every minute of the logs, with their own windows and cool-downs and the stored anomalies."""
    logs = frames.logs(spark, d)
    start, end = logs.agg(F.min("ts"), F.max("ts")).first()
    return backtest.backtest_rules(frames.alert_rules(spark, d), logs, start, end, 1, analysis.anomalies_flat(_analyses(spark, d)))


def rule_listing(spark, d):
    return engine.rule_listing(frames.alert_rules(spark, d)).select("id", "name", "owner_id", "status", "created_at")


# --- incidents ---------------------------------------------------------------

def find_alerts(spark, d):
    return incidents.find_alerts(frames.alerts(spark, d), status="active", severity="high").select(
        "id", "source_id", "title", "created_at")


def alert_stats(spark, d):
    alerts = frames.alerts(spark, d)
    return incidents.alert_stats(alerts, latest_ts(alerts, "created_at"))


def alert_lifecycle(spark, d):
    return incidents.apply_alert_actions(frames.alerts(spark, d), frames.alert_actions(spark, d))


def _tickets(spark, d) -> DataFrame:
    return incidents.tickets_from_alerts(
        frames.alerts(spark, d), frames.alert_rules(spark, d), frames.log_sources(spark, d))


def tickets_from_alerts(spark, d):
    """Tickets of the stored alerts and of the alerts the rules raise now."""
    rules, sources = frames.alert_rules(spark, d), frames.log_sources(spark, d)
    fresh = incidents.tickets_from_alerts(_new_alerts(spark, d), rules, sources)
    # The id of a fresh ticket holds the evaluation time; the rule id is enough here.
    fresh = fresh.withColumn("id", F.concat(F.lit("tkt-now-"), "rule_id"))
    keep = ["id", "title", "description", "priority", "status", "log_id", "source_id", "server_id", "rule_id"]
    return _tickets(spark, d).select(*keep).unionByName(fresh.select(*keep))


def ticket_board(spark, d):
    return incidents.ticket_board(incidents.latest_ticket_status(_tickets(spark, d), frames.ticket_updates(spark, d)))


def _routed(spark, d) -> DataFrame:
    return incidents.route_notifications(_tickets(spark, d), frames.alert_rules(spark, d))


def route_notifications(spark, d):
    return _routed(spark, d).select("ticket_id", "rule_id", "pos", "channel", "severity", "status",
                                    map_text("config").alias("config"))


def notification_outcomes(spark, d):
    return incidents.notification_outcomes(_routed(spark, d))


def render_notifications(spark, d):
    return incidents.render_notifications(_routed(spark, d), dt.datetime(2024, 2, 1))


def incident_chain(spark, d):
    rules, alerts = frames.alert_rules(spark, d), frames.alerts(spark, d)
    tickets = _tickets(spark, d)
    outcomes = incidents.notification_outcomes(incidents.route_notifications(tickets, rules))
    return incidents.incident_chain(alerts, tickets, outcomes, rules)


def alert_sla(spark, d):
    return incidents.alert_sla(frames.alerts(spark, d))


# --- analysis ----------------------------------------------------------------

def analysis_batches(spark, d):
    batches = analysis.analysis_batches(frames.logs(spark, d))
    asked = frames.log_sources(spark, d).select(
        F.concat(F.lit("an-"), "id").alias("analysis_id"), F.col("id").alias("source_id"), F.lit("batch").alias("analysis_type"))
    filled = batches.select("source_id", "batch_no", "pos", "log_id", F.lit(None).cast("string").alias("summary"))
    empty = analysis.empty_analyses(asked, batches).select(
        "source_id", F.lit(0).cast("long").alias("batch_no"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("log_id"), "summary")
    return filled.unionByName(empty)


def render_context(spark, d):
    """Contexts of all log batches, plain and with times, and of batches of whole texts."""
    short = analysis.render_context(analysis.analysis_batches(frames.logs(spark, d)))
    texts = frames.messages(spark, d).withColumn("level", detect_level(F.col("message"))).withColumn(
        "ts", as_ntz(dt.datetime(2024, 1, 1)))
    long = analysis.render_context(analysis.analysis_batches(texts, 20))
    timed = analysis.render_context(analysis.analysis_batches(frames.logs(spark, d), 50), with_time=True)
    out = None
    for kind, df in (("short", short), ("texts", long), ("timed", timed)):
        rows = df.select(F.lit(kind).alias("form"), "source_id", "batch_no", "lines", "context")
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_responses(spark, d):
    return _analyses(spark, d).select(
        "analysis_id", "severity", "summary", "health_score", F.size("anomalies").alias("n_anomalies"),
        F.size("patterns").alias("n_patterns"), list_text("recommendations").alias("recommendations"), "error")


def anomalies_flat(spark, d):
    return analysis.anomalies_with_logs(_analyses(spark, d), frames.logs(spark, d)).select(
        "analysis_id", "pos", "log_id", "type", "confidence", "description", "suggested_action", "log_level")


def patterns_flat(spark, d):
    return analysis.patterns_flat(_analyses(spark, d)).select(
        "analysis_id", "pos", "pattern", "occurrences", "significance", "log_id")


def summary_severity(spark, d):
    return _analyses(spark, d).groupBy(analysis.summary_severity(F.col("health_score")).alias("severity")).agg(
        F.count("*").alias("n"), F.min("health_score").alias("lowest"), F.max("health_score").alias("highest"))


def summarize_window(spark, d):
    logs = frames.logs(spark, d)
    as_of = latest_ts(logs)
    exact = analysis.summarize_window(logs, as_of, 72)
    pieces = analysis.summary_pieces(logs, as_of, 72).groupBy("source_id").agg(
        (F.max("batch_no") + 1).alias("pieces"), F.count("*").alias("shown"))
    return exact.join(pieces, "source_id").select(
        "source_id", "total", "errors", map_text("levels").alias("levels"), "start_ts", "end_ts", "pieces", "shown")


def _errors(spark, d) -> DataFrame:
    """All fatal logs: the errors a root-cause run is asked about."""
    return store.find_logs(frames.logs(spark, d), level="fatal").select("log_id")


def rca_context(spark, d):
    logs = frames.logs(spark, d)
    shown = analysis.rca_context(logs, _errors(spark, d)).select(
        F.lit("shown").alias("part"), "log_id", F.col("batch_no").alias("piece"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("errors"))
    around = analysis.context_per_error(logs, logs.filter(F.col("level") == "fatal")).select(
        F.lit("around").alias("part"), "log_id", F.lit(None).cast("long").alias("piece"), F.col("context_rows").alias("rows"), F.col("context_errors").alias("errors"))
    return shown.unionByName(around)


def offline_scorer(contexts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: counts the error lines of each context."""
    return [_offline_reply(context) for context in contexts]


def _offline_reply(context: str) -> str:
    lines = context.split("\n")
    bad = sum(line.startswith(("[ERROR]", "[FATAL]", "Level: error", "Level: fatal")) for line in lines)
    if lines[0].startswith("Level: "):
        anomaly = "true" if bad else "false"
        return f'{{"isAnomaly": {anomaly}, "confidence": {0.9 if bad else 0.1}, "explanation": "{lines[0]}"}}'
    score = round(100 * (1 - bad / max(len(lines), 1)))
    return f'Result: {{"summary": "{bad} of {len(lines)} lines are errors", "healthScore": {score}}}'


def score_batches(spark, d):
    """Batches of every source, and every log alone."""
    logs = frames.logs(spark, d)
    contexts = analysis.render_context(analysis.analysis_batches(logs)).withColumn(
        "analysis_id", F.concat_ws("-", F.lit("batch"), "source_id", "batch_no"))
    batches = analysis.parse_responses(analysis.score_batches(contexts, offline_scorer))
    singles = analysis.parse_single_responses(
        analysis.score_batches(analysis.single_contexts(logs), offline_scorer))
    return batches.select("analysis_id", "source_id", "summary", F.col("health_score").cast("double").alias("score")).unionByName(
        singles.select("analysis_id", "source_id", F.col("explanation").alias("summary"), F.col("confidence").alias("score")))


def rca_results(spark, d):
    return analysis.rca_results(frames.root_cause_replies(spark, d)).select(
        "analysis_id", "severity", "confidence", "summary", list_text("affected_components").alias("components"),
        list_text("recommended_fixes").alias("fixes"), "analysis_depth")


def analysis_history(spark, d):
    return analysis.analysis_history(_analyses(spark, d), source_id="src4", analysis_type="summary").select(
        "analysis_id", "created_at", "severity")


def analysis_report(spark, d):
    return analysis.analysis_report(_analyses(spark, d), frames.logs(spark, d))


def error_spikes(spark, d):
    return analysis.detect_error_spikes(frames.logs(spark, d), "6 hours", 24, 2.0)


def mine_patterns(spark, d):
    """Templates of the log messages and of every line of the whole texts."""
    return analysis.mine_patterns(_messages_and_lines(spark, d)).select(
        "template", "occurrences", "share", "significance")


def _messages_and_lines(spark, d) -> DataFrame:
    lines = frames.messages(spark, d).select(
        F.col("log_id").alias("doc"), F.posexplode(split_lines(F.col("message"))).alias("i", "message")).select(
        F.concat_ws("#", "doc", F.col("i").cast("string")).alias("log_id"), "message")
    return frames.logs(spark, d).select("log_id", "message").unionByName(lines)


def pattern_logs(spark, d):
    """The template of every log message and of every line of the whole texts."""
    return analysis.pattern_logs(_messages_and_lines(spark, d))


def detect_bursts(spark, d):
    return analysis.detect_bursts(frames.logs(spark, d), "30 minutes", 3)


def rca_timeline(spark, d):
    window = analysis.rca_window(frames.logs(spark, d), _errors(spark, d))
    return analysis.rca_timeline(window).select("log_id", "ts", "level", "significance")


def affected_components(spark, d):
    return analysis.affected_components(analysis.rca_window(frames.logs(spark, d), _errors(spark, d)))


def health_scores(spark, d):
    return analysis.health_scores(frames.logs(spark, d))


# --- streaming ---------------------------------------------------------------

def stream_ingest(spark, d):
    lines = frames.shape_raw_lines(frames.shape_logs(frames.event_stream(spark, d)))
    rows = jobs.run_to_table(jobs.stream_ingest(lines), "stream-ingest")
    return rows.filter(F.col("error").isNull()).select(
        "log_id", "source_id", "level", "message", "format", map_text("metadata").alias("metadata"), "ts")


def stream_tumbling(spark, d):
    rows = jobs.run_to_table(jobs.stream_tumbling_counts(frames.log_stream(spark, d), "3 hours"), "stream-tumbling")
    return rows.withColumn("bucket_start", ntz("bucket_start"))


def _over_pieces(spark, d, label: str, job: Callable[[DataFrame, dt.datetime], DataFrame], pieces: int = 2) -> DataFrame:
    """A job run over the events piece by piece, each run going on from the checkpoint of the one before."""
    since = frames.table(spark, d, "events").agg(F.min("ts")).first()[0]
    folder, rows = shared_dir(spark, label), None
    for logs in frames.log_pieces(spark, d, shared_dir(spark, f"{label}-events"), pieces):
        rows = jobs.run_to_table(job(logs, since), label, folder)
    return rows


def stream_rules(spark, d):
    """Every change of every rule's verdict, judged each minute."""
    rows = _over_pieces(spark, d, "stream-rules", lambda logs, since: jobs.stream_rules(logs, frames.alert_rules(spark, d), since))
    return rows.withColumn("as_of", ntz("as_of"))


def stream_sessions(spark, d):
    rows = jobs.run_to_table(jobs.stream_sessions(frames.log_stream(spark, d), "30 minutes"), "stream-sessions")
    return rows.withColumn("start_ts", ntz("start_ts")).withColumn("end_ts", ntz("end_ts"))


def stream_cooldown(spark, d):
    """Every trigger of every rule, judged each minute, outside its cool-down."""
    rows = _over_pieces(spark, d, "stream-cooldown", lambda logs, since: jobs.stream_cooldown(logs, frames.alert_rules(spark, d), since))
    return rows.withColumn("triggered_at", ntz("triggered_at"))


def stream_silence(spark, d):
    """Every time a source fell silent for half an hour."""
    rows = _over_pieces(spark, d, "stream-silence", lambda logs, since: jobs.stream_silence(logs, frames.log_sources(spark, d), 30, since))
    return rows.withColumn("last_ts", ntz("last_ts")).withColumn("as_of", ntz("as_of"))


def stream_source_refresh(spark, d):
    """Sources of streamed messages, the sender map being read again for every micro-batch."""
    messages = frames.log_stream(spark, d).select(
        F.col("log_id").alias("message_id"), F.concat(F.lit("10.1.0."), "user_id").alias("sender_ip"), F.lit("udp").alias("transport"))
    return jobs.run_source_refresh(messages, lambda: frames.log_sources(spark, d)).select("message_id", "source_id", "server_id")


def sink_round_trip(spark, d):
    """Logs written by day and read back for ten days, of which only those are read."""
    path = shared_dir(spark, "logs")
    write_logs(frames.logs(spark, d).select(*COLUMNS), path)
    stored = spark.read.parquet(path)
    start = dt.datetime(2024, 1, 5)
    return store.find_logs(stored, start=start, end=start + dt.timedelta(days=10)).select(*COLUMNS, F.col("dt").cast("string").alias("day"))


def rule_loop(spark, d):
    """Three turns of the rule loop half an hour apart, the last one repeated: stored alerts with what hangs on them, and the rules' state."""
    first, last = frames.logs(spark, d).agg(F.min("ts"), F.max("ts")).first()
    end = first + (last - first) // dt.timedelta(minutes=1) * dt.timedelta(minutes=1)
    held = Store(spark, shared_dir(spark, "rule-loop"))
    found = materialize(analysis.anomalies_flat(_analyses(spark, d)).select("source_id", "type", "confidence", "created_at"), "loop-anomalies")
    for minutes in (60, 30, 0, 0):
        workflows.rule_run(frames.alert_rules(spark, d), frames.logs(spark, d), frames.log_sources(spark, d), held,
                           end - dt.timedelta(minutes=minutes), found)
    behind = held["alert_logs"].counts()
    tickets = held["tickets"].read().select(F.col("rule_id").alias("_r"), F.col("created_at").alias("_at"), "priority")
    alerts = held["alerts"].read()
    fired = alerts.join(behind, alerts["id"] == behind["alert_id"], "left").join(
        tickets, (F.col("rule_id") == F.col("_r")) & (F.col("created_at") == F.col("_at")), "left").select(
        F.lit("alert").alias("kind"), "rule_id", F.col("created_at").alias("at"), F.coalesce("n_logs", F.lit(0)).alias("n"), "priority")
    state = held["rule_stats"].read().filter(F.col("run") == end.strftime("%Y%m%d%H%M%S%f")).select(
        F.lit("state").alias("kind"), "rule_id", F.col("last_triggered_at").alias("at"), F.col("trigger_count").alias("n"),
        F.lit(None).cast("string").alias("priority"))
    return fired.unionByName(state)


def analysis_job(spark, d):
    """The analysis job over the logs of two weeks, then over all, then again: stored results, and the logs left open."""
    logs = frames.logs(spark, d)
    held = Store(spark, shared_dir(spark, "analysis-job"))
    for run, rows in (("first", logs.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 15)))), ("second", logs), ("third", logs)):
        workflows.analysis_run(rows, held, offline_scorer, run, ARRIVAL)
    covered = held["ledger"].read()
    counts = covered.groupBy("analysis_id").agg(F.count("*").alias("n_logs"))
    stored = held["analyses"].read().join(counts, "analysis_id").select("analysis_id", "source_id", "summary", "health_score", "n_logs")
    left = store.unanalyzed_logs(logs, covered).agg(F.count("*").alias("n_logs"))
    none = F.lit(None)
    return stored.unionByName(left.select(
        F.lit("open").alias("analysis_id"), none.cast("string").alias("source_id"), none.cast("string").alias("summary"),
        none.cast(stored.schema["health_score"].dataType).alias("health_score"), "n_logs"))


def stream_dedupe(spark, d):
    lines = frames.log_stream(spark, d).withColumn("raw_content", F.concat_ws(" ", "ts", "message"))
    again = frames.log_stream(spark, d).withColumn("raw_content", F.concat_ws(" ", "ts", "message"))
    rows = jobs.run_to_table(
        jobs.stream_dedupe(lines.unionByName(again)).select("log_id", "source_id", "level", "ts"), "stream-dedupe")
    return rows.withColumn("ts", ntz("ts"))


# --- tenancy -----------------------------------------------------------------

def _tenant_logs(spark, d) -> DataFrame:
    return tenancy.with_organization(frames.logs(spark, d), frames.log_sources(spark, d))


def _usage(spark, d) -> DataFrame:
    return tenancy.usage_metering(
        frames.logs(spark, d), frames.model_replies(spark, d), frames.log_sources(spark, d))


def _organizations(spark, d) -> DataFrame:
    """Organisations of the sources' owners with a plan by their number of sources."""
    return frames.log_sources(spark, d).groupBy(F.col("owner_id").alias("organization_id")).agg(
        F.count("*").alias("rules"), F.count_if(F.col("status") == "online").alias("users")
    ).withColumn("plan", F.when(F.col("rules") > 5, "pro").when(F.col("rules") > 3, "starter").otherwise("free"))


def usage_metering(spark, d):
    return _usage(spark, d)


def quota_check(spark, d):
    return tenancy.quota_check(_usage(spark, d), _organizations(spark, d))


def retention(spark, d):
    kept = tenancy.apply_retention(_tenant_logs(spark, d), _organizations(spark, d), _as_of(spark, d))
    return kept.groupBy("organization_id").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


def tenant_scope(spark, d):
    return tenancy.tenant_scope(_tenant_logs(spark, d), "org15").select("log_id", "source_id", "organization_id", "level")


def severity_heatmap(spark, d):
    return tenancy.severity_heatmap(frames.alerts(spark, d))


QUERIES = {
    "ingest_batches": ingest_batches,
    "parse_dispatch": parse_dispatch,
    "incremental_pull": incremental_pull,
    "rule_loop": rule_loop,
    "analysis_job": analysis_job,
    "explode_pages": explode_pages,
    "syslog_ingest": syslog_ingest,
    "sender_source_map": sender_source_map,
    "frame_lines": frame_lines,
    "provenance_counts": provenance_counts,
    "pull_plan": pull_plan,
    "ingestion_status": ingestion_status,
    "quarantine": quarantine,
    "read_raw_lines": read_raw_lines,
    "parse_json_lines": parse_json_lines,
    "parse_syslog3164": parse_syslog3164,
    "parse_syslog5424": parse_syslog5424,
    "normalize_level": normalize_levels,
    "detect_level": detect_levels,
    "normalize_webhooks": normalize_webhooks,
    "metadata_extract": metadata_extract,
    "find_logs": find_logs,
    "page_logs": page_logs,
    "search_logs": search_logs,
    "log_stats": log_stats,
    "lookup_logs": lookup_logs,
    "unanalyzed_logs": unanalyzed_logs,
    "mark_analyzed": mark_analyzed,
    "level_distribution": level_distribution,
    "time_range": time_range,
    "volume_timeseries": volume_timeseries,
    "rule_selection": rule_selection,
    "rule_cooldown": rule_cooldown,
    "rule_error_count": _type_query("error_count"),
    "rule_error_rate": _type_query("error_rate"),
    "rule_log_level": _type_query("log_level"),
    "rule_keyword_match": _type_query("keyword_match"),
    "rule_no_logs": _type_query("no_logs"),
    "rule_ai_anomaly": _type_query("ai_anomaly"),
    "rule_unknown_type": _type_query("custom"),
    "evaluate_rules": evaluate_rules,
    "rule_matched_logs": rule_matched_logs,
    "alert_logs": alert_logs,
    "trigger_alerts": trigger_alerts,
    "rule_stats": rule_stats,
    "rule_test": rule_test,
    "backtest_rules": backtest_rules,
    "rule_listing": rule_listing,
    "find_alerts": find_alerts,
    "alert_stats": alert_stats,
    "alert_lifecycle": alert_lifecycle,
    "tickets_from_alerts": tickets_from_alerts,
    "ticket_board": ticket_board,
    "route_notifications": route_notifications,
    "notification_outcomes": notification_outcomes,
    "render_notifications": render_notifications,
    "incident_chain": incident_chain,
    "alert_sla": alert_sla,
    "analysis_batches": analysis_batches,
    "render_context": render_context,
    "parse_responses": parse_responses,
    "anomalies_flat": anomalies_flat,
    "patterns_flat": patterns_flat,
    "summary_severity": summary_severity,
    "summarize_window": summarize_window,
    "rca_context": rca_context,
    "score_batches": score_batches,
    "rca_results": rca_results,
    "analysis_history": analysis_history,
    "analysis_report": analysis_report,
    "error_spikes": error_spikes,
    "mine_patterns": mine_patterns,
    "pattern_logs": pattern_logs,
    "detect_bursts": detect_bursts,
    "rca_timeline": rca_timeline,
    "affected_components": affected_components,
    "health_scores": health_scores,
    "stream_ingest": stream_ingest,
    "stream_tumbling": stream_tumbling,
    "stream_rules": stream_rules,
    "stream_sessions": stream_sessions,
    "stream_cooldown": stream_cooldown,
    "stream_silence": stream_silence,
    "stream_source_refresh": stream_source_refresh,
    "sink_round_trip": sink_round_trip,
    "stream_dedupe": stream_dedupe,
    "usage_metering": usage_metering,
    "quota_check": quota_check,
    "retention": retention,
    "tenant_scope": tenant_scope,
    "severity_heatmap": severity_heatmap,
}
