"""The recurring jobs end to end: rules to alerts and what follows from them, and logs to stored analyses.

Each run has a time or a name, and its rows are written under it. A run that is repeated, wholly or after it was cut
short, changes nothing that was written before.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.timing import as_ntz
from tallywatch.operators import analysis, incidents, logs as store_of_logs, rules as engine
from tallywatch.session import materialize
from tallywatch.sources.sinks import Store

_STATS = "rule_id string, last_triggered_at timestamp_ntz, trigger_count long, run string"
_LEDGER = "log_id string, analysis_id string"


def rules_with_stats(rules: DataFrame, store: Store) -> DataFrame:
    """Rules with the newest stored time and count of their triggers, where there are any."""
    stats = store["rule_stats"].read(_STATS).groupBy(F.col("rule_id").alias("_rule")).agg(
        F.max("last_triggered_at").alias("_last"), F.max("trigger_count").alias("_count"))
    return rules.join(stats, rules["id"] == stats["_rule"], "left").withColumn(
        "last_triggered_at", F.greatest("last_triggered_at", "_last")).withColumn(
        "trigger_count", F.coalesce("_count", "trigger_count")).drop("_rule", "_last", "_count")


def rule_run(rules: DataFrame, logs: DataFrame, sources: DataFrame, store: Store, as_of: dt.datetime,
             anomalies: DataFrame | None = None) -> None:
    """One turn of the rule loop: usable rules evaluated, their alerts, the logs behind them, tickets, notifications and new rule state written.

    A rule that does not pass ``validate_rules`` is not evaluated. The logs that any window reaches are written once
    and read from there; logs behind alerts of rules that ask alike are stored once. The state is written last: until then the rules
    are as before and a repeated turn finds the same.
    """
    run = as_of.strftime("%Y%m%d%H%M%S%f")
    if run in store["rule_stats"].batches():
        return
    usable = engine.validate_rules(rules).filter(F.col("_error").isNull()).drop("_error")
    known = materialize(rules_with_stats(usable, store), "rules-known")
    recent = materialize(engine.recent_logs(logs, known, as_of), "recent-logs")
    alerts = materialize(engine.trigger_alerts(engine.evaluate_rules(known, recent, as_of, anomalies=anomalies), as_of), "new-alerts")
    store["alerts"].append(run, alerts)
    fired = known.join(alerts.select(F.col("rule_id").alias("id")), "id", "left_semi")
    sets, logs_of_sets = engine.matched_sets(fired, recent, as_of, anomalies)
    store["alert_logs"].append_sets(run, engine.alert_logs(alerts, sets, "match_set"), logs_of_sets)
    tickets = materialize(incidents.tickets_from_alerts(alerts, known, sources), "new-tickets")
    store["tickets"].append(run, tickets)
    store["outcomes"].append(run, incidents.notification_outcomes(incidents.route_notifications(tickets, known)))
    store["rule_stats"].append(run, engine.rule_stats(known, alerts).withColumn("run", F.lit(run)))


def analysis_run(logs: DataFrame, store: Store, scorer: analysis.Scorer, run: str, as_of: dt.datetime) -> None:
    """Logs that no stored analysis covers, in batches, scored, parsed and stored; the ledger remembers what is covered.

    A batch whose reply failed is stored with its error and counts as covered, like any other.
    """
    if run in store["ledger"].batches():
        return
    open_logs = store_of_logs.unanalyzed_logs(logs, store["ledger"].read(_LEDGER))
    batches = materialize(analysis.analysis_batches(open_logs).withColumn(
        "analysis_id", F.concat_ws("-", F.lit(run), "source_id", "batch_no")), "open-batches")
    contexts = analysis.render_context(batches).withColumn("analysis_id", F.concat_ws("-", F.lit(run), "source_id", "batch_no"))
    replies = analysis.score_batches(contexts, scorer).withColumn("created_at", as_ntz(as_of)).withColumn("analysis_type", F.lit("batch"))
    store["analyses"].append(run, analysis.parse_responses(replies))
    store["ledger"].append(run, batches.select("log_id", "analysis_id"))
