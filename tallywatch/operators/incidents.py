"""Alerts, tickets and notification records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.text import or_default
from tallywatch.functions.timing import as_ntz, minutes_before, ntz_to_iso

# Message colours by severity and the outcome texts of each channel.
SEVERITY_COLORS = {"low": "#36a64f", "medium": "#daa038", "high": "#ff6b35", "critical": "#cc0000"}
EMAIL_LOGGED = "Email notification logged (SMTP not configured)"
IN_APP_CREATED = "In-app notification created"
NO_WEBHOOK_URL = "Webhook URL not configured"
NO_SLACK_URL = "Slack webhook URL not configured"
UNKNOWN_CHANNEL = "Unknown notification type"


def find_alerts(alerts: DataFrame, status: str | None = None, severity: str | None = None,
                source_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest alerts that meet the equality filters."""
    df = alerts
    for column, value in (("status", status), ("severity", severity), ("source_id", source_id)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(F.desc("created_at"), "id").limit(limit)


def alert_stats(alerts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(kind, name, n): total, each status (zero-filled), present severities, recent active alerts."""
    recent = F.count_if(
        (F.col("status") == "active") & (F.col("created_at") >= as_ntz(minutes_before(as_of, 60))))
    cells = alerts.groupBy("status", "severity").agg(F.count("*").alias("n"), recent.alias("recent"))
    sets = cells.groupingSets([["status"], ["severity"], []], "status", "severity").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("recent").alias("recent"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "severity").otherwise("total")
    def entry(kind: Column, name: Column, n: Column) -> Column:
        return F.struct(kind.alias("kind"), name.cast("string").alias("name"), n.cast("long").alias("n"))

    none = F.lit(None)
    # The grand-total row also carries the recent count.
    found = F.when(F.col("g") == 0b11, F.array(
        entry(F.lit("total"), none, F.col("n")), entry(F.lit("recent"), none, F.col("recent")),
    )).otherwise(F.array(entry(kind, F.coalesce("status", "severity"), F.col("n"))))
    # Zero rows: every status, and the totals of an empty table.
    zeros = [entry(F.lit("status"), F.lit(s), F.lit(0)) for s in schemas.ALERT_STATUSES]
    zeros += [entry(F.lit("total"), none, F.lit(0)), entry(F.lit("recent"), none, F.lit(0))]
    filler = alerts.sparkSession.range(1).select(F.inline(F.array(*zeros)))
    return sets.select(F.inline(found)).unionByName(filler).groupBy("kind", "name").agg(F.sum("n").alias("n"))


def apply_alert_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alert state after an action log ``(alert_id, action, actor, notes, at, action_id)``.

    The stored state is continued: what no action sets stays as it is. Any state may
    follow any other, so the last action sets the status. The
    acknowledger is the actor of the last acknowledge, or else of the first resolve.
    The notes are the last ones given with an acknowledge or a resolve.
    """
    order = F.struct("at", "action_id")
    ack, res = F.col("action") == "acknowledge", F.col("action") == "resolve"
    sets_notes = (ack & (F.length("notes") > 0)) | (res & F.col("notes").isNotNull())
    folded = actions.groupBy("alert_id").agg(
        F.max_by("action", order).alias("last_action"),
        F.max_by(F.struct("actor", "at"), F.when(ack, order)).alias("ack"),
        F.min_by(F.struct("actor", "at"), F.when(res, order)).alias("first_res"),
        F.max(F.when(res, F.col("at"))).alias("resolved_at"),
        F.max_by("notes", F.when(sets_notes, order)).alias("resolution_notes"),
        F.count("*").alias("n_actions"),
    )
    # Status after each action.
    status = (
        F.when(F.col("last_action") == "acknowledge", "acknowledged")
        .when(F.col("last_action") == "resolve", "resolved")
        .when(F.col("last_action") == "silence", "silenced")
    )
    kinds = {"status": "string", "acknowledged_by": "string", "acknowledged_at": "timestamp_ntz",
             "resolved_at": "timestamp_ntz", "resolution_notes": "string"}
    stored = alerts.select("id", "severity", "source_id", "created_at", *[
        (F.col(c) if c in alerts.columns else F.lit(None).cast(kind)).alias(f"_{c}") for c, kind in kinds.items()])
    # A resolve names an acknowledger only when nobody has acknowledged before.
    unseen = F.col("_acknowledged_by").isNull() & F.col("_acknowledged_at").isNull()
    by = F.coalesce("ack", F.when(unseen, F.col("first_res")))
    return stored.join(folded, stored["id"] == folded["alert_id"], "left").select(
        "id", "severity", "source_id", "created_at",
        F.coalesce(status, F.col("_status"), F.lit("active")).alias("status"),
        F.when(by.isNull(), F.col("_acknowledged_by")).otherwise(by["actor"]).alias("acknowledged_by"),
        F.when(by.isNull(), F.col("_acknowledged_at")).otherwise(by["at"]).alias("acknowledged_at"),
        F.coalesce("resolved_at", "_resolved_at").alias("resolved_at"),
        F.coalesce("resolution_notes", "_resolution_notes").alias("resolution_notes"),
        F.coalesce("n_actions", F.lit(0)).alias("n_actions"),
    )


def ticket_priority(severity: Column) -> Column:
    """Upper-case severity when it is a known priority, else MEDIUM."""
    upper = F.upper(severity)
    return F.when(upper.isin(schemas.TICKET_PRIORITIES), upper).otherwise(F.lit("MEDIUM"))


def tickets_from_alerts(alerts: DataFrame, rules: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One open ticket per alert, with its first matched log and its rule.

    ``source_id`` is the rule's source; ``server_id`` comes from the source's
    settings when they name one.
    """
    rule = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"),
                        F.col("source_id").alias("rule_source"))
    first_log = (
        F.col("first_log_id") if "first_log_id" in alerts.columns else F.get("log_ids", F.lit(0)))
    joined = alerts.withColumn("_first", first_log).join(rule, "rule_id", "left")
    if sources is None:
        joined = joined.withColumn("server_id", F.lit(None).cast("string"))
    else:
        config = F.from_json("config", schemas.SOURCE_CONFIG)
        homes = sources.select(F.col("id").alias("rule_source"), config["serverId"].alias("server_id"))
        joined = joined.join(homes, "rule_source", "left")
    text = F.concat(F.lit("An anomaly was detected based on rule: "), "rule_name")
    return joined.select(
        F.concat(F.lit("tkt-"), "id").alias("id"),
        F.concat(F.lit("Alert: "), or_default(F.col("rule_name"), "Anomaly Detected")).alias("title"),
        F.coalesce(F.nullif("description", F.lit("")), text).alias("description"),
        ticket_priority(F.col("severity")).alias("priority"),
        F.lit("OPEN").alias("status"),
        F.col("_first").alias("log_id"), F.col("rule_source").alias("source_id"), "server_id",
        "rule_id", F.col("id").alias("alert_id"), "created_at",
    )


def latest_ticket_status(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Tickets with the newest status update ``(ticket_id, status, at, update_id)`` applied."""
    last = updates.groupBy("ticket_id").agg(
        F.max_by("status", F.struct("at", "update_id")).alias("_status"), F.max("at").alias("updated_at"))
    return tickets.join(last, tickets["id"] == last["ticket_id"], "left").withColumn(
        "status", F.coalesce("_status", "status")).drop("_status", "ticket_id")


def ticket_listing(tickets: DataFrame) -> DataFrame:
    """Tickets, newest first."""
    return tickets.orderBy(F.desc("created_at"), "id")


def ticket_board(tickets: DataFrame) -> DataFrame:
    """Counts by status and priority."""
    return tickets.groupBy("status", "priority").agg(
        F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def route_notifications(tickets: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per ticket and action of its rule, in the order of the actions."""
    actions = rules.select(F.col("id").alias("rule_id"), F.posexplode(
        F.from_json("actions", schemas.ACTIONS)).alias("pos", "a"))
    return tickets.join(actions, "rule_id").select(
        F.col("id").alias("ticket_id"), "rule_id", "pos", F.col("a.type").alias("channel"),
        F.col("a.config").alias("config"), "title", "description",
        F.col("priority").alias("severity"), "status", "source_id", "created_at")


def notification_outcomes(routed: DataFrame, default_slack_url: str | None = None) -> DataFrame:
    """What can be said before delivery: success, message and error per routed row.

    A webhook or Slack row with a target is ready to send; delivery itself is not done here.
    """
    channel, config = F.col("channel"), F.col("config")
    hook = F.nullif(config["url"], F.lit(""))
    slack = F.coalesce(F.nullif(config["webhookUrl"], F.lit("")), F.lit(default_slack_url).cast("string"))
    error = (
        F.when((channel == "webhook") & hook.isNull(), NO_WEBHOOK_URL)
        .when((channel == "slack") & slack.isNull(), NO_SLACK_URL)
        .when(~channel.isin("email", "webhook", "slack", "in_app"), UNKNOWN_CHANNEL)
    )
    message = (
        F.when(channel == "email", EMAIL_LOGGED)
        .when(channel == "in_app", IN_APP_CREATED)
        .when((channel == "webhook") & hook.isNotNull(), F.concat(F.lit("Webhook delivered to "), hook))
        .when((channel == "slack") & slack.isNotNull(), "Slack notification sent")
    )
    return routed.select(
        "ticket_id", "rule_id", "pos", "channel", error.isNull().alias("success"),
        message.alias("message"), error.alias("error"))


def render_notifications(routed: DataFrame, as_of: dt.datetime, footer: str = "tallywatch") -> DataFrame:
    """Payload text per routed row: webhook JSON, Slack JSON, e-mail subject and body."""
    severity = F.col("severity")
    color = F.create_map(*[F.lit(x) for pair in SEVERITY_COLORS.items() for x in pair])[F.lower(severity)]

    def field(title: str, value: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short"))

    webhook = F.to_json(F.struct(
        F.struct(
            F.col("ticket_id").alias("id"), "title", "description", "severity", "status",
            F.col("source_id").alias("sourceId"), ntz_to_iso(F.col("created_at")).alias("createdAt"),
        ).alias("alert"),
        F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z").alias("timestamp"),
    ))
    slack = F.to_json(F.struct(
        F.col("config")["channel"].alias("channel"),
        F.array(F.struct(
            color.alias("color"),
            F.concat(F.lit("\U0001F6A8 "), "title").alias("title"),
            F.col("description").alias("text"),
            F.array(
                field("Severity", F.upper(severity)), field("Status", F.col("status")),
                field("Source", F.coalesce("source_id", F.lit("N/A"))), field("Alert ID", F.col("ticket_id")),
            ).alias("fields"),
            F.lit(footer).alias("footer"),
            F.timestamp_diff("SECOND", as_ntz(dt.datetime(1970, 1, 1)), F.col("created_at")).cast("string").alias("ts"),
        )).alias("attachments"),
    ))
    subject = F.concat(F.lit("["), F.upper(severity), F.lit("] "), "title")
    return routed.select(
        "ticket_id", "pos", "channel",
        F.when(F.col("channel") == "webhook", webhook).when(F.col("channel") == "slack", slack)
        .when(F.col("channel") == "email", F.col("description")).alias("body"),
        F.when(F.col("channel") == "email", subject).alias("subject"),
        F.when(F.col("channel") == "slack", color).alias("color"),
    )


def incident_chain(alerts: DataFrame, tickets: DataFrame, outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert to ticket to notification rows, with marks for broken references."""
    sent = outcomes.groupBy("ticket_id").agg(
        F.count("*").alias("notifications"), F.count_if(~F.col("success")).alias("failed"))
    known = rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("_rule"))
    chain = (
        alerts.select(F.col("id").alias("alert_id"), "rule_id", F.col("status").alias("alert_status"))
        .join(tickets.select("alert_id", F.col("id").alias("ticket_id"), F.col("status").alias("ticket_status")),
              "alert_id", "full")
        .join(sent, "ticket_id", "left")
        .join(known, "rule_id", "left")
    )
    link = (
        F.when(F.col("ticket_id").isNull(), "alert without ticket")
        .when(F.col("alert_status").isNull(), "ticket without alert")
        .when(F.col("_rule").isNull(), "rule missing")
        .when(F.col("notifications").isNull(), "not notified")
        .otherwise("complete")
    )
    return chain.select(
        "alert_id", "ticket_id", "rule_id", "alert_status", "ticket_status",
        F.coalesce("notifications", F.lit(0)).alias("notifications"),
        F.coalesce("failed", F.lit(0)).alias("failed"), link.alias("link"))


def alert_sla(alerts: DataFrame) -> DataFrame:
    """Minutes to acknowledge and to resolve, by severity."""
    def minutes(end: str) -> Column:
        return F.timestamp_diff("MINUTE", F.col("created_at"), F.col(end))

    ack, res = minutes("acknowledged_at"), minutes("resolved_at")
    return alerts.groupBy("severity").agg(
        F.count("*").alias("n"),
        F.count(ack).alias("acknowledged"), F.avg(ack).alias("avg_ack_minutes"), F.max(ack).alias("max_ack_minutes"),
        F.count(res).alias("resolved"), F.avg(res).alias("avg_resolve_minutes"),
        F.percentile_approx(res, 0.5, 10000).alias("p50_resolve_minutes"),
    )
