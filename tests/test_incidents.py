import datetime as dt
import json

from tallywatch.operators import incidents

T0 = dt.datetime(2026, 2, 1)


def alerts_of(spark, rows):
    return spark.createDataFrame(
        [(i, "r1", sev, st, "s1", T0 + dt.timedelta(minutes=m)) for i, sev, st, m in rows],
        "id string, rule_id string, severity string, status string, source_id string, created_at timestamp_ntz")


def test_stats_fill_statuses_and_bound_is_inclusive(spark):
    alerts = alerts_of(spark, [("a", "low", "active", 0), ("b", "low", "active", 60), ("c", "high", "resolved", 61)])
    got = {(r["kind"], r["name"]): r["n"] for r in incidents.alert_stats(alerts, T0 + dt.timedelta(minutes=120)).collect()}
    assert got == {("total", None): 3, ("recent", None): 1, ("severity", "low"): 2, ("severity", "high"): 1,
                   ("status", "active"): 2, ("status", "acknowledged"): 0, ("status", "resolved"): 1, ("status", "silenced"): 0}
    empty = incidents.alert_stats(alerts.filter("false"), T0)
    assert {(r["kind"], r["name"]): r["n"] for r in empty.collect()}[("total", None)] == 0


def test_lifecycle(spark):
    alerts = alerts_of(spark, [(x, "low", "active", 0) for x in "abcde"])
    def act(alert, action, actor, notes, minute):
        return (alert, action, actor, notes, T0 + dt.timedelta(minutes=minute), f"{minute:03d}")
    actions = spark.createDataFrame([
        act("a", "acknowledge", "ann", "looking", 1), act("a", "resolve", "bob", None, 2),
        act("b", "resolve", "bob", "done", 1), act("b", "acknowledge", "cyd", "", 2),
        act("c", "silence", "ann", "ignored", 1),
        act("d", "resolve", "bob", "x", 1), act("d", "resolve", "cyd", "y", 2),
    ], "alert_id string, action string, actor string, notes string, at timestamp_ntz, action_id string")
    got = {r["id"]: r for r in incidents.apply_alert_actions(alerts, actions).collect()}
    def view(key):
        r = got[key]
        return r["status"], r["acknowledged_by"], r["resolution_notes"], r["resolved_at"] and r["resolved_at"].minute, r["n_actions"]
    assert view("a") == ("resolved", "ann", "looking", 2, 2)
    assert view("b") == ("acknowledged", "cyd", "done", 1, 2)
    assert view("c") == ("silenced", None, None, None, 1)
    assert view("d") == ("resolved", "bob", "y", 2, 2)
    assert view("e") == ("active", None, None, None, 0)


def test_stored_alert_state_is_continued(spark):
    at = T0 + dt.timedelta(minutes=3)
    alerts = spark.createDataFrame(
        [("kept", "low", "s", T0, "resolved", "ann", at, at, "old note"), ("again", "low", "s", T0, "acknowledged", "ann", at, None, None)],
        "id string, severity string, source_id string, created_at timestamp_ntz, status string, acknowledged_by string, "
        "acknowledged_at timestamp_ntz, resolved_at timestamp_ntz, resolution_notes string")
    actions = spark.createDataFrame([("again", "resolve", "bob", "done", T0 + dt.timedelta(minutes=9), "1")],
                                    "alert_id string, action string, actor string, notes string, at timestamp_ntz, action_id string")
    got = {r["id"]: r for r in incidents.apply_alert_actions(alerts, actions).collect()}
    kept, again = got["kept"], got["again"]
    assert (kept["status"], kept["acknowledged_by"], kept["resolved_at"], kept["resolution_notes"]) == ("resolved", "ann", at, "old note")
    assert (again["status"], again["acknowledged_by"], again["acknowledged_at"], again["resolution_notes"]) == ("resolved", "ann", at, "done")


def rules_of(spark):
    actions = [{"type": "email", "config": {"email": "x@example.com"}}, {"type": "webhook", "config": {"url": "http://h"}},
               {"type": "webhook", "config": {}}, {"type": "slack", "config": {"channel": "#c"}},
               {"type": "in_app", "config": {}}, {"type": "pager", "config": {}}]
    return spark.createDataFrame([("r1", "Disk", "s1", json.dumps(actions)), ("r2", "Quiet", None, "[]")],
                                 "id string, name string, source_id string, actions string")


def tickets_of(spark):
    alerts = spark.createDataFrame([
        ("a1", "r1", "critical", "why", ["l2", "l9"], T0), ("a2", "r2", "odd", "", [], T0), ("a3", "gone", "low", "z", ["l1"], T0)],
        "id string, rule_id string, severity string, description string, log_ids array<string>, created_at timestamp_ntz")
    sources = spark.createDataFrame([("s1", '{"serverId":"web"}')], "id string, config string")
    return alerts, incidents.tickets_from_alerts(alerts, rules_of(spark), sources)


def test_tickets(spark):
    got = {r["alert_id"]: r for r in tickets_of(spark)[1].collect()}
    assert (got["a1"]["title"], got["a1"]["priority"], got["a1"]["log_id"], got["a1"]["server_id"]) == ("Alert: Disk", "CRITICAL", "l2", "web")
    assert (got["a2"]["priority"], got["a2"]["log_id"], got["a2"]["description"]) == ("MEDIUM", None, "An anomaly was detected based on rule: Quiet")
    assert got["a3"]["title"] == "Alert: Anomaly Detected" and got["a3"]["source_id"] is None


def test_notifications_in_action_order(spark):
    routed = incidents.route_notifications(tickets_of(spark)[1], rules_of(spark))
    rows = incidents.notification_outcomes(routed).orderBy("pos").collect()
    assert [(r["channel"], r["success"]) for r in rows] == [
        ("email", True), ("webhook", True), ("webhook", False), ("slack", False), ("in_app", True), ("pager", False)]
    assert [r["error"] for r in rows if not r["success"]] == [
        "Webhook URL not configured", "Slack webhook URL not configured", "Unknown notification type"]
    with_default = incidents.notification_outcomes(routed, "http://default").filter("channel = 'slack'").first()
    assert with_default["success"] and with_default["message"] == "Slack notification sent"


def test_payloads(spark):
    routed = incidents.route_notifications(tickets_of(spark)[1], rules_of(spark))
    rows = {(r["channel"], r["pos"]): r for r in incidents.render_notifications(routed, T0, footer="f").collect()}
    hook = json.loads(rows[("webhook", 1)]["body"])
    assert hook["alert"] == {"id": "tkt-a1", "title": "Alert: Disk", "description": "why", "severity": "CRITICAL", "status": "OPEN",
                             "sourceId": "s1", "createdAt": "2026-02-01T00:00:00.000Z"}
    slack = json.loads(rows[("slack", 3)]["body"])
    part = slack["attachments"][0]
    assert (slack["channel"], part["color"], part["ts"], part["footer"]) == ("#c", "#cc0000", "1769904000", "f")
    assert [f["value"] for f in part["fields"]] == ["CRITICAL", "OPEN", "s1", "tkt-a1"]
    assert rows[("email", 0)]["subject"] == "[CRITICAL] Alert: Disk"


def test_incident_chain_marks_broken_links(spark):
    alerts, tickets = tickets_of(spark)
    rules = rules_of(spark)
    outcomes = incidents.notification_outcomes(incidents.route_notifications(tickets, rules))
    stray = spark.createDataFrame([("a4", "r1", "active")], "id string, rule_id string, status string").unionByName(
        alerts.selectExpr("id", "rule_id", "'active' AS status"))
    lone = tickets.filter("alert_id <> 'a2'").unionByName(tickets.filter("alert_id = 'a2'").selectExpr(
        *["'zz' AS alert_id" if c == "alert_id" else c for c in tickets.columns]))
    got = {r["alert_id"]: r["link"] for r in incidents.incident_chain(stray, lone, outcomes, rules).collect()}
    assert got == {"a1": "complete", "a2": "alert without ticket", "a3": "rule missing", "a4": "alert without ticket", "zz": "ticket without alert"}


def test_ticket_updates(spark):
    tickets = tickets_of(spark)[1]
    updates = spark.createDataFrame([("tkt-a1", "RESOLVED", T0, "1"), ("tkt-a1", "IN_PROGRESS", T0, "2")],
                                    "ticket_id string, status string, at timestamp_ntz, update_id string")
    board = incidents.ticket_board(incidents.latest_ticket_status(tickets, updates)).collect()
    assert {(r["status"], r["priority"], r["n"]) for r in board} == {("IN_PROGRESS", "CRITICAL", 1), ("OPEN", "MEDIUM", 1), ("OPEN", "LOW", 1)}
