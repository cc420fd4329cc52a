import datetime as dt
import json
import re
import random

from pyspark.sql import functions as F

from tallywatch.sources import ingest, parse, sinks
from tallywatch.functions.timing import within

NOW = dt.datetime(2026, 2, 23, 12)


def test_bulk_and_single_envelopes(spark):
    bulk = {"sourceId": "http", "serverId": "srv", "format": "JSON", "logs": [
        {"level": "info", "message": "Request GET /api/users 200 OK 12ms", "metadata": {"path": "/api/users", "status": 200, "duration": 12}},
        {"level": "warn", "message": "Slow query detected", "metadata": {"duration": 3200}},
        {"level": "error", "message": "pool exhausted", "metadata": {"pool": "main", "active": 10, "waiting": 5}},
        {"level": "info", "message": "Cron job", "timestamp": "2026-02-23T14:30:00Z"},
        {"level": "fatal", "message": "Out of memory", "metadata": {"pid": 12345, "rss": "2.1GB"}},
    ]}
    one = {"sourceId": "http", "level": "debug", "message": "alone"}
    def frame(body):
        return spark.createDataFrame([("e1", json.dumps(body), NOW)], "envelope_id string, payload string, received_at timestamp_ntz")
    rows = ingest.ingest_batches(frame(bulk)).unionByName(ingest.ingest_single(frame(one))).orderBy("log_id", "level").collect()
    assert len(rows) == 6 and not any(r["is_analyzed"] for r in rows)
    by_level = {r["message"]: r for r in rows}
    assert by_level["Request GET /api/users 200 OK 12ms"]["metadata"] == {"path": "/api/users", "status": "200", "duration": "12"}
    assert by_level["Cron job"]["ts"] == dt.datetime(2026, 2, 23, 14, 30)
    assert by_level["Out of memory"]["ts"] == NOW and by_level["Out of memory"]["format"] == "json"
    assert by_level["alone"]["server_id"] is None


def test_sender_map_and_syslog(spark):
    sources = spark.createDataFrame([
        ("a", "syslog", '{"syslogIp":"1.1.1.1","syslogIps":["1.1.1.2"],"ip":"1.1.1.3","serverId":"sa"}', dt.datetime(2025, 1, 1)),
        ("b", "syslog", '{"syslogIp":"1.1.1.2"}', dt.datetime(2025, 1, 2)),
        ("c", "api", '{"syslogIp":"1.1.1.1"}', dt.datetime(2025, 1, 3)),
        ("d", "syslog", None, dt.datetime(2025, 1, 4)),
    ], "id string, type string, config string, created_at timestamp_ntz")
    senders = ingest.sender_map(sources)
    assert {(r["ip"], r["source_id"], r["server_id"]) for r in senders.collect()} == {
        ("1.1.1.1", "a", "sa"), ("1.1.1.2", "b", None), ("1.1.1.3", "a", "sa")}
    messages = spark.createDataFrame([
        ("m1", "<11>Feb 23 10:15:02 h k: x", "::ffff:1.1.1.1", "tcp", NOW),
        ("m2", "<11>Feb 23 10:15:02 h k: x", "::ffff:1.1.1.1", "udp", NOW),
        ("m3", "plain words", "9.9.9.9", "udp", NOW),
    ], "message_id string, raw string, sender_ip string, transport string, received_at timestamp_ntz")
    rows = {r["log_id"]: r for r in ingest.ingest_syslog(messages, senders).collect()}
    assert rows["m1"]["source_id"] == "a" and rows["m1"]["metadata"]["senderIp"] == "1.1.1.1"
    assert rows["m2"]["source_id"] == "unregistered:::ffff:1.1.1.1"
    assert rows["m3"]["source_id"] == "unregistered:9.9.9.9" and rows["m3"]["server_id"] is None
    assert rows["m3"]["metadata"] == {"senderIp": "9.9.9.9", "receivedVia": "syslog-listener"}


def test_stamp_wins(spark):
    df = spark.createDataFrame([({"receivedVia": "forged", "x": "1"},)], "m map<string,string>")
    out = df.select(ingest.stamp_provenance(F.col("m"), {"receivedVia": F.lit("scheduled-pull"), "pullMethod": F.lit(None)}).alias("m")).first()["m"]
    assert out == {"receivedVia": "scheduled-pull", "x": "1"}


def test_frame_lines_against_plain_python(spark):
    rng = random.Random(7)
    rows, expected = [], set()
    for stream in ("hot", "cold", "none"):
        text = ""
        for seq in range(300 if stream == "hot" else 5):
            chunk = "".join(rng.choice(["a", "b", " ", "\n", "\t", ""]) for _ in range(rng.randrange(0, 6)))
            if stream == "none":
                chunk = chunk.replace("\n", "")
            rows.append((stream, seq, chunk))
            text += chunk
        for number, line in enumerate(text.split("\n")[:-1]):
            if line.strip():
                expected.add((stream, number, line.strip()))
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    for size in (16, 1, 1024):
        found = ingest.frame_lines(df, block_size=size).collect()
        assert {(r["stream_id"], r["line_no"], r["line"]) for r in found} == expected and len(found) == len(expected)


def test_framing_shuffles_texts_by_block_once(spark):
    df = spark.createDataFrame([("a", i, "x\ny") for i in range(50)], "stream_id string, seq long, chunk string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ingest.frame_lines(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_block = [line for line in shuffles if re.search(r"hashpartitioning\(stream_id#\d+, block#", line)]
    # One by block (the other branch reuses it), one of the edges by line; lines inside a block move no more.
    assert len(by_block) - plan.count("ReusedExchange [stream_id") <= 1 and len(shuffles) - len(by_block) <= 1


def test_datagrams_are_kept_whole(spark):
    df = spark.createDataFrame([("u", 0, " a\nb ")], "stream_id string, seq long, chunk string")
    assert ingest.frame_datagrams(df).first()["line"] == " a\nb "


def test_http_pages(spark):
    df = spark.createDataFrame([
        ("arr", "application/json", '["x y", {"b": 1, "a": [1, "q"]}, 5, null, true]'), ("obj", "application/json", '{"a": 1}'),
        ("bad", "application/json", "[1, 2"), ("txt", "text/plain", "l1\n\nl2"), ("nil", "application/json", "[]"),
    ], "page_id string, content_type string, body string")
    got = {}
    for r in ingest.explode_http_page(df).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["line"])
    assert got == {"arr": ["x y", '{"b":1,"a":[1,"q"]}', "5", "null", "true"], "obj": ['{"a": 1}'],
                   "bad": ["[1, 2"], "txt": ["l1", "", "l2"]}


def test_pull_plan_reasons(spark):
    def conf(**k):
        return json.dumps(k)
    sources = spark.createDataFrame([
        ("due", conf(pullEnabled=True, serverId="up")), ("text", conf(pullEnabled="true", serverId="up")),
        ("off", conf(pullEnabled=False)), ("none", None), ("noserver", conf(pullEnabled=True)),
        ("gone", conf(pullEnabled=True, serverId="zz")), ("down", conf(pullEnabled=True, serverId="down")),
        ("web", conf(pullEnabled=True, pullMethod="http", httpUrl="http://x", pullIntervalMs=120000)),
        ("nourl", conf(pullEnabled=True, pullMethod="http")), ("ftp", conf(pullEnabled=True, pullMethod="ftp")),
    ], "id string, config string")
    servers = spark.createDataFrame([("up", "active"), ("down", "maintenance")], "id string, status string")
    got = {r["source_id"]: (r["status"], r["skip_reason"], r["interval_ms"]) for r in ingest.pull_plan(sources, servers).collect()}
    assert got == {
        "due": ("due", None, 60000), "noserver": ("skipped", "no server id", 60000), "gone": ("skipped", "server not found", 60000),
        "down": ("skipped", "server is maintenance", 60000), "web": ("due", None, 120000),
        "nourl": ("skipped", "no url", 60000), "ftp": ("skipped", "unknown method", 60000)}


def test_webhooks(spark):
    def frame(body):
        return spark.createDataFrame([("p", json.dumps(body), NOW)], "payload_id string, payload string, received_at timestamp_ntz")
    z = parse.normalize_zabbix(frame({"severity": "High", "subject": "CPU", "message": "load", "host": "h"})).first()
    assert (z["level"], z["message"]) == ("fatal", "[Zabbix] CPU: load")
    rows = parse.normalize_alertmanager(frame({"alerts": [
        {"status": "firing", "startsAt": "2026-02-23T01:00:00Z", "labels": {"alertname": "A"}, "annotations": {"summary": "s", "description": "d"}},
        {"status": "resolved", "labels": {"alertname": "B"}, "annotations": {"summary": "", "description": "d"}}]})).orderBy("pos").collect()
    assert [(r["level"], r["message"]) for r in rows] == [("error", "[Prometheus] A: s"), ("info", "[Prometheus] B: d")]
    assert rows[0]["ts"] == dt.datetime(2026, 2, 23, 1) and rows[1]["ts"] == NOW
    d = parse.normalize_datadog(frame({"level": "warning", "message": "[Datadog] t: m", "metadata": {"source": "x", "tags": "a"}})).first()
    assert d["level"] == "warn" and d["metadata"] == {"source": "datadog", "tags": "a"}


def test_log_table_round_trip_and_day_pruning(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(f"l{i}", "s", "info", "m", dt.datetime(2026, 1, 1 + i % 3, 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "log_id string, source_id string, level string, message string, ts timestamp_ntz")
    sinks.write_logs(df, path)
    back = spark.read.parquet(path)
    assert sorted(r["log_id"] for r in back.collect()) == sorted(r[0] for r in rows)
    day = within(back, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 2, 23))
    assert day.count() == 10
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
